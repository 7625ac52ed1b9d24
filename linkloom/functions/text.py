"""Text as column expressions: tokens, plural folding, sections, clipping, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.ids import outer_trim


# all but letters and digits; the places before a capital that follows a small letter or digit, or begins the word after capitals
BREAKS = r"[^\p{L}\p{N}]+|(?=[A-Z])(?:(?<=[a-z0-9])|(?<=[A-Z])(?=.[a-z]))"


def words(value: Column) -> Column:
    """The tokens of ``value`` with a blank between them, and maybe one at either end."""
    return F.lower(F.regexp_replace(value, BREAKS, " "))


def tokens(value: Column) -> Column:
    """Words of identifiers and prose in lower case: paths, snake, kebab and camel case are split. Null gives none."""
    return F.coalesce(F.filter(F.split(words(value), " "), lambda t: t != ""), F.array().cast("array<string>"))


def fold_plural(term: Column, revision: int = 2) -> Column:
    """A light s-stemmer; revision 1 keeps words of three letters and strips -ses as a whole."""
    long_enough = F.length(term) > (3 if revision == 1 else 2)
    double = r"(ches|shes|xes|zes|ses)$" if revision == 1 else r"(ches|shes|xes|zes|sses)$"
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    folded = (
        F.when(term.endswith("ies") & (F.length(term) > 4), F.concat(cut(3), F.lit("y")))
        .when(term.rlike(r"(ss|us|is)$"), term)
        .when(term.rlike(double), cut(2))
        .when(term.endswith("s"), cut(1))
        .otherwise(term)
    )
    return F.when(long_enough, folded).otherwise(term)


def folded(term: str, revision: int = 2) -> str:
    """:func:`fold_plural` of one word without line ends."""
    if len(term) <= (3 if revision == 1 else 2):
        return term
    if term.endswith("ies") and len(term) > 4:
        return term[:-3] + "y"
    if term.endswith(("ss", "us", "is")):
        return term
    if term.endswith(("ches", "shes", "xes", "zes", "ses" if revision == 1 else "sses")):
        return term[:-2]
    return term.removesuffix("s")


def terms(value: Column, stopwords: Column | None = None, fold: bool = True, revision: int = 2) -> Column:
    """Tokens without ``stopwords`` (an array), plurals folded after the filter."""
    found = tokens(value)
    if stopwords is not None:
        found = F.filter(found, lambda t: ~F.array_contains(stopwords, t))
    return F.transform(found, lambda t: fold_plural(t, revision)) if fold else found


def clip(value: Column, limit: int) -> Column:
    """At most ``limit`` characters, an ellipsis after what was cut; null as empty."""
    text = F.coalesce(value, F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("…")))


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def non_empty(value: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    text = outer_trim(value)
    return F.when(text != "", text)


def section(body: Column, heading: str) -> Column:
    """The text under ``## heading`` up to the next heading, null where it is missing or blank."""
    return non_empty(F.regexp_extract(body, rf"(?im)^##[ \t]+{heading}[ \t]*$([\s\S]*?)(?=^#{{1,6}}\s|(?![\s\S]))", 1))


def list_items(text: Column) -> Column:
    """The items of ``-`` and ``*`` lists, trimmed, blank ones left out."""
    items = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*[-*][ \t]+(.*)$"), 1), non_empty)
    return F.coalesce(F.filter(items, lambda i: i.isNotNull()), F.array().cast("array<string>"))


def wiki_links(text: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|label]]``, embeds left out, in order of their places."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!!)\[\[([^\]\n|]+)(?:\|[^\]\n]*)?\]\]"), 1)
    return F.filter(F.transform(found, lambda t: outer_trim(t)), lambda t: t != "")


def strip_fence(text: Column) -> Column:
    """The inside of a Markdown code fence, or the trimmed text where it opens with none."""
    trimmed = outer_trim(text)
    opened = F.regexp_replace(trimmed, r"^```[A-Za-z0-9_-]*\s*\n?", "")
    return F.when(trimmed.startswith("```"), outer_trim(F.regexp_replace(opened, r"```(?![\s\S]*```)[\s\S]*$", ""))).otherwise(trimmed)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def requirement_text(title: Column, statement: Column, criteria: Column) -> Column:
    """Title, statement and acceptance criteria joined by blanks; null parts as empty."""
    parts = F.array_join(F.coalesce(criteria, F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(statement, F.lit("")), F.when(parts != "", parts))
