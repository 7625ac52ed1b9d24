"""Functions paired with their documentation.

One recursive pattern captures the doc comment, the signature and the balanced body of a function together; strings,
template literals and comments are passed over as wholes, so that braces inside of them do not count. A second step
drops pairs whose documentation says nothing of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.ids import symbol_id

_PARTS = r"""
(?(DEFINE)
  (?P<text>"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\$]++|\\.|\$(?!\{)|\$(?&braces))*+`)
  (?P<note>/\*[\s\S]*?\*/|//[^\n]*+)
  (?P<braces>\{(?:(?&text)|(?&note)|(?&braces)|[^{}"'`/]++|/(?![/*]))*+\})
  (?P<parens>\((?:(?&text)|(?&note)|(?&parens)|[^()"'`/]++|/(?![/*]))*+\))
)
"""

_FUNCTION = regex.compile(
    _PARTS
    + r"""
(?:(?P<doc>/\*\*(?!/)[\s\S]*?\*/)\s*+(?:(?:/\*(?!\*)[\s\S]*?\*/|//[^\n]*+\n)\s*+)*+)?+
(?P<signature>
  (?:@[\w.$]++(?&parens)?+\s*+)*+
  (?:(?:export|default|declare|public|private|protected|static|abstract|override|readonly|async|function|(?:get|set)(?=\s++[\w$#\[]))\b\s*+)*+
  \*?\s*+
  (?:
    (?:const|let|var)\s++[\w$]++\s*+(?::[^=;{}]++)?=\s*+(?:async\b\s*+)?(?:<(?:[^<>(){};]|<[^<>]*+>)*+>\s*+)?(?:(?&parens)|[\w$]++)\s*+(?::(?:[^={}();]|(?&parens)|(?&braces))++)?=>
  |
    (?!(?:if|for|while|switch|catch|return|new|with|super|throw|typeof|await|else|do)\b)(?<![\w$#.])[#\w$]++\s*+(?:<(?:[^<>(){};]|<[^<>]*+>)*+>\s*+)?(?&parens)
    (?:\s*+:\s*+(?:(?&text)|(?&parens)|[^{}"'`();]|\{(?=[^{}]*+\}\s*+(?:\[\]\s*+|>\s*+|\|\s*+)*+[{;])[^{}]*+\})*+)?
  )
)\s*+
(?P<body>(?&braces)|(?<==>\s*+)[^;{}]++;?)
""",
    regex.VERBOSE,
)

#: what stands for a function that is declared only, or cut off: all of its code
_DECLARED = regex.compile(r"(?:(?P<doc>/\*\*(?!/)[\s\S]*?\*/))?+(?:\s|/\*[\s\S]*?\*/|//[^\n]*(?:\n|\Z))*+(?P<signature>\S[\s\S]*)(?P<body>)")
_BRACKET = regex.compile(_PARTS + r"(?&text)|(?&note)|[(){}]", regex.VERBOSE)
_OTHER_END = {"(": ")", "{": "}"}
_LEADING = regex.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*(?:\n|\Z))*+")
_MARKS = regex.compile(r"[\s/*]+")

#: at the start of a line, or after a sentence where the lines were joined
_BLOCK_TAG = regex.compile(r"(?:^|(?<=[.!?:;)}]\s))@[A-Za-z][\w-]*")
_INHERIT = regex.compile(r"\{?@inherit-?doc\b[^}\n]*\}?", regex.IGNORECASE)
_WORK = regex.compile(r"(?:\b(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b|(?<![\p{L}\p{N}])(?:todo|fixme|to do|hack|xxx|tbd|wip)\s*(?=:|$|\())[^\n]*", regex.MULTILINE)
_WORK_START = regex.compile(r"^(?:to do|todo|fixme|tbd|wip|hack|xxx)\b\s*[.:!-]*\s*$", regex.IGNORECASE)
#: fixed values: marks that linters, formatters, coverage tools and compilers read
_DIRECTIVE = regex.compile(
    r"(?:^|(?<=[.!?]\s))(?:eslint(?:-[\w-]+)?|tslint:[\w-]+|prettier-ignore(?:-\w+)?|istanbul ignore|c8 ignore|v8 ignore|biome-ignore|deno-lint-ignore(?:-file)?"
    r"|@ts-(?:ignore|expect-error|nocheck|check)|ts-(?:ignore|expect-error|nocheck)|jshint\b|jslint\b|stylelint-[\w-]+|noinspection|webpack\w+:|#?region|#?endregion|sourceMappingURL=|@?vite-ignore|global\s+\w+\s*:|NOSONAR|oxlint-[\w-]+|cspell:[\w-]+)(?![\p{L}])[^\n]*",
    regex.MULTILINE,
)
_CODE_END = regex.compile(r"(?:[;{}]|=>)\s*$|^\s*[\w$.]+\((?:[^()]|\([^()]*\))*\)\s*$")
_CODE_START = regex.compile(r"^(?:(?:const|let|var|return|import|export|throw|await|yield|delete|else|case|this\.[\w.]+|[\w$.]+\s*[-+*/]?=)(?![\p{L}]).*[=(){};.]|(?:if|for|while|switch|catch)\s*\(.*\)|[}\])]+\s*[;,]?$)")
_WORD = regex.compile(r"[\p{L}\p{N}_$]+(?:['’]\p{L}+)*")
_CAMEL = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lo}+|\p{N}+")


def name_words(name: str | None) -> set[str]:
    """The words of a camel- or snake-cased name in lower case, and the name itself, each also with an added s."""
    words = {w.lower() for w in _CAMEL.findall(name or "")}
    if name:
        words.add(name.lower())
    return words | {w + "s" for w in words}


def own_words(comment: str | None, name: str | None) -> list[str]:
    """The words of a comment that say something the name does not.

    Left out are comment marks and rules, everything from the first block tag on, inherit tags, notes of work to be
    done and directives to tools (both to the end of the line), disabled code, and the words of the name.
    """
    text = _INHERIT.sub(" ", (comment or "").replace("\r\n", "\n").replace("\r", "\n"))
    text = regex.sub(r"\*+/", "\n", regex.sub(r"/\*+", "\n", text))
    lines = []
    for line in regex.split(r"\n|(?<=[\s])\*(?=\s)", text):
        line = regex.sub(r"^[\s*]*(?://+)?[\s*]*", "", line).strip()
        tag = _BLOCK_TAG.search(line)
        directive = _DIRECTIVE.search(line)
        if tag and not (directive and directive.start() <= tag.start()):
            lines.append(line[: tag.start()])
            break
        lines.append(line)
    known = name_words(name)
    words = []
    for line in lines:
        line = _DIRECTIVE.sub(" ", line)
        line = "" if _WORK_START.match(line.strip()) else _WORK.sub(" ", line)
        line = line.strip()
        if not line or _CODE_END.search(line) or _CODE_START.search(line):
            continue
        for word in _WORD.findall(line):
            parts = [p.lower() for p in _CAMEL.findall(word)]
            if word.lower() not in known and not (parts and all(p in known for p in parts)):
                words.append(word)
    return words


def is_trivial(comment: str | None, name: str | None, least: int = 3) -> bool:
    return len(own_words(comment, name)) < least


def _balanced(text: str) -> str:
    """``text`` with every bracket that has no partner as a blank, so that no search runs to its end in vain."""
    stack: list[tuple[str, int]] = []
    lost: list[int] = []
    for token in _BRACKET.finditer(text):
        mark = token.group()
        if mark in _OTHER_END:
            stack.append((_OTHER_END[mark], token.start()))
        elif mark in (")", "}"):
            if not any(wanted == mark for wanted, _ in stack[-2:]):
                lost.append(token.start())
                continue
            while stack[-1][0] != mark:
                lost.append(stack.pop()[1])
            stack.pop()
    lost += [at for _, at in stack]
    if not lost:
        return text
    marks = list(text)
    for at in lost:
        marks[at] = " "
    return "".join(marks)


def functions_in(source: str | None) -> list[dict]:
    """Every function or method of a source text: doc (or None), signature and body, in order, nested ones included."""
    found, at, text = [], 0, _balanced(source or "")
    while match := _FUNCTION.search(text, at):
        found.append({"doc": match["doc"], "signature": match["signature"].strip(), "body": match["body"].strip()})
        at = match.start("body") + 1
    return found


def _as_comment(documentation: str) -> str:
    """The text of a documentation column as the doc comment it was taken from."""
    text = documentation.strip()
    inner = text[3:-2] if text.startswith("/**") and text.endswith("*/") and len(text) > 4 else text
    return "/**\n" + inner.replace("*/", "* /") + "\n*/"


def pair(name: str | None, documentation: str | None, source: str | None) -> tuple | None:
    """(documentation, signature, body) of one function, or None where code or telling documentation is missing.

    The three are captured together from the text of the function below its doc comment. That comment is
    ``documentation`` unless nothing but comment marks is left of it; then it is the one at the head of ``source``.
    Code is what stands in ``source`` beyond leading comments; a function without a balanced body (declared only, or
    cut off) has all of it as signature.
    """
    text = (source or "").strip()
    told = bool(_MARKS.sub("", documentation or ""))
    if told:
        text = _as_comment(documentation) + "\n" + text[_LEADING.match(text).end() :]
    # a layout that breaks a string over lines is mended by the second try
    match = _FUNCTION.match(text) or _FUNCTION.match(" ".join(text.split())) or _DECLARED.match(text)
    if not match or is_trivial(match["doc"], name):
        return None
    return documentation if told else match["doc"], match["signature"].strip(), match["body"].strip() or None


def newest_snapshots(commits: DataFrame) -> DataFrame:
    """repositoryCommit of the newest snapshot of each repository, by snapshotNo."""
    order = Window.partitionBy("repository").orderBy(F.desc("snapshotNo"), F.desc("repositoryCommit"))
    known = commits.select("repositoryCommit", "repository", "snapshotNo").dropna()
    return known.withColumn("n", F.row_number().over(order)).filter("n = 1").select("repositoryCommit")


def documented_functions(symbols: DataFrame, commits: DataFrame) -> DataFrame:
    """Pairs of the newest snapshots: repositoryCommit, symbolId, documentation, signature, body.

    Kept are symbols of kind function or method with code and documentation that is not trivial; rows without a
    symbolId are left out, repeated rows come out once, a null name has no words. ``body`` is null where no
    balanced body stands. Empty tables give no rows.
    """
    rows = symbols.select("repositoryCommit", symbol_id(F.col("symbolId")).alias("symbolId"), "kind", "name", "documentation", "normalizedSource")
    rows = rows.filter(F.col("kind").isin("function", "method") & F.col("symbolId").isNotNull())
    rows = rows.join(newest_snapshots(commits), "repositoryCommit", "left_semi").drop("kind").distinct()
    schema = T.StructType([rows.schema["repositoryCommit"], rows.schema["symbolId"], *[T.StructField(c, T.StringType()) for c in ("documentation", "signature", "body")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                found = pair(row.name, row.documentation, row.normalizedSource)
                if found:
                    out.append((row.repositoryCommit, row.symbolId, *found))
            yield pd.DataFrame(out, columns=schema.names)

    pairs = rows.mapInPandas(run, schema)
    # a symbol that is listed with several texts comes out once, with the last of them
    image = F.max(F.struct("documentation", "signature", "body")).alias("p")
    return pairs.groupBy("repositoryCommit", "symbolId").agg(image).select("repositoryCommit", "symbolId", "p.*")


_NAME = regex.compile(r"(?:const|let|var)\s+([\w$]+)|([#\w$]+)\s*(?:<|\()")


def documented_in_files(files: DataFrame) -> DataFrame:
    """Pairs of whole source files (doc_id, text): doc_id, place (of the function in its file, from 1), name, documentation, signature, body.

    Functions without a doc comment or with a trivial one are dropped; null, empty and blank files give no rows.
    """
    schema = T.StructType([files.schema["doc_id"], T.StructField("place", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("name", "documentation", "signature", "body")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for place, f in enumerate(functions_in(text), 1):
                    named = _NAME.search(f["signature"])
                    name = named and (named[1] or named[2])
                    if f["doc"] and not is_trivial(f["doc"], name):
                        out.append((doc_id, place, name, f["doc"], f["signature"], f["body"]))
            yield pd.DataFrame(out, columns=schema.names)

    return files.select("doc_id", "text").filter(F.col("text").isNotNull()).mapInPandas(run, schema)
