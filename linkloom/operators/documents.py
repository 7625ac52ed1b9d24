"""Requirement documents: frontmatter, validation and wiki links.

Splitting and section lookup are column expressions; only YAML itself is read by Python, a batch of documents at a
time.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.config import DEFAULT_PRIORITY, PRIORITIES, STATUSES
from linkloom.functions import text
from linkloom.sources.frontmatter import read_mapping

_FRONT = r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n([\s\S]*))?$"


def split_frontmatter(documents: DataFrame, column: str) -> DataFrame:
    """``documents`` with front and body; both null where a text does not open with a closed ``---`` block."""
    found = F.col(column).rlike(_FRONT)
    return documents.withColumn("front", F.when(found, F.regexp_extract(column, _FRONT, 1))).withColumn("body", F.when(found, F.regexp_extract(column, _FRONT, 2)))


@F.pandas_udf(T.StringType())
def _to_json(front: pd.Series) -> pd.Series:
    def one(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            mapping = read_mapping(value)
        except ValueError:
            return None
        return json.dumps(mapping, default=str, ensure_ascii=False) if isinstance(mapping, dict) else None

    return front.map(one)


def parse_documents(documents: DataFrame) -> DataFrame:
    """Requirement documents (path, content) as columns, with ``violations`` and ``warnings`` (arrays of rule:field).

    Columns: path, id, title, status, priority, statement, rationale, criteria, links, extra (VARIANT, all keys of the
    frontmatter), valid. Frontmatter wins over body sections. Rules: malformed-frontmatter (missing, not closed or no
    YAML mapping; nothing else is looked at then), missing-field, no-acceptance-criteria, malformed-links;
    unknown-status and unknown-priority are warnings.
    """
    rows = split_frontmatter(documents.select(F.translate("path", "\\", "/").alias("path"), "content"), "content")
    rows = rows.withColumn("json", _to_json("front")).withColumn("v", F.try_parse_json("json"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    is_text = lambda name: F.coalesce(F.schema_of_variant(get(name, "variant")), F.lit("")) == "STRING"
    value = lambda name: text.non_empty(F.when(is_text(name), get(name, "string")))
    section = lambda heading: text.section(F.coalesce("body", F.lit("")), heading)
    empty = F.array().cast("array<string>")
    listed = F.filter(F.transform(get("acceptance_criteria", "array<string>"), text.non_empty), lambda c: c.isNotNull())
    criteria = F.coalesce(listed, text.list_items(section("Acceptance criteria")), empty)
    raw_links = get("links", "array<struct<symbol:string,reviewer:string,timestamp:string,commit:string>>")
    whole = lambda e: F.forall(F.array(e["symbol"], e["reviewer"], e["timestamp"], e["commit"]), lambda x: text.non_empty(x).isNotNull())
    has_links = F.coalesce(F.schema_of_variant(get("links", "variant")), F.lit("VOID")) != "VOID"
    ok = F.col("v").isNotNull()
    note = lambda cond, what: F.when(cond, F.lit(what))
    out = rows.select(
        "path", value("id").alias("id"), value("title").alias("title"), value("status").alias("status"), F.coalesce(value("priority"), F.lit(DEFAULT_PRIORITY)).alias("priority"),
        F.coalesce(value("statement"), section("Statement")).alias("statement"), F.coalesce(value("rationale"), section("Rationale")).alias("rationale"), criteria.alias("criteria"),
        F.coalesce(F.filter(raw_links, whole), F.array().cast("array<struct<symbol:string,reviewer:string,timestamp:string,commit:string>>")).alias("links"),
        F.col("v").alias("extra"), ok.alias("ok"), (has_links & raw_links.isNull()).alias("no_list"), F.coalesce(F.exists(raw_links, lambda e: ~whole(e)), F.lit(False)).alias("bad_entry"),
    )
    checks = [note(F.col(c).isNull(), f"missing-field:{c}") for c in ("id", "title", "status")]
    checks += [note(F.size("criteria") == 0, "no-acceptance-criteria"), note(F.coalesce("no_list", F.lit(False)) | F.col("bad_entry"), "malformed-links:links")]
    warned = [note(~F.col("status").isin(*STATUSES), "unknown-status:status"), note(~F.col("priority").isin(*PRIORITIES), "unknown-priority:priority")]
    out = out.withColumn("violations", F.when(~F.col("ok"), F.array(F.lit("malformed-frontmatter"))).otherwise(F.array_compact(F.array(*checks))))
    out = out.withColumn("warnings", F.when(~F.col("ok"), empty).otherwise(F.array_compact(F.array(*warned))))
    return out.withColumn("valid", F.col("ok") & F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("status").isNotNull()).drop("ok", "no_list", "bad_entry")


def shared_ids(documents: DataFrame) -> DataFrame:
    """id, path and n of every document (id, path) whose id n rows share, one row for each distinct path.

    Rows without an id are left out; a null path stays null. An id is counted before its paths are joined to it, so no
    list of paths is made, however many documents share it.
    """
    rows = documents.select("id", "path").filter(F.col("id").isNotNull())
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.distinct().join(twice, "id").select("id", "path", "n")


def duplicate_documents(parsed: DataFrame) -> DataFrame:
    """path, id and n (documents that use it) of valid documents with a shared id."""
    return shared_ids(parsed.filter("valid").select("id", "path")).select("path", "id", "n")


def validation_report(parsed: DataFrame) -> DataFrame:
    """All findings: path, id, rule, field, level (violation or warning); duplicate ids included."""
    found = [parsed.select("path", "id", F.explode(c).alias("f"), F.lit(level).alias("level")) for c, level in (("violations", "violation"), ("warnings", "warning"))]
    twice = duplicate_documents(parsed).select("path", "id", F.lit("duplicate-id:id").alias("f"), F.lit("violation").alias("level"))
    part = lambda i: F.get(F.split("f", ":"), i)
    return found[0].unionByName(found[1]).unionByName(twice).select("path", "id", part(F.lit(0)).alias("rule"), part(F.lit(1)).alias("field"), "level")


def strict_requirements(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requirements with a difficulty, once for each id (the first path wins), and the rejected: path, id, rule.

    Rules: invalid-document, missing-difficulty, duplicate-id.
    """
    difficulty = text.non_empty(F.try_variant_get("extra", "$.difficulty", "string"))
    rows = parsed.withColumn("difficulty", difficulty)
    fit = F.col("valid") & F.col("difficulty").isNotNull()
    turn = F.row_number().over(Window.partitionBy("id", fit).orderBy("path"))
    judged = rows.withColumn("rule", F.when(~F.col("valid"), "invalid-document").when(F.col("difficulty").isNull(), "missing-difficulty").when(turn > 1, "duplicate-id"))
    return judged.filter("rule is null").drop("rule"), judged.filter("rule is not null").select("path", "id", "rule")


def _with_links(content: str, links: list) -> str:
    """``content`` with its ``links`` key replaced by ``links`` (dropped where there are none)."""
    newline = "\r\n" if "\r\n" in content else "\n"
    lines = content.replace("\r\n", "\n").split("\n")
    end = lines.index("---", 1)
    kept, inside = [], False
    for line in lines[1:end]:
        if inside and (line.startswith((" ", "\t", "-")) or not line.strip()):
            continue
        inside = line.split(":")[0].strip() == "links" and not line.startswith((" ", "\t"))
        if not inside:
            kept.append(line)
    block = ["links:"] if links else []
    for link in links:
        for i, name in enumerate(("symbol", "reviewer", "timestamp", "commit")):
            block.append(("  - " if i == 0 else "    ") + f"{name}: {json.dumps(link[name], ensure_ascii=False)}")
    return newline.join(["---", *kept, *block, *lines[end:]])


def write_links(documents: DataFrame, links: DataFrame) -> DataFrame:
    """The documents (path, content) whose links differ from ``links``, with their new contents.

    ``links`` has id, symbol, reviewer, timestamp and commit and replaces what the documents record; it is written
    sorted by symbol, nulls as empty. Documents without an id or frontmatter stay as they are.
    """
    empty = F.lit("")
    part = F.struct(*[F.coalesce(c, empty).alias(c) for c in ("symbol", "reviewer", "timestamp", "commit")])
    wanted = links.filter("id is not null and symbol is not null").groupBy("id").agg(F.array_sort(F.collect_set(part)).alias("wanted"))
    now = parse_documents(documents).filter("valid").select("path", "id", F.array_sort("links").alias("now"))
    nothing = F.array().cast("array<struct<symbol:string,reviewer:string,timestamp:string,commit:string>>")
    changed = now.join(wanted, "id", "left").withColumn("wanted", F.coalesce("wanted", nothing)).filter("not (now <=> wanted)")
    rows = documents.withColumn("path", F.translate("path", "\\", "/")).join(changed.select("path", "wanted"), "path")

    @F.pandas_udf(T.StringType())
    def rewritten(content: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([_with_links(c, list(w)) for c, w in zip(content, wanted)])

    return rows.select("path", rewritten("content", "wanted").alias("content"))


def resolve_wiki_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, target, path: where a wiki link leads, null for nowhere.

    ``documents`` has path and requirementId. Tiers: the path itself (with or without .md), the file name, the
    requirement id; the first tier that matches holds, and in it the first path.
    """
    stem = F.regexp_replace("path", r"\.md$", "")
    names: list[tuple[int, Column]] = [(1, F.col("path")), (1, stem), (2, F.element_at(F.split(stem, "/"), -1)), (3, F.col("requirementId"))]
    keyed = documents.select("path", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), n.alias("target")) for t, n in names])).alias("k")).select("path", "k.*")
    first = keyed.filter("target is not null").groupBy("target").agg(F.min(F.struct("tier", "path")).alias("hit"))
    return links.join(first, "target", "left").select("doc", "target", F.col("hit.path").alias("path"))


def next_requirement_id(requirements: DataFrame, prefix: str) -> str:
    """The id after the greatest ``prefix``-number in use, padded to the width in use (three digits at least)."""
    found = F.regexp_extract("id", rf"^{prefix}-(\d+)$", 1)
    row = requirements.select(found.alias("n")).filter("n <> ''").agg(F.max(F.col("n").cast("bigint")).alias("top"), F.max(F.length("n")).alias("width")).first()
    return f"{prefix}-{(row['top'] or 0) + 1:0{max(3, row['width'] or 0)}d}"
