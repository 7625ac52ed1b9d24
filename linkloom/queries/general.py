"""Queries of the general data-processing problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.operators import change_feed, references, snapshots


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_feed.current_links(table(spark, sf_dir, "decisions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("retrieval", "labeled_links", "stored_links", "commits", "symbol_index")
    return references.orphan_symbols(*[table(spark, sf_dir, n) for n in names])


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(p2_found(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, sf_dir, "symbol_index"), table(spark, sf_dir, "commits"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"


def _symbol(column: str) -> str:
    return f"nullif(replace(trim({column}, {_BLANKS}), chr(92), '/'), '')"


def _requirement(column: str) -> str:
    return f"nullif(upper(trim({column}, {_BLANKS})), '')"


def _canonical(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '\\s+', ' ', 'g'))"


_P1 = f"""
WITH read AS (
  SELECT {_requirement("requirementId")} AS requirementId, {_symbol("proposedSymbolId")} AS proposedSymbolId,
         {_symbol("symbolId")} AS symbolId, seq, lower(trim(kind, {_BLANKS})) AS kind,
         regexp_extract(timestamp, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})[Tt ](\\d{{2}}:\\d{{2}}(?::\\d{{2}}(?:\\.\\d+)?)?)\\s*([Zz]|[+-]\\d{{2}}:?\\d{{2}})?\\s*$', ['d', 't', 'z']) AS p
  FROM decisions),
timed AS (
  SELECT *, epoch_us(try_cast(p.d || ' ' || p.t AS TIMESTAMP))
    - CASE WHEN p.z IN ('', 'Z', 'z') THEN 0 ELSE (CASE WHEN p.z[1] = '-' THEN -1 ELSE 1 END)
      * (CAST(p.z[2:3] AS BIGINT) * 60 + CAST(right(p.z, 2) AS BIGINT)) * 60000000 END AS moment
  FROM read),
last AS (
  SELECT *, row_number() OVER (PARTITION BY requirementId, proposedSymbolId ORDER BY moment DESC, seq DESC) AS n
  FROM timed WHERE requirementId IS NOT NULL AND proposedSymbolId IS NOT NULL AND moment IS NOT NULL
    AND kind IN ('accept', 'redirect', 'reject'))
SELECT requirementId, proposedSymbolId, symbolId, seq FROM last WHERE n = 1 AND kind <> 'reject'
"""

_P2 = f"""
WITH refs AS (
  SELECT 'retrieval' AS tbl, {_requirement("requirementId")} AS requirementId, {_symbol("c.symbolId")} AS symbolId, repositoryCommit AS k
  FROM (SELECT requirementId, repositoryCommit, unnest(candidates) AS c FROM retrieval)
  UNION ALL SELECT 'labeled_links', {_requirement("requirementId")}, {_symbol("symbolId")}, repositoryCommit FROM labeled_links
  UNION ALL SELECT 'stored_links', {_requirement("requirementId")}, {_symbol("symbolId")}, "commit" FROM stored_links)
SELECT DISTINCT tbl, strftime(committedAt, '%Y-%m') AS period, requirementId, symbolId
FROM refs JOIN commits ON k = repositoryCommit
WHERE requirementId IS NOT NULL AND symbolId IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM symbol_index s WHERE s.repositoryCommit = k AND {_symbol("s.symbolId")} = refs.symbolId)
"""

#: every list with the place of each of its symbols, and the best score
RANKED_LISTS = f"""
WITH entries AS (
  SELECT {_requirement("requirementId")} AS requirementId, configurationId, repositoryCommit, c.rank AS r, c.score AS s, {_symbol("c.symbolId")} AS symbolId
  FROM (SELECT requirementId, configurationId, repositoryCommit, unnest(candidates) AS c FROM retrieval)),
once AS (
  SELECT requirementId, configurationId, repositoryCommit, symbolId, max(s) AS score, arg_min(coalesce(r, 2147483648), (-s, coalesce(r, 2147483648))) AS r
  FROM entries WHERE requirementId IS NOT NULL AND configurationId IS NOT NULL AND repositoryCommit IS NOT NULL
    AND symbolId IS NOT NULL AND s IS NOT NULL AND isfinite(s) GROUP BY ALL)
SELECT requirementId, configurationId, repositoryCommit, symbolId, score,
  CAST(row_number() OVER (PARTITION BY requirementId, configurationId, repositoryCommit ORDER BY score DESC, r, symbolId) AS INTEGER) AS place FROM once
"""

_P4 = f"""
WITH pairs AS (
  SELECT repositoryCommit, lag(repositoryCommit) OVER w AS earlier, lead(repositoryCommit) OVER w AS later
  FROM commits WINDOW w AS (PARTITION BY repository ORDER BY snapshotNo)),
r AS (
  SELECT DISTINCT repositoryCommit, earlier, later, {_symbol("symbolId")} AS symbolId, {_canonical("signature")} AS a, {_canonical("normalizedSource")} AS b
  FROM symbol_index JOIN pairs USING (repositoryCommit) WHERE {_symbol("symbolId")} IS NOT NULL),
o AS (SELECT later AS k, symbolId, a, b FROM r WHERE later IS NOT NULL),
n AS (SELECT repositoryCommit AS k, symbolId, a, b FROM r WHERE earlier IS NOT NULL)
SELECT coalesce(o.k, n.k) AS repositoryCommit, coalesce(o.symbolId, n.symbolId) AS symbolId,
  CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.k = n.k AND o.symbolId = n.symbolId
WHERE o.k IS NULL OR n.k IS NULL OR o.a <> n.a OR o.b <> n.b
"""

SQL = {
    "p1_found": _P1, "p2_found": _P2, "p4_found": _P4,
    "p2_report": f"SELECT tbl, period, count(*) AS orphans FROM ({_P2}) GROUP BY tbl, period",
}
