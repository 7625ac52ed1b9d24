"""Queries of the problems of this package; only the top-N query can be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import mix, pairs, residue, tokens, topn
from linkloom.queries.general import _requirement, _symbol
from linkloom.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_candidates(_table(spark, sf_dir, "retrieval"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("repositoryCommit", "symbolId")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.documented_functions(_table(spark, sf_dir, "symbol_index"), _table(spark, sf_dir, "commits"))


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the documents that are source files."""
    return pairs.documented_in_files(spread(_table(spark, sf_dir, "documents").filter("source = 'source-code'")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(spread(_table(spark, sf_dir, "documents")))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.Mix(spread(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "mix_targets")).uses().select("doc_id", "uses")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.Mix(spread(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "mix_targets")).report()


def p7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.Mix(spread(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "mix_targets")).order()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(spread(_table(spark, sf_dir, "documents")))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_report(spread(_table(spark, sf_dir, "documents")))


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_pairs": p5_pairs, "p5_files": p5_files, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_report": p7_report, "p7_order": p7_order, "p8_found": p8_found, "p8_report": p8_report}
_P3 = f"""
WITH items AS (
  SELECT {_requirement("requirementId")} AS requirementId, configurationId, repositoryCommit, c.rank AS r, c.score AS s, {_symbol("c.symbolId")} AS symbolId
  FROM (SELECT requirementId, configurationId, repositoryCommit, unnest(candidates) AS c FROM retrieval)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY requirementId, configurationId, repositoryCommit, symbolId ORDER BY s DESC, r ASC NULLS LAST) AS n
  FROM items WHERE requirementId IS NOT NULL AND configurationId IS NOT NULL AND repositoryCommit IS NOT NULL
    AND symbolId IS NOT NULL AND s IS NOT NULL AND isfinite(s)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY requirementId, configurationId, repositoryCommit ORDER BY s DESC, r ASC NULLS LAST, symbolId) AS place
  FROM best WHERE n = 1)
SELECT requirementId, configurationId, repositoryCommit, CAST(place AS INTEGER) AS place, symbolId FROM placed WHERE place <= 5
"""

SQL: dict[str, str] = {"p3_found": _P3}
