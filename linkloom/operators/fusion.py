"""Merging two rankings. Contributions are united and summed, which equals a full outer join with absence as zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool_size(k: int) -> int:
    """Candidates to take from each ranking before a merge that keeps ``k``."""
    return 2 * k


def _merge(parts: DataFrame, list_keys: list[str], k: int) -> DataFrame:
    merged = parts.groupBy(*list_keys, "item").agg(F.round(F.sum("part"), 12).alias("score"))
    best = Window.partitionBy(*list_keys).orderBy(F.desc("score"), "item")
    return merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*list_keys, "rank", "item", "score")


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, list_keys: list[str], k: int = 10, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank); inputs have the list's keys, item and rank, each item once in a list."""
    parts = [df.select(*list_keys, "item", (F.lit(1.0) / (constant + F.col("rank"))).alias("part")) for df in (first, second)]
    return _merge(parts[0].unionByName(parts[1]), list_keys, k)


def min_max(df: DataFrame, list_keys: list[str]) -> DataFrame:
    """Scores of each list scaled to 0 … 1; a list of equal scores gets 1."""
    w = Window.partitionBy(*list_keys)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("scaled", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def weighted_fusion(first: DataFrame, second: DataFrame, list_keys: list[str], k: int = 10, alpha: float = 0.5) -> DataFrame:
    """alpha times the scaled score of the first and the rest times that of the second ranking."""
    parts = [min_max(df, list_keys).select(*list_keys, "item", (F.col("scaled") * w).alias("part")) for df, w in ((first, alpha), (second, 1 - alpha))]
    return _merge(parts[0].unionByName(parts[1]), list_keys, k)


def fusion_id(first: str, second: str, strategy: str, parameter: float) -> str:
    return f"hybrid({strategy};{'k' if strategy == 'rrf-v1' else 'a'}={parameter:g})[{first}+{second}]"
