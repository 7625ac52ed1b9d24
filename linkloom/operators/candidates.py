"""Candidate lists of retrieval runs: their pieces, entries, first places and the places of single symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.ids import requirement_id, symbol_id
from linkloom.session import materialize

#: what names a list
LIST = ["requirementId", "configurationId", "repositoryCommit"]


def named_lists(retrieval: DataFrame) -> DataFrame:
    """The pieces of lists whose name is whole (LIST, candidates); empty pieces are left out."""
    lists = retrieval.select(requirement_id(F.col("requirementId")).alias("requirementId"), "configurationId", "repositoryCommit", "candidates")
    return lists.filter(F.col("requirementId").isNotNull() & F.col("configurationId").isNotNull() & F.col("repositoryCommit").isNotNull() & (F.size("candidates") > 0))


def scored_entries(lists: DataFrame, kept: list[str]) -> DataFrame:
    """``kept``, rank, symbolId and score of every entry with a symbol and a finite score."""
    rows = lists.select(*kept, F.explode("candidates").alias("c"))
    rows = rows.select(*kept, F.col("c.rank").alias("rank"), symbol_id(F.col("c.symbolId")).alias("symbolId"), F.col("c.score").alias("score"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    # -0.0 and 0.0 are one score
    return rows.filter(F.col("symbolId").isNotNull() & finite).withColumn("score", F.col("score") + F.lit(0.0))


def _best_entries(lists: DataFrame) -> DataFrame:
    """One row per list and symbol: order, a struct that ascends from the best entry on."""
    order = F.struct(-F.col("score"), F.coalesce(F.col("rank").cast("bigint"), F.lit(1 << 31)), F.col("symbolId"))
    return scored_entries(lists, LIST).groupBy(*LIST, "symbolId").agg(F.min(order).alias("order"))


def first_places(retrieval: DataFrame, n: int) -> DataFrame:
    """The ``n`` best distinct symbols of each list: LIST, place, symbolId, score (of the best entry).

    Order: higher score, lower rank (null last), symbolId. Entries are reduced by (list, symbol) first, which spreads
    a large list over all tasks; each task then passes no more than ``n`` rows of a list on.
    """
    w = Window.partitionBy(*LIST).orderBy("order")
    placed = _best_entries(named_lists(retrieval)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return placed.select(*LIST, "place", "symbolId", (-F.col("order.col1")).alias("score"))


def whole_places(retrieval: DataFrame, wanted: DataFrame) -> DataFrame:
    """The places of the symbols of ``wanted`` (LIST, symbolId) in their whole lists, as :func:`first_places` counts.

    A place is one more than the number of better symbols, so no list has to be sorted or held by one task. Symbols
    that are not in their list have no row.
    """
    wanted = wanted.select(*LIST, "symbolId").distinct()
    lists = named_lists(retrieval).join(wanted.select(*LIST).distinct(), LIST, "left_semi")
    best = materialize(_best_entries(lists), "entries")
    asked = best.join(wanted, [*LIST, "symbolId"], "left_semi").withColumnRenamed("order", "own")
    met = asked.join(best.select(*LIST, "order"), LIST)
    return met.groupBy(*LIST, "symbolId").agg((F.count(F.when(F.col("order") < F.col("own"), 1)) + 1).alias("place"))
