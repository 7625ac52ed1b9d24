"""The decision log: latest state, recorded bands, statistics, and banding of proposals.

The log's order is its position (``seq``), not its time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.config import BANDS
from linkloom.functions.ids import outer_trim, requirement_id, symbol_id


def band(confidence: Column, classification: Column, suggest: float = 0.75, review: float = 0.5) -> Column:
    """suggest, review or discard by inclusive bounds; what is unrelated is discarded. Null confidence is discarded."""
    return F.when(classification == "unrelated", "discard").when(confidence >= suggest, "suggest").when(confidence >= review, "review").otherwise("discard")


def decision_log(decisions: DataFrame) -> DataFrame:
    """Clean log rows, once for each seq: ids in normal form, kind lower-cased; rows that are no decision left out."""
    rows = decisions.select(
        "seq", requirement_id(F.col("requirementId")).alias("requirementId"), symbol_id(F.col("proposedSymbolId")).alias("proposedSymbolId"),
        symbol_id(F.col("symbolId")).alias("symbolId"), F.lower(outer_trim(F.col("kind"))).alias("kind"), "relationship", "modelClassification",
        "modelConfidence", "band", "reviewer", "timestamp", "repositoryCommit",
    )
    valid = F.col("seq").isNotNull() & F.col("requirementId").isNotNull() & F.col("proposedSymbolId").isNotNull() & F.col("kind").isin("accept", "reject", "redirect")
    rows = rows.filter(valid)
    rest = [c for c in rows.columns if c != "seq"]
    return rows.groupBy("seq").agg(F.max(F.struct(*rest)).alias("d")).select("seq", "d.*")


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last decision of every (requirementId, proposedSymbolId)."""
    rest = [c for c in log.columns if c not in ("requirementId", "proposedSymbolId", "seq")]
    return log.groupBy("requirementId", "proposedSymbolId").agg(F.max(F.struct("seq", *rest)).alias("d")).select("requirementId", "proposedSymbolId", "d.*")


def accepted_links(log: DataFrame) -> DataFrame:
    """Links that stand after the log: the latest decisions without the rejected."""
    return latest_decisions(log).filter(F.col("kind") != "reject").select("requirementId", "proposedSymbolId", "symbolId", "relationship", "reviewer", "timestamp", "repositoryCommit")


def recorded_bands(log: DataFrame) -> DataFrame:
    """The band at the time of the last decision."""
    return latest_decisions(log).select("requirementId", "proposedSymbolId", "band")


def is_override(kind: Column, band_: Column) -> Column:
    return (kind == "redirect") | ((kind == "reject") & (band_ == "suggest")) | ((kind == "accept") & (band_ == "discard"))


def review_statistics(log: DataFrame) -> DataFrame:
    """Counts over the latest decisions for all (band 'all') and for each band: decided, accepted, rejected, redirected, overrides, override_rate."""
    rows = latest_decisions(log).withColumn("over", F.coalesce(is_override(F.col("kind"), F.col("band")), F.lit(False)))
    sliced = rows.withColumn("slice", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("band").isin(*BANDS), F.col("band"))))))
    count = lambda c: F.count(F.when(c, 1))
    stats = sliced.groupBy(F.col("slice").alias("band")).agg(
        F.count(F.lit(1)).alias("decided"), count(F.col("kind") == "accept").alias("accepted"), count(F.col("kind") == "reject").alias("rejected"),
        count(F.col("kind") == "redirect").alias("redirected"), count(F.col("over")).alias("overrides"),
    )
    return stats.withColumn("override_rate", F.col("overrides") / F.col("decided"))


def bucketed(proposals: DataFrame, recorded: DataFrame) -> DataFrame:
    """Proposals (requirementId, symbolId, confidence, classification) with band and reviewed; decided ones keep their recorded band."""
    known = recorded.select("requirementId", F.col("proposedSymbolId").alias("symbolId"), F.col("band").alias("recorded"))
    rows = proposals.join(known, ["requirementId", "symbolId"], "left")
    return rows.select(*proposals.columns, F.coalesce("recorded", band(F.col("confidence"), F.col("classification"))).alias("band"), F.col("recorded").isNotNull().alias("reviewed"))


def review_queue(bucketed_: DataFrame, stale: DataFrame) -> DataFrame:
    """Open proposals: not discarded and not decided, with ``stale`` (requirementId, symbolId).

    Sorted: suggested ones first, then by requirement and symbol, as rows of a table have no order of arrival.
    """
    open_ = bucketed_.filter((F.col("band") != "discard") & ~F.col("reviewed"))
    flags = stale.select("requirementId", "symbolId").distinct().withColumn("stale", F.lit(True))
    rows = open_.join(flags, ["requirementId", "symbolId"], "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    return rows.orderBy(F.when(F.col("band") == "suggest", 0).otherwise(1), "requirementId", "symbolId")


def check_decisions(batch: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each row of ``batch`` (requirementId, symbolId, kind, redirectTo, reviewer) with ``problem``, null where it may be recorded.

    Problems in this order: unknown-kind, blank-reviewer, redirect-without-target, target-without-redirect,
    unmatched-proposal. Relationship: that of the model, supports or else implements.
    """
    known = proposals.groupBy("requirementId", "symbolId").agg(F.max("classification").alias("classification"))
    rows = batch.join(known, ["requirementId", "symbolId"], "left")
    target = F.coalesce(outer_trim(F.col("redirectTo")), F.lit("")) != ""
    kind = F.coalesce("kind", F.lit(""))
    problem = (
        F.when(~kind.isin("accept", "reject", "redirect"), "unknown-kind")
        .when(F.coalesce(outer_trim(F.col("reviewer")), F.lit("")) == "", "blank-reviewer")
        .when((kind == "redirect") & ~target, "redirect-without-target")
        .when((kind != "redirect") & target, "target-without-redirect")
        .when(F.col("classification").isNull(), "unmatched-proposal")
    )
    return rows.withColumn("problem", problem).withColumn("relationship", F.when(F.col("classification") == "supports", "supports").otherwise("implements"))
