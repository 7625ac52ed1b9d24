"""Links between requirements and symbols: index, lookups, reconciliation, staleness, coverage, drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.ids import requirement_id, symbol_id, symbol_path

KEY = ["requirementId", "symbolId"]


def clean_links(links: DataFrame) -> DataFrame:
    """requirementId, symbolId, reviewer, timestamp, commit with ids in normal form; rows without an id left out."""
    rows = links.select(requirement_id(F.col("requirementId")).alias("requirementId"), symbol_id(F.col("symbolId")).alias("symbolId"), "reviewer", "timestamp", "commit")
    return rows.filter(F.col("requirementId").isNotNull() & F.col("symbolId").isNotNull())


def link_index(links: DataFrame) -> DataFrame:
    """One row per (requirementId, symbolId): the first by timestamp, then commit and reviewer (nulls last)."""
    first = Window.partitionBy(*KEY).orderBy(F.asc_nulls_last("timestamp"), F.asc_nulls_last("commit"), F.asc_nulls_last("reviewer"))
    return links.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def adjacency(index: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct (``key``, ``value``) in order of both: each key's list is a run of rows.

    Ranges of the sort are cut by both columns, so that a key with very many values lies in several of them and is
    never gathered in one row or task.
    """
    return index.select(key, value).distinct().orderBy(key, value)


def symbols_for(index: DataFrame, requirement: str) -> DataFrame:
    return index.filter(F.col("requirementId") == requirement).select("symbolId").orderBy("symbolId")


def requirements_for(index: DataFrame, symbol: str) -> DataFrame:
    return index.filter(F.col("symbolId") == symbol).select("requirementId").orderBy("requirementId")


def unlinked(requirements: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct requirementIds without a link."""
    return requirements.select("requirementId").dropna().distinct().join(index.select("requirementId"), "requirementId", "left_anti")


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Disagreements of two link indexes: requirementId, symbolId, rule.

    missing-from-index, absent-from-frontmatter, or field-mismatch where reviewer, timestamp or commit differ
    (null equals null).
    """
    fields = ("reviewer", "timestamp", "commit")
    left = expected.select(*KEY, F.struct(*fields).alias("e"))
    right = actual.select(*KEY, F.struct(*fields).alias("a"))
    same = F.col("e.reviewer").eqNullSafe(F.col("a.reviewer")) & F.col("e.timestamp").eqNullSafe(F.col("a.timestamp")) & F.col("e.commit").eqNullSafe(F.col("a.commit"))
    rule = F.when(F.col("a").isNull(), "missing-from-index").when(F.col("e").isNull(), "absent-from-frontmatter").when(~same, "field-mismatch")
    return left.join(right, KEY, "full_outer").select(*KEY, rule.alias("rule")).filter(F.col("rule").isNotNull())


def resolve(index: DataFrame, known: DataFrame, previous: DataFrame, commit: Column) -> DataFrame:
    """Every link with resolved, last_resolved and checked.

    ``known`` holds the symbolIds of the commit now, ``previous`` (requirementId, symbolId, last) the last run. A link
    that does not resolve keeps the commit at which it last did, else the commit it was stored with.
    """
    now = known.select("symbolId").distinct().withColumn("here", F.lit(True))
    before = previous.groupBy(*KEY).agg(F.max("last").alias("last"))
    rows = index.join(now, "symbolId", "left").join(before, KEY, "left")
    here = F.coalesce("here", F.lit(False))
    return rows.select(*KEY, here.alias("resolved"), F.when(here, commit).otherwise(F.coalesce("last", "commit")).alias("last_resolved"), commit.alias("checked"))


def proposal_staleness(proposals: DataFrame, known: DataFrame, excluded: Callable[[Column], Column]) -> DataFrame:
    """Proposals with stale, reason (excluded or missing, null where they resolve) and path."""
    now = known.select("symbolId").distinct().withColumn("here", F.lit(True))
    rows = proposals.join(now, "symbolId", "left").withColumn("path", symbol_path(F.col("symbolId")))
    stale = F.col("here").isNull()
    gone = F.when(F.col("path").isNotNull() & excluded(F.col("path")), "excluded").otherwise("missing")
    return rows.select("requirementId", "symbolId", stale.alias("stale"), F.when(stale, gone).alias("reason"), "path")


def coverage(requirements: DataFrame, index: DataFrame, broken: DataFrame) -> DataFrame:
    """Per requirement: state (linked, stale when all of its links are broken, unlinked), links, broken_links."""
    bad = broken.select("symbolId").distinct().withColumn("bad", F.lit(1))
    counts = index.join(bad, "symbolId", "left").groupBy("requirementId").agg(F.count(F.lit(1)).alias("links"), F.count("bad").alias("broken_links"))
    rows = requirements.select("requirementId").dropna().distinct().join(counts, "requirementId", "left").na.fill(0, ["links", "broken_links"])
    state = F.when(F.col("links") == 0, "unlinked").when(F.col("links") == F.col("broken_links"), "stale").otherwise("linked")
    return rows.select("requirementId", state.alias("state"), "links", "broken_links")


def coverage_summary(rows: DataFrame) -> DataFrame:
    """Requirements, links and broken links by state."""
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("requirements"), F.sum("links").alias("links"), F.sum("broken_links").alias("broken_links"))


def affected_links(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Links whose symbol changed between snapshots: ``changes`` has repositoryCommit, symbolId, change."""
    return index.select(*KEY).join(changes, "symbolId").select("requirementId", "symbolId", "repositoryCommit", "change")


def renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Suspected renames: removed and added symbols of one commit whose bodies are equal.

    Both have repositoryCommit, symbolId and body (a hash; null or empty bodies are no evidence). Of several
    candidates the first by id is named, together with their number.
    """
    gone = removed.filter(F.col("body").isNotNull()).select("repositoryCommit", "body", F.col("symbolId").alias("old"))
    new = added.filter(F.col("body").isNotNull()).groupBy("repositoryCommit", "body").agg(F.min("symbolId").alias("renamed_to"), F.count(F.lit(1)).alias("candidates"))
    return gone.join(new, ["repositoryCommit", "body"]).select("repositoryCommit", F.col("old").alias("symbolId"), "renamed_to", "candidates")


def result_differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two result lists (keys, item, rank) of different provenance: keys, item, first_rank, second_rank where they differ."""
    a = first.select(*keys, "item", F.col("rank").alias("first_rank"))
    b = second.select(*keys, "item", F.col("rank").alias("second_rank"))
    return a.join(b, [*keys, "item"], "full_outer").filter(~F.col("first_rank").eqNullSafe(F.col("second_rank")))
