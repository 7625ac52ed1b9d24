"""What changed between consecutive full snapshots.

Both sides of a pair of neighbouring snapshots are reduced to one canonical hash per key and meet in a full outer
join on (pair, key): a side that is missing gives an addition or a removal, unequal hashes a change. Only keys and
hashes are shuffled, and the join reuses the partitioning of the aggregation before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.ids import canonical_space, symbol_id


def canonical_hash(*texts: Column) -> Column:
    """SHA-256 (32 bytes) over the canonical forms of ``texts``; lengths keep neighbouring texts apart."""
    forms = [canonical_space(t) for t in texts]
    return F.unhex(F.sha2(F.concat_ws("|", *[F.length(f).cast("string") for f in forms], *forms), 256))


def snapshot_pairs(commits: DataFrame) -> DataFrame:
    """repositoryCommit, earlier and later commit of the same repository by snapshotNo (null at the ends).

    Commits without an id, a repository or a snapshotNo have no place in the order. A commit that is listed
    repeatedly counts once, with its greatest (repository, snapshotNo).
    """
    once = commits.select("repositoryCommit", "repository", "snapshotNo").dropna()
    once = once.groupBy("repositoryCommit").agg(F.max(F.struct("repository", "snapshotNo")).alias("at")).select("repositoryCommit", "at.*")
    turn = Window.partitionBy("repository").orderBy("snapshotNo", "repositoryCommit")
    return once.select("repositoryCommit", F.lag("repositoryCommit").over(turn).alias("earlier"), F.lead("repositoryCommit").over(turn).alias("later"))


def snapshot_changes(symbols: DataFrame, commits: DataFrame) -> DataFrame:
    """Differences of neighbouring snapshots: repositoryCommit (of the later one), symbolId, change.

    changed means that signature or normalizedSource differ beyond white space. Rows without a symbolId or of an
    unknown commit are in no snapshot; of repeated rows of a symbol the one loaded last holds. A commit without
    rows is an empty snapshot.
    """
    pairs = snapshot_pairs(commits)
    rows = symbols.select("repositoryCommit", symbol_id(F.col("symbolId")).alias("symbolId"), F.struct("loadedAt", canonical_hash(F.col("signature"), F.col("normalizedSource")).alias("hash")).alias("image"))
    rows = rows.filter(F.col("symbolId").isNotNull()).join(pairs, "repositoryCommit")

    def side(pair: Column, keep: Column, name: str) -> DataFrame:
        return rows.filter(keep).groupBy(pair.alias("pair"), "symbolId").agg(F.max("image").getField("hash").alias(name))

    before = side(F.col("later"), F.col("later").isNotNull(), "old")
    after = side(F.col("repositoryCommit"), F.col("earlier").isNotNull(), "new")
    both = before.join(after, ["pair", "symbolId"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(F.col("pair").alias("repositoryCommit"), "symbolId", change.alias("change")).filter(F.col("change").isNotNull())
