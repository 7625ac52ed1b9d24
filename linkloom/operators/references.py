"""References to records that do not exist.

Parent keys are cut into ranges of their 64-bit hash, and each range is stored as sorted arrays. References are
sent to the same ranges and probed there, a whole Arrow table at once, by binary search; a hit of the hash counts
only if the key itself is equal. Hashing the key makes ranges equally large whatever the keys look like. A range
that receives more references than a probe takes at once (a key may be referred to by a third of all rows) is cut into
parts by the referring rows, and its array goes to each part. The loads of ranges stay in a table on the cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.ids import requirement_id, symbol_id
from linkloom.session import default_partitions, materialize

#: parent keys of one sorted array, and references probed against it at once, at most about
ARRAY_KEYS, PROBE_ROWS = 100_000, 250_000


#: share of the referring rows by which the loads of ranges are estimated
LOAD_SAMPLE = 1 / 16


def _ranged(df: DataFrame, keys: list[str], bits: int) -> DataFrame:
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(k) for k in keys]))
    return hashed.withColumn("__range", F.shiftrightunsigned("__h", 64 - bits).cast("int"))


def sorted_key_arrays(parents: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """One row per range: ``__range`` and parallel arrays of hashes and keys, ordered by hash and key."""
    ranged = _ranged(parents.select(*keys).dropna().distinct(), keys, bits)
    ordered = F.array_sort(F.collect_list(F.struct("__h", *keys))).alias("__sorted")
    arrays = ranged.groupBy("__range").agg(ordered)
    return arrays.select("__range", F.col("__sorted.__h").alias("__hashes"), *[F.col(f"__sorted.{k}").alias(f"__parent_{i}") for i, k in enumerate(keys)])


def missing(hashes: np.ndarray, stored: list[pa.Array], probe_hashes: np.ndarray, probed: list[pa.Array]) -> np.ndarray:
    """Which of the probed keys are not among the stored ones; ``hashes`` ascend."""
    first = np.searchsorted(hashes, probe_hashes, "left")
    last = np.searchsorted(hashes, probe_hashes, "right")
    found = np.zeros(len(probe_hashes), dtype=bool)
    step = 0
    open_ = np.flatnonzero(first < last)
    while len(open_):  # one turn, but for keys that share a 64-bit hash
        at = pa.array(first[open_] + step)
        same = np.ones(len(open_), dtype=bool)
        for parent, ref in zip(stored, probed):
            same &= pc.equal(parent.take(at), ref.take(pa.array(open_))).to_numpy(zero_copy_only=False)
        found[open_[same]] = True
        step += 1
        open_ = open_[~same & (first[open_] + step < last[open_])]
    return ~found


def _flat(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    values = column.combine_chunks()
    values = values.flatten() if len(values) else pa.array([], kind)
    return values.cast(kind)


def _parts(sample: DataFrame, fraction: float, keys: list[str], bits: int, probe_rows: int) -> DataFrame | None:
    """__range and __parts of the ranges that receive more than ``probe_rows`` references; None where there are none.

    A written table of one row a range at most, which Spark broadcasts where its files are small.
    """
    loads = _ranged(sample.dropna(subset=keys), keys, bits).groupBy("__range").agg((F.count(F.lit(1)) / fraction).alias("n"))
    table = materialize(loads.filter(F.col("n") > probe_rows).select("__range", F.ceil(F.col("n") / probe_rows).cast("int").alias("__parts")), "range-loads")
    return None if table.isEmpty() else table


def orphans(references: DataFrame, parents: DataFrame, keys: list[str], probe_rows: int = PROBE_ROWS, sample: DataFrame | None = None, fraction: float = 1.0) -> DataFrame:
    """The rows of ``references`` whose ``keys`` are in no row of ``parents``.

    Rows of ``references`` with a null key are left out, as are parents with one. Repeated references come out
    once or more. Without parents every reference comes out, without references none. ``sample`` (about ``fraction`` of
    the references) only decides into how many parts a range is cut, never what comes out.
    """
    spark = references.sparkSession
    columns = references.columns
    count = parents.count()  # from the footers
    bits = max(1, math.ceil(math.log2(max(default_partitions(spark) * 4, count / ARRAY_KEYS, 2))))
    arrays = materialize(sorted_key_arrays(parents, keys, bits), "key-arrays")
    refs = _ranged(references.dropna(subset=keys), keys, bits)
    parts = _parts(references if sample is None else sample, fraction, keys, bits, probe_rows)
    if parts is not None:
        # a reference goes to any part of its range, so that equal ones, however many, are spread like others
        refs = refs.join(parts, "__range", "left")
        refs = refs.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
        arrays = arrays.join(parts, "__range", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    else:
        refs, arrays = refs.withColumn("__part", F.lit(0)), arrays.withColumn("__part", F.lit(0))
    size = len(keys)

    def probe(refs_table: pa.Table, array_table: pa.Table) -> pa.Table:
        out = refs_table.select(columns)
        if not refs_table.num_rows or not array_table.num_rows:
            return out
        stored = [_flat(array_table.column(f"__parent_{i}"), pa.string()) for i in range(size)]
        probed = [refs_table.column(k).combine_chunks().cast(pa.string()) for k in keys]
        hashes = _flat(array_table.column("__hashes"), pa.int64()).to_numpy()
        gone = missing(hashes, stored, refs_table.column("__h").to_numpy(), probed)
        return out.filter(pa.array(gone))

    schema = references.schema
    return refs.groupBy("__range", "__part").cogroup(arrays.groupBy("__range", "__part")).applyInArrow(probe, schema)


def symbol_references(retrieval: DataFrame, labeled: DataFrame, stored: DataFrame, commits: DataFrame) -> DataFrame:
    """References of three tables to symbols: tbl, period, commit, requirementId, symbolId.

    Rows with a null (or blank) requirementId or symbolId or with a commit unknown to ``commits`` are none. The
    period is the month ('YYYY-MM') of the commit; null where the commit has no time.
    """
    times = commits.select(F.col("repositoryCommit").alias("commit"), F.date_format("committedAt", "yyyy-MM").alias("period"))
    times = times.dropna(subset=["commit"]).groupBy("commit").agg(F.max("period").alias("period"))
    nested = retrieval.select(
        F.lit("retrieval").alias("tbl"), F.col("repositoryCommit").alias("commit"), requirement_id(F.col("requirementId")).alias("requirementId"),
        F.array_distinct(F.transform(F.col("candidates.symbolId"), symbol_id)).alias("ids"),
    ).filter(F.col("requirementId").isNotNull() & F.col("commit").isNotNull()).join(times, "commit")
    from_lists = nested.select("tbl", "period", "commit", "requirementId", F.explode("ids").alias("symbolId"))

    def flat(df: DataFrame, name: str, commit: str) -> DataFrame:
        rows = df.select(F.lit(name).alias("tbl"), F.col(commit).alias("commit"), requirement_id(F.col("requirementId")).alias("requirementId"), symbol_id(F.col("symbolId")).alias("symbolId"))
        return rows.filter(F.col("requirementId").isNotNull() & F.col("commit").isNotNull()).join(times, "commit").select(from_lists.columns)

    all_rows = from_lists.unionByName(flat(labeled, "labeled_links", "repositoryCommit")).unionByName(flat(stored, "stored_links", "commit"))
    return all_rows.filter(F.col("symbolId").isNotNull())


def orphan_symbols(retrieval: DataFrame, labeled: DataFrame, stored: DataFrame, commits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct references that no snapshot row answers: tbl, period, requirementId, symbolId."""
    refs = symbol_references(retrieval, labeled, stored, commits)
    few = symbol_references(*[t.sample(LOAD_SAMPLE, seed=1) for t in (retrieval, labeled, stored)], commits)
    parents = symbols.select(F.col("repositoryCommit").alias("commit"), symbol_id(F.col("symbolId")).alias("symbolId"))
    return orphans(refs, parents, ["commit", "symbolId"], sample=few, fraction=LOAD_SAMPLE).select("tbl", "period", "requirementId", "symbolId").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table and period: tbl, period, orphans (distinct references)."""
    return found.groupBy("tbl", "period").agg(F.count(F.lit(1)).alias("orphans"))
