"""The N best distinct items of every group, by secondary sort.

Lists are hash-partitioned by group and sorted inside the partitions by group, score and identifier; a stream of
Arrow batches then passes N rows of each group on, holding no more than one batch and N identifiers. Groups of more
than HOT_ITEMS items are cut into as many parts as keep a part at about that size, each part is reduced to its N best,
and only those meet: an item among the N best of its group is among the N best of its part, with its best entry. There
is no bound on the number of such groups or of their parts: they are named in a table, not on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.candidates import LIST, named_lists, scored_entries
from linkloom.session import materialize

#: about how many items of one group a task takes; a group with more is cut into parts
HOT_ITEMS = 50_000


def _first_n(group: list[str], item: str, n: int, output: list[str]):
    """A function over sorted Arrow batches: rows of the first ``n`` distinct items of each group, with ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # the group of the last row seen
        given: list = []  # what was passed on of that group
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            start = np.zeros(size, dtype=bool)
            for name in group:
                column = batch.column(name)
                if size > 1:
                    start[1:] |= pc.not_equal(column.slice(1), column.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            head = [batch.column(name)[0].as_py() for name in group]
            goes_on = head == last
            start[0] = True
            run_of = np.cumsum(start) - 1
            items = batch.column(item)
            codes = items.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, firsts = np.unique(run_of * (int(codes.max()) + 1) + codes, return_index=True)
            new = np.zeros(size, dtype=bool)
            new[firsts] = True
            before = 0
            if goes_on:
                before = len(given)
                end = int(np.argmax(start[1:])) + 1 if start[1:].any() else size
                new[:end] &= ~pc.is_in(items.slice(0, end), value_set=pa.array(given, items.type)).to_numpy(zero_copy_only=False)
            count = np.cumsum(new)
            begin = np.flatnonzero(start)
            place = count - (count[begin] - new[begin])[run_of]
            place[run_of == 0] += before
            keep = new & (place <= n)
            tail = run_of == run_of[-1]
            kept_tail = items.filter(pa.array(keep & tail)).to_pylist()
            given = given + kept_tail if goes_on and run_of[-1] == 0 else kept_tail
            last = [batch.column(name)[size - 1].as_py() for name in group]
            if keep.any():
                chosen = batch.filter(pa.array(keep))
                arrays = [pa.array(place[keep], pa.int32()) if name == "place" else chosen.column(name) for name in output]
                yield pa.RecordBatch.from_arrays(arrays, names=output)

    return run


def _sorted_first(rows: DataFrame, group: list[str], order: list, item: str, n: int, part: list[str], output: list[str]) -> DataFrame:
    """``rows`` already lie in partitions that hold whole (parts of) groups."""
    kept = [c for c in output if c != "place"]
    ready = rows.withColumn("__g", F.xxhash64(*group, *part)).sortWithinPartitions("__g", *group, *part, *order)
    ready = ready.select(*dict.fromkeys([*group, *part, item, *kept]))
    kinds = dict(rows.dtypes) | {"place": "int"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in output)
    return ready.mapInArrow(_first_n([*group, *part], item, n, output), schema)


def hot_groups(lists: DataFrame, group: list[str], size: Column, above: int) -> DataFrame:
    """__hot (hash of the group) and __parts of every group with more than ``above`` items, as a written table.

    There are at most as many rows as all items hold times ``above``; Spark broadcasts the table where its files are
    small, and joins it otherwise.
    """
    counts = lists.groupBy(F.xxhash64(*group).alias("__hot")).agg(F.sum(size.cast("bigint")).alias("n")).filter(F.col("n") > above)
    return materialize(counts.select("__hot", F.ceil(F.col("n") / above).cast("int").alias("__parts")), "hot-groups")


def top_candidates(retrieval: DataFrame, n: int = 5, hot_items: int = HOT_ITEMS) -> DataFrame:
    """The ``n`` best distinct symbols of each list: requirementId, configurationId, repositoryCommit, place, symbolId.

    A list is all pieces with the same (requirementId, configurationId, repositoryCommit), none of them null.
    Candidates with a null or blank symbolId or a score that is null, NaN or infinite do not count. Order: higher
    score, lower rank (null last), symbolId in byte order; a symbol stands once, with its best entry. Repeated
    pieces change nothing; lists without a candidate that counts give no rows.
    """
    group, lists = LIST, named_lists(retrieval)
    hot = hot_groups(lists, group, F.size("candidates.rank"), hot_items)
    order = [F.desc("score"), F.asc_nulls_last("rank"), F.asc("symbolId")]
    output = [*group, "place", "symbolId"]

    def whole(df: DataFrame) -> DataFrame:
        return _sorted_first(scored_entries(df.repartition(*group), group), group, order, "symbolId", n, [], output)

    if hot.isEmpty():
        return whole(lists)
    keyed = lists.withColumn("__hot", F.xxhash64(*group))
    # pieces go to a part whatever they hold, so that copies of one piece cannot crowd it
    pieces = keyed.join(hot, "__hot").withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts")).cast("int"))
    pieces = pieces.select(*group, "candidates", "__part").repartition(*group, "__part")
    partial = _sorted_first(scored_entries(pieces, [*group, "__part"]), group, order, "symbolId", n, ["__part"], [*group, "rank", "symbolId", "score"])
    final = _sorted_first(partial.repartition(*group), group, order, "symbolId", n, [], output)
    return whole(keyed.join(hot, "__hot", "left_anti").drop("__hot")).unionByName(final)
