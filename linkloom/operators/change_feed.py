"""Applying a feed of inserts, updates and deletes to a table of immutable files.

The table keeps row images in files that are never rewritten. A batch of changes is applied by

1. reducing the batch to the last change of each key (partial aggregation before the shuffle),
2. looking the keys up in the key -> (file, position, order) index,
3. appending the images of the changes that are newer than the stored one, and
4. setting the bits of the superseded rows in the deletion bitmaps of their files.

Readers meet the bitmaps by (file, block of positions), without a shuffle of images, and drop the rows whose bit is set.
Deletes stay in the table as tombstones, so that an older change which arrives later cannot bring a row back;
readers leave them out. The result depends on the order columns only, never on the order of arrival or on how
the feed was cut into batches.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.ids import outer_trim, requirement_id, symbol_id
from linkloom.functions.timestamps import moment_micros
from linkloom.session import materialize, workspace

#: positions covered by one bitmap row, as Spark's bitmap functions define it
BITMAP_BITS = 32_768
#: bytes of bitmaps that one read sends to every task at most
BITMAP_BYTES = 64 << 20


class DeltaTable:
    """A keyed table under ``root`` made of image files, an index and deletion bitmaps.

    ``keys`` and ``order`` name the columns of the identity and of the order of changes, ``payload`` the others;
    ``__deleted`` (boolean) marks a change that removes the row. Key columns must not be null; nulls in the order
    columns come first. Two changes of one key with equal order count as one; the greater payload stands.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]):
        self.spark, self.root = spark, root
        self.keys, self.order, self.payload = list(keys), list(order), list(payload)
        self.batches = 0
        while self._files().exists(self._hadoop_path(self._path("applied", self.batches))):
            self.batches += 1  # a table that is opened again

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._hadoop_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, part: str, batch: int | None = None) -> str:
        return f"{self.root}/{part}" + (f"/batch={batch}" if batch is not None else "")

    def _order(self, prefix: str = "") -> Column:
        return F.struct(*[F.col(prefix + c) for c in self.order])

    def _located(self, keys: DataFrame) -> DataFrame:
        """The newest index entry of each of ``keys``: superseded entries lose by their order.

        Entries of other keys are dropped before the aggregation; with a small batch that is a broadcast semi join.
        """
        parts = [self._path("index", i) for i in range(self.batches)]
        entries = self.spark.read.parquet(*parts).join(keys, self.keys, "left_semi")
        newest = F.max_by(F.struct("__file", "__position", *self.order), self._order()).alias("__live")
        return entries.groupBy(*self.keys).agg(newest)

    def apply(self, changes: DataFrame) -> None:
        """Apply one batch; ``changes`` has the keys, the order, the payload and ``__deleted``."""
        image = F.struct(*self.order, "__deleted", *self.payload)
        last = changes.groupBy(*self.keys).agg(F.max(image).alias("__image"))
        if self.batches:
            found = last.join(self._located(last.select(*self.keys)), self.keys, "left")
            stored = F.struct(*[F.col(f"__live.{c}") for c in self.order])
            fresh = found.filter(F.col("__live").isNull() | (F.struct(*[F.col(f"__image.{c}") for c in self.order]) > stored))
            where = [F.col("__live.__file").alias("__old_file"), F.col("__live.__position").alias("__old_position")]
        else:
            fresh = last
            where = [F.lit(None).cast("string").alias("__old_file"), F.lit(None).cast("bigint").alias("__old_position")]
        batch = self.batches
        # what a failed attempt left under this number is overwritten; readers know finished batches only
        fresh.select(*self.keys, "__image.*", *where).write.mode("overwrite").parquet(self._path("data", batch))
        images = self.spark.read.parquet(self._path("data", batch))
        images.select(*self.keys, *self.order, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__position")).write.mode("overwrite").parquet(self._path("index", batch))
        if batch:
            (
                images.filter(F.col("__old_file").isNotNull())
                .groupBy(F.col("__old_file").alias("file"), F.expr(f"__old_position div {BITMAP_BITS}").alias("block"))
                .agg(F.expr(f"bitmap_construct_agg(__old_position % {BITMAP_BITS})").alias("bits"))
                .write.mode("overwrite").parquet(self._path("deleted", batch))
            )
        self._files().mkdirs(self._hadoop_path(self._path("applied", batch)))
        self.batches += 1

    def _images(self, files: list[str]) -> DataFrame:
        return self.spark.read.parquet(*files).select(
            *self.keys, *self.order, *self.payload, "__deleted",
            F.col("_metadata.file_path").alias("file"),
            F.expr(f"_metadata.row_index div {BITMAP_BITS}").alias("block"),
            F.expr(f"cast(_metadata.row_index % {BITMAP_BITS} as int)").alias("__bit"),
        )

    def read(self) -> DataFrame:
        """The rows that exist now: keys, order and payload. A table without a batch cannot be read.

        Images are never shuffled: files without a bitmap are read as they are, the others in groups whose bitmaps take
        BITMAP_BYTES at most and go to every task. One group is the usual case.
        """
        kept = [*self.keys, *self.order, *self.payload]
        folders = [self._path("data", i) for i in range(self.batches)]
        if self.batches == 1:
            return self._images(folders).filter(~F.col("__deleted")).select(*kept)
        bitmaps = self.spark.read.parquet(*[self._path("deleted", i) for i in range(1, self.batches)])
        merged = materialize(bitmaps.groupBy("file", "block").agg(F.expr("bitmap_or_agg(bits)").alias("bits")), "bitmaps")
        # one row for each file of the table, fewer than the listing that Spark makes of it
        sizes = {r["file"]: r["n"] * BITMAP_BITS // 8 for r in merged.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
        octet = F.conv(F.hex(F.expr("substring(bits, __bit div 8 + 1, 1)")), 16, 10).cast("int")
        is_set = F.expr("shiftright(__octet, __bit % 8) & 1") == 1
        whole = sum(sizes.values()) <= BITMAP_BYTES
        groups = [(folders, merged)] if whole else [(files, merged.filter(F.col("file").isin(files))) for files in _packed(sizes, BITMAP_BYTES)]
        if not whole and (bare := [f for f in self._data_files(folders) if f not in sizes]):
            groups.append((bare, None))
        parts = []
        for files, marks in groups:
            rows = self._images(files)
            if marks is not None:
                rows = rows.join(F.broadcast(marks), ["file", "block"], "left").withColumn("__octet", octet)
                rows = rows.filter(F.col("bits").isNull() | ~is_set)
            parts.append(rows.filter(~F.col("__deleted")).select(*kept))
        return functools.reduce(DataFrame.unionByName, parts)

    def _data_files(self, folders: list[str]) -> list[str]:
        """The files of the table, named as the bitmaps name them."""
        return [r["file"] for r in self.spark.read.parquet(*folders).select(F.col("_metadata.file_path").alias("file")).distinct().collect()]


def _packed(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Names in groups whose sizes sum up to ``most`` at most, or of a single one."""
    groups: list[list[str]] = []
    room = 0
    for name in sorted(sizes):
        if not groups or sizes[name] > room:
            groups.append([])
            room = most
        groups[-1].append(name)
        room -= sizes[name]
    return groups


def arrival_batches(feed: DataFrame, column: str, batches: int) -> Column:
    """The number of the batch, from 0, that a row of ``feed`` belongs to by its time of arrival; nulls arrive last.

    The cuts only decide what is applied together, so an approximate quantile is enough.
    """
    micros = F.unix_micros(F.col(column).cast("timestamp"))
    shares = [i / batches for i in range(1, batches)]
    row = feed.agg(F.percentile_approx(micros, shares, 1000).alias("cuts")).first() if shares else None
    cuts = sorted(set((row and row["cuts"]) or []))
    number = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        number = F.when(micros <= cut, i).otherwise(number)
    return number


def decision_changes(decisions: DataFrame, *kept: Column) -> DataFrame:
    """The changes of a decision log that can take effect, as a feed for :class:`DeltaTable`, with the columns ``kept``.

    Dropped: a requirementId, proposedSymbolId, kind or timestamp that is null, empty or blank, a timestamp that
    names no real moment, a kind other than accept, reject and redirect (after trimming and lower-casing).
    """
    kind = F.lower(outer_trim(F.col("kind")))
    return decisions.select(
        requirement_id(F.col("requirementId")).alias("requirementId"),
        symbol_id(F.col("proposedSymbolId")).alias("proposedSymbolId"),
        moment_micros(F.col("timestamp")).alias("moment"),
        F.col("seq").cast("bigint").alias("seq"),
        symbol_id(F.col("symbolId")).alias("symbolId"),
        (kind == "reject").alias("__deleted"),
        kind.alias("__kind"), *kept,
    ).filter(
        F.col("requirementId").isNotNull() & F.col("proposedSymbolId").isNotNull() & F.col("moment").isNotNull()
        & F.col("__kind").isin("accept", "reject", "redirect")
    ).drop("__kind")


def current_links(decisions: DataFrame, batches: int = 3) -> DataFrame:
    """The links left by a decision log: requirementId, proposedSymbolId, symbolId, seq of the last change.

    The feed is applied in ``batches`` batches in order of arrival. An empty log gives no rows; a redirect or
    accept whose symbolId is null gives a link with a null symbolId; repeated deliveries count once.
    """
    spark = decisions.sparkSession
    table = DeltaTable(spark, workspace(spark, "links"), ["requirementId", "proposedSymbolId"], ["moment", "seq"], ["symbolId"])
    needed = decisions.select("requirementId", "proposedSymbolId", "symbolId", "seq", "kind", "timestamp", "receivedAt")
    # the feed is read and parsed once, and lies by batches from then on
    path = workspace(spark, "changes")
    numbered = decision_changes(needed, arrival_batches(needed, "receivedAt", batches).alias("__batch"))
    numbered.write.partitionBy("__batch").parquet(path)
    changes = spark.read.schema(numbered.schema).parquet(path)
    for i in range(batches):
        table.apply(changes.filter(F.col("__batch") == i).drop("__batch"))
    return table.read().select("requirementId", "proposedSymbolId", "symbolId", "seq")
