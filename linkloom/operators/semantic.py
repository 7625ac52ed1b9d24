"""Embedding retrieval: texts by content key, a cache of vectors, and the nearest vectors of every query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import ids, vectors

#: queries of a block and items of a part, on average; both lie in memory as one matrix each
QUERY_BLOCK, ITEM_PART = 256, 20_000
#: bytes of queries that go to every task at most; items, and scores, that are made at once there
QUERY_BYTES, ITEM_SLICE, SCORES = 32 << 20, 1_024, 4 << 20


def symbol_text(kind: Column, qualified: Column, path: Column, signature: Column, documentation: Column, source: Column) -> Column:
    """The text of a symbol that is embedded: labelled lines, empty ones left out."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))
    first = F.concat(F.coalesce(kind, F.lit("")), F.lit(" "), F.coalesce(qualified, F.lit("")))
    return F.concat_ws("\n", first, F.concat(F.lit("path: "), F.coalesce(path, F.lit(""))), line("signature: ", signature), line("documentation: ", documentation), line("source: ", source))


def embedding_key(text: Column) -> Column:
    return ids.digest(text, 32)


def valid_cache(cache: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Entries (model, key, vector) of this model with as many finite numbers as it has dimensions."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return cache.filter((F.col("model") == model) & (F.size("vector") == dimensions) & finite).select("key", "vector")


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """key and text of the distinct texts that the cache lacks."""
    keyed = texts.filter(F.col("text").isNotNull()).select(embedding_key(F.col("text")).alias("key"), "text")
    return keyed.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 64) -> DataFrame:
    """key and unit vector of every (key, text), made by ``embedder`` in batches on the workers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made: list[list[float]] = []
            for at in range(0, len(frame), batch):
                part = frame["text"].iloc[at : at + batch].tolist()
                got = embedder(part)
                if len(got) != len(part) or any(len(v) != dimensions for v in got):
                    raise ValueError(f"the embedder must give {len(part)} vectors of {dimensions} numbers")
                made += [list(map(float, v)) for v in got]
            yield pd.DataFrame({"key": frame["key"], "vector": made})

    return texts.select("key", "text").mapInPandas(run, "key string, vector array<double>").withColumn("vector", vectors.l2_normalize(F.col("vector")))


def pruned_cache(cache: DataFrame, needed: DataFrame) -> DataFrame:
    """The entries that this run used."""
    return cache.join(needed.select("key").distinct(), "key", "left_semi")


def nearest(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` items of the greatest cosine for every query: query, rank, item, score (rounded to nine digits).

    ``queries`` has query and vector, ``items`` item and vector, both ids of type bigint. Queries that take QUERY_BYTES
    at most go to every task, and the items are read in place, batch by batch as a matrix. Beyond that every block of
    queries meets every part of the items in a task of its own. Either way only the k best of a task are shuffled.
    Negative scores stay; ties are settled by item. Null ids or vectors, and vectors of another length than the
    queries' first, do not count; a zero vector has a cosine of 0 with all.
    """
    asked = queries.filter(F.col("vector").isNotNull() & F.col("query").isNotNull()).select("query", F.col("vector").cast("array<double>").alias("vector"))
    held = items.filter(F.col("vector").isNotNull() & F.col("item").isNotNull()).select("item", F.col("vector").cast("array<double>").alias("vector"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vector").cast("bigint")), F.lit(0)).alias("numbers")).first()
    if size["numbers"] * 8 <= QUERY_BYTES:
        met = _nearest_in_place(asked, held, k)
        return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "rank", "item", "score")
    blocks = max(1, -(-size["n"] // QUERY_BLOCK))
    parts = max(1, -(-held.count() // ITEM_PART))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = held.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = T.StructType([asked.schema["query"], held.schema["item"], T.StructField("score", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, qv = _matrix(left, "query")
        i, iv = _matrix(right, "item", qv.shape[1] if len(q) else 0)
        if not len(q) or not len(i):
            return pa.table({"query": pa.array([], pa.int64()), "item": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        scores = np.round(qv @ iv.T, 9)
        order = np.argsort(i, kind="stable")
        best = np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(q)), best.shape[1])
        cols = order[best.ravel()]
        return pa.table({"query": q[rows], "item": i[cols], "score": scores[rows, cols]})

    met = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(run, schema)
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "rank", "item", "score")


def _nearest_in_place(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """query, item, score of the ``k`` best items of each partition of ``held``, the queries being few."""
    q, qv = _matrix(asked.toArrow(), "query")
    sent = asked.sparkSession.sparkContext.broadcast((q, qv))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qv = sent.value
        items, scores = np.empty((len(q), 0), np.int64), np.empty((len(q), 0))
        for batch in batches:
            i, iv = _matrix(pa.Table.from_batches([batch]), "item", qv.shape[1])
            step = max(1, min(ITEM_SLICE, SCORES // max(1, len(q))))
            for at in range(0, len(i), step):
                part = i[at : at + step]
                items = np.concatenate([items, np.broadcast_to(part, (len(q), len(part)))], axis=1)
                scores = np.concatenate([scores, np.round(qv @ iv[at : at + step].T, 9)], axis=1)
                first = np.lexsort((items, -scores), axis=1)[:, :k]
                items, scores = np.take_along_axis(items, first, axis=1), np.take_along_axis(scores, first, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, items.shape[1])), pa.array(items.ravel()), pa.array(scores.ravel())], names=["query", "item", "score"])

    if not len(q):
        return held.sparkSession.createDataFrame([], "query bigint, item bigint, score double")
    return held.mapInArrow(run, "query bigint, item bigint, score double")


def _matrix(table: pa.Table, key: str, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and unit vectors as rows; vectors of another length are left out."""
    vectors_ = table.column("vector").combine_chunks()
    if not len(vectors_):
        return np.empty(0, np.int64), np.empty((0, width))
    sizes = np.asarray(pc.list_value_length(vectors_))
    width = width or int(sizes[0])
    keep = sizes == width
    flat = np.asarray(vectors_.filter(pa.array(keep)).flatten(), dtype=np.float64).reshape(-1, width)
    length = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return table.column(key).to_numpy()[keep], flat / np.where(length == 0, 1, length)
