"""Documents with template residue, filler, error pages or script notices.

1. Texts are cut into units (titles, field values, paragraphs, list items); a unit is known by the words of its form, so
   that copies fall together. Labels that can be trusted come from the form alone (unfilled places, filler, error
   objects, empty pages) and from a short table of seeds, which are units like any other.
2. Near-duplicates of units are found by partitioned tables of 128-bit SimHash fingerprints of their five-word shingles:
   a table compares the bits of one random selection, and pairs that meet in a table are verified by their Hamming
   distance and then by the Jaccard similarity of their shingles. A selection has more bits the more units there are,
   and there are as many tables as RECALL asks for at a similarity of exactly SIMILARITY. The majority of few shingles
   says little, so units of at most SHORT shingles meet by the prefixes of their sorted shingle sets, which lose no pair.
3. The trusted labels spread over the connected components of these links, step by step from labelled units to their
   neighbours, until no unit is new. Only links that start at residue are needed for that, so the table of labelled
   units is the query side of each step and all units are the other.
4. A document with a unit of such a component comes out.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.residue_rules import SEEDS, message_form, normal_form, units_of
from linkloom.session import materialize

#: words of a shingle, least Jaccard similarity
SHINGLE, SIMILARITY = 5, 0.8
#: what rounding may take from a product with SIMILARITY; it only admits more candidates
ROUNDING = 1e-9
#: a set of fewer shingles has no near-duplicate but itself: 3 of 4 is less than 0.8
LEAST_SHINGLES = 4
#: units of LONG shingles or more have a fingerprint, units of SHORT or fewer a prefix; similar sets share one of both
LONG, SHORT = 32, 40
#: bits of a fingerprint; differing bits of a pair at most (at a similarity of 0.8 they are 20 on average, deviation 4 to 5)
BITS, HAMMING = 128, 38
#: share of pairs of exactly SIMILARITY that the tables are to bring together, and units of a bucket on average
RECALL, BUCKET = 0.95, 16
#: labelled units of a bucket that are compared first; the others are compared with what is not linked by then
FIRST = 16
#: shingles whose bits are counted at once
_BATCH_SHINGLES = 100_000
#: odd factors that keep the words of a shingle apart
_FACTORS = [int(x) for x in np.random.default_rng(7).integers(1 << 32, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)]


def shingles(normal: str) -> set[str]:
    """The runs of five words; a text of fewer words is one shingle."""
    words = normal.split(" ")
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def _key(normal: str) -> int:
    return xxhash.xxh3_64_intdigest(normal) - (1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(normals: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, ascending within a text, and the number of each text's."""
    lists = pc.split_pattern(normals.cast(pa.string()), " ")
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64)
    flat = words[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(normals)), np.diff(np.r_[0, ends]))
    at = np.flatnonzero(ends[owner] - np.arange(len(flat)) >= SHINGLE)
    made = np.zeros(len(at), dtype=np.uint64)
    for i, factor in enumerate(_FACTORS):
        made += flat[at + i] * np.uint64(factor)
    made, owner = _mixed(made), owner[at]
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    new = np.r_[True, (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])][: len(made)]
    return made[new], np.bincount(owner[new], minlength=len(normals))


def fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each text (sizes above zero): bit by bit what most of its shingles have."""
    out = np.empty((len(sizes), 2), dtype=np.uint64)
    ends = np.cumsum(sizes)
    cuts = np.r_[0, np.flatnonzero(np.diff(ends // _BATCH_SHINGLES)) + 1, len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        part = hashes[ends[a] - sizes[a] : ends[b - 1]]
        begin = (np.cumsum(sizes[a:b]) - sizes[a:b]).astype(np.int64)
        for word, values in enumerate((part, _mixed(part ^ np.uint64(0x9E3779B97F4A7C15)))):
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
            out[a:b, word] = np.packbits(2 * ones > sizes[a:b, None], axis=1).view(np.uint64).ravel()
    return out


def text_units(documents: DataFrame) -> DataFrame:
    """doc_id, unit (64-bit key of the form), normal (the form), trusted (labelled by its form); once for each document.

    A place inside of a unit is a unit of its own, named so that it meets no other text. Null, empty and blank texts
    have no units.
    """
    rows = documents.select("doc_id", "text", "source").filter(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            at: list[int] = []
            for i, (text, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found: dict[str, bool] = {}
                for normal, places, whole in units_of(text, source):
                    if normal:
                        found[normal] = found.get(normal, False) or whole
                    for place in places:
                        found["place: " + normal_form(place) + " " + place[:1]] = True
                for normal, trusted in found.items():
                    at.append(i)
                    out[0].append(_key(normal))
                    out[1].append(normal)
                    out[2].append(trusted)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_())], names=["doc_id", "unit", "normal", "trusted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, unit bigint, normal string, trusted boolean")


def seed_units(found: DataFrame) -> DataFrame:
    """unit, normal, trusted of the table of seeds."""
    forms = sorted({message_form(s)[0] for s in SEEDS})
    return found.sparkSession.createDataFrame([(_key(f), f, True) for f in forms], "unit bigint, normal string, trusted boolean")


def near_prints(units: DataFrame) -> DataFrame:
    """unit, normal, trusted, n (shingles), high and low (the fingerprint, null for short units), keys (the prefix, empty for long ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = shingle_sets(batch.column("normal"))
            ends = np.cumsum(sizes)
            many = sizes >= LONG
            high = low = np.zeros(len(sizes), dtype=np.int64)
            if many.any():
                prints = np.zeros((len(sizes), 2), dtype=np.uint64)
                prints[many] = fingerprints(hashes[np.repeat(many, sizes)], sizes[many])
                high, low = prints[:, 0].astype(np.int64), prints[:, 1].astype(np.int64)
            few = (sizes >= LEAST_SHINGLES) & (sizes <= SHORT)
            lengths = np.where(few, sizes - np.ceil(sizes * SIMILARITY - ROUNDING).astype(np.int64) + 1, 0)
            within = np.arange(len(hashes)) - np.repeat(ends - sizes, sizes)
            keys = hashes[within < np.repeat(lengths, sizes)].astype(np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
            arrays = [*batch.columns, pa.array(sizes, pa.int32()), pa.array(high, pa.int64(), mask=~many), pa.array(low, pa.int64(), mask=~many), pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["unit", "normal", "trusted", "n", "high", "low", "keys"])

    return units.select("unit", "normal", "trusted").mapInArrow(run, "unit bigint, normal string, trusted boolean, n int, high bigint, low bigint, keys array<bigint>")


def selections(units: int) -> list[tuple[int, int]]:
    """The bits (as masks of both words) that each table compares, for so many units with a fingerprint."""
    bits = max(8, math.ceil(math.log2(max(2, units / BUCKET))))
    # a bit is equal with the share of the angle between two sets of that similarity
    equal = 1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - equal**bits))
    rng = random.Random(11)
    masks = []
    for _ in range(tables):
        mask = sum(1 << i for i in rng.sample(range(BITS), bits))
        masks.append(tuple(((m + (1 << 63)) % (1 << 64)) - (1 << 63) for m in (mask >> 64, mask % (1 << 64))))
    return masks


def _keyed(prints: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """unit, n, high, low, i (place of the key in the prefix), tab, key: one row for each key of each unit."""
    table = F.array(*[F.struct(F.lit(t).alias("tab"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t, (a, b) in enumerate(masks)])
    kept = ["unit", "n", "high", "low"]
    short = prints.filter(F.size("keys") > 0).select(*kept, F.posexplode("keys").alias("i", "key"))
    long = prints.filter(F.col("high").isNotNull()).select(*kept, F.inline(table))
    long = long.select(*kept, F.lit(0).alias("i"), F.xxhash64(F.col("high").bitwiseAND(F.col("a")), F.col("low").bitwiseAND(F.col("b"))).alias("key"), "tab")
    return short.withColumn("tab", F.lit(-1)).unionByName(long)


def _may_be_near() -> Column:
    """Whether a pair that shares a key is to be compared by text.

    Behind the first shared key of two prefixes both sets must hold enough shingles; what shares only later keys has
    met at the first. Fingerprints must be near, and the sizes as near as the similarity asks.
    """
    shared = (F.col("n") + F.col("m")) * (SIMILARITY / (1 + SIMILARITY)) - ROUNDING
    enough = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= shared
    apart = F.bit_count(F.col("high").bitwiseXOR(F.col("from_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("from_low")))
    return enough & ((F.col("tab") < 0) | (apart <= HAMMING)) & (F.col("unit") != F.col("from"))


def near_units(frontier: DataFrame, rest: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """unit of every row of ``rest`` that is linked to one of ``frontier`` (both rows of :func:`near_prints`).

    Of the labelled units of a bucket FIRST are compared first, as one link is enough; the others are compared with the
    units that have no link by then, so that no pair is lost and a bucket full of copies does not multiply out.
    """
    nth = F.row_number().over(Window.partitionBy("tab", "key").orderBy("from"))
    names = {"unit": "from", "n": "m", "high": "from_high", "low": "from_low", "i": "j"}
    asked = materialize(_keyed(frontier, masks).withColumnsRenamed(names).withColumn("nth", nth), "asked-keys")
    told = frontier.select(F.col("unit").alias("from"), F.col("normal").alias("other"))

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) >= SIMILARITY for x, y in zip(a, b)], dtype=bool)

    def linked(units: DataFrame, keys: DataFrame) -> DataFrame:
        pairs = _keyed(units, masks).join(keys, ["tab", "key"]).filter(_may_be_near()).select("unit", "from").distinct()
        texts = pairs.join(units.select("unit", "normal"), "unit").join(told, "from")
        return materialize(texts.filter(similar("normal", "other")).select("unit").distinct(), "residue-step")

    first = linked(rest, asked.filter(F.col("nth") <= FIRST))
    more = asked.filter(F.col("nth") > FIRST)
    if more.isEmpty():
        return first
    return first.unionByName(linked(rest.join(first, "unit", "left_anti"), more))


def linked_units(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """unit of every unit without a trusted label in a component with one; ``found`` are rows of :func:`text_units`."""
    words = F.length("normal") - F.length(F.replace("normal", F.lit(" "))) + 1
    able = found.select("unit", "normal", "trusted").filter(~F.col("normal").startswith("place: ") & (words >= LEAST_SHINGLES + SHINGLE - 1))
    once = able.unionByName(seeds).groupBy("unit").agg(F.first("normal").alias("normal"), F.max("trusted").alias("trusted"))
    prints = materialize(near_prints(once), "prints").filter(F.col("n") >= LEAST_SHINGLES)
    masks = selections(prints.filter(F.col("high").isNotNull()).count())
    frontier, rest = prints.filter("trusted"), prints.filter(~F.col("trusted"))
    steps: list[DataFrame] = []
    while not steps or not steps[-1].isEmpty():
        steps.append(near_units(frontier, rest, masks))
        frontier = rest.join(steps[-1], "unit", "left_semi")
        # one anti join with all steps, so that a step does not repeat those before it
        rest = prints.filter(~F.col("trusted")).join(functools.reduce(DataFrame.unionByName, steps), "unit", "left_anti")
    return functools.reduce(DataFrame.unionByName, steps)


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the documents in which residue stands as the whole or in the place of a part.

    Null, empty and blank texts are no case; copies of a document come out each. Columns other than doc_id, text and
    source do not matter, and a null source is none.
    """
    found = materialize(text_units(documents), "units")
    seeds = seed_units(found)
    labelled = found.filter("trusted").select("unit").unionByName(seeds.select("unit")).unionByName(linked_units(found, seeds))
    return found.join(labelled, "unit", "left_semi").select("doc_id").distinct()


def residue_report(documents: DataFrame) -> DataFrame:
    """evidence and documents: for each kind of evidence the documents for which it is the strongest.

    In this order: place, form (both trusted in the document itself), seed (a unit equal to a seed), equal (a unit that
    is trusted in another document), near (a unit that is linked to residue).
    """
    found = materialize(text_units(documents), "units")
    seeds = seed_units(found)
    marked = [found.filter("trusted").select("unit", F.lit(4).alias("by")), seeds.select("unit", F.lit(3).alias("by")), linked_units(found, seeds).select("unit", F.lit(5).alias("by"))]
    labels = functools.reduce(DataFrame.unionByName, marked).groupBy("unit").agg(F.min("by").alias("by"))
    own = F.when(F.col("normal").startswith("place: "), 1).when(F.col("trusted"), 2).otherwise(F.col("by"))
    best = found.join(labels, "unit").groupBy("doc_id").agg(F.min(own).alias("by"))
    name = F.element_at(F.array(*map(F.lit, ("place", "form", "seed", "equal", "near"))), F.col("by"))
    return best.groupBy(name.alias("evidence")).agg(F.count(F.lit(1)).alias("documents"))
