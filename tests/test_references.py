import random

import numpy as np
import pyarrow as pa

from linkloom.operators.references import missing, orphan_symbols, orphans


def test_equal_hashes_are_told_apart_by_their_keys():
    hashes = np.array([1, 5, 5, 5, 9])
    stored = [pa.array(["a", "b", "c", "d", "e"])]
    gone = missing(hashes, stored, np.array([5, 5, 1, 9, 7]), [pa.array(["d", "x", "a", "e", "q"])])
    assert gone.tolist() == [False, True, False, False, True]


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(1)
    parents = [(f"c{rng.randint(0, 9)}", f"s{rng.randint(0, 200)}", "extra") for _ in range(900)] + [(None, "s", ""), ("c1", None, "")]
    refs = [("c1", "hot-missing", f"r{i}") for i in range(2000)] + [(f"c{rng.randint(0, 11)}", f"s{rng.randint(0, 260)}", f"r{i}") for i in range(3000)]
    refs += [("c1", "hot-missing", "same")] * 500 + [(None, "s1", "x"), ("c1", None, "y")]
    held = {(a, b) for a, b, _ in parents}
    expected = {r for r in refs if r[0] and r[1] and (r[0], r[1]) not in held}
    p = spark.createDataFrame(parents, "commit string, symbolId string, __h string")
    r = spark.createDataFrame(refs, "commit string, symbolId string, who string")
    for limit in (100, 1_000_000):
        assert {tuple(x) for x in orphans(r, p, ["commit", "symbolId"], limit).collect()} == expected


def test_even_load_is_cut_alike(spark):
    p = spark.createDataFrame([(f"c{i}", f"s{i}") for i in range(0, 3000, 2)], "commit string, symbolId string")
    r = spark.createDataFrame([(f"c{i}", f"s{i}", j) for i in range(3000) for j in range(2)], "commit string, symbolId string, n int")
    found = orphans(r, p, ["commit", "symbolId"], 90).collect()
    assert len(found) == 3000 and all(int(x.symbolId[1:]) % 2 for x in found)


def test_empty_sides(spark):
    p = spark.createDataFrame([("c", "s")], "commit string, symbolId string")
    r = spark.createDataFrame([("c", "t", 1)], "commit string, symbolId string, n int")
    assert orphans(r.limit(0), p, ["commit", "symbolId"]).count() == 0
    assert [tuple(x) for x in orphans(r, p.limit(0), ["commit", "symbolId"]).collect()] == [("c", "t", 1)]


def test_references_of_three_tables(spark):
    commits = spark.createDataFrame([("c1", "r", 1, "2025-03-05 00:00:00"), ("c2", "r", 2, "2025-04-05 00:00:00")], "repositoryCommit string, repository string, snapshotNo int, committedAt string").selectExpr("repositoryCommit", "repository", "snapshotNo", "to_timestamp(committedAt) committedAt")
    symbols = spark.createDataFrame([("c1", " ts:a\\b "), ("c2", "ts:z"), (None, "q")], "repositoryCommit string, symbolId string")
    retrieval = spark.createDataFrame(
        [("req-1", "c1", [(1, "ts:a/b", 1.0), (2, "ts:new", 2.0), (2, " ts:new", 2.0), (None, None, None)]), ("req-1", "gone", [(1, "x", 1.0)]), ("r", None, [(1, "x", 1.0)]), ("r", "c1", None), ("r", "c1", []), ("", "c1", [(1, "x", 1.0)])],
        "requirementId string, repositoryCommit string, candidates array<struct<rank:int,symbolId:string,score:double>>",
    )
    labeled = spark.createDataFrame([("r2", "ts:z", "c1"), ("r2", "ts:z", "c2"), ("r2", " ", "c2")], "requirementId string, symbolId string, repositoryCommit string")
    stored = spark.createDataFrame([("r3", "TS:Z", "c2"), ("r3", "TS:Z", "c2"), (None, "TS:Z", "c2")], "requirementId string, symbolId string, commit string")
    found = {tuple(x) for x in orphan_symbols(retrieval, labeled, stored, commits, symbols).collect()}
    assert found == {("retrieval", "2025-03", "REQ-1", "ts:new"), ("labeled_links", "2025-03", "R2", "ts:z"), ("stored_links", "2025-04", "R3", "TS:Z")}


def test_one_reference_that_is_a_third_of_all_rows_is_spread(spark):
    """Equal references lie in several parts of their range, and no part takes many more than it should."""
    rows = [("hot", 1)] * 3000 + [(f"k{i % 500}", i) for i in range(6000)]
    refs = spark.createDataFrame(rows, "k string, n int").repartition(4)
    parents = spark.createDataFrame([(f"k{i}",) for i in range(0, 500, 2)], "k string")
    found = orphans(refs, parents, ["k"], probe_rows=100)
    assert sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[0] == "hot" or int(r[0][1:]) % 2)
    assert orphans(refs, parents, ["k"], probe_rows=100, sample=refs.sample(0.25, seed=3), fraction=0.25).count() == found.count()
