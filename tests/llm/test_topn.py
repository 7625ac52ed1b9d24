import math
import random

import pytest

from linkloom.llm.topn import top_candidates

SCHEMA = "requirementId string, configurationId string, repositoryCommit string, candidates array<struct<rank:int,symbolId:string,score:double>>, place string, extra int"


def brute(rows, n=5):
    best = {}
    for req, conf, commit, items, *_ in rows:
        req = (req or "").strip().upper()
        if not req or conf is None or commit is None:
            continue
        for c in items or []:
            if c is None:
                continue
            rank, sym, score = c
            sym = (sym or "").strip().replace("\\", "/")
            if not sym or score is None or math.isnan(score) or math.isinf(score):
                continue
            key = (-score, rank is None, rank or 0, sym.encode())
            group = best.setdefault((req, conf, commit), {})
            group[sym] = min(group.get(sym, key), key)
    return {(*g, i + 1, s) for g, items in best.items() for i, (s, _) in enumerate(sorted(items.items(), key=lambda x: x[1])[:n])}


@pytest.mark.parametrize("hot", [3, 50, 10**9])  # 3: most of the lists are cut, and into many parts
def test_against_brute_force(spark, hot):
    rng = random.Random(hot)
    score = lambda: rng.choice([1.0, 2.0, 2.0, 0.0, -0.0, rng.random(), None, float("nan"), float("inf")])
    rows = []
    for i in range(900):
        req = rng.choice(["req-1", " REQ-1"]) if rng.random() < 0.4 else rng.choice([None, "  ", f"r{rng.randint(2, 60)}"])
        items = [rng.choice([(rng.choice([None, rng.randint(0, 9)]), rng.choice([f"s{rng.randint(0, 40)}", "a\\b", " a/b", "Ä", None, " "]), score())]) for _ in range(rng.randint(0, 12))]
        row = (req, rng.choice(["x", "x", None]), rng.choice(["c", None, "c"]), rng.choice([items, items, None]), "p", 1)
        rows += [row] * rng.choice([1, 1, 3])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r) for r in top_candidates(df, 5, hot_items=hot).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)


def test_groups_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("r", "x", "c", [(i % 3, f"s{i % 11}", float(i % 5))], "p", 1) for i in range(200)] + [("q", "x", "c", [(1, "only", 1.0)], "p", 1)]
        assert {tuple(r) for r in top_candidates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert top_candidates(spark.createDataFrame([], SCHEMA)).collect() == []
