import math
import random

from linkloom.operators.candidates import first_places, whole_places

SCHEMA = "requirementId string, configurationId string, repositoryCommit string, candidates array<struct<rank:int,symbolId:string,score:double>>, place string, score int"


def brute(rows):
    best = {}
    for req, conf, commit, items, *_ in rows:
        if not (req or "").strip() or conf is None or commit is None:
            continue
        for rank, sym, score in items or []:
            if (sym or "").strip() and score is not None and math.isfinite(score):
                sym = sym.strip().replace("\\", "/")
                key = (-score, rank is None, rank or 0, sym.encode())
                group = best.setdefault((req.strip().upper(), conf, commit), {})
                group[sym] = min(group.get(sym, key), key)
    return {(*g, i + 1, s, -k[0]) for g, items in best.items() for i, (s, k) in enumerate(sorted(items.items(), key=lambda x: x[1]))}


def lists(rng):
    score = lambda: rng.choice([1.0, 2.0, 2.0, 0.0, -0.0, rng.random(), None, float("nan"), float("inf")])
    rows = []
    for _ in range(500):
        req = " req-1" if rng.random() < 0.4 else rng.choice([None, "  ", f"r{rng.randint(2, 40)}"])
        items = [(rng.choice([None, rng.randint(0, 9)]), rng.choice([f"s{rng.randint(0, 30)}", "a\\b", " a/b", "Ä", None, " "]), score()) for _ in range(rng.randint(0, 12))]
        rows += [(req, rng.choice(["x", "x", None]), rng.choice(["c", None, "c"]), rng.choice([items, items, None]), "p", 1)] * rng.choice([1, 1, 3])
    return rows


def test_first_and_whole_places_against_brute_force(spark):
    rows = lists(random.Random(5))
    df, all_ = spark.createDataFrame(rows, SCHEMA).repartition(3), brute(rows)
    found = [tuple(r) for r in first_places(df, 5).collect()]
    assert len(found) == len(set(found)) and set(found) == {r for r in all_ if r[3] <= 5}
    wanted = [("REQ-1", "x", "c", s) for s in ("s1", "s2", "Ä", "absent")]
    asked = spark.createDataFrame([*wanted, wanted[0]], "requirementId string, configurationId string, repositoryCommit string, symbolId string")
    assert {tuple(r) for r in whole_places(df, asked).collect()} == {(*r[:3], r[4], r[3]) for r in all_ if (*r[:3], r[4]) in wanted}


def test_empty(spark):
    assert first_places(spark.createDataFrame([], SCHEMA), 5).collect() == []
