import random

from linkloom.operators.snapshots import snapshot_changes

SYMBOLS = "repositoryCommit string, symbolId string, signature string, normalizedSource string, loadedAt timestamp, pair string, change string"
COMMITS = "repositoryCommit string, repository string, snapshotNo int, extra string"


def test_against_brute_force(spark):
    rng = random.Random(4)
    commits = [(f"c{r}{i}", f"repo{r}", n, "e") for r in range(3) for i, n in enumerate([1, 3, 4, 9])] + [(None, "repo0", 2, ""), ("x", None, 5, "")]
    rows, state = [], {}
    space = lambda t: rng.choice([t, t.replace(" ", "  \n"), f" {t} "]) if t else rng.choice(["", None, "  "])
    for commit, repo, *_ in commits[:12]:
        for s in rng.sample(range(30), 20):
            sig, src = rng.choice(["f ( x )", "g", ""]), rng.choice(["body one", "body two"])
            state[(commit, f"a/{s}")] = (sig, src)
            for _ in range(rng.choice([1, 1, 2])):
                rows.append((commit, rng.choice([f"a/{s}", f" a\\{s}"]), space(sig), space(src), None, "p", "c"))
    rows += [("x", "a/1", "s", "b", None, "", ""), ("unknown", "a/1", "s", "b", None, "", ""), ("c00", None, "s", "b", None, "", ""), (None, "a", "s", "b", None, "", "")]
    expected = set()
    for r in range(3):
        names = [f"c{r}{i}" for i in range(4)]
        for old, new in zip(names, names[1:]):
            a = {s: v for (c, s), v in state.items() if c == old}
            b = {s: v for (c, s), v in state.items() if c == new}
            expected |= {(new, s, "added") for s in b.keys() - a.keys()} | {(new, s, "removed") for s in a.keys() - b.keys()} | {(new, s, "changed") for s in a.keys() & b.keys() if a[s] != b[s]}
    rng.shuffle(rows)
    found = [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame(commits, COMMITS)).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_neighbouring_texts_do_not_run_together_and_empty_tables(spark):
    commits = spark.createDataFrame([("a", "r", 1, ""), ("b", "r", 2, "")], COMMITS)
    rows = [("a", "s", "xy", "z", None, "", ""), ("b", "s", "x", "yz", None, "", "")]
    assert [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SYMBOLS), commits).collect()] == [("b", "s", "changed")]
    assert snapshot_changes(spark.createDataFrame([], SYMBOLS), commits).count() == 0
    assert snapshot_changes(spark.createDataFrame(rows, SYMBOLS), commits.limit(0)).count() == 0
