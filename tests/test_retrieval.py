import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.config import LEXICAL_V3, LEXICAL_V4, LEXICAL_V5
from linkloom.functions import text
from linkloom.operators import evaluation, fusion, lexical, semantic
from linkloom.plans import runs

SYMBOL = "symbolId string, kind string, name string, qualifiedName string, relativePath string, startLine int, endLine int, signature string, documentation string, normalizedSource string"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "words"),
    [("expireInactiveSession", ["expire", "inactive", "session"]), ("src/auth\\session-store.ts", ["src", "auth", "session", "store", "ts"]), ("HTTPServer v2Api", ["http", "server", "v2", "api"]), ("REQ_CORE-010", ["req", "core", "010"]), ("", []), ("  ", []), ("naïve Ünïcode, 日本", ["naïve", "ünïcode", "日本"]), (None, [])],
)
def test_tokens(spark, value, words):
    assert one(spark, text.tokens, value) == words


@pytest.mark.parametrize(("term", "first", "second"), [("entries", "entry", "entry"), ("classes", "class", "class"), ("buses", "bus", "buse"), ("ids", "ids", "id"), ("boxes", "box", "box"), ("status", "status", "status"), ("is", "is", "is"), ("uses", "us", "use"), ("ties", "tie", "tie")])
def test_plurals(spark, term, first, second):
    assert [one(spark, lambda c, r=r: text.fold_plural(c, r), term) for r in (1, 2)] == [first, second]


def test_text_helpers(spark):
    assert one(spark, lambda c: text.clip(c, 3), "abcd") == "abc…" and one(spark, lambda c: text.clip(c, 4), "abcd") == "abcd" and one(spark, lambda c: text.clip(c, 4), None) == ""
    assert one(spark, text.wiki_links, "a [[x]] ![[embed]] [[ y|label]] [[ ]] [[z0]]") == ["x", "y", "z0"]
    assert one(spark, text.strip_fence, ' ```json\n{"a": "``"}\n``` trailing') == '{"a": "``"}' and one(spark, text.strip_fence, " x ") == "x"
    body = "## Statement\nfirst\n\nmore\n## Acceptance criteria\n- one\n* two \n-\nthree\n# end"
    assert one(spark, lambda c: text.section(c, "statement"), body) == "first\n\nmore"
    assert one(spark, lambda c: text.list_items(text.section(c, "Acceptance criteria")), body) == ["one", "two"]
    assert one(spark, text.estimate_tokens, "abcde") == 2


def words(value, stop, fold):
    import re

    t = re.sub(r"[_-]+", " ", re.sub(r"[\\/]+", " ", value or ""))
    t = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t))
    return [fold(w) for w in re.sub(r"[^\w\s]|_", " ", t).lower().split() if w not in stop]


def brute_bm25(queries, rows, config, stop, fold):
    fields = [[words(f"{r[2]} {r[3]}", stop, fold), words(r[7], stop, fold), words(r[8], stop, fold), words(r[4], stop, fold), words(r[9], stop, fold)] for r in rows]
    averages = [np.mean([len(f[i]) for f in fields if f[i]] or [1]) for i in range(5)]
    df = Counter(t for f in fields for t in {x for part in f for x in part})
    out = {}
    for name, query in queries:
        scores = []
        for r, f in zip(rows, fields):
            score = 0.0
            for t, qtf in Counter(words(query, stop, fold)).items():
                p = sum(w * part.count(t) / (1 - config.b + config.b * len(part) / a) for w, part, a in zip(config.weights.values(), f, averages))
                if p:
                    score += math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * qtf * p * (config.k1 + 1) / (config.k1 + p)
            inner = sum(o[4] == r[4] and r[5] <= o[5] and r[6] >= o[6] and o[6] - o[5] < r[6] - r[5] for o in rows)
            score *= config.kind_weights.get(r[1], 1.0) / (1 + (config.containment or 0) * inner)
            if score > 0:
                scores.append((-round(score, 9), r[0]))
        out[name] = [s for _, s in sorted(scores)[:5]]
    return out


@pytest.mark.parametrize("config", [LEXICAL_V5, LEXICAL_V4, LEXICAL_V3])
def test_bm25_against_brute_force(spark, config):
    rng = random.Random(8)
    vocabulary = "expire session store token load save user find item query match index build note board".split()
    rows = []
    for i in range(40):
        name = rng.choice(vocabulary) + rng.choice(vocabulary).title()
        start = rng.randint(1, 50)
        rows.append((f"s{i:02}", rng.choice(["function", "file", "class"]), name, f"C.{name}", f"src/{rng.randint(0, 3)}.ts", start, start + rng.randint(0, 30), f"{name}(x: {rng.choice(vocabulary)})", rng.choice([None, "", " ".join(rng.choices(vocabulary, k=6)) + " the"]), " ".join(rng.choices(vocabulary, k=12))))
    queries = [(f"q{i}", " ".join(rng.choices(vocabulary, k=4)) + " and the boards") for i in range(6)] + [("none", "zzz"), ("empty", "")]
    symbols = spark.createDataFrame(rows, SYMBOL).withColumn("doc", F.col("symbolId"))
    found = {}
    for r in lexical.bm25f(spark.createDataFrame(queries, "query string, text string"), symbols, 5, config).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append(r.doc)
    fold = lambda w: "board" if w == "boards" else w  # noqa: E731 - the only plural in here
    expected = brute_bm25(queries, rows, config, set(config.stopwords), fold)
    assert found == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("config", [LEXICAL_V5, LEXICAL_V4, LEXICAL_V3])
def test_bm25_writes_no_pairs(spark, config, monkeypatch):
    """Queries that meet all texts: the best of every task are written, not one row for each pair."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    rows = {}
    monkeypatch.setattr(lexical, "materialize", lambda df, name, save=lexical.materialize: rows.setdefault(name, save(df, name)))
    monkeypatch.setattr(lexical, "TEXT_BLOCK", 500, raising=False)
    symbols = spark.range(4000).selectExpr("concat('s', id) as doc", "'function' as kind", "concat('w', id % 1000) as name", "'load' as qualifiedName", "'p' as relativePath", "cast(id as int) as startLine", "cast(id as int) as endLine", "'' as signature", "'' as documentation", "'save' as normalizedSource")
    queries = spark.range(300).selectExpr("concat('q', id) as query", "concat('load save w', id) as text")
    began = written()
    found = lexical.bm25f(queries, symbols, 3, config).collect()
    assert {q: [r.doc for r in sorted(found, key=lambda r: r.rank) if r.query == q] for q in ("q7", "q299")} == {"q7": ["s1007", "s2007", "s3007"], "q299": ["s1299", "s2299", "s299"]}
    assert len(found) == 900 and max(df.count() for df in rows.values()) < 20_000 and written() - began < 4_000_000


@pytest.mark.parametrize("config", [LEXICAL_V5, LEXICAL_V4, LEXICAL_V3])
def test_terms_of_texts_once_a_word(spark, config, monkeypatch):
    """The words of texts are looked at once a batch, not one by one where they stand, and are those of the columns."""
    rng = random.Random(5)
    ends = ["", "s", "es", "ies", "sses", "ses", "ches", "shes", "xes", "zes", "us", "is", "ss", "ES", "İs", "Σ"]
    parts = lambda: "".join(rng.choice(["The", "of", "HTTPServer", "naïve", "日本", "id", "x9Y", "a", "B", "𝒜", "é"]) + rng.choice(ends) + rng.choice(["", "", "_", "-", "/", "\\", " ", "\t\n", "\u00a0", "'", "\x0b"]) for _ in range(rng.randint(0, 7)))
    rows = [(i, [parts() for _ in range(5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "n int, texts array<string>")
    stop = list(config.stopwords)
    terms = F.array(*[lexical._terms(F.col("texts")[i], stop, config) for i in range(5)])
    saved = []
    monkeypatch.setattr(lexical, "materialize", lambda df, name, save=lexical.materialize: saved.append((name, df)) or save(df, name))
    symbols = spark.createDataFrame([("d", "function", "Loads", "A.loads", "p", 1, 2, "", "", "the boxes")], SYMBOL).withColumn("doc", F.col("symbolId"))
    assert lexical.bm25f(spark.createDataFrame([("q", "box")], "query string, text string"), symbols, 3, config).count() == 1
    forms = next(df for name, df in saved if name == "forms")
    assert "lambdafunction" not in forms._jdf.queryExecution().optimizedPlan().toString()
    found = lexical._with_terms(df.select("n", F.transform("texts", text.words).alias("terms")), stop, config)
    assert {r.n: r.terms for r in found.collect()} == {r.n: r.terms for r in df.select("n", terms.alias("terms")).collect()}


@pytest.mark.parametrize("config", [LEXICAL_V4, LEXICAL_V3])
def test_bm25_takes_texts_and_priors_in_one_pass(spark, config, monkeypatch):
    """Where the prior is of the kind alone, no join puts texts and documents together; null docs count as documents only."""
    saved = []
    monkeypatch.setattr(lexical, "materialize", lambda df, name, save=lexical.materialize: saved.append((name, df)) or save(df, name))
    rows = [(d, kind, "load", "A.load", "p", 1, 2, "", "", "the boxes") for d, kind in (("d", "function"), ("c", "function"), ("b", "file"), ("a", "file"), (None, "function"))]
    rows += [(d, "function", "save", "A.save", "q", 1, 2, "", "", "") for d in ("e", None, None)]
    symbols = spark.createDataFrame(rows, SYMBOL).withColumn("doc", F.col("symbolId"))
    found = lexical.bm25f(spark.createDataFrame([("q", "box")], "query string, text string"), symbols, 3, config).orderBy("rank").collect()
    forms = next(df for name, df in saved if name == "forms")
    assert "Join" not in forms._jdf.queryExecution().optimizedPlan().toString()
    p = 1 / (1 - config.b + config.b * 1)  # of the source, as long as the average
    score = math.log(1 + (8 - 4 + 0.5) / (4 + 0.5)) * (config.k1 + 1) * p / (config.k1 + p)
    assert [(r.doc, round(r.score, 6)) for r in found] == [("c", round(score, 6)), ("d", round(score, 6)), ("a", round(score / 2, 6))]


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_bm25_shuffles_documents_of_found_groups_only(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "WANTED", most, raising=False)
    symbols = spark.range(500).selectExpr("concat('s', id) as doc", "'function' as kind", "concat('w', id % 100) as name", "'load' as qualifiedName", "'p' as relativePath", "1 as startLine", "2 as endLine", "'' as signature", "'' as documentation", "'save' as normalizedSource")
    found = lexical.bm25f(spark.createDataFrame([("q", "w7")], "query string, text string"), symbols, 3, LEXICAL_V4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (most > 0)
    assert [r.doc for r in found.orderBy("rank").collect()] == ["s107", "s207", "s307"]


def test_stopwords_are_looked_up_once_a_word(spark, monkeypatch):
    plans = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "collect", lambda df, get=frame.collect: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or get(df))
    symbols = spark.createDataFrame([("s", "function", n, "A.x", "p", 1, 2, "", "", "") for n in ("ofThe", "theWills", "mays")], SYMBOL)
    stop = lexical.effective_stopwords(symbols, LEXICAL_V4)
    assert set(LEXICAL_V4.stopwords) - set(stop) == {"of", "the", "will", "may", "a"}
    assert "Union" not in plans[0]


def test_containment_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"d{i}", rng.choice(["a", "a", "b", None]), rng.choice([None, 0, rng.randint(1, 40)]), rng.choice([None, -3, 0, *[rng.randint(1, 60)] * 5])) for i in range(300)]
    fit = [r for r in rows if None not in r and r[3] >= 0]
    expected = {r[0]: 0 for r in rows}
    for d, p, s, e in fit:
        expected[d] = sum(p == q and s <= t and f <= e and f - t < e - s for _, q, t, f in fit)
    df = spark.createDataFrame(rows, "doc string, path string, start int, end int")
    assert {r.doc: r.inner for r in lexical.contained_counts(df).collect()} == expected
    assert lexical.contained_counts(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", [1 << 18, 20])
def test_containment_on_one_task_per_file(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "FILE_SPANS", most)
    rng = random.Random(4)
    rows = [(f"d{i:03}", rng.choice(["a", "a", "b", "c", f"p{i % 90}", None]), rng.choice([None, 0, *[rng.randint(1, 20)] * 9]), rng.choice([None, -3, 0, *[rng.randint(1, 30)] * 9])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc string, path string, start int, end int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    found = {r.doc: r.inner for r in lexical._with_inner(df).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    fit = [r for r in rows if None not in r and r[3] >= 0]
    assert found == {d: sum(p == q and s <= t and f <= e and f - t < e - s for _, q, t, f in fit) if None not in (p, s, e) and e >= 0 else 0 for d, p, s, e in rows}


def test_stopwords_that_name_identifiers_stay(spark):
    symbols = spark.createDataFrame([("s", "function", "toItem", "Any.toItem", "p", 1, 2, "", "", "")], SYMBOL)
    kept = lexical.effective_stopwords(symbols)
    assert "to" not in kept and "any" not in kept and "the" in kept
    assert "to" in lexical.effective_stopwords(symbols, LEXICAL_V3)


@pytest.mark.parametrize("in_place", [0, 1 << 20])
def test_nearest_against_brute_force(spark, monkeypatch, in_place):
    monkeypatch.setattr(semantic, "QUERY_BYTES", in_place)
    monkeypatch.setattr(semantic, "ITEM_SLICE", 7)
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 3)
    monkeypatch.setattr(semantic, "ITEM_PART", 20)
    rng = np.random.default_rng(1)
    items = [(i, rng.normal(size=6).tolist()) for i in range(90)] + [(200, [0.0] * 6), (201, None), (202, [1.0, 2.0]), (203, None)]
    items.append((204, items[0][1]))
    queries = [(i, items[i][1]) for i in range(0, 10)] + [(300, None)]
    q, it = spark.createDataFrame(queries, "query bigint, vector array<double>"), spark.createDataFrame(items, "item bigint, vector array<double>")
    found = {}
    for r in semantic.nearest(q, it, 4).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append(r.item)
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for name, v in queries[:10]:
        ranked = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in items if w and len(w) == 6)
        assert found[name] == [i for _, i in ranked[:4]]
    assert semantic.nearest(q.limit(0), it).count() == 0 and semantic.nearest(q, it.limit(0)).count() == 0


def test_fusion(spark):
    schema = "q string, item string, rank int, score double"
    first = spark.createDataFrame([("a", "x", 1, 9.0), ("a", "y", 2, 5.0), ("b", "z", 1, 3.0)], schema)
    second = spark.createDataFrame([("a", "y", 1, 0.9), ("a", "w", 2, 0.1), ("c", "v", 1, -1.0)], schema)
    rrf = [tuple(r) for r in fusion.reciprocal_rank_fusion(first, second, ["q"], 2).orderBy("q", "rank").collect()]
    assert [r[:3] for r in rrf] == [("a", 1, "y"), ("a", 2, "x"), ("b", 1, "z"), ("c", 1, "v")] and rrf[0][3] == pytest.approx(1 / 62 + 1 / 61)
    weighted = {(r.q, r.item): r.score for r in fusion.weighted_fusion(first, second, ["q"], 5, 0.25).collect()}
    assert weighted == {("a", "x"): 0.25, ("a", "y"): 0.75, ("a", "w"): 0.0, ("b", "z"): 0.25, ("c", "v"): 0.75}


def test_metrics_and_comparison(spark):
    lists = spark.createDataFrame([("r1", "a", 1), ("r1", "a", 4), ("r1", "b", 2), ("r1", "c", 3), ("r2", "d", 2), ("r3", "e", 1)], "r string, item string, rank int")
    truth = spark.createDataFrame([("r1", "c"), ("r1", "z"), ("r1", "c"), ("r2", "d"), ("r4", "q")], "r string, item string")
    scope = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "r string")
    items = {x.r: x for x in evaluation.scored_items(lists, truth, scope, ["r"]).collect()}
    assert (items["r1"].recall_3, items["r1"].hit_1, items["r1"].reciprocal_rank) == (0.5, 0.0, pytest.approx(1 / 3))
    assert items["r3"].recall_1 is None and items["r4"].recall_10 == 0.0 and items["r4"].reciprocal_rank == 0.0
    total = evaluation.averaged(evaluation.scored_items(lists, truth, scope, ["r"]), []).first()
    assert (total.scored, total.unscored, total.recall_3, total.hit_3) == (3, 1, 0.5, pytest.approx(200 / 3)) and total.mrr == pytest.approx((1 / 3 + 1 / 2) / 3)
    pairs = "g string, a string"
    found = {r.g: r for r in evaluation.prediction_metrics(spark.createDataFrame([("x", "1"), ("x", "2"), ("x", "2"), ("y", "1")], pairs), spark.createDataFrame([("x", "2"), ("x", "3"), ("z", "1")], pairs), ["a"], ["g"]).collect()}
    assert (found["x"].precision, found["x"].recall, found["x"].f1) == (0.5, 0.5, 0.5) and (found["y"].precision, found["y"].f1, found["z"].recall) == (0.0, 0.0, 0.0)
    metrics = spark.createDataFrame([("m", "s", 0.5), ("n", "s", 0.5), ("m", "t", 0.1)], "configuration string, stratum string, recall double")
    assert {tuple(r) for r in evaluation.compare(metrics, "configuration", "stratum", "recall").collect()} == {("s", 2, 0.5, "m,n"), ("t", 1, 0.1, "m")}
    assert evaluation.shared_ks({"a": [1, 3, 5], "b": [1, 5, 10]}) == ([1, 5], {3: ["a"], 10: ["b"]})


def fakes():
    """An embedder and a model that the workers need no module for."""

    def embedder(texts):
        import hashlib

        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]

    def model(prompt):
        import json
        import re

        if "fail" in prompt:
            raise RuntimeError("no answer")
        ids = re.findall(r"symbolId: (\S+)", prompt)
        return json.dumps({"verdicts": [{"symbolId": s, "classification": "implements", "confidence": 0.8, "rationale": "it does"} for s in ids[:-1]]})

    return embedder, model


def test_runs_and_sweep(spark):
    fake_embedder, fake_model = fakes()
    rows = [(f"s{i}", "function", f"loadItem{i}", f"loadItem{i}", "src/a.ts", i, i, f"loadItem{i}()", "loads the item", f"return {i}") for i in range(6)]
    symbols = spark.createDataFrame(rows, SYMBOL)
    queries = spark.createDataFrame([("r1", "load item"), ("r2", "fail to load")], "requirementId string, text string")
    hybrid = runs.retrieve("hybrid", queries, symbols, 3, embedder=fake_embedder, dimensions=8)
    assert hybrid.groupBy("requirementId").count().collect() == hybrid.groupBy("requirementId").count().filter("count = 3").collect()
    cache = runs.semantic_run(queries, symbols, 2, fake_embedder, 8)[1]
    assert cache.count() == 8
    again, used = runs.semantic_run(queries, symbols, 2, lambda t: 1 / 0, 8, cache)  # everything is cached
    assert again.count() == 4 and used.count() == 8
    proposals, failures = runs.analyze(queries, symbols, fake_model, 2)
    assert [(p.requirementId, p.band) for p in proposals.collect()] == [("r1", "suggest")]
    assert sorted((f.requirementId, f.rule) for f in failures.collect()) == [("r1", "missing-verdict"), ("r2", "provider-error")]
    relevant = spark.createDataFrame([("r1", "s0"), ("r2", "s1")], "requirementId string, item string")
    metrics, skipped = runs.sweep([{"mode": "lexical"}, {"mode": "semantic"}], queries, symbols, relevant, 5)
    assert metrics.count() == 1 and "semantic" in skipped


def test_whole_metrics_rank_whole_lists_of_all_requirements(spark, tmp_path):
    from linkloom.queries import reference

    sym = lambda i: f"ts:src/a.ts#f{i:02d}:function"
    listed = lambda ids: [(n + 1, sym(i), 100.0 - n) for n, i in enumerate(ids)]
    reqs = [("REQ-A-0001", "a", "s", ["x"], "high-overlap"), ("REQ-A-0002", "b", "s", ["x"], "high-overlap"), ("REQ-A-0003", "c", "s", ["x"], None), ("REQ-A-0004", "d", "s", ["x"], None)]
    spark.createDataFrame(reqs, "id string, title string, statement string, acceptance_criteria array<string>, difficulty string").write.parquet(f"{tmp_path}/requirements.parquet")
    # the only independent label of 1 stands at place 12 (two pieces, one symbol twice); 2 is labelled and has no list; 3 only by review; 4 has no label
    rows = [("REQ-A-0001", "bm25f-v5", "c1", listed(range(1, 8))), ("REQ-A-0001", "bm25f-v5", "c1", [(None, sym(i), 50.0 - i) for i in [7, *range(8, 14)]]), ("REQ-A-0003", "bm25f-v5", "c1", listed([1, 2])), ("REQ-A-0004", "semantic-v2", "c1", [])]
    spark.createDataFrame(rows, "requirementId string, configurationId string, repositoryCommit string, candidates array<struct<rank int, symbolId string, score double>>").write.parquet(f"{tmp_path}/retrieval.parquet")
    labels = [("REQ-A-0001", sym(12), "independent"), ("REQ-A-0001", sym(1), "candidate-review"), ("REQ-A-0002", sym(5), "independent"), ("REQ-A-0003", sym(2), "candidate-review"), ("REQ-A-0004", sym(2), None)]
    spark.createDataFrame([(*x, "implements", "c1") for x in labels], "requirementId string, symbolId string, labelPass string, relationship string, repositoryCommit string").write.parquet(f"{tmp_path}/labeled_links.parquet")
    found = {(r.configurationId, r.stratum): (r.scored, r.unscored, r.mrr, r.recall_10, r.hit_1) for r in reference.retrieval_metrics(spark, str(tmp_path)).collect()}
    single = (2, 2, round(1 / 24, 9), 0.0, 0.0)
    assert found == {
        ("bm25f-v5", "overall"): single, ("bm25f-v5", "independent-only"): single, ("bm25f-v5", "high-overlap"): (2, 0, *single[2:]),
        ("bm25f-v5", "independent-plus-candidate-review"): (3, 1, 0.5, 0.5, round(100 / 3, 7)),
        ("semantic-v2", "overall"): (2, 2, 0.0, 0.0, 0.0), ("semantic-v2", "independent-only"): (2, 2, 0.0, 0.0, 0.0), ("semantic-v2", "high-overlap"): (2, 0, 0.0, 0.0, 0.0),
        ("semantic-v2", "independent-plus-candidate-review"): (3, 1, 0.0, 0.0, 0.0),
    }
    assert {r.stratum: r.best_by for r in reference.config_comparison(spark, str(tmp_path)).collect()}["independent-plus-candidate-review"] == "bm25f-v5"
    assert {r.stratum: r.bm25f_v5 for r in reference.config_pivot(spark, str(tmp_path)).collect()}["overall"] == single[2]


@pytest.mark.parametrize("name", ["bm25f_v3_topk", "bm25f_v4_topk"])
def test_bm25_asks_for_every_requirement(spark, tmp_path, name):
    """Whatever the number of a requirement is, and without one; the SQL asks for the same."""
    import duckdb

    from linkloom.queries import reference
    from linkloom.queries.reference_sql import SQL

    rows = [("REQ-A-0001", "load a board", "s"), ("REQ-A-0020", "save the boards", "s"), (" req-a-0037 ", "loaded board", None), ("REQ-A", "save", "x"), ("REQ-A-9999999999", "load", "x"), ("REQ-A-0002", "zebra", "s"), (None, "load", "x")]
    spark.createDataFrame([(*r, []) for r in rows], "id string, title string, statement string, acceptance_criteria array<string>").selectExpr("*", "'' as difficulty").write.parquet(f"{tmp_path}/requirements.parquet")
    symbols = [(f"ts:a.ts#{n}:function", "function", n, f"A.{n}", "a.ts", i, i + 1, "", "", "", "c1", None) for i, n in enumerate(("loadBoard", "saveBoard", "other"))]
    spark.createDataFrame(symbols, SYMBOL + ", repositoryCommit string, loadedAt timestamp").write.parquet(f"{tmp_path}/symbol_index.parquet")
    found = sorted(map(tuple, reference.QUERIES[name](spark, str(tmp_path)).collect()))
    assert {r[0] for r in found} == {"REQ-A-0001", "REQ-A-0020", "REQ-A-0037", "REQ-A", "REQ-A-9999999999"}
    con = duckdb.connect()
    for t in ("requirements", "symbol_index"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(con.sql(SQL[name]).fetchall()) == found


@pytest.mark.parametrize("config", [LEXICAL_V5, LEXICAL_V4, LEXICAL_V3])
def test_bm25_deals_many_queries_to_tasks(spark, config, monkeypatch):
    """The best are written once a part of the texts, and there are fewer parts than partitions of texts; blocks of any size."""
    monkeypatch.setattr(lexical, "TEXT_BLOCK", 7)
    monkeypatch.setattr(lexical, "DEALT_QUERIES", 2, raising=False)
    saved = {}
    monkeypatch.setattr(lexical, "materialize", lambda df, name, save=lexical.materialize: saved.setdefault(name, save(df, name)))
    rng = random.Random(3)
    vocabulary = "expire session store token load save user find item query match index build note board".split()
    rows = [(f"s{i:03}", rng.choice(["function", "file", "class"]), rng.choice(vocabulary), "C", "a.ts", i, i + rng.randint(0, 9), rng.choice(vocabulary), "", " ".join(rng.choices(vocabulary, k=5))) for i in range(150)]
    queries = [(f"q{i}", " ".join(rng.choices(vocabulary, k=4))) for i in range(17)] + [("none", "zzz")]
    symbols = spark.createDataFrame(rows, SYMBOL).withColumn("doc", F.col("symbolId"))
    found = {}
    for r in lexical.bm25f(spark.createDataFrame(queries, "query string, text string"), symbols, 5, config).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append(r.doc)
    assert found == {k: v for k, v in brute_bm25(queries, rows, config, set(config.stopwords), lambda w: w).items() if v}
    # eight tasks, the first with two parts of the texts for at most three queries
    assert len(saved["best"].inputFiles()) >= 8 and saved["best"].count() <= (17 + 3) * 5
