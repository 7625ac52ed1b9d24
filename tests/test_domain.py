import json

import pytest
from pyspark.sql import functions as F

from linkloom.functions import ids
from linkloom.operators import documents, links, payload, review
from linkloom.sources import artifacts, exclusions, extractor, files, frontmatter, scanner, settings


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ids(spark):
    df = spark.createDataFrame([(" ts:a\\b#C.d:method　", " req-1\t"), ("", " "), (None, None)], "s string, r string")
    found = df.select(ids.symbol_id(F.col("s")), ids.requirement_id(F.col("r")), ids.symbol_path(ids.symbol_id(F.col("s")))).collect()
    assert [tuple(r) for r in found] == [("ts:a/b#C.d:method", "REQ-1", "a/b"), (None, None, None), (None, None, None)]
    with pytest.raises(Exception, match="absolute path"):
        spark.createDataFrame([("/etc/x", "q", "file")], "p string, q string, k string").select(ids.base_symbol_id(F.col("p"), F.col("q"), F.col("k"))).collect()


LOG = "seq bigint, requirementId string, proposedSymbolId string, symbolId string, kind string, relationship string, modelClassification string, modelConfidence double, band string, reviewer string, timestamp string, repositoryCommit string"


def test_decision_log(spark):
    raw = [
        (1, "r", "a", "a", "accept", "implements", "implements", 0.9, "suggest", "x", "t9", "c"), (2, "r", "a", "b", "Redirect ", "supports", "implements", 0.9, "suggest", "x", "t1", "c"), (2, "R ", "a", "b", "redirect", "supports", "implements", 0.9, "suggest", "x", "t1", "c"),
        (3, "r", "c", "c", "reject", None, "supports", 0.6, "suggest", "x", "t", "c"), (4, "r", "d", "d", "accept", None, "unrelated", 0.9, "discard", "x", "t", "c"), (5, "r", "e", "e", "reject", None, None, None, None, "x", "t", "c"), (6, None, "e", "e", "accept", None, None, None, None, "x", "t", "c"), (None, "r", "e", "e", "accept", None, None, None, None, "x", "t", "c"), (7, "r", "e", "e", "undo", None, None, None, None, "x", "t", "c"),
    ]
    log = review.decision_log(spark.createDataFrame(raw, LOG))
    assert log.count() == 5
    assert [(r.proposedSymbolId, r.symbolId) for r in review.accepted_links(log).orderBy("proposedSymbolId").collect()] == [("a", "b"), ("d", "d")]
    stats = {r.band: r for r in review.review_statistics(log).collect()}
    assert (stats["all"].decided, stats["all"].overrides, stats["suggest"].redirected, stats["discard"].overrides) == (4, 3, 1, 1)
    proposals = spark.createDataFrame([("R", "a", 0.1, "implements"), ("R", "z", 0.75, "implements"), ("R", "y", 0.5, "supports"), ("R", "x", 0.99, "unrelated"), ("R", "w", None, "implements")], "requirementId string, symbolId string, confidence double, classification string")
    banded = review.bucketed(proposals, review.recorded_bands(log))
    assert {(r.symbolId, r.band, r.reviewed) for r in banded.collect()} == {("a", "suggest", True), ("z", "suggest", False), ("y", "review", False), ("x", "discard", False), ("w", "discard", False)}
    queue = review.review_queue(banded, spark.createDataFrame([("R", "y")], "requirementId string, symbolId string"))
    assert {(r.symbolId, r.stale) for r in queue.collect()} == {("z", False), ("y", True)}
    batch = spark.createDataFrame([("R", "z", "accept", None, "me"), ("R", "z", "accept", "q", "me"), ("R", "z", "redirect", " ", "me"), ("R", "z", "reject", None, "\t"), ("R", "nope", "accept", None, "me"), ("R", "z", "undo", None, "me"), ("R", "y", "redirect", "q", "me")], "requirementId string, symbolId string, kind string, redirectTo string, reviewer string")
    assert sorted(str(r.problem) for r in review.check_decisions(batch, proposals).collect()) == ["None", "None", "blank-reviewer", "redirect-without-target", "target-without-redirect", "unknown-kind", "unmatched-proposal"]


def test_links(spark):
    schema = "requirementId string, symbolId string, reviewer string, timestamp string, commit string"
    raw = spark.createDataFrame([(" r1", "a", "x", "2", "c2"), ("R1", "a ", "y", "1", "c1"), ("R1", "b", None, None, None), ("R2", "b", "x", "1", "c1"), (None, "b", "x", "1", "c1")], schema)
    index = links.link_index(links.clean_links(raw)).cache()
    assert rows(index.select(*schema.replace(" string", "").split(", "))) == [("R1", "a", "y", "1", "c1"), ("R1", "b", None, None, None), ("R2", "b", "x", "1", "c1")]
    assert [tuple(r) for r in links.adjacency(index, "symbolId", "requirementId").collect()] == [("a", "R1"), ("b", "R1"), ("b", "R2")]
    assert rows(links.symbols_for(index, "R1")) == [("a",), ("b",)] and rows(links.requirements_for(index, "b")) == [("R1",), ("R2",)]
    reqs = spark.createDataFrame([("R1",), ("R2",), ("R3",), (None,)], "requirementId string")
    assert rows(links.unlinked(reqs, index)) == [("R3",)]
    broken = spark.createDataFrame([("b",)], "symbolId string")
    cover = links.coverage(reqs, index, broken)
    assert rows(cover) == [("R1", "linked", 2, 1), ("R2", "stale", 1, 1), ("R3", "unlinked", 0, 0)]
    assert rows(links.coverage_summary(cover)) == [("linked", 1, 2, 1), ("stale", 1, 1, 1), ("unlinked", 1, 0, 0)]
    other = spark.createDataFrame([("R1", "a", "y", "1", "c1"), ("R1", "b", None, None, "c"), ("R9", "z", "x", "1", "c")], schema)
    assert rows(links.reconcile(index, other)) == [("R1", "b", "field-mismatch"), ("R2", "b", "missing-from-index"), ("R9", "z", "absent-from-frontmatter")]
    known = spark.createDataFrame([("a",)], "symbolId string")
    before = spark.createDataFrame([("R2", "b", "c7")], "requirementId string, symbolId string, last string")
    assert rows(links.resolve(index, known, before, F.lit("now"))) == [("R1", "a", True, "now", "now"), ("R1", "b", False, None, "now"), ("R2", "b", False, "c7", "now")]
    proposals = spark.createDataFrame([("R", "a"), ("R", "ts:dist/x.ts#f:function"), ("R", "ts:src/x.ts#f:function"), ("R", "odd")], "requirementId string, symbolId string")
    assert {(r.symbolId, r.reason) for r in links.proposal_staleness(proposals, known, exclusions.excluded_path).collect()} == {("a", None), ("ts:dist/x.ts#f:function", "excluded"), ("ts:src/x.ts#f:function", "missing"), ("odd", "missing")}
    gone = spark.createDataFrame([("c", "old", "h"), ("c", "none", None)], "repositoryCommit string, symbolId string, body string")
    new = spark.createDataFrame([("c", "new2", "h"), ("c", "new1", "h"), ("d", "new0", "h")], "repositoryCommit string, symbolId string, body string")
    assert rows(links.renames(gone, new)) == [("c", "old", "new1", 2)]
    lists = "k string, item string, rank int"
    assert rows(links.result_differences(spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], lists), spark.createDataFrame([("q", "a", 1), ("q", "c", 2)], lists), ["k"])) == [("q", "b", 2, None), ("q", "c", None, 2)]


def test_payload_and_verdicts(spark):
    symbols = spark.createDataFrame([("a", "function", "A", "p", 1, 2, "s" * 600, None, "x")], "symbolId string, kind string, qualifiedName string, relativePath string, startLine int, endLine int, signature string, documentation string, normalizedSource string")
    candidates = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("q", "a", 1)], "requirementId string, symbolId string, rank int")
    with pytest.raises(Exception, match="not in the index"):
        payload.payload_items(candidates, symbols, ["requirementId"], 2).collect()
    items = payload.payload_items(candidates, symbols, ["requirementId"], 2, strict=False)
    assert items.filter("requirementId = 'r'").first().signature == "s" * 500 + "…"
    sent = items.unionByName(items.filter("requirementId = 'q'").withColumn("symbolId", F.lit("z")).withColumn("source", F.lit("y" * 3000))).unionByName(items.filter("requirementId = 'r'").withColumn("requirementId", F.lit("new")))
    found = {(r.requirementId, r.symbolId, r.rule) for r in payload.audit(sent, candidates, ["requirementId"], 1).collect()}
    assert found == {("q", None, "excess-items"), ("q", "z", "unretrieved-item"), ("q", "z", "oversized-field"), ("new", None, "unknown-list")}
    assert tuple(payload.tallies(sent, candidates, ["requirementId"], 1).first()) == (4, 3, 2)
    entries = [
        {"symbolId": "a", "classification": "implements", "confidence": "0.9", "rationale": "text"}, {"symbolId": "a", "classification": "implements", "confidence": 0.9, "rationale": "text"}, {"symbolId": "x", "classification": "implements", "confidence": 1, "rationale": "t"},
        "no object", {"symbolId": "b", "classification": "supports", "confidence": 1, "rationale": " why\n"}, {"symbolId": "c", "classification": "maybe", "confidence": 1, "rationale": "t"}, {"symbolId": "d", "classification": "supports", "confidence": 1.5, "rationale": "t"}, {"symbolId": "e", "classification": "supports", "confidence": 0, "rationale": " "},
    ]
    bodies = [("r", "```json\n" + json.dumps({"verdicts": entries}) + "\n```"), ("bad", "no json"), ("list", "[1]"), ("none", '{"verdicts": {}}'), ("null", None)]
    held = spark.createDataFrame([("r", s, i) for i, s in enumerate("abcdef")], "requirementId string, symbolId string, rank int")
    proposals, failures = payload.verdicts(spark.createDataFrame(bodies, "requirementId string, body string"), held, ["requirementId"])
    assert rows(proposals) == [("r", "b", 1, "supports", 1.0, "why")]
    assert rows(failures.select("requirementId", "symbolId", "rule")) == sorted([
        ("r", "a", "confidence-out-of-range"), ("r", "a", "duplicate-symbol"), ("r", "x", "unknown-symbol"), ("r", None, "schema-mismatch"), ("r", "c", "unknown-classification"), ("r", "d", "confidence-out-of-range"),
        ("r", "e", "empty-rationale"), ("r", "f", "missing-verdict"), ("bad", None, "invalid-json"), ("list", None, "schema-mismatch"), ("none", None, "schema-mismatch"), ("null", None, "invalid-json"),
    ], key=str)
    usage = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), (None, 5, 6)], "requirementId string, inputTokens bigint, outputTokens bigint")
    assert rows(payload.usage_totals(usage)) == [("a", False, 2, 4, 6), (None, True, 3, 9, 12)]


GOOD = "---\nid: REQ-1\ntitle: One\nstatus: proposed\nlinks:\n  - symbol: s\n    reviewer: r\n    timestamp: t\n    commit: c\n  - symbol: s\nowner: me\n---\n## Statement\nDo it.\n\n## Acceptance criteria\n- a\n- b\n"


def test_documents(spark, tmp_path):
    docs = [("a.md", GOOD), ("b\\c.md", "---\nid: REQ-1\ntitle: Two\nstatus: odd\npriority: P9\nacceptance_criteria: [x, ' ']\nstatement: front\n---"), ("none.md", "no front"), ("bad.md", "---\n[a, b]\n---\n"), ("empty.md", "---\ntitle: ' '\nlinks: 3\n---\n"), ("null.md", None)]
    parsed = documents.parse_documents(spark.createDataFrame(docs, "path string, content string")).cache()
    found = {r.path: r for r in parsed.collect()}
    assert (found["a.md"].statement, found["a.md"].criteria, found["a.md"].priority, [x.symbol for x in found["a.md"].links], found["a.md"].violations) == ("Do it.", ["a", "b"], "P1", ["s"], ["malformed-links:links"])
    assert (found["b/c.md"].statement, found["b/c.md"].criteria, found["b/c.md"].warnings, found["b/c.md"].valid) == ("front", ["x"], ["unknown-status:status", "unknown-priority:priority"], True)
    assert all(found[p].violations == ["malformed-frontmatter"] and not found[p].valid for p in ("none.md", "bad.md", "null.md"))
    assert found["empty.md"].violations == ["missing-field:id", "missing-field:title", "missing-field:status", "no-acceptance-criteria", "malformed-links:links"]
    assert rows(documents.duplicate_documents(parsed)) == [("a.md", "REQ-1", 2), ("b/c.md", "REQ-1", 2)]
    report = documents.validation_report(parsed)
    assert report.filter("rule = 'duplicate-id'").count() == 2 and report.filter("level = 'warning'").count() == 2
    held = spark.createDataFrame([("specs/a.md", "REQ-1"), ("other/a.md", "REQ-2")], "path string, requirementId string")
    asked = spark.createDataFrame([(1, "specs/a"), (1, "a"), (1, "REQ-2"), (1, "nope")], "doc int, target string")
    assert rows(documents.resolve_wiki_links(asked, held)) == [(1, "REQ-2", "other/a.md"), (1, "a", "other/a.md"), (1, "nope", None), (1, "specs/a", "specs/a.md")]
    assert documents.next_requirement_id(spark.createDataFrame([("P-007",), ("P-0041",), ("Q-9",)], "id string"), "P") == "P-0042"
    (tmp_path / "specs" / "sub dir").mkdir(parents=True)
    (tmp_path / "specs" / "sub dir" / "x+1.md").write_text("text\nmore")
    (tmp_path / "specs" / "y.txt").write_text("no")
    vault, missing = files.read_vault(spark, f"file://{tmp_path}", ["specs", "gone"], spark.createDataFrame([("specs/none.md", "z")], "path string, content string"))
    assert rows(vault) == [("specs/sub dir/x+1.md", "text\nmore")] and missing == ["gone"]


def test_links_are_written_back_and_strict_loading(spark):
    schema = "path string, content string"
    docs = spark.createDataFrame([("a.md", GOOD), ("b.md", GOOD.replace("REQ-1", "REQ-2").replace("owner: me", "difficulty: high-overlap")), ("c.md", GOOD.replace("REQ-1", "REQ-2").replace("owner: me", "difficulty: x")), ("bad.md", "x")], schema)
    links = spark.createDataFrame([("REQ-1", "s", "r", "t", "c"), ("REQ-2", "n: #1", "r", None, "c"), ("REQ-2", "a", "r", "t", "c")], "id string, symbol string, reviewer string, timestamp string, commit string")
    changed = documents.write_links(docs, links)
    assert {r.path for r in changed.collect()} == {"b.md", "c.md"}
    again = documents.parse_documents(changed)
    found = {r.path: r for r in again.collect()}
    assert [x.symbol for x in found["b.md"].links] == ["a"] and found["b.md"].statement == "Do it." and "difficulty: high-overlap" in {r.path: r.content for r in changed.collect()}["b.md"]
    kept, rejected = documents.strict_requirements(documents.parse_documents(docs))
    assert [(r.path, r.difficulty) for r in kept.collect()] == [("b.md", "high-overlap")]
    assert rows(rejected) == [("a.md", "REQ-1", "missing-difficulty"), ("bad.md", None, "invalid-document"), ("c.md", "REQ-2", "duplicate-id")]


def test_frontmatter_without_a_yaml_library(monkeypatch):
    text = "id: 'a b'\nn: 3\nflag: true\nlist:\n- x\n- \"y\"\nmaps:\n  - k: 1\n    v: two words\n  - k: 2\nempty:\ninline: [a, 'b, c']\n# note\n"
    expected = {"id": "a b", "n": 3, "flag": True, "list": ["x", "y"], "maps": [{"k": 1, "v": "two words"}, {"k": 2}], "empty": None, "inline": ["a", "b, c"]}
    assert frontmatter.read_mapping(text) == expected
    monkeypatch.setattr(frontmatter, "yaml", None)
    assert frontmatter.read_mapping(text) == expected


def test_settings():
    s = settings.parse_settings("retrieval:\n  mode: hybrid\n  topK: 0\n  extra: 1\nbands:\n  suggest: 0.4\n  review: 0.6\nwhat: 1\nexclude: [a]\n")
    assert (s.mode, s.top_k, s.suggest, s.exclude) == ("hybrid", 10, 0.75, ["a"])
    assert set(s.warnings) == {("what", "unknown-key"), ("retrieval.extra", "unknown-key"), ("retrieval.top_k", "invalid-value"), ("bands", "invalid-value")}
    assert settings.parse_settings(None).warnings == [("", "missing-config")] and settings.parse_settings("- a").warnings == [("", "malformed-config")]
    assert settings.parse_ks("5, 1,5") == (1, 5)


def test_exclusions(spark):
    paths = {"src/a.ts": False, "node_modules/x/a.ts": True, "src/dist/a.ts": True, "src/dist.ts": False, "lib/a.min.js": True, "keep/no.ts": True, "keep/yes.ts": False, "deep/er/tmp/x.ts": True, "a/b.gen.ts": True, "docs/x/y.ts": True, "src\\build\\a.ts": True}
    patterns = ["# note", "", "/keep/*.ts", "!/keep/yes.ts", "tmp/", "*.gen.ts", "docs/**/y.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.x for r in df.select("p", exclusions.excluded_path(F.col("p"), patterns).alias("x")).collect()} == paths


SOURCE = """/** Head. */
import x from "y";
export interface Used extends Base { a: { b: string } }
interface Unused { a: string }
/** Does it. */
@dec({ a: 1 })
export class Box<T> extends Base implements Used {
  private f = (a: string) => { return /[}]/.test(a); };
  constructor() {}
  constructor(private a: Used) { super(`}${a ? "}" : `{`}`); }
  static async load<T>(id: string, ...rest: T[]): Promise<Map<string, Used>> { return new Map(); }
  get v(): { a: number } { return { a: 1 }; }
  set v(x: { a: number }) { this.f("x"); }
  abstract other(): void;
}
export function over(a: string): void;
export function over(a: string | { k: () => void } = "x"): void { if (a) { } }
function hidden() { return 1 / 2 / 3; }
export const arrow = async (a: number): Promise<void> => { await a; }, plain = 5;
const expr = function named(b) { return b; };
"""


def test_extractor(spark):
    df = spark.createDataFrame([("src/box.ts", SOURCE), ("src/empty.ts", None), (None, "x"), ("src/broken.ts", "class {{{ ( function `")], "path string, content string")
    found = {(r.relativePath, r.kind, r.signature): r for r in extractor.extract_symbols(df, "c1").collect()}
    signatures = {k[2] for k in found if k[0] == "src/box.ts"}
    assert signatures == {
        "", "interface Used extends Base", "class Box extends Base implements Used", "constructor(private a: Used)", "static async load(id: string, ...rest: T[]): Promise<Map<string, Used>>", "v(): { a: number }", "v(x: { a: number })",
        'function over(a: string | { k: () => void } = "x"): void', "function hidden()", "async function arrow(a: number): Promise<void>", "function expr(b)",
    }
    cls = found["src/box.ts", "class", "class Box extends Base implements Used"]
    assert (cls.symbolId, cls.documentation, cls.exported, cls.startLine, cls.endLine) == ("ts:src/box.ts#Box:class", "Does it.", True, 6, 15)
    assert all(k[1] == "file" for k in found if k[0] in ("src/empty.ts",)) and len({r.symbolId for r in found.values()}) == len(found)
    assert scanner.collapse("a  b\n c", 3) == "a b…"


def test_artifacts(spark, tmp_path):
    symbols = extractor.extract_symbols(spark.createDataFrame([("src/box.ts", SOURCE)], "path string, content string"), "c1")
    artifacts.write_symbol_index(symbols, str(tmp_path / "index"), "c1", "1.0", ["a"])
    body, header = artifacts.read_symbol_index(spark, str(tmp_path / "index"))
    assert rows(body.select("symbolId", "startLine", "exported")) == rows(symbols.select("symbolId", "startLine", "exported")) and header["symbolCount"] == symbols.count()
    assert artifacts.is_current(header, {"repositoryCommit": "c1", "engineVersion": "1.0", "excludePatterns": ["a"]}) and not artifacts.is_current(None, {})
    lists = spark.createDataFrame([("r", "cfg", "c", 2, "b", 0.5), ("r", "cfg", "c", 1, "a", 0.75)], "requirementId string, configurationId string, repositoryCommit string, rank int, symbolId string, score double")
    artifacts.write_results(lists, str(tmp_path / "results"), "c", "1.0")
    assert rows(artifacts.exploded(artifacts.read_results(spark, str(tmp_path / "results"))[0])) == rows(lists)
    (tmp_path / "labels.json").write_text(json.dumps({"repositoryCommit": "c", "createdAt": "t", "labeler": "l", "links": [{"requirementId": "r", "symbolId": "s", "labelPass": "independent", "relationship": "implements", "confidence": "high", "rationale": "x"}]}))
    assert artifacts.read_labels(spark, str(tmp_path / "labels.json")).first().symbolId == "s"
    (tmp_path / "log.json").write_text(json.dumps({"decisions": [{"requirementId": "r", "kind": "accept"}, {"requirementId": "q", "kind": "reject"}]}))
    assert [(r.seq, r.requirementId) for r in artifacts.read_decisions(spark, str(tmp_path / "log.json")).collect()] == [(0, "r"), (1, "q")]
    (tmp_path / "cache.json").write_text(json.dumps({"modelId": "m", "dimensions": 2, "entries": [{"key": "k", "vector": [0.6, 0.8]}, {"key": "bad", "vector": [1.0]}]}))
    assert [r.key for r in artifacts.read_embedding_cache(spark, str(tmp_path / "cache.json"), "m", 2).collect()] == ["k"]
    assert artifacts.read_embedding_cache(spark, str(tmp_path / "cache.json"), "other", 2).count() == 0
    (tmp_path / "wrong.jsonl").write_text('{"artifact":"symbol-index","version":9}\n')
    with pytest.raises(ValueError, match="version 9"):
        artifacts.read_symbol_index(spark, str(tmp_path / "wrong.jsonl"))
    report = json.loads(artifacts.envelope("coverage-report", "c", "1.0", requirements=lists.limit(1), total=1))
    assert report["total"] == 1 and report["requirements"][0]["requirementId"] == "r"


def whole(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_documents_written_and_read_back(spark, tmp_path):
    log = spark.createDataFrame([(2, "q", "s", "reject", 0.5), (1, "r", "s", "accept", None)], "seq bigint, requirementId string, proposedSymbolId string, kind string, modelConfidence double")
    artifacts.write_decisions(log, str(tmp_path / "log"))
    read = artifacts.read_decisions(spark, str(tmp_path / "log"))
    assert [(r.seq, r.requirementId, r.kind, r.modelConfidence) for r in read.orderBy("seq").collect()] == [(0, "r", "accept", None), (1, "q", "reject", 0.5)]
    proposals = spark.createDataFrame([("r", "b", 2, "supports", 0.5, "w", "review"), ("r", "a", 1, "implements", 1.0, "w", "suggest")], artifacts.PROPOSAL)
    failures = spark.createDataFrame([("q", "invalid-json")], "requirementId string, rule string")
    artifacts.write_proposals(proposals, failures, str(tmp_path / "p"), {"repositoryCommit": "c"}, {"suggest": 0.75, "review": 0.5}, {"calls": 2}, partial=True)
    written = whole(tmp_path / "p")
    assert [p["symbolId"] for p in written["proposals"]] == ["a", "b"] and written["partial"] is True and written["failures"] == [{"requirementId": "q", "rule": "invalid-json"}]
    assert rows(artifacts.read_proposals(spark, str(tmp_path / "p"))) == rows(proposals)
    artifacts.write_proposals(proposals.limit(0), failures.limit(0), str(tmp_path / "none"), {}, {}, {})
    assert whole(tmp_path / "none")["proposals"] == [] and "partial" not in whole(tmp_path / "none")
    cache = spark.createDataFrame([("b", [0.6, 0.8]), ("a", [1.0, 0.0]), ("old", [0.0, 1.0])], "key string, vector array<double>")
    artifacts.write_embedding_cache(cache, cache.filter("key <> 'old'"), str(tmp_path / "cache"), "m", 2)
    assert rows(artifacts.read_embedding_cache(spark, str(tmp_path / "cache"), "m", 2)) == [("a", [1.0, 0.0]), ("b", [0.6, 0.8])]
    index = spark.createDataFrame([("r", "b", "x", "t", "c"), ("r", "a", None, "t", "c")], "requirementId string, symbolId string, reviewer string, timestamp string, commit string")
    artifacts.write_link_index(index, str(tmp_path / "index"), "c")
    assert whole(tmp_path / "index")["links"] == [{"requirementId": "r", "symbolId": "a", "timestamp": "t", "commit": "c"}, {"requirementId": "r", "symbolId": "b", "reviewer": "x", "timestamp": "t", "commit": "c"}]
    artifacts.write_payload_log(proposals.select("requirementId", "rank", "symbolId"), str(tmp_path / "sent"), {"repositoryCommit": "c"}, "semantic", 7)
    assert whole(tmp_path / "sent")["retrieval"] == {"mode": "semantic", "embedding": {"embedded": 7}}
    states = spark.createDataFrame([("r", "linked", 2, 1), ("q", "unlinked", 0, 0)], "requirementId string, state string, links bigint, broken_links bigint")
    artifacts.write_coverage_report(states, str(tmp_path / "cov"), "c", "1.0")
    assert whole(tmp_path / "cov")["summary"] == {"total": 2, "linked": 1, "stale": 0, "unlinked": 1, "linkTotal": 2, "brokenLinkTotal": 1} and "brokenLinks" not in whole(tmp_path / "cov")


def test_metric_reports_read_back(spark, tmp_path):
    kinds = "configurationId string, stratum string, scored bigint, " + ", ".join(f"recall_{k} double, hit_{k} double" for k in (1, 3, 5, 10)) + ", mrr double"
    metrics = spark.createDataFrame([("m", "overall", 2, 0.1, 10.0, 0.3, 30.0, 0.5, 50.0, 1.0, 100.0, 0.25), ("n", "overall", 1, *[0.0] * 9)], kinds)
    unscored = spark.createDataFrame([("b", "overall"), ("a", "overall")], "requirementId string, stratum string")
    text = artifacts.metrics_report(metrics, unscored, "m", {"repositoryCommit": "c"})
    assert json.loads(text)["breakdowns"][0]["requirementsWithoutGroundTruth"] == ["a", "b"]
    (tmp_path / "m.json").write_text(text)
    read = artifacts.read_metrics(spark, str(tmp_path / "m.json")).first()
    assert (read.label, read.requirementCount, read.recall["3"], read.hit["10"], read.mrr) == ("overall", 2, 0.3, 100.0, 0.25)
    row = ("suggest-only", 3, 1, 2, 4, 1, 0.5, 0.25, 1 / 3)
    proposal = spark.createDataFrame([row], "stratum string, requirements bigint, without_labels bigint, predicted bigint, relevant bigint, true_positives bigint, precision double, recall double, f1 double")
    told = json.loads(artifacts.proposal_metrics_report(proposal, None, 4))
    assert told["breakdowns"][0]["bands"] == ["suggest"] and told["proposalsOutsideScope"] == 4
    assert json.loads(artifacts.comparison_report(spark.createDataFrame([("s", 2, 0.5, "m,n")], "stratum string, reported int, best double, best_by string"), {3: ["m"]}))["omittedKs"] == {"3": ["m"]}
    found = spark.createDataFrame([("a.md", "x", "bad-status", "status", "violation")], "path string, id string, rule string, field string, level string")
    assert json.loads(artifacts.validation_report(found, 2, 1, ["docs"]))["valid"] is False
    (tmp_path / "cut.jsonl").write_text('{"symbolId":"a"}\n{"symbolId":\n')
    with pytest.raises(ValueError, match="not valid JSON"):
        artifacts.read_symbol_index(spark, str(tmp_path / "cut.jsonl"))


def test_reports(spark):
    from linkloom.plans import reports

    df = spark.createDataFrame([("b|x", 0.5, None), ("a", 1.0, 0.25)], "name string, recall double, hit double")
    assert reports.markdown_table(df, ["name", "recall"], ["name"]).splitlines()[2:] == ["| a | 1.000 |", "| b\\|x | 0.500 |"]
    assert reports.csv_text(df, ["name", "hit"], ["name"]) == "name,hit\na,0.250\nb|x,\n"
    assert reports.bar_chart(df, "name", ["recall", "hit"]).count("<rect") == 4
    with pytest.raises(ValueError, match="series"):
        reports.bar_chart(df, "name", [])


def test_audit_of_units_and_disclosure(spark):
    kinds = "requirementId string, symbolId string, rank int, signature string, documentation string, source string"
    items = spark.createDataFrame([("r", "a", 1, "s" * 600, None, "y" * 3000), ("r", "a", 1, "s", "d", "y")], kinds)
    candidates = spark.createDataFrame([("r", "a", 1)], "requirementId string, symbolId string, rank int")
    units = spark.createDataFrame([("r", "t" * 5000), ("r", "t"), ("r", None)], "requirementId string, text string")
    found = payload.audit(items, candidates, ["requirementId"], 5, units=units)
    assert rows(found) == sorted([("r", "a", "duplicate-item", 1), ("r", "a", "oversized-field", 2), ("r", None, "duplicate-requirement", 2), ("r", None, "oversized-field", 1)], key=str)
    logs = [("a", "lexical", "lexical", None), ("b", "semantic", "lexical", 3), ("c", "hybrid", "hybrid", None), ("d", None, "semantic", 5), ("e", None, None, 1)]
    told = payload.audit_disclosure(spark.createDataFrame(logs, "run string, mode string, logged_mode string, embedded bigint"), ["run"])
    assert rows(told) == [("b", "mode-mismatch"), ("b", "unexpected-embedding"), ("c", "undisclosed-embedding"), ("e", "unexpected-embedding")]


def test_planted_renames(spark):
    sides = "repositoryCommit string, symbolId string, body string"
    gone = spark.createDataFrame([("c", "old", "h1"), ("c", "lost", "h2"), ("c", "blank", None), ("d", "old", "h1")], sides)
    new = spark.createDataFrame([("c", "new-b", "h1"), ("c", "new-a", "h1"), ("c", "none", None)], sides)
    assert rows(links.renames(gone, new)) == [("c", "old", "new-a", 2)]
