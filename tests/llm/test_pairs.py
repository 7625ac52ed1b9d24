import time

import pytest
import regex

from linkloom.llm import pairs
from linkloom.llm.pairs import documented_functions, documented_in_files, functions_in, is_trivial, own_words, pair

SOURCE = '''
/** Adds two numbers, whatever "{" they hold. */
export function add(a: number, b = ")"): number { return `${a + `}`}` + b; } // }
class A {
  /** Looks it up by key. */
  get size(): number { if (x) { return "}" } return 1; }
  async *run({a, b}: {a: string}): Promise<{x: number}> { for (const i of []) { /* } */ } }
}
/** Arrow. */
export const f = async <T>(x: T): Promise<T> => { return x; };
const g = (y) => y + 1;
'''


def test_functions_with_strings_comments_and_nesting():
    found = functions_in(SOURCE)
    assert [x["signature"].split("(")[0].split()[-1] for x in found][:3] == ["add", "size", "*run"]
    assert [x["body"][:3] for x in found] == ["{ r", "{ i", "{ f", "{ r", "y +"]
    assert found[0]["doc"].startswith("/** Adds") and found[0]["body"].endswith("b; }") and found[2]["doc"] is None
    assert functions_in(None) == [] and functions_in("x = {") == []


def test_unbalanced_text_takes_no_long_search():
    begun = time.perf_counter()
    assert functions_in("f(" * 20_000) == [] and functions_in("f() {" * 5_000) == []
    assert [f["signature"] for f in functions_in("(" * 5_000 + "\nfunction last(a) { return 1; }")] == ["function last(a)"]
    assert time.perf_counter() - begun < 20


def test_pairs_come_from_the_pattern(monkeypatch):
    monkeypatch.setattr(pairs, "_FUNCTION", regex.compile(r"(?!)"))
    monkeypatch.setattr(pairs, "_DECLARED", regex.compile(r"(?!)"))
    assert pair("walk", "Says what it does in words.", "walk() { }") is None


@pytest.mark.parametrize(
    ("comment", "name", "trivial"),
    [
        (None, "f", True), ("", "f", True), ("/** */", "f", True), ("-----\nassignOwner\n-----", "assignOwner", True), ("@param a the value\n@returns many words here", "f", True),
        ("{@inheritDoc Base.f}", "f", True), ("TODO: add the many things that are missing", "f", True), ("to do", "f", True), ("Todo entries are handled here as well.", "f", False),
        ("eslint-disable-next-line no-console -- the log is not ready", "f", True), ("The eslint-disable mark of the old module is honoured.", "f", False),
        ("const a = this.b.filter((x) => x);\nreturn a;", "f", True), ("Counts open tasks too.", "countTask", True), ("Counts open tasks too.", "list", False), ("Oldest wins, always.", "f", False),
        ("Review the verdict.", "reviewVerdict", True), ("Keeps a copy until then.\nTODO: drop the branch", "f", False), ("/** Keeps a copy. TODO: drop the open branch */", "f", False), ("* Runs in linear time.\n* @see other", "f", False),
        ("Fristen ohne Datum gelten nie.", "f", False), ("@ts-expect-error", "f", True), ("#region helpers for many things", "f", True), ("n/a", None, True), ("Reads the @since marks of old modules.", "f", False), ("/** Says it. @param a what it is @returns many words here */", "f", True), ("this.a.open(b);", "f", True), ("FIXME", "f", True),
    ],
)
def test_trivial(comment, name, trivial):
    assert is_trivial(comment, name) is trivial


def test_own_words_leave_out_camel_parts():
    assert own_words("Method fetchLabel for one reviewer", "fetchLabelLink") == ["Method", "for", "one", "reviewer"]


def test_pair_prefers_the_column_and_falls_back_to_the_head():
    head = "/** Walks over every open entry. */ walk(a: X): Y { return '}'; }"
    assert pair("walk", None, head)[0].startswith("/** Walks") and pair("walk", "/** */", head)[2] == "{ return '}'; }"
    assert pair("walk", "TBD", head) is None
    assert pair("walk", "Says what it does in words.", "walk(): void;") == ("Says what it does in words.", "walk(): void;", None)
    assert pair("walk", "Says what it does in words.", "/** only a comment */ // more") is None
    assert pair("walk", "Says what it does in words.", None) is None
    assert pair("walk", "Says what it does in words.", 'walk(): void { throw new Error("a\n b"); }')[2].startswith("{ throw")


def test_rows_of_the_newest_snapshots(spark):
    commits = spark.createDataFrame([("c1", "r", 1), ("c2", "r", 4), ("d1", "q", 1), (None, "q", 9), ("e", None, 1)], "repositoryCommit string, repository string, snapshotNo int")
    schema = "repositoryCommit string, symbolId string, kind string, name string, documentation string, normalizedSource string, body string, p string"
    good = ("Keeps the order of entries.", "f() { }")
    rows = [("c2", " ts:a\\f ", "function", "f", *good), ("c2", "ts:a/f", "function", "f", *good), ("c1", "old", "function", "f", *good), ("d1", "m", "method", None, *good), ("d1", "k", "class", "f", *good), ("d1", None, "method", "f", *good), ("d1", "n", None, "f", *good), ("d1", "long", "function", "g", "word " * 20000, "g() { " + "x;" * 50000 + " }")]
    df = spark.createDataFrame([(*r, "b", "p") for r in rows], schema)
    found = documented_functions(df, commits).collect()
    assert sorted((r.repositoryCommit, r.symbolId) for r in found) == [("c2", "ts:a/f"), ("d1", "long"), ("d1", "m")]
    assert documented_functions(df.limit(0), commits).collect() == [] and documented_functions(df, commits.limit(0)).collect() == []


def test_pairs_of_files(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, ""), (4, "/** Says a lot of things. */ function cut(a) {"), (5, "/** Add. */ function add(a) { return a; }")], "doc_id bigint, text string")
    found = documented_in_files(df).collect()
    assert [(r.doc_id, r.place, r.name) for r in found] == [(1, 1, "add"), (1, 2, "size")] and found[1].body == '{ if (x) { return "}" } return 1; }'
