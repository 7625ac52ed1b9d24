import random

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import residue
from linkloom.llm.residue_rules import SEEDS, message_form, units_of

SEED_FORMS = {message_form(s)[0] for s in SEEDS}


def is_residue(text, source=None):
    """By its form, or as a copy of a seed."""
    return any(places or whole or form in SEED_FORMS for form, places, whole in units_of(text, source))


def near(spark, texts, trusted):
    """Keys of the texts that are not ``trusted`` (numbers of texts) and are linked to one that is."""
    rows = {residue._key(t): (residue._key(t), t, i in trusted) for i, t in reversed(list(enumerate(texts)))}
    prints = residue.near_prints(spark.createDataFrame(list(rows.values()), "unit bigint, normal string, trusted boolean")).filter("n >= 4").cache()
    masks = residue.selections(prints.filter("high is not null").count())
    return {r.unit for r in residue.near_units(prints.filter("trusted"), prints.filter("not trusted"), masks).collect()}


RESIDUE = [
    "{{ title }}", "title: {{title}}", "- [INSERT OWNER HERE]", "The old [Your title] bridge takes 4 ms.", "Both ${req.name} and its trail.", "TBD", "status: tbd", "leaves TBD queries behind", "## ???", "_______________",
    "<describe the owner>", "&lt;owner&gt;", "<<actor>>", "%OWNER%", "$(req.title)", "$OWNER$", "@@TITLE@@", "<%= name %>", "{% if x %}", "#{req.date}", "{0} {1}", "[[ACTOR]]", "__SUMMARY__", "[object Object]", "undefined",
    "REQ-XXX-NNN", "XXXXXXXX", "(to be filled in: owner)", "[à compléter]", "(texte à venir)", "[tu wpisz treść]", "(pendiente de rellenar)", "<Name des Verantwortlichen>", "［ここに本文を入力］", "（未記入）", "○○○○",
    "Measured on Click here to enter title.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Magna sed dolor vestibulum ipsum tempor.", "text text text text text", "foo bar foo bar foo bar", "jkfdw asdfk qwlkj fdsaj",
    "Sample text goes here. Replace it with your own content.", "Your text here. Your text here.", "Dies ist ein Blindtext. Er steht hier nur, damit die Seite nicht leer ist.", "404 Not Found", "Error 503", "HTTP Status 400 – Bad Request",
    "404: Not Found - Reference #22ab667 - code=404 path=/metric/entry - at open (index.js:1:2) - trace-web/4.1", "Page introuvable", "- Sesja wygasła. Zaloguj się ponownie.", '{"error":"Access denied","status":403,"id":"9a"}',
    "<html><head><title>403 Forbidden</title></head><body><h1>403 Forbidden</h1><p>Return to the home page</p></body></html>", "You need to enable JavaScript to run this app.", "Menu  Search  Sign in This viewer requires JavaScript.",
    "このページを表示するには JavaScript を有効にしてください。", "Bitte é aktivieren Sie JavaScript, um diese Anwendung zu nutzen.",
]
CONTENT = [
    'A reviewer who sees "Page not found" should go back.', "In a template, `{{ title }}` is replaced by the name.", "What used to be TBD in REQ-SYNC-1 is settled.", "Usage: trace link <requirement> <symbol> [--note <text>] adds one symbol.",
    "Generic types like Map<index, cursor> and Promise<void> are kept.", "See [[REQ-AUDIT-2580]] and [[docs/ticket]].", "The vault holds entries {draft, open, closed} in that order.", "Use %s for the band and %d for its count.",
    "A value that is undefined must be shown as an empty band, never as [object Object].", "The gateway shall answer with 404 Not Found when an index is unknown.", "Enabling JavaScript for the preview was turned down.",
    "Ohne JavaScript muss die Liste lesbar bleiben.", "Dummy text such as lorem ipsum made the link ranking useless.", "Placeholders in the query field (grey hint text) disappear.", "We count error pages (HTTP 500, 502, 504) per day.",
    "Access to the owner is denied to guests.", "不明な要件には「ページが見つかりません」と表示し、索引へ戻るリンクを出す。", "see {@link mergeBand} <|endoftext|> ¯\\_(ツ)_/¯ 0xDEADBEEF MAX_QUEUE_SIZE", "Ein Platzhalter wie `{{ titel }}` wird ersetzt.", "", "   ", "status: proposed",
]
CODE_RESIDUE = ["export class __MODULENAME__ {\n}", "export function {{moduleName}}(a: X): number {\n}", "/**\n * @@className@@\n */\nexport class A {}", "/**\n * [[serviceName]]\n */\nexport class A {}", "export class A {}\n404 Not Found"]
CODE_CONTENT = [
    'const sample = "lorem ipsum";\nconst t = `${a}-${b}`;', "export class A {\n  // TODO: restore the stale symbol\n  private readonly m = new Map<string, X>();\n}", 'const noScript = "Please enable JavaScript";\nconst __cache__ = {};', "import { a } from './b.js';\nif (x === undefined) { return null; }",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert is_residue(text)


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert not is_residue(text)


@pytest.mark.parametrize(("texts", "expected"), [(CODE_RESIDUE, True), (CODE_CONTENT, False)])
def test_code(texts, expected):
    assert [is_residue(t, "source-code") for t in texts] == [expected] * len(texts)


@pytest.mark.parametrize("words_of_a_unit", [(36, 45), (60, 200)])
@pytest.mark.parametrize("units", [None, 10**7])
def test_near_duplicates_meet_in_the_tables(spark, monkeypatch, words_of_a_unit, units):
    """Recall of fingerprints and prefixes at a similarity of 0.8 to 0.85, against brute force, also with keys as long as for many units."""
    rng, vocabulary, texts = random.Random(5), [f"w{i}" for i in range(4000)], []
    if units:
        made = residue.selections(units)
        monkeypatch.setattr(residue, "selections", lambda n: made)
    while len(texts) < 400:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*words_of_a_unit))]
        other = base[: round(len(base) * rng.uniform(0.82, 0.9))] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))]
        if 0.8 <= residue.jaccard(" ".join(base), " ".join(other)) <= 0.85:
            texts += [" ".join(base), " ".join(other)]
    trusted = set(range(0, len(texts), 2))
    expected = {residue._key(t) for i, t in enumerate(texts) if i % 2}
    found = near(spark, texts, trusted)
    assert found <= expected and len(found) >= 0.9 * len(expected) > 100


def test_fingerprints_against_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "ä", "日", "z1"]) for _ in range(n)) for n in (1, 4, 5, 6, 40, 41, 300)]
    hashes, sizes = residue.shingle_sets(pa.array(texts))
    assert sizes.tolist() == [len(residue.shingles(t)) if len(t.split(" ")) >= 5 else 0 for t in texts]
    at = np.cumsum(sizes) - sizes
    some = residue.fingerprints(hashes, sizes[2:])
    for i, n, made in zip(at[2:], sizes[2:], some):
        for word, values in enumerate((hashes[i : i + n], residue._mixed(hashes[i : i + n] ^ np.uint64(0x9E3779B97F4A7C15)))):
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) * 2 > n
            assert np.packbits(bits).view(np.uint64)[0] == made[word]


def test_no_labelled_unit_of_a_crowded_bucket_is_passed_over(spark, monkeypatch):
    """Many labelled units share a key with a unit that only one of them is near to."""
    monkeypatch.setattr(residue, "FIRST", 1)
    base = [f"w{i}" for i in range(12)]
    others = [base[:5] + [f"x{i}y{j}" for j in range(7)] for i in range(30)]
    texts = [" ".join(w) for w in [base, [*base, "end"], *others]]
    assert near(spark, texts, set(range(1, len(texts)))) == {residue._key(texts[0])}


def test_short_units_at_the_least_similarity_meet(spark):
    """Units of 8 to 25 words: all pairs of exactly 0.8 are found, none below it."""
    rng = random.Random(7)
    texts, expected = [], set()
    for i in range(1600):
        k, pair = i % 4 + 1, f"u{i}x"
        base = [f"{pair}{rng.randrange(10**6)}" for _ in range(4 * k + 4)]
        other = base + [f"{pair}e{j}" for j in range(k + i // 4 % 2)]  # 4k of 5k shingles, or of 5k + 1
        a, b = " ".join(base), " ".join(other)
        assert (residue.jaccard(a, b) == 0.8) == (len(other) == 5 * k + 4)
        texts += [a, b]
        expected |= {residue._key(b)} if len(other) == 5 * k + 4 else set()
    assert near(spark, texts, set(range(0, len(texts), 2))) == expected


def test_labels_from_one_document_reach_others(spark):
    """A message that no seed holds: an error object labels it, links carry the label to copies and near forms."""
    message = "Frobnication of the outer ledger could not be carried out by the night shift of the second vault keeper"
    texts = ['{"error":"%s","status":503,"id":"9a"}' % message, message + ".", message + " today", "Loading... " + message, "The ledger is kept by the night shift.", "JavaScript is disabled in your browser. Turn it on and reload."]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in residue.residue_documents(df).collect()} == {0, 1, 2, 3, 5}
    assert {(r.evidence, r.documents) for r in residue.residue_report(df).collect()} == {("form", 1), ("equal", 2), ("near", 1), ("seed", 1)}


def test_labels_spread_over_a_chain_and_copies_come_out(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(300)]
    filler = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud".split()
    chain = [filler + [rng.choice(words) for _ in range(12)]]
    for _ in range(6):  # each step replaces a word of the Latin until the rules see no filler
        step = list(chain[-1])
        step[len(chain) * 3] = rng.choice(words)
        chain.append(step)
    other = " ".join(rng.choice(words) for _ in range(60))
    texts = [" ".join(c) for c in chain] + [other, None, "", " \n ", "TBD", "TBD", "x" * 300_000]
    df = spark.createDataFrame([(i, t, rng.choice(["a", None]), "n") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, unit string")
    found = {r.doc_id for r in residue.residue_documents(df).collect()}
    direct = {i for i, t in enumerate(texts) if t and is_residue(t)}
    assert direct <= found and {11, 12} <= found and not found & {7, 8, 9, 10, 13}
    for i in range(1, 7):
        if residue.jaccard(*(message_form(texts[j])[0] for j in (i - 1, i))) >= residue.SIMILARITY and i - 1 in found:
            assert i in found
    assert residue.residue_documents(df.limit(0)).collect() == []
