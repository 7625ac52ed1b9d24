import os
import random

import pytest

from linkloom.llm import mix, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files")


def test_targets_share_what_capped_sources_cannot_give():
    assert mix.targets({"a": 100, "b": 900}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}) == {"a": 200, "b": 800}
    assert mix.targets({"a": 500, "b": 500}, {"a": 0.3, "b": 0.7}, {"a": 9, "b": 9}) == {"a": 300, "b": 700}
    assert mix.targets({"a": 0, "b": 10, "c": 5}, {"a": 0.5, "b": 0.5, "c": 0.0}, {"a": 2, "b": 1, "c": 1}) == {"a": 0, "b": 10, "c": 0}
    assert mix.targets({}, {}, {}) == {}


@pytest.mark.parametrize("size", [1, 7, 64, 4096])
@pytest.mark.parametrize("seed", range(12))
def test_schedule_stays_within_one_block_of_every_share(seed, size):
    rng = random.Random(seed)
    blocks = [rng.choice([0, 1, 2, 50, 300, rng.randint(1, 900)]) for _ in range(rng.randint(1, 9))] + [1]
    total, seen, slot = sum(blocks), [0] * len(blocks), 0
    for i, gone in enumerate(mix.round_starts(blocks, size)):
        assert seen == gone
        for s, k in mix.edf_window(blocks, i * size, min(total, (i + 1) * size), gone):
            assert seen[s] == k and k * total // blocks[s] <= slot < -(-(k + 1) * total // blocks[s])  # not before its release, by its deadline
            seen[s] += 1
            slot += 1
            assert all(abs(seen[j] - slot * n / total) < 1 for j, n in enumerate(blocks))
    assert seen == blocks


def docs(spark, rng):
    rows = []
    for source, n in (("big", 600), ("mid", 150), ("small", 12), ("other", 40), (None, 10)):
        rows += [(source, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 40))) if rng.random() > 0.05 else None) for _ in range(n)]
    return spark.createDataFrame([(i, s, t, 7) for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string, uses int")


def test_mix_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK", 100)
    monkeypatch.setattr(mix, "ROUND", 16)
    monkeypatch.setattr(mix, "BUCKET_DOCUMENTS", 40)
    df = docs(spark, random.Random(1))
    goal = spark.createDataFrame([("big", 0.3, 2), ("mid", 0.4, 3), ("small", 0.3, 2), ("absent", 0.0, 1), (None, 0.1, 1), ("mid", 0.1, 1)], "source string, weight double, max_repeats int")
    made = mix.Mix(df, goal)
    uses = made.uses().collect()
    assert len({u.doc_id for u in uses}) == len(uses) and all(u.uses > 0 and u.tokens > 0 for u in uses)
    got = {s: sum(u.uses * u.tokens for u in uses if u.source == s) for s in ("big", "mid", "small")}
    longest = max(u.tokens for u in uses)
    assert all(abs(got[s] - made.targets[s]) <= longest for s in got)
    assert abs(sum(got.values()) - sum(made.sizes.values())) <= 3 * longest
    assert got["small"] == 2 * made.sizes["small"] and max(u.uses for u in uses if u.source == "mid") <= 3
    report = {r.source: r for r in made.report().collect()}
    assert report["small"].tokens == got["small"] and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and report["absent"].documents == 0
    order = sorted(made.order().collect(), key=lambda r: (r.slot, r.at))
    assert [r.slot for r in order] == sorted(r.slot for r in order) and len({(r.doc_id, r.repeat) for r in order}) == len(order)
    # at every point of the mix a source is within a block (and the documents that overhang it) of its share
    whole, so_far, done = sum(r.tokens for r in order), dict.fromkeys(got, 0), 0
    for i, r in enumerate(order):
        so_far[r.source] += r.tokens
        done += r.tokens
        if i + 1 == len(order) or order[i + 1].slot != r.slot:
            assert all(abs(so_far[s] - done * got[s] / whole) <= 3 * (mix.BLOCK + longest) for s in got)
    assert len(order) == sum(u.uses for u in uses)
    assert sorted(u.doc_id for u in mix.Mix(df, goal).uses().collect()) == sorted(u.doc_id for u in uses)


def test_uses_come_from_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mix.Mix, "schedule", lambda self: self.spark.createDataFrame([("big", 0, 0)], "source string, block bigint, slot bigint"))
    goal = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.5, 2)], "source string, weight double, max_repeats int")
    assert {u.source for u in mix.Mix(docs(spark, random.Random(1)), goal).uses().collect()} == {"big"}


def test_empty(spark):
    df = docs(spark, random.Random(2))
    goal = spark.createDataFrame([("big", 1.0, 1)], "source string, weight double, max_repeats int")
    assert mix.Mix(df.limit(0), goal).uses().collect() == []
    assert mix.Mix(df, goal.limit(0)).uses().collect() == []
    assert mix.Mix(df.limit(0), goal).report().collect()[0].actual_share == 0.0
