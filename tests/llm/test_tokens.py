import os
import random

import pytest

from linkloom.llm import tokens
from linkloom.llm.bpe import BytePairEncoder

FILE = f"{tokens.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files")


def reference():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(3)
    fixed = ["", " ", "aaaa", "a" * 5000, "aa" * 1500, " " * 2500 + "x", "\t\n  \n" * 30, "é" * 3000, "<|endoftext|>", "we'll WE'LL don't", "​﻿x", "日本語" * 800, "½²①", "\x00\x01", "🇪🇺👩‍💻", "x" * 20 + "\n"]
    return fixed + ["".join(rng.choice("ab \n's.é9日") for _ in range(rng.randint(0, 70))) for _ in range(1500)]


def test_merge_rounds_equal_the_library():
    encoder, texts = BytePairEncoder(open(FILE, encoding="utf-8").read()), odd_texts()
    for _ in range(2):  # the second time all words are known
        flat, offsets = encoder.encode_batch(texts)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == reference()(texts)


def test_encode_and_count(spark):
    texts = [None, "", "  ", "Hello <|endoftext|> world", "naïve café", *odd_texts()[:60]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1)], "doc_id bigint, text string, ids string, tokens int")
    rows = tokens.encode(df).collect()
    expected = reference()([t or "" for t in texts])
    assert len(rows) == len(texts) + 1
    assert {(r.doc_id, tuple(r.ids)) for r in rows} == {(i, tuple(e)) for i, e in enumerate(expected)}
    counts = {r.doc_id: r.tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()}
    assert counts == {i: len(e) for i, e in enumerate(expected)}
    assert tokens.encode(df.limit(0)).collect() == []


def test_slices_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 10)
    assert [x for part in tokens._slices(["a" * 9, None, "bb", "", "c" * 50, "d"]) for x in part] == ["a" * 9, None, "bb", "", "c" * 50, "d"]
