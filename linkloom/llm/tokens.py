"""Encoding a corpus with a public tokenizer, and counting its tokens.

The vocabulary has a fixed size (about 1.5 MB) and is sent to the workers once, as a broadcast variable.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.llm.bpe import BytePairEncoder

#: where the vocabulary files lie unless told otherwise
TOKENIZERS = os.environ.get("LINKLOOM_TOKENIZERS", "/opt/tokenizers")

#: texts are encoded in slices of about so many characters, whatever the size of an Arrow batch
SLICE_CHARS = 4_000_000

_encoders: dict[int, BytePairEncoder] = {}


def _encoder(definition) -> BytePairEncoder:
    """One encoder in each worker process, so that its cache outlives a task."""
    key = hash(definition.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = BytePairEncoder(definition.value)
    return _encoders[key]


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size > SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _definition(df: DataFrame, vocabulary: str):
    with open(vocabulary if os.path.isabs(vocabulary) else f"{TOKENIZERS}/{vocabulary}", encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``id_column`` and ``ids`` (array of int) of every row, without special tokens.

    Strings that look like special tokens are plain text. Null and empty texts give an empty list; repeated rows
    and null ids pass as they are. Other columns are not read.
    """
    definition = _definition(documents, vocabulary)
    rows = documents.select(id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1).to_pylist()):
                flat, offsets = encoder.encode_batch(texts)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], names=[id_column, "ids"])
                at += len(texts)

    return rows.mapInArrow(run, f"`{id_column}` {dict(rows.dtypes)[id_column]}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text_column: str = "text", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """The columns ``keep`` and ``tokens`` (bigint) of every row; null and empty texts have none."""
    definition = _definition(documents, vocabulary)
    rows = documents.select(*keep, text_column)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition)
        for batch in batches:
            counts = [np.diff(encoder.encode_batch(texts)[1]) for texts in _slices(batch.column(len(keep)).to_pylist())]
            tokens = pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], tokens], names=[*keep, "tokens"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint")
