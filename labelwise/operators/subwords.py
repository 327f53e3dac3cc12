"""Subword ids of a public tokenizer: the lengths that a model sees, where ``tokens`` counts words.

``subwords`` adds the number of subwords of each whole text and its first ``max_length`` ids. Tokenizer files are a
parameter (a path that every executor has); none is trained here. The tokenizer is built once per Python worker and uses the
task's own core only. Texts go through it in Arrow batches, by chunks of ``CHUNK`` characters and at least one text, so only
the ids of one chunk are held beside the result.

A null text has null columns; an empty one has no subwords. Rows are neither moved nor dropped; there is no shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = 1 << 20


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a JSON file, without any truncation or padding that the file may ask for."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def subwords(df: DataFrame, text_col: str, path: str, max_length: int, count: str = "n_subwords", ids: str = "input_ids") -> DataFrame:
    """``df`` without ``text_col``, with ``count`` (of the whole text) and ``ids`` (its first ``max_length``)."""
    others = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(path).encode_batch_fast
        for b in batches:
            texts = b.column(len(others)).to_pylist()
            lengths, first = [], []
            for chunk in _chunks([t for t in texts if t is not None]):
                for e in encode(chunk, add_special_tokens=False):
                    got = e.ids
                    lengths.append(len(got))
                    first.append(got[:max_length])
            known = iter(zip(lengths, first))
            rows = [(None, None) if t is None else next(known) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(others)], pa.array([n for n, _ in rows], pa.int64()),
                                              pa.array([x for _, x in rows], pa.list_(pa.int64()))], [*others, count, ids])

    fields = [df.schema[c] for c in others] + [T.StructField(count, T.LongType()), T.StructField(ids, T.ArrayType(T.LongType()))]
    return df.select(*others, text_col).mapInArrow(run, T.StructType(fields))
