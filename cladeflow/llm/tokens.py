"""Sizes of texts in tokens of a public tokenizer, given as a file of ranks."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public tokenizers' files lie.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the byte-level ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a worker process, read once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(text_col: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(text_col).to_pylist()]
            keep = [i for i in range(batch.num_columns) if i != text_col]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(sizes, pa.int64())], [*[batch.schema.names[i] for i in keep], "n_tokens"])

    return run


def count_tokens(docs: DataFrame, text: str = "text", path: str = os.path.join(TOKENIZERS, RANKS)) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens``; null and empty texts have none."""
    plain = docs.drop("n_tokens")
    fields = [f for f in plain.schema.fields if f.name != text]
    return plain.mapInArrow(_count(plain.columns.index(text), path), T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))
