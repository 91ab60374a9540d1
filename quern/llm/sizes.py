"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files lie, and the one that is used unless another is named.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how texts are split before the byte pairs of this vocabulary are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):
    """The tiktoken encoder of a rank file; loaded once per Python worker, which outlives a task."""
    loaded = vars(sys).setdefault("_token_encoders", {})
    if path not in loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return loaded[path]


def with_tokens(rows: DataFrame, text: str, keep: list[str], out: str = "n_tokens", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each whole text; a null or empty text has none."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(x)) if x else 0 for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[f.name for f in schema.fields])

    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)
