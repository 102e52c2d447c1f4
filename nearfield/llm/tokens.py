"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file of byte-level BPE; the same place on every executor.
TOKENIZER = os.environ.get("NEARFIELD_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the byte-level vocabulary cuts texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters handed to the tokenizer at once; cut only where a new word begins.
CHUNK = 1 << 20


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = TOKENIZER) -> int:
    """Tokens of the whole text. Texts beyond ``CHUNK`` are cut between a letter or digit and a blank, where no token spans."""
    encode, total, at = encoding(path).encode_ordinary, 0, 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and not (text[end] == " " and text[end - 1].isalnum()):
            end += 1
        total += len(encode(text[at:end]))
        at = end
    return total + len(encode(text[at:] if at else text))


def token_counts(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """``keep`` and the number of tokens of each row's text; null and empty texts have 0."""
    slim = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kept = [f for f in slim.schema if f.name in keep]
    names = [f.name for f in kept]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            n = pa.array([count(t, path) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), n], [*names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{out} long"])
    return slim.mapInArrow(sizes, schema)
