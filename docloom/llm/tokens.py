"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary lies on every executor; a parameter of every operator.
VOCABULARY = os.environ.get("DOCLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

_ENCODERS: dict = {}


def encoder(path: str = VOCABULARY):
    """The encoder of a vocabulary file, loaded once in each worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("docloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _border(text: str, at: int) -> int:
    """The first place from ``at`` on where a letter is followed by none: two tokens always meet there, whatever stands around it."""
    n = len(text)
    while at < n and not (text[at - 1].isalpha() and not text[at].isalpha()):
        at += 1
    return at


def token_ids(text: str, path: str = VOCABULARY, block: int = 1 << 20) -> list[int]:
    """Tokens of the whole text; very long ones are encoded in blocks that end between a letter and another character, so
    that they are the same tokens as those of the text at once. A stretch without such a place is one block."""
    enc = encoder(path)
    if len(text) <= block:
        return enc.encode_ordinary(text)
    out, start = [], 0
    while start < len(text):
        end = _border(text, start + block)
        out += enc.encode_ordinary(text[start:end])
        start = end
    return out


def token_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_tokens) of every row; null and empty texts have 0 tokens. Map-only; texts don't leave the workers."""
    columns = [F.col(key).alias("_key"), F.col(text).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]]
    fields = [docs.schema[key], *[docs.schema[c] for c in keep]]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(token_ids(t, path)) if t else 0 for t in batch.column(1).to_pylist()], dtype=np.int32)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, pa.array(sizes)], names=[key, *keep, "n_tokens"])

    return docs.select(*columns).mapInArrow(run, ddl)
