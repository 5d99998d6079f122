"""Encoding a corpus with a public byte-level BPE (problem 6): forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be bridged
by a merge. Wherever such a pair stands between two characters, the text may be
cut: what comes out for the pieces, one after the other, is what comes out for
the whole. The tokenizer's own splitting pattern is respected by two more
conditions: no cut after white space, whose run the pattern splits by what
follows, and none before an apostrophe, which could then begin a contraction.

Cuts are found for a whole text at once by looking its byte pairs up in a table.
The fragments are short and repeat, so each worker keeps a bounded memo of them
and the tokenizer itself sees only new ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments a worker remembers, and the longest fragment that is remembered, in bytes.
MEMO, MEMO_BYTES = 150_000, 48

# Last two bytes of the UTF-8 forms of white space beyond ASCII.
WIDE_BLANKS = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *[(0x80, b) for b in range(0x80, 0x8B)], (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)]


def default_vocabulary() -> str:
    """The installed vocabulary file of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """byte_bpe_50k without special tokens; strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros(65536, bool)
        for token in ranks:
            if len(token) > 1:
                raw = np.frombuffer(token, np.uint8).astype(np.uint16)
                inside[(raw[:-1] << 8) | raw[1:]] = True
        first, second = np.arange(65536) >> 8, np.arange(65536) & 255
        ascii_blank = (first == 32) | ((first >= 9) & (first <= 13)) | ((first >= 28) & (first <= 31))
        self.may_cut = ~inside & ((second & 0xC0) != 0x80) & (second != 0x27) & ~ascii_blank
        self.wide_blank = np.zeros(65536, bool)
        for a, b in WIDE_BLANKS:
            self.wide_blank[(a << 8) | b] = True
        self.memo: dict[bytes, list[int]] = {}

    def fragments(self, raw: bytes) -> list[bytes]:
        """The pieces of a text between its certain cuts."""
        if len(raw) < 2:
            return [raw]
        codes = np.frombuffer(raw, np.uint8)
        pairs = (codes[:-1].astype(np.uint16) << 8) | codes[1:]
        cut = self.may_cut[pairs]
        cut[1:] &= ~self.wide_blank[pairs[:-1]]
        ends = np.flatnonzero(cut) + 1
        at = [0, *ends.tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(at, at[1:])]  # noqa: B905

    def encode(self, text: str | None) -> list[int]:
        """The token ids of a text; none for a null or empty one."""
        if not text:
            return []
        memo, ids = self.memo, []
        for piece in self.fragments(text.encode("utf-8")):
            known = memo.get(piece)
            if known is None:
                known = self.bpe.encode_ordinary(piece.decode("utf-8"))
                if len(piece) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = known
            ids += known
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None, ids_per_batch: int = 2_000_000) -> DataFrame:
    """(key, ids array<int>): the token ids of each text.

    Null and empty texts give an empty list. Texts are encoded whole, whatever
    their length; long batches are emitted in parts so that no Arrow batch holds
    much more than ``ids_per_batch`` ids.
    """
    where = path or default_vocabulary()
    source = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(where)
        for batch in batches:
            begin, ends, values = 0, [0], []

            def part(stop: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(values, np.int32)))
                return pa.RecordBatch.from_arrays([batch.column(0).slice(begin, stop - begin), lists], names=[key, "ids"])

            for i, text in enumerate(batch.column(1)):
                values += one.encode(text.as_py())
                ends.append(len(values))
                if len(values) >= ids_per_batch:
                    yield part(i + 1)
                    begin, ends, values = i + 1, [0], []
            if len(ends) > 1:
                yield part(batch.num_rows)

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, tokens bigint): the number of token ids of each text, 0 for a null or empty one."""
    where = path or default_vocabulary()
    source = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(where)
        for batch in batches:
            counts = pa.array([len(one.encode(t.as_py())) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[key, "tokens"])

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, tokens bigint")
