"""Encoding a corpus with a public byte-level BPE vocabulary.

Each piece of text that the vocabulary's pattern cuts out is merged by a segment tree over its byte positions.
A leaf holds the rank of the pair that starts at its position, an inner node the leftmost minimum of its leaves;
a merge takes the root's pair, joins it with its live neighbour and updates the leaves of the pairs it touched, each
in logarithmic time.  Pieces recur, so that a task remembers their ids up to a bound; a remembered piece is merged once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .. import skew

#: The vocabulary and the pattern that cuts text before merging (fixed values of the public vocabulary).
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a task remembers at once, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64


def read_ranks(path: str = DEFAULT_RANKS) -> bytes:
    """The rank file's bytes; read on the driver, so that executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    # A node is rank * size + position: its minimum is the leftmost of the lowest rank.
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 2)), list(range(-1, n))  # live neighbours; a token ends where the next begins

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] != none:
        i = tree[1] % size
        j = after[i]
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
        put(j, none)
        r = ranks.get(piece[i : after[end]]) if end < n else None
        put(i, none if r is None else r * size + i)
        h = before[i]
        if h >= 0:
            r = ranks.get(piece[h:end])
            put(h, none if r is None else r * size + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Texts to ids with one vocabulary; remembers pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.cut, self.seen = ranks, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        seen, out = self.seen, []
        for piece in self.cut(text):
            ids = seen.get(piece)
            if ids is None:
                ids = merge(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= REMEMBERED_CHARS:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out


def encoded(texts: DataFrame, key: Column, text: Column, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids): the ids of every row's whole text, without special tokens, whose strings in a text are ordinary text.

    Null and empty texts have the empty list.  Repeated rows give repeated results.
    """
    spark = texts.sparkSession
    content = spark.sparkContext.broadcast(read_ranks(ranks_path))  # the vocabulary's fixed size, under a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(parse_ranks(content.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = pa.array([encoder.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    return skew.spread(texts.select(key.cast("long").alias("key"), text.alias("text"))).mapInArrow(run, "key long, ids array<int>")
