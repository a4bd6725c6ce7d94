"""Whole-corpus encoding with a public byte-level BPE vocabulary.

A piece (one match of the pre-tokenizer pattern) starts as its bytes.  A
segment tree over the ranks of adjacent pairs keeps in its root the leftmost
pair of lowest rank; merging it changes at most two neighbour pairs, each a
logarithmic point update, until the root says that no pair can merge.  So a
piece of n bytes costs O(n log n), however long it is.  Pieces seen before
come from a per-worker memo of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread

#: The pre-tokenizer pattern of this vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MEMO = 400_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, data.splitlines()))}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}
        self.none = max(ranks.values()) + 1

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pairs, width = n - 1, 1
        while width < pairs:
            width *= 2
        # A node holds rank * span + position: its minimum is the leftmost lowest rank.
        span = width
        nothing = self.none * span
        tree = [nothing] * (2 * width)
        for i in range(pairs):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None:
                tree[width + i] = rank * span + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] < nothing:
            i = tree[1] % span
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            if j < pairs:
                update(j, nothing)
            rank = ranks.get(parts[i] + parts[k]) if k < n else None
            update(i, nothing if rank is None else rank * span + i)
            if (h := before[i]) >= 0:
                rank = ranks.get(parts[h] + parts[i])
                update(h, nothing if rank is None else rank * span + h)
        return [ranks[p] for p in parts if p is not None]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> Encoder:
    return Encoder(load_ranks(vocabulary))


def encode_corpus(df: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """(doc_id, ids): the ids of each text, without special tokens.

    ``vocabulary`` is the path of a rank file (base64 token, rank), read on the
    driver and sent to the workers; its size does not grow with the data.
    An empty and a null text both give an empty list.  Strings that look like
    special tokens are ordinary text.  One row per input row, repeated rows
    and null ids included.  Only the two named columns are read.
    """
    with open(vocabulary, "rb") as handle:
        shared = df.sparkSession.sparkContext.broadcast(handle.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            lists = pa.array([encoder.encode(t) for t in batch.column(1).to_pylist()], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, ids array<int>")
