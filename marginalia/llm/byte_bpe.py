"""Byte-level byte-pair encoding with a hierarchical-bitmap rank queue, and decoding.

Merges of one pre-token run lowest rank first, leftmost first. Waiting positions lie in one bucket per
rank; three levels of 64-bit words (two of wider ones for short pre-tokens) tell which buckets are filled, so that
find-first-set gives the next rank in three steps whatever the length. Positions form a linked list; an entry whose pair has
changed meanwhile is stale and skipped. A pre-token of n bytes takes O(n log n) steps at most.

Defined results: null and empty texts have no ids; texts of any length are encoded whole; repeated
rows give repeated rows; an empty table gives an empty table. Only ``doc_id`` and the text are read.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heappop, heappush

from pyspark.sql import DataFrame, functions as F

from .common import worker_state

# Pre-tokens whose ids a worker keeps, in two halves; when the newer is full the older goes, but for what was met since,
# which changes no result.
CACHED = 600_000
# Pre-tokens up to this length are merged without calls to the queue.
INLINE_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class RankQueue:
    """Positions by rank; ``pop`` gives the leftmost position of the lowest filled rank.

    A bucket with one position is that number, with more a heap.
    """

    def __init__(self, ranks: int):
        self.leaf = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0  # one bit for each middle word
        self.bucket: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.bucket.setdefault(rank, position)
        if held is position:
            self.leaf[rank >> 6] |= 1 << (rank & 63)
            self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        elif type(held) is int:
            if held != position:
                self.bucket[rank] = [held, position] if held < position else [position, held]
        else:
            heappush(held, position)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        high = (top & -top).bit_length() - 1
        word = self.middle[high]
        mid = high << 6 | (word & -word).bit_length() - 1
        word = self.leaf[mid]
        rank = mid << 6 | (word & -word).bit_length() - 1
        position = self.bucket[rank]
        if type(position) is not int:
            held, position = position, heappop(position)
            if held:
                return rank, position
        del self.bucket[rank]
        word &= word - 1
        self.leaf[mid] = word
        if not word:
            word = self.middle[high] & ~(1 << (mid & 63))
            self.middle[high] = word
            if not word:
                self.top = top & ~(1 << high)
        return rank, position


class ByteBpe(dict):
    """Pre-token to its ids as 32-bit integers; a missing pre-token is encoded and kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.leaf = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.pairs = [ranks.get(bytes([x, y]), -1) for x in range(256) for y in range(256)]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED // 2:
            self.older.clear()
            self.older.update(self)
            self.clear()
        ids = self.older.pop(piece, None)
        if ids is None:
            ids = array("I", self.merged(piece.encode())).tobytes()
        self[piece] = ids
        return ids

    def merged(self, piece: bytes) -> tuple[int, ...]:
        rank_of, n = self.ranks.get, len(piece)
        rank = rank_of(piece)
        if rank is not None:
            return (rank,)
        if n > INLINE_BYTES:
            return self._merged_by_queue(piece)
        # The queue's steps again without its calls, over two levels of wider words: they are most of the time of a short
        # pre-token. The ranks of its pairs of bytes come from a table.
        leaf, bucket, top, pairs = self.leaf, self.queue.bucket, 0, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [pairs[x << 8 | y] for x, y in zip(piece, piece[1:])]
        for i, rank in enumerate(waiting):
            if rank >= 0:
                if rank not in bucket:
                    bucket[rank] = i
                    leaf[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
                elif type(held := bucket[rank]) is int:
                    bucket[rank] = [held, i]
                else:
                    held.append(i)  # positions ascend, so that it stays a heap
        waiting.append(-1)
        while top:
            high = (top & -top).bit_length() - 1
            word = leaf[high]
            rank = high << 8 | (word & -word).bit_length() - 1
            i = bucket[rank]
            if type(i) is not int:
                held, i = i, heappop(i)
            else:
                held = None
            if not held:
                del bucket[rank]
                leaf[high] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if waiting[i] != rank:
                continue  # stale
            gone = after[i]
            after[i] = end = after[gone]
            waiting[gone] = waiting[i] = -1
            left = before[i]
            if end < n:
                before[end] = i
                waiting[i] = rank = rank_of(piece[i:after[end]], -1)
                if rank >= 0:
                    if rank not in bucket:
                        bucket[rank] = i
                        leaf[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
                    elif type(held := bucket[rank]) is int:
                        bucket[rank] = [held, i] if held < i else [i, held]
                    else:
                        heappush(held, i)
            if left >= 0:
                waiting[left] = rank = rank_of(piece[left:end], -1)
                if rank >= 0:
                    if rank not in bucket:
                        bucket[rank] = left
                        leaf[rank >> 8] |= 1 << (rank & 255)
                        top |= 1 << (rank >> 8)
                    elif type(held := bucket[rank]) is int:
                        bucket[rank] = [held, left] if held < left else [left, held]
                    else:
                        heappush(held, left)
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i:after[i]]))
            i = after[i]
        return tuple(out)

    def _merged_by_queue(self, piece: bytes) -> tuple[int, ...]:
        rank_of, n = self.ranks.get, len(piece)
        push, pop = self.queue.push, self.queue.pop
        # The part at i runs up to after[i]; before[i] is the part to its left; waiting[i] is the rank of i and its right neighbour.
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        waiting = [-1] * n
        for i in range(n - 1):
            rank = rank_of(piece[i:i + 2])
            if rank is not None:
                waiting[i] = rank
                push(rank, i)
        while (entry := pop()) is not None:
            rank, i = entry
            if waiting[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[gone]
            after[i], waiting[gone] = end, -1
            if end < n:
                before[end] = i
                waiting[i] = rank = rank_of(piece[i:after[end]], -1)
                if rank >= 0:
                    push(rank, i)
            else:
                waiting[i] = -1
            left = before[i]
            if left >= 0:
                waiting[left] = rank = rank_of(piece[left:end], -1)
                if rank >= 0:
                    push(rank, left)
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i:after[i]]))
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder for one rank file."""
    return worker_state(f"bpe {path} {pattern}", lambda: ByteBpe(read_ranks(path), pattern))


def byte_bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``: the ids of the whole text as little-endian unsigned 32-bit integers."""

    def run(batches):
        import pyarrow as pa

        encode = coder(path, pattern).encode
        for batch in batches:
            ids = [encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    given = docs.select("doc_id", F.col(text).alias("text"))
    return given.mapInArrow(run, given.select("doc_id", F.lit(b"").alias("ids")).schema)


def byte_bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``bytes``, what the ids of each row stand for."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = worker_state(f"bytes {path}", lambda: {rank: token for token, rank in coder(path, pattern).ranks.items()})
        for batch in batches:
            back = [b"".join(map(table.__getitem__, np.frombuffer(i.as_py(), "<u4").tolist())) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=["doc_id", "ids", "bytes"])

    given = encoded.select("doc_id", "ids")
    return given.mapInArrow(run, given.withColumn("bytes", F.lit(b"")).schema)
