"""Token counts that follow edits: a segment tree of pre-tokens per document.

Each document's pre-tokens are the leaves of a tree whose nodes hold the sums of characters and tokens below
them. An edit finds its leaves by descending on characters, pre-tokenizes the touched leaves again with
the two leaves before them as context, goes on to the right until an old leaf boundary is a boundary again, encodes
only what it read there, and updates the sums on the way up. The pattern must decide each match from the text at
its right alone (no look-behind), with at most two characters looked at behind a match.

Defined results: a null text is empty; places beyond the text mean its end; a null or empty list of edits changes
nothing; null parts of an edit count as 0 or as empty; repeated rows give repeated rows; an empty table gives an
empty table. Only ``doc_id``, ``text`` and ``edits`` are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .byte_bpe import INLINE_BYTES, ByteBpe, read_ranks
from .common import worker_state

NO_RANK = 1 << 40


class ScannedBpe(ByteBpe):
    """Ids as of ``ByteBpe``; the pairs of a short pre-token are few, so that looking through them costs less than a queue."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(ranks, pattern)
        self.pairs_or_none = array("q", [NO_RANK if r < 0 else r for r in self.pairs])

    def merged(self, piece: bytes) -> tuple[int, ...]:
        if piece in self.ranks or len(piece) > INLINE_BYTES:
            return super().merged(piece)
        rank_of, pairs = self.ranks.get, self.pairs_or_none
        starts = list(range(len(piece) + 1))  # of the parts, and the end
        waiting = [pairs[x << 8 | y] for x, y in zip(piece, piece[1:])]
        while waiting:
            rank = min(waiting)
            if rank == NO_RANK:
                break
            i = waiting.index(rank)
            del starts[i + 1], waiting[i]
            if i < len(waiting):
                waiting[i] = rank_of(piece[starts[i]:starts[i + 2]], NO_RANK)
            if i:
                waiting[i - 1] = rank_of(piece[starts[i - 1]:starts[i + 1]], NO_RANK)
        return tuple([rank_of(piece[a:b]) for a, b in zip(starts, starts[1:])])


class DocumentTree:
    """Counts of one text. Leaf ``i`` holds the text of some pre-tokens, at first of one."""

    def __init__(self, text: str, bpe):
        import numpy as np

        self.bpe = bpe
        self.leaves = pieces = bpe.find(text)
        self.encoded = 0  # pre-tokens encoded because of edits
        n = len(pieces)
        self.size = 1 << (max(n, 1) - 1).bit_length()
        node = np.zeros((2, 2 * self.size), np.int64)
        node[0, self.size:self.size + n] = np.fromiter(map(len, pieces), np.int64, n)
        node[1, self.size:self.size + n] = np.fromiter(map(len, map(bpe.__getitem__, pieces)), np.int64, n) >> 2
        width = self.size
        while width > 1:
            node[:, width // 2:width] = node[:, width:2 * width:2] + node[:, width + 1:2 * width:2]
            width //= 2
        self.chars, self.tokens = node.tolist()  # edits take single numbers, which are quick from lists

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with the character at ``place`` and where that leaf begins."""
        node, start, chars = 1, 0, self.chars
        while node < self.size:
            node *= 2
            if place >= start + chars[node]:
                start += chars[node]
                node += 1
        return node - self.size, start

    def _set(self, first: int, last: int, pieces: list[str]) -> None:
        """``pieces`` into leaf ``first``; those behind it up to ``last`` become empty. Sums are taken up level by level."""
        if first == len(self.leaves):
            self.leaves.append("")
        chars, tokens = self.chars, self.tokens
        n = max(last - first, 1)
        self.leaves[first:first + n] = ["".join(pieces)] + [""] * (n - 1)
        low, high = first + self.size, first + self.size + n
        chars[low:high] = tokens[low:high] = [0] * n
        chars[low] = sum(map(len, pieces))
        tokens[low] = sum(map(len, map(self.bpe.__getitem__, pieces))) >> 2
        high -= 1
        while low > 1:
            low, high = low // 2, high // 2
            for node in range(low, high + 1):
                chars[node] = chars[2 * node] + chars[2 * node + 1]
                tokens[node] = tokens[2 * node] + tokens[2 * node + 1]

    def _text(self, first: int, last: int) -> str:
        return "".join(self.leaves[first:last])

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replace ``cut`` characters at ``at`` by ``put``."""
        total = self.n_chars
        at = min(max(at, 0), total)
        end = min(at + max(cut, 0), total)
        if at == end and not put:
            return
        first, start = self._leaf_at(max(at - 1, 0)) if total else (0, 0)
        for _ in range(2):
            if start:
                first, start = self._leaf_at(start - 1)
        # Leaves first..last-1 are replaced; the text behind them starts at ``stop``.
        last, stop = self._leaf_at(end) if end < total else (len(self.leaves), total)
        last, stop = (last + 1, stop + self.chars[last + self.size]) if stop < total else (last, stop)
        old = self._text(first, last)
        while True:
            ahead = last
            seen = 0
            while ahead < len(self.leaves) and seen < 3:
                seen += self.chars[ahead + self.size]
                ahead += 1
            new = old[:at - start] + put + old[end - start:]
            pieces, length = [], 0
            for piece in self.bpe.find(new + self._text(last, ahead)):
                if length >= len(new):
                    break
                pieces.append(piece)
                length += len(piece)
            if length == len(new):
                break
            old += self._text(last, ahead)
            last = ahead
        self.encoded += len(pieces)
        self._set(first, last, pieces)

    def text(self) -> str:
        return self._text(0, len(self.leaves))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Join a table ``doc_id, seq, at, cut, put`` to its documents as a list in the order of ``seq``."""
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "cut", "put"))).alias("edits"))
    return docs.select("doc_id", "text").join(
        lists.select("doc_id", F.transform("edits", lambda e: F.struct(e["at"].alias("at"), e["cut"].alias("cut"), e["put"].alias("put"))).alias("edits")),
        "doc_id", "left")


def edited_token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` has ``edits``, a list of ``at, cut, put`` applied one after another, each to the text as it then is.

    Gives ``doc_id, tokens_before, tokens_after, chars_after, n_pretokens, n_reencoded``.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        bpe = worker_state(f"scanned bpe {path} {pattern}", lambda: ScannedBpe(read_ranks(path), pattern))
        names = ["doc_id", "tokens_before", "tokens_after", "chars_after", "n_pretokens", "n_reencoded"]
        for batch in batches:
            rows = []
            for key, text, edits in zip(*batch.columns):
                tree = DocumentTree(text.as_py() or "", bpe)
                before, n = tree.n_tokens, len(tree.leaves)
                for e in edits.as_py() or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
                rows.append((before, tree.n_tokens, tree.n_chars, n, tree.encoded))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    given = docs.select("doc_id", "text", "edits")
    schema = given.select("doc_id", *[F.lit(0).cast("long").alias(n) for n in
                                      ("tokens_before", "tokens_after", "chars_after", "n_pretokens", "n_reencoded")]).schema
    return given.mapInArrow(run, schema)


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits for every document, made from the document itself: an insertion, a deletion and a new end."""
    size = F.length(F.coalesce("text", F.lit("")))
    one = lambda at, cut, put: F.struct(at.cast("long").alias("at"), cut.cast("long").alias("cut"), put.alias("put"))
    return docs.select("doc_id", "text", F.array(
        one(F.pmod(F.xxhash64("doc_id"), size + 1), F.lit(0), F.concat_ws(" ", F.lit(" edited"), "source", "lang", F.lit("it's 42\n\n  x"))),
        one(F.floor(size / 4), F.least(F.lit(40), F.floor(size / 8)), F.lit("")),
        one(size, F.lit(9), F.lit("  the end")),
    ).alias("edits"))
