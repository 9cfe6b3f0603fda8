"""Stupid-backoff scores of each text under the n-gram counts of all other texts.

The score of a word after its context is count(context, word) / count(context) of the longest context
that other documents also have before the word, times 0.4 for each word the context was shortened by;
a word alone has count / all words, and one that no other document has counts one half. A document's own
n-grams are taken off the counts. Scores are summed as natural logarithms.

Relationally: n-grams of a run of documents are exploded and counted within the run; the counts are
dealt by ranges of their hash, and each range is one part of the count table. The join sends the totals back to
the run in the order it asked, and they are summed per document. A frequent n-gram is one entry of each run
however often it occurs, so no key is hot. N-grams are known by 64-bit hashes. Entries travel as sorted
arrays in byte planes, not as a row each. The runs are made twice, once to count and once to score, so ``docs``
must be a table that gives the same rows in the same order when read again; if not, this raises.

Defined results: a null text, or one without words, has no words and a null mean; copies count for each
other; repeated rows are documents like others; an empty table gives an empty table. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..storage import materialize
from .words import grams, hash_words, in_runs

ORDER = 2
BACKOFF = 0.4
RUN_CHARS = 1 << 22
# Characters of text whose n-grams make one part of a count table, about.
PART_CHARS = 1 << 23


def _planes(values, width: int) -> bytes:
    """Whole numbers as ``width`` byte planes: the planes of high bytes are nearly constant and compress away."""
    import numpy as np

    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(planes: bytes, width: int):
    import numpy as np

    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


class _Run:
    """Documents one after another: ``doc`` and ``word`` of each position, ``words`` the distinct hashes."""

    def __init__(self, words, word, sizes):
        import numpy as np

        self.words, self.word, self.sizes = words, word, sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def level(self, k: int):
        """Distinct ``k``-grams in order, and for each position the one that ends there (-1: none)."""
        import numpy as np

        if k == 1:
            return self.words, self.word.astype(np.int64)
        ends = np.flatnonzero(self.place >= k - 1)
        at = np.full(len(self.word), -1, np.int64)
        keys, at[ends] = np.unique(grams(self.words[self.word], k)[ends - (k - 1)], return_inverse=True)
        return keys, at


def _runs(batches: Iterator) -> Iterator[tuple[int, list, _Run]]:
    import numpy as np

    for batch in batches:
        for rows in in_runs(zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))), RUN_CHARS):
            found, sizes = [], []
            some, chars = [], 0
            for n, (_, text) in enumerate(rows):
                some.append(text)
                chars += len(text)
                if chars >= 1 << 20 or n == len(rows) - 1:
                    hashes, at = hash_words(some)
                    found.append(hashes)
                    sizes.append(np.diff(at))
                    some, chars = [], 0
            words, word = np.unique(np.concatenate(found), return_inverse=True)
            run = _Run(words, word, np.concatenate(sizes))
            name = hashlib.blake2b(digest_size=8)
            name.update(repr([doc_id for doc_id, _ in rows]).encode())
            name.update(run.word.astype("<i8").tobytes())
            name.update(words.tobytes())
            yield int.from_bytes(name.digest(), "little", signed=True), [doc_id for doc_id, _ in rows], run


def _batch(rows: list[tuple], kinds: list, names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def ngram_entries(docs: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """``level, part, run, keys, counts``: the distinct n-grams of each run, dealt by ranges of their hash."""

    def make(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        for name, _, run in _runs(batches):
            for k in range(1, order + 1):
                keys, at = run.level(k)
                counts = np.bincount(at[at >= 0], minlength=len(keys))
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [(k, p, name, _planes(np.diff(keys[a:b], prepend=np.uint64(0)), 8), _planes(counts[a:b], 4))
                        for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if rows:
                    yield _batch(rows, [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()],
                                 ["level", "part", "run", "keys", "counts"])

    return docs.select("doc_id", "text").mapInArrow(make, "level int, part int, run long, keys binary, counts binary")


def _totals(pdf):
    """One part of the count table, joined to the entries that made it: totals in the order of each run's entries."""
    import numpy as np
    import pandas as pd

    keys = [np.cumsum(_numbers(k, 8), dtype=np.uint64) for k in pdf["keys"]]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([_numbers(c, 4) for c in pdf["counts"]]).astype(np.float64)).astype(np.uint64)
    ends = np.cumsum([len(k) for k in keys])
    answers = [_planes(total[at[e - len(k):e]], 6) for k, e in zip(keys, ends)]
    return pd.DataFrame({"level": pdf["level"], "part": pdf["part"], "run": pdf["run"], "totals": answers, "part_total": int(total.sum())})


def skeletons(docs: DataFrame) -> DataFrame:
    """``run, doc_ids, sizes, words, word``: what scoring a run needs besides the counts."""

    def make(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for name, doc_ids, run in _runs(batches):
            row = (name, doc_ids, run.sizes.tolist(), _planes(np.diff(run.words, prepend=np.uint64(0)), 8), _planes(run.word, 4))
            yield _batch([row], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()],
                         ["run", "doc_ids", "sizes", "words", "word"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        make, "run long, doc_ids array<long>, sizes array<long>, words binary, word binary")


def _score(run: _Run, totals: dict, all_words: int, order: int, backoff: float):
    """The sum of log scores of each document of a run."""
    import numpy as np

    n = len(run.word)
    score, open_ = np.zeros(n), np.ones(n, bool)
    counts = []
    for k in range(1, order + 1):
        keys, at = run.level(k)
        total = totals.get(k, np.zeros(0, np.uint64)).astype(np.int64)
        if len(total) != len(keys):
            raise RuntimeError("the documents were not the same when they were read again")
        held = np.flatnonzero(at >= 0)
        pairs, mine, own = np.unique(run.doc[held] * max(len(keys), 1) + at[held], return_inverse=True, return_counts=True)
        others = np.zeros(n, np.int64)
        others[held] = total[at[held]] - own[mine]
        counts.append(others)
    for k in range(order, 1, -1):
        hit = np.flatnonzero(open_ & (counts[k - 1] > 0) & (run.place >= k - 1))
        # The context of a k-gram ends one word earlier.
        score[hit] += np.log(counts[k - 1][hit] / counts[k - 2][hit - 1])
        open_[hit] = False
        score[open_ & (run.place >= k - 1)] += np.log(backoff)
    rest = np.maximum(all_words - run.sizes[run.doc], 1)
    score[open_] += np.log(np.maximum(counts[0][open_], 0.5) / rest[open_])
    return np.bincount(run.doc, weights=score, minlength=len(run.sizes))


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, log_score, mean_log_score``."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(16, -(-chars // PART_CHARS))
    entries = ngram_entries(docs.select(F.col("doc_id").cast("long"), "text"), parts, order)
    answers = entries.groupBy("level", "part").applyInPandas(
        _totals, "level int, part int, run long, totals binary, part_total long")
    answers = materialize(answers, "ngram-counts")
    # One number per part.
    all_words = answers.filter("level = 1").groupBy("part").agg(F.max("part_total").alias("n")).agg(F.sum("n")).first()[0] or 0

    def score(skeleton, found):
        import numpy as np
        import pandas as pd

        out = []
        for row in skeleton.itertuples():
            run = _Run(np.cumsum(_numbers(row.words, 8), dtype=np.uint64), _numbers(row.word, 4).astype(np.int64), np.array(row.sizes, np.int64))
            totals = {k: np.concatenate([_numbers(t, 6) for t in g.sort_values("part")["totals"]])
                      for k, g in found.drop_duplicates(["level", "part"]).groupby("level")}
            logs = _score(run, totals, all_words, order, backoff)
            out.append(pd.DataFrame({"doc_id": pd.array(list(row.doc_ids), "Int64"), "n_words": run.sizes, "log_score": logs}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_words": [], "log_score": []})

    scored = skeletons(docs).groupBy("run").cogroup(answers.groupBy("run")).applyInPandas(
        score, "doc_id long, n_words long, log_score double")
    score_ = F.round("log_score", 6)
    return scored.select("doc_id", "n_words", score_.alias("log_score"),
                         F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("mean_log_score"))
