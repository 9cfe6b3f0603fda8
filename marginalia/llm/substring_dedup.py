"""Passages that repeat across documents, also with small changes, by collinear chaining.

1. Seeds: runs of ``SEED_WORDS`` words, one in ``KEEP`` by their hash alone, so that a run that survives an edit is a seed on both
   sides or on neither; and of each ``WINDOW`` consecutive runs the one with the smallest hash, so that no equal stretch is without.
2. Each seed links its places to its first place in the corpus (smallest ``doc_id``, then smallest position): a star, never all pairs.
3. The links of a document to one other document are chained in order: a Fenwick tree over positions gives the best
   predecessor under a gap cost that is linear in the words skipped. A chain needs two seeds: one alone is mostly chance.
   Of a document's chains those are left whose places a longer one covers without a gap.
4. Only the words around each chain are fetched; both sides are aligned outwards from the chain's seeds, over
   substitutions, insertions and deletions, as far as at least ``SIMILARITY`` of the words agree. An alignment that comes
   to the edge of the words fetched gets more of them, until it ends by itself. An insertion of more than ``WIDE_BAND``
   words ends a segment; what lies behind it is a segment of its own.
5. Segments of a document that one other document holds are merged; a run of more than ``PASSAGE_WORDS`` words is a
   repeated passage. The first place of a passage in the corpus is not reported.
6. Segments from different documents may adjoin. Such a run of more than ``PASSAGE_WORDS`` words counts where another
   document has the same ``PASSAGE_WORDS + 1`` words in a row in such a run of its own, and nowhere else.

Defined results: null texts and texts without words have no passages; a null ``doc_id`` is left out; rows with one
``doc_id`` and one text are the same document, with different texts they are different ones that share their number in
results; passages that repeat within one document only are not looked for; an empty table gives an empty table. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import collections
import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.ranks import with_place
from ..storage import materialize
from .common import give_back
from .words import grams, hash_words, in_runs

SEED_WORDS = 4
KEEP = 3
WINDOW = 16
PASSAGE_WORDS = 50
SIMILARITY = 0.8
# A chain gains a seed's words per seed and pays for each skipped word of either side.
GAP_COST = 0.05
SEGMENT_WORDS = 16
# Words skipped on either side of a difference; the wide band is tried where the narrow one has nothing.
BAND, WIDE_BAND = 12, 48
# Words by which an alignment may fall short of the similarity on its way.
SLACK = 16
# A chain on one diagonal is left where fewer than half of the words beside its seeds agree, so many on either side; so are
# chains as far inside a passage already found.
BESIDE = 16
# Words fetched on either side of a chain, and by how much that grows for alignments that come to their edge: seeds of a
# passage may all have their first place elsewhere for a while.
MARGIN, GROWTH = 128, 8
# Bits of the filter on texts, in rows of 32,768 bits: two megabytes.
FILTER_BITS = 1 << 24
# Links in one task's group, about; a document's links stay together.
GROUP_LINKS = 50_000
# Chains whose requests for words of one document are put into one row, about; a document asked by many has several rows.
LIST_REQUESTS = 256


def seeds_of(hashes, at):
    """The seeds of many texts, whose words begin at ``at``: the number of the text, the place in it and the hash."""
    import numpy as np

    runs = grams(hashes, SEED_WORDS)
    end = np.repeat(at[1:], np.diff(at))[:len(runs)]
    place = np.arange(len(runs))
    keep = (runs < np.uint64((1 << 64) // KEEP)) & (place + SEED_WORDS <= end)
    # The smallest of each window, the leftmost of equal ones, from windows of half its length.
    least, where, width = runs, place, 1
    while width < WINDOW and len(least) > width:
        a, b = least[:-width], least[width:]
        where = np.where(a <= b, where[:-width], where[width:])
        least, width = np.minimum(a, b), 2 * width
    if width == WINDOW:
        keep[where[place[:len(where)] + WINDOW + SEED_WORDS - 1 <= end[:len(where)]]] = True
    count = np.diff(at) - SEED_WORDS + 1
    for i in np.flatnonzero((count > 0) & (count < WINDOW)).tolist():  # texts without a whole window
        keep[at[i] + runs[at[i]:at[i] + count[i]].argmin()] = True
    pos = np.flatnonzero(keep)
    text = np.searchsorted(at, pos, "right") - 1
    return text, pos - at[text], runs[pos]


def seeds(docs: DataFrame, once: bool = False) -> DataFrame:
    """``doc_id, pos, seed``; of equal seeds of one row only the first if ``once``."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for rows in in_runs(zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)))):
                text, pos, seed = seeds_of(*hash_words([text for _, text in rows]))
                if once:
                    order = np.argsort(seed, kind="stable")
                    again = (np.diff(seed[order]) == 0) & (np.diff(text[order]) == 0)
                    order = np.delete(order, np.flatnonzero(again) + 1)
                    text, pos, seed = text[order], pos[order], seed[order]
                ids = np.array([doc_id for doc_id, _ in rows], np.int64)[text]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array(pos.astype(np.int32)), pa.array(seed.view(np.int64))], names=["doc_id", "pos", "seed"])
        give_back()

    given = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return given.mapInArrow(run, "doc_id long, pos int, seed long")


def links(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, from_id, from_pos``: each place of a shared seed and the seed's first place, in another document."""
    # With one row per seed and document, or equal ones, the smallest document has one place; a smallest struct would need sorting.
    first = seeds(docs, once=True).groupBy("seed").agg(
        F.min("doc_id").alias("from_id"), F.min_by("pos", "doc_id").alias("from_pos"), F.max("doc_id").alias("z")).filter("from_id < z")
    first = materialize(first.select("seed", "from_id", "from_pos"), "seeds")
    return seeds(docs).join(first, "seed").filter("doc_id <> from_id").select("doc_id", "pos", "from_id", "from_pos")


def chain(x, y) -> list[list[int]]:
    """Chains of the matches ``(x, y)``, given in the order of ``x``: lists of indexes, best chain first.

    A match's score is its seed's words plus the best score before it, less the gap cost of the words between; with a
    linear cost that is a maximum over smaller ``x`` and ``y``, kept in a Fenwick tree over the ranks of ``y``.
    """
    n = len(x)
    if n == 1:
        return [[0]]
    ys = sorted(set(y))
    rank = {v: i + 1 for i, v in enumerate(ys)}
    best = [(-1.0, -1)] * (len(ys) + 1)  # score plus the cost of what lies before, and the match
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:  # matches at one place do not follow each other
            r, top = rank[y[j]] - 1, (-1.0, -1)
            while r:
                if best[r] > top:
                    top = best[r]
                r &= r - 1
            gained = top[0] - GAP_COST * (x[j] + y[j])
            score[j], before[j] = (SEED_WORDS + gained, top[1]) if top[1] >= 0 and gained > 0 else (float(SEED_WORDS), -1)
            j += 1
        for m in range(i, j):
            entry, r = (score[m] + GAP_COST * (x[m] + y[m]), m), rank[y[m]]
            while r < len(best):
                if entry > best[r]:
                    best[r] = entry
                r += r & -r
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: (-score[m], m)):
        path, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = before[m]
        if path:
            out.append(path[::-1])
    return out


def _chains(pdf):
    """The chains of a group's documents, with the places of their seeds in both; a row for each pair of documents."""
    import numpy as np
    import pandas as pd

    pdf = pdf.drop_duplicates().sort_values(["doc_id", "from_id", "pos", "from_pos"], kind="stable")
    a, b = pdf["doc_id"].to_numpy(), pdf["from_id"].to_numpy()
    xs, ys = pdf["pos"].to_numpy(), pdf["from_pos"].to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1).tolist(), len(pdf)] if len(pdf) else [0]
    rows = []
    for lo, hi in zip(cuts, cuts[1:]):
        x, y = xs[lo:hi].tolist(), ys[lo:hi].tolist()
        steps = set(np.diff(xs[lo:hi] - ys[lo:hi]).tolist())
        # One diagonal without large gaps is its own best chain.
        plain = steps <= {0} and (hi - lo < 2 or np.diff(xs[lo:hi]).max() * 2 * GAP_COST < SEED_WORDS) and (hi - lo < 2 or np.diff(xs[lo:hi]).min() > 0)
        again = collections.Counter(y)
        for n, path in enumerate([list(range(hi - lo))] if plain else chain(x, y)):
            # A text that repeats itself has many places of one seed, which cannot follow each other.
            if len(path) < 2 and again[y[path[0]]] < 2:
                continue
            rows.append((a[lo], b[lo], n, [x[i] for i in path], [y[i] for i in path]))
    give_back()
    kept = [row for _, of in itertools.groupby(rows, key=lambda r: r[0]) for row in _needed(list(of))]
    pairs = []
    for (doc_id, from_id), of in itertools.groupby(sorted(kept, key=lambda r: r[:3]), key=lambda r: r[:2]):
        of = list(of)
        pairs.append((doc_id, from_id, [r[2] for r in of], [len(r[3]) for r in of],
                      list(itertools.chain.from_iterable(r[3] for r in of)), list(itertools.chain.from_iterable(r[4] for r in of))))
    return pd.DataFrame(pairs, columns=["doc_id", "from_id", "ns", "sizes", "xs", "ys"])


def _needed(rows: list[tuple]) -> list[tuple]:
    """A document's chains without those whose places another chain covers.

    A chain covers the places between its seeds where they lie on one diagonal, no more than ``WINDOW`` words apart, over
    more than ``PASSAGE_WORDS`` words: there the other document has the passage already. Chains with more seeds go first.
    """
    if len(rows) == 1:
        return rows
    covered = bytearray(max(r[3][-1] for r in rows) + SEED_WORDS)
    kept = []
    for row in sorted(rows, key=lambda r: (-len(r[3]), r[1], r[2])):
        xs, ys = row[3], row[4]
        if covered.find(0, xs[0], xs[-1] + SEED_WORDS) < 0:
            continue
        kept.append(row)
        first = 0
        for i in range(1, len(xs) + 1):
            if i < len(xs) and xs[i] - xs[i - 1] <= WINDOW and xs[i] - ys[i] == xs[first] - ys[first]:
                continue
            if xs[i - 1] + SEED_WORDS - xs[first] > PASSAGE_WORDS:
                covered[xs[first]:xs[i - 1] + SEED_WORDS] = b"\1" * (xs[i - 1] + SEED_WORDS - xs[first])
            first = i
    return kept


# The chains of a pair of documents: their numbers, how many seeds each has, and the seeds' places, one chain after another.
CHAINS = "doc_id long, from_id long, ns array<int>, sizes array<int>, xs array<int>, ys array<int>"


def chains(linked: DataFrame, groups: int) -> DataFrame:
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g")
    return linked.groupBy(group).applyInPandas(_chains, CHAINS)


def _only(frames: Iterator) -> Iterator:
    """Of each pair's chains those whose numbers are in ``todo``."""
    import numpy as np

    for frame in frames:
        rows = []
        for doc_id, from_id, ns, sizes, xs, ys, todo in zip(*[frame[c] for c in ("doc_id", "from_id", "ns", "sizes", "xs", "ys", "todo")]):
            asked = np.isin(ns, todo)
            each = np.repeat(asked, sizes)
            rows.append((doc_id, from_id, ns[asked], sizes[asked], xs[each], ys[each]))
        yield type(frame)(rows, columns=["doc_id", "from_id", "ns", "sizes", "xs", "ys"])


def _fours(words):
    """Each four words of 16 bits as one number."""
    import numpy as np

    w = words.astype(np.uint64)
    n = max(len(w) - 3, 0)
    return w[:n] | w[1:n + 1] << np.uint64(16) | w[2:n + 2] << np.uint64(32) | w[3:n + 3] << np.uint64(48)


def _go_on(a4, b4) -> tuple[int, int] | None:
    """The nearest places from where four words agree, within the narrow band if there are any, else within the wide one."""
    same = a4[:WIDE_BAND + 1, None] == b4[None, :WIDE_BAND + 1]
    p, q = same.nonzero()
    if not len(p):
        return None
    near = (p <= BAND) & (q <= BAND)
    if near.any():
        p, q = p[near], q[near]
    best = ((p + q) * 100 + abs(p - q)).argmin()  # fewest words skipped, and equal numbers first
    return int(p[best]), int(q[best])


def _stretch(a, b, a4, b4) -> list[tuple[int, int, int]]:
    """Places up to which ``a`` and ``b`` go along from their beginnings: words of either, and how many of them agree.

    After a difference the words go on side by side if five of the next eight agree, else from the nearest place where
    four words agree again; ``a4`` and ``b4`` are their fours.
    """
    i = j = agree = 0
    points = [(0, 0, 0)]
    while True:
        n = min(len(a) - i, len(b) - j)
        equal = a[i:i + n] == b[j:j + n]
        same = int(equal.argmin()) if n else 0
        if n and equal[same]:
            same = n
        i, j, agree = i + same, j + same, agree + same
        if same:
            points.append((i, j, agree))
        if agree < SIMILARITY * max(i, j) - SLACK:
            return points
        if int(equal[same + 1:same + 9].sum()) >= 5:
            i, j = i + 1, j + 1
            continue
        found = _go_on(a4[i:], b4[j:])
        if not found:
            return points
        p, q = found
        if p == q:
            agree += int((a[i:i + p] == b[j:j + p]).sum())
        i, j = i + p, j + q


def _both_ways(left: list, right: list) -> tuple:
    """The places on either side with the most words between of which at least ``SIMILARITY`` agree."""
    import numpy as np

    best, most = (left[0], right[0]), 0
    if len(left) * len(right) <= 64:
        for point in left:
            for end in right:
                n = point[0] + end[0]
                if n > most and point[2] + end[2] >= SIMILARITY * max(n, point[1] + end[1]):
                    best, most = (point, end), n
        return best
    ends = np.array(right)
    for point in left:
        whole = ends + point
        good = np.flatnonzero(whole[:, 2] >= SIMILARITY * whole[:, :2].max(1))
        if len(good):
            at = good[whole[good, 0].argmax()]
            if whole[at, 0] > most:
                best, most = (point, right[at]), whole[at, 0]
    return best


def _promising(a, b, at, shift: int) -> bool:
    """Whether half of the words beside a chain's seeds agree on its diagonal: most chains of two seeds are chance."""
    first, end = int(at[0]) - BESIDE, int(at[-1]) + SEED_WORDS + BESIDE
    first, end = max(first, 0, -shift), min(end, len(a), len(b) - shift)
    return 2 * int((a[first:end] == b[first + shift:end + shift]).sum()) >= end - first


SEGMENTS = "doc_id long, from_id long, n int, first int, end int, agree int, from_word int, open boolean"


def _words_of(words, starts, upto):
    """Where the words asked for begin within ``words``, and those with their fours."""
    import numpy as np

    words = np.frombuffer(words, np.uint16)
    bases = np.concatenate([[0], np.cumsum(upto - starts)]).tolist()
    return words, _fours(words), starts.tolist(), bases


def _around(places, words, total: int, margin: int):
    """The words around a chain's places in one document, their fours, and the number of the first."""
    words, fours, starts, bases = words
    first, end = max(int(places[0]) - margin, 0), min(int(places[-1]) + SEED_WORDS + margin, total)
    k = bisect.bisect_right(starts, first) - 1
    low = bases[k] + first - starts[k]
    high = low + end - first
    return words[low:high], fours[low:max(high - 3, low)], first


def _segments(margin: int):
    """Both sides of each chain of a group's documents, aligned; ``open`` where a side had no more words fetched."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        key = ["doc_id", "from_id"]
        pdf = pdf.drop_duplicates(["own", *key])
        own = pdf[pdf["own"]]
        both = own.merge(pdf.loc[~pdf["own"], [*key, "places", "starts", "upto", "words", "total"]], on=key)
        pairs = list(zip(*[both[c] for c in ("places_x", "places_y", "starts_x", "starts_y", "upto_x", "upto_y", "words_x", "words_y", "total_x", "total_y")]))
        # Of a document's chains those with more seeds go first; one well inside a passage that is found says nothing new.
        order = []
        for i, (doc_id, from_id, ns, sizes) in enumerate(zip(*[both[c] for c in (*key, "ns", "sizes")])):
            end = 0
            for n, size in zip(ns.tolist(), sizes.tolist()):
                end += size
                order.append((doc_id, -size, from_id, n, i, end))
        order.sort()
        rows = []
        for doc_id, of in itertools.groupby(order, key=lambda o: o[0]):
            passage, pair = None, -1
            for _, size, from_id, n, i, end in of:
                x_places, y_places, *where, x_bytes, y_bytes, x_total, y_total = pairs[i]
                xs, ys = x_places[end + size:end], y_places[end + size:end]
                passage = passage if passage is not None else bytearray(x_total)
                if passage.find(0, max(int(xs[0]) - BESIDE, 0), min(int(xs[-1]) + SEED_WORDS + BESIDE, x_total)) < 0:
                    continue
                if i != pair:  # chains of as many seeds come pair by pair
                    pair, x_words, y_words = i, _words_of(x_bytes, where[0], where[2]), _words_of(y_bytes, where[1], where[3])
                a, a4, x_first = _around(xs, x_words, x_total, margin)
                b, b4, y_first = _around(ys, y_words, y_total, margin)
                # Where there is more of either text than was fetched.
                before, behind = (x_first > 0, y_first > 0), (x_first + len(a) < x_total, y_first + len(b) < y_total)
                covered = -1
                if ys[0] - xs[0] == ys[-1] - xs[-1] and not _promising(a, b, xs - x_first, int(ys[0] - y_first) - int(xs[0] - x_first)):
                    continue
                for x, y in zip(xs.tolist(), ys.tolist()):
                    if x < covered:
                        continue
                    i, j = x - x_first, y - y_first
                    left = _stretch(a[:i][::-1], b[:j][::-1], a4[:max(i - 3, 0)][::-1], b4[:max(j - 3, 0)][::-1])
                    right = _stretch(a[i:], b[j:], a4[i:], b4[j:])
                    edge = before[0] and left[-1][0] >= i or before[1] and left[-1][1] >= j
                    edge |= behind[0] and right[-1][0] >= len(a) - i or behind[1] and right[-1][1] >= len(b) - j
                    left, right = _both_ways(left, right)
                    agree = left[2] + right[2]
                    covered = x + max(right[0], 1)
                    if agree >= SEGMENT_WORDS:
                        rows.append((doc_id, from_id, n, x - left[0], x + right[0], agree, y - left[1], bool(edge)))
                        if left[0] + right[0] > PASSAGE_WORDS:
                            passage[x - left[0]:x + right[0]] = b"\1" * (left[0] + right[0])
        give_back()
        return pd.DataFrame(rows, columns=["doc_id", "from_id", "n", "first", "end", "agree", "from_word", "open"])

    return run


def _runs_of(segments: list, gap: int = 2) -> Iterator[list]:
    """Segments in their order, in lists of those that adjoin."""
    run: list = []
    for s in sorted(segments):
        if run and s[0] > end + gap:
            yield run
            run = []
        end = max(end, s[1]) if run else s[1]
        run.append(s)
    if run:
        yield run


def _passages(pdf):
    """The segments of a group's documents to their passages, and to ``mixed`` runs that no one document holds."""
    import pandas as pd

    rows = []
    parts = sorted(zip(*[pdf[c].tolist() for c in ("doc_id", "from_id", "first", "end", "agree", "from_word")]))
    for doc_id, of in itertools.groupby(parts, key=lambda p: p[0]):
        segments, held = [], []
        for from_id, own in itertools.groupby(of, key=lambda p: p[1]):
            own = [(first, end, agree, from_id, from_word) for _, _, first, end, agree, from_word in own]
            segments += own
            held += [(r[0][0], max(s[1] for s in r), r) for r in _runs_of(own)]
        held = [h for h in held if h[1] - h[0] > PASSAGE_WORDS]
        # Parts that different documents hold, and that overlap, are one passage.
        joined = [[h for h in run] for run in _runs_of(held, -1)] if held else []
        for run in joined:
            first, end = run[0][0], max(h[1] for h in run)
            main = max((s for h in run for s in h[2]), key=lambda s: (s[2], -s[3]))
            rows.append((doc_id, first, end - first, main[3], main[4], main[2], sorted({h[2][0][3] for h in run}), False))
        whole = [(run[0][0], max(h[1] for h in run)) for run in joined]
        for run in _runs_of(segments):
            first, end = run[0][0], max(s[1] for s in run)
            if end - first > PASSAGE_WORDS and not any(a <= first and end <= b for a, b in whole):
                rows.append((doc_id, first, end - first, run[0][3], run[0][4], 0, [], True))
    return pd.DataFrame(rows, columns=["doc_id", "first_word", "n_words", "from_id", "from_word", "n_agree", "source_ids", "mixed"])


def _windows(batches: Iterator):
    """Each run of ``PASSAGE_WORDS + 1`` words within a document's mixed runs, as 128 bits."""
    import numpy as np
    import pyarrow as pa

    n = PASSAGE_WORDS + 1
    for batch in batches:
        for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            hashes = hash_words([text.as_py() or ""])[0]
            one, two = grams(hashes, n), grams(hashes * np.uint64(0x9E3779B97F4A7C15), n)
            at = np.unique(np.concatenate([np.arange(r["first_word"], min(r["first_word"] + r["n_words"] - n + 1, len(one))) for r in runs]))
            for low in range(0, len(at), 100_000):
                part = at[low:low + 100_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(part), doc_id)), pa.array(part.astype(np.int32)), pa.array(one[part].view(np.int64)),
                    pa.array(two[part].view(np.int64))], names=["doc_id", "at", "one", "two"])


def _held_elsewhere(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages within mixed runs that an earlier document has in a mixed run of its own, word for word."""
    runs = mixed.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "n_words")).alias("runs"))
    texts = _texts_of(texts, mixed.select(F.col("doc_id").alias("_id")))
    windows = runs.join(texts, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "runs").mapInArrow(
        _windows, "doc_id long, at int, one long, two long")
    windows = materialize(windows, "windows")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max("doc_id").alias("z")).filter("f.doc_id < z")
    again = windows.join(first, ["one", "two"]).filter("doc_id > f.doc_id")
    n = PASSAGE_WORDS + 1
    in_order = W.partitionBy("doc_id").orderBy("at")
    begins = F.coalesce(F.col("at") > F.lag("at").over(in_order) + n, F.lit(True)).cast("int")
    islands = again.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(in_order))
    words = (F.max("at") - F.min("at") + n).cast("int")
    start = F.min(F.struct("at", "f"))
    return islands.groupBy("doc_id", "_island").agg(
        F.min("at").alias("first_word"), words.alias("n_words"), start["f"]["doc_id"].alias("from_id"), start["f"]["at"].alias("from_word"),
        words.alias("n_agree"), F.sort_array(F.collect_set("f.doc_id")).alias("source_ids")).drop("_island")


def _without_overlap(found: DataFrame) -> DataFrame:
    """Passages of a document that overlap as one, named after the longest."""
    in_order = W.partitionBy("doc_id").orderBy("first_word", "n_words")
    ends = F.max(F.col("first_word") + F.col("n_words")).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first_word") >= ends, F.lit(True)).cast("int")
    islands = found.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    main = F.max(F.struct("n_agree", (-F.col("from_id")).alias("_order"), "from_id", "from_word"))
    return islands.groupBy("doc_id", "_island").agg(
        F.min("first_word").alias("first_word"), (F.max(F.col("first_word") + F.col("n_words")) - F.min("first_word")).cast("int").alias("n_words"),
        main["from_id"].alias("from_id"), main["from_word"].alias("from_word"), main["n_agree"].alias("n_agree"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("source_ids")).drop("_island")


def _windows_of(pair, places, sizes, total, margin: int):
    """Where the words around chains begin and end, and their pair; those of a pair that overlap as one.

    ``pair`` ascends, ``total`` has the words of each chain's document.
    """
    import numpy as np

    ends = np.cumsum(sizes)
    # Each pair has a range of numbers of its own, so that one pass merges the windows of all.
    base = pair * (total.max(initial=0) + 1)
    first = np.maximum(places[ends - sizes] - margin, 0) + base
    order = np.argsort(first, kind="stable")
    first = first[order]
    end = np.maximum.accumulate((np.minimum(places[ends - 1] + SEED_WORDS + margin, total) + base)[order])
    begins = np.flatnonzero(first[1:] > end[:-1]) + 1
    low, high = np.concatenate([[0], begins]), np.concatenate([begins - 1, [len(end) - 1]])
    return pair[low], first[low] - base[low], end[high] - base[low]


def _cut_words(margin: int):
    """The words that each document's requests ask for, as 16-bit hashes; a row per request."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("own", pa.bool_()), ("doc_id", pa.int64()), ("from_id", pa.int64()), *[
            (c, pa.list_(pa.int32())) for c in ("ns", "sizes", "places", "starts", "upto")], ("words", pa.binary()), ("total", pa.int32())])

        for batch in batches:
            for rows in in_runs(enumerate(t.as_py() for t in batch.column(1))):
                hashes, at = hash_words([text for _, text in rows])
                hashes = hashes.astype(np.uint16)
                lists = batch.column(0).slice(rows[0][0], len(rows))
                asked = lists.flatten()
                row = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
                chains_of = asked.field("sizes").value_lengths().to_numpy()
                places, sizes = [asked.field(c).flatten().to_numpy().astype(np.int64) for c in ("places", "sizes")]
                total = np.diff(at)[row]
                pair, first, end = _windows_of(np.repeat(np.arange(len(asked)), chains_of), places, sizes, np.repeat(total, chains_of), margin)
                begin = at[row[pair]]
                words = [hashes[a:b] for a, b in zip((begin + first).tolist(), (begin + end).tolist())]
                upto = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                offsets = upto(np.bincount(pair, minlength=len(asked)))
                bytes_of = upto(np.bincount(pair, 2 * (end - first), len(asked)))
                yield pa.RecordBatch.from_arrays([
                    *[asked.field(c).cast(schema.field(c).type) for c in schema.names[:6]],
                    *[pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (first, end)],
                    pa.Array.from_buffers(pa.binary(), len(asked), [None, bytes_of.buffers()[1], pa.py_buffer(np.concatenate(words))]),
                    pa.array(total.astype(np.int32))], schema=schema)
        give_back()

    return run


def _requests(found: DataFrame) -> DataFrame:
    """``owner, asked``: which words are wanted of a document, in lists of about ``LIST_REQUESTS``."""
    def one(own: bool, owner: str, places: str):
        return found.select(F.col(owner).alias("owner"), F.lit(own).alias("own"), "doc_id", "from_id", "ns", "sizes", F.col(places).alias("places"))

    wanted = one(True, "doc_id", "xs").unionByName(one(False, "from_id", "ys"))
    counts = materialize(wanted.groupBy("owner").agg(F.ceil(F.sum(F.size("ns")) / LIST_REQUESTS).alias("lists")), "requests")
    row = F.struct("own", "doc_id", "from_id", "ns", "sizes", "places")
    salt = F.pmod(F.xxhash64("own", "doc_id", "from_id"), "lists")
    # Dealt out by owner and list: the join's partitions would gather a document that many ask for in one task.
    dealt = wanted.join(counts, "owner").select("owner", salt.alias("salt"), row.alias("row")).repartition("owner", "salt")
    return dealt.groupBy("owner", "salt").agg(F.collect_list("row").alias("asked")).drop("salt")


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``_id``, one number for each document; and if some are not its ``doc_id``, those with it.

    Texts that share a ``doc_id`` get numbers below all others. Without such rows nothing is hashed or joined.
    """
    given = docs.withColumn("_id", F.col("doc_id").cast("long"))
    ids = given.filter("_id is not null")
    many = materialize(ids.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id"), "repeated-ids")
    if many.isEmpty():
        return given, None
    key = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("none"))
    texts = materialize(ids.join(many, "_id", "left_semi").select("_id", key.alias("_key")).distinct(), "repeated-ids")
    several = texts.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id")
    texts = materialize(texts.join(several, "_id", "left_semi"), "repeated-ids")
    if texts.isEmpty():
        return given, None
    low = min(0, ids.agg(F.min("_id")).first()[0])
    placed = with_place(texts.withColumn("_all", F.lit(0)), ["_all"], ["_id", "_key"], "_n", "repeated-ids")
    names = materialize(placed.select("_id", "_key", (F.lit(low).cast("long") - F.col("_n")).alias("_own")), "repeated-ids")
    given = given.withColumn("_key", key).join(names, ["_id", "_key"], "left").withColumn("_id", F.coalesce("_own", "_id"))
    return given.select(*docs.columns, "_id"), names.select(F.col("_own").alias("_name"), F.col("_id").alias("_doc_id"))


def _texts_of(texts: DataFrame, owners: DataFrame) -> DataFrame:
    """The texts of the documents ``_id`` of ``owners``, and few others: a bitmap of fixed size goes to where texts are read.

    So a later look at few documents does not shuffle the texts of all.
    """
    # Spark numbers the bits from 1.
    at = F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS)) + 1
    bucket, place = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    bits = owners.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = texts.withColumns({"_bucket": bucket, "_place": place}).join(F.broadcast(bits), "_bucket").withColumn("_byte", byte)
    return marked.filter(F.expr("_byte >> cast(_place % 8 as int) & 1") == 1).select(*texts.columns)


def _found(given: DataFrame) -> DataFrame:
    """The passages of rows told apart by ``_id``."""
    texts = given.select("_id", "text")
    linked = materialize(links(texts.withColumnRenamed("_id", "doc_id")), "links")
    groups = max(1, linked.count() // GROUP_LINKS)
    asked = materialize(chains(linked, groups), "chains")
    group = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g")
    margin, parts = MARGIN, []
    while True:
        of = texts if margin == MARGIN else _texts_of(texts, asked.select(F.explode(F.array("doc_id", "from_id")).alias("_id")))
        cut = _requests(asked).join(of, F.col("owner") == F.col("_id")).select("asked", "text").mapInArrow(
            _cut_words(margin), "own boolean, doc_id long, from_id long, ns array<int>, sizes array<int>, places array<int>, starts array<int>, "
            "upto array<int>, words binary, total int")
        segments = materialize(cut.groupBy(group).applyInPandas(_segments(margin), SEGMENTS), "segments")
        # A chain that came to the edge is aligned anew, with more words.
        unfinished = segments.filter("open").select("doc_id", "from_id", "n").distinct()
        parts.append(segments.join(unfinished, ["doc_id", "from_id", "n"], "left_anti"))
        if unfinished.isEmpty():
            break
        todo = unfinished.groupBy("doc_id", "from_id").agg(F.collect_list("n").alias("todo"))
        asked = materialize(asked.join(todo, ["doc_id", "from_id"]).mapInPandas(_only, CHAINS), "chains")
        margin *= GROWTH
    segments = parts[0]
    for part in parts[1:]:
        segments = segments.unionByName(part)
    found = segments.groupBy(group).applyInPandas(
        _passages, "doc_id long, first_word int, n_words int, from_id long, from_word int, n_agree int, source_ids array<long>, mixed boolean")
    found = materialize(found, "found")
    clear, mixed = found.filter("not mixed").drop("mixed"), found.filter("mixed").drop("mixed")
    if mixed.isEmpty():
        return clear
    return _without_overlap(clear.unionByName(materialize(_held_elsewhere(mixed, texts), "held-elsewhere")))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, first_word, n_words, from_id, from_word, n_agree, source_ids``: each passage that another document has before.

    Words count from 0. ``from_id`` has the longest part of the passage, ``n_agree`` words of it; ``source_ids`` all that hold
    more than ``PASSAGE_WORDS`` words of it in a row.
    """
    given, names = told_apart(docs.select("doc_id", "text"))
    found = _found(given)
    if names is None:
        return found
    columns = found.columns
    for c in ("doc_id", "from_id"):
        name = names.select(F.col("_name").alias(c), F.col("_doc_id").alias(f"_{c}"))
        found = found.join(name, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    listed = found.withColumn("_row", F.monotonically_increasing_id())
    listed = materialize(listed, "found")
    name = names.select(F.col("_name").alias("s"), "_doc_id")
    own = listed.select("_row", F.explode("source_ids").alias("s")).join(name, "s", "left").groupBy("_row").agg(
        F.sort_array(F.collect_set(F.coalesce("_doc_id", "s"))).alias("source_ids"))
    return listed.drop("source_ids").join(own, "_row").select(*columns)


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without its repeated passages, ``n_chars`` set anew if there; documents of which no word is left go."""
    given, _ = told_apart(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    found = _found(given).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("_cuts"))
    found = materialize(found.select(F.col("doc_id").alias("_of"), "_cuts"), "passages")

    @F.pandas_udf("string")
    def cut(text, cuts):
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")

        def one(t, spans):
            if spans is None or t is None:
                return t
            at = [m.span() for m in word.finditer(t)]
            out, upto = [], 0
            for s in spans:
                first, end = s["first_word"], s["first_word"] + s["n_words"]
                if first >= len(at):
                    break
                out.append(t[upto:at[first][0]])
                upto = max(upto, at[end][0] if end < len(at) else len(t))
            return "".join([*out, t[upto:]])

        import pandas as pd

        return pd.Series([one(t, s) for t, s in zip(text, cuts)])

    rows = given.join(found, F.col("_id") == F.col("_of"), "left")
    whole = F.col("_cuts").isNull()
    new = rows.withColumn("_text", F.when(whole, F.col("text")).otherwise(cut("text", "_cuts")))
    new = new.filter(whole | F.col("_text").rlike("[^\\x20\\x09-\\x0D]"))
    changed = {"text": F.col("_text"), "n_chars": F.when(whole, F.col("_row.n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(F.length("_text"))}
    return new.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
