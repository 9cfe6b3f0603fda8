"""Plain one-by-one versions of the operators, and documents with every odd case."""

from __future__ import annotations

import collections
import math
import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, sha string, name string, "
          "length string, run string, n_words string, set_id string, _row string, rank string, `_id` string, edits_ string")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def prose(rng, n, width=400):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(width)) + rng.choice(["", "", ",", "."]) for _ in range(n))


def odd_documents(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    rng = random.Random(4)
    long_text = prose(rng, 6000)
    texts = [None, "", "   \n\t ", "one", "One", "two words", "a b c d e", long_text, long_text.upper(), "x" * 20000, "\n".join(["same line here"] * 30),
             "12 34 !!", "é" * 50 + " ñandú 日本語", *[prose(rng, 60) for _ in range(8)]]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", None][i % 2], len(t or ""), *["c"] * 0) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[1], (100, texts[13], "en", "s1", 1), (101, texts[13], None, None, None)]
    return spark.createDataFrame([(*r, True, *["clash"] * 10) for r in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n=5):
    w = words_of(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_classes(rows, similarity=0.8):
    """``(doc_id, text)`` rows to ``(class, links, copies)``, in order."""
    sets = [shingles(t) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=lambda s: min(d for (d, _), x in zip(rows, sets) if x == s))
    root = {s: i for i, s in enumerate(kinds)}
    links = collections.Counter()
    parent = list(range(len(kinds)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(kinds):
        for j in range(i):
            b = kinds[j]
            if len(a & b) * 10 >= round(similarity * 10) * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    smallest = {}
    for (d, _), s in zip(rows, sets):
        if s:
            r = find(root[s])
            smallest[r] = min(smallest.get(r, d), d)
    copies = collections.Counter(sets)
    return [(smallest[find(root[s])], links[root[s]], copies[s]) if s else (d, 0, 1) for (d, _), s in zip(rows, sets)]


def backoff_scores(texts, order, backoff=0.4):
    own = []
    every = collections.Counter()
    for t in texts:
        w = words_of(t)
        own.append(collections.Counter(tuple(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)))
        every.update(own[-1])
    total = sum(len(words_of(t)) for t in texts)
    scores = []
    for t, mine in zip(texts, own):
        w, score = words_of(t), 0.0
        count = lambda g: every[g] - mine[g]
        for i in range(len(w)):
            k = min(order, i + 1)
            while k > 1 and count(tuple(w[i - k + 1:i + 1])) <= 0:
                k, score = k - 1, score + math.log(backoff)
            top = tuple(w[i - k + 1:i + 1])
            score += math.log(count(top) / count(top[:-1])) if k > 1 else math.log(max(count(top), 0.5) / max(total - len(w), 1))
        scores.append(score)
    return scores
