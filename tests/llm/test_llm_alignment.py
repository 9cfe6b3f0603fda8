import collections
import hashlib
import random

import numpy as np
import plain
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import catalog, token_alignment as ta
from marginalia.llm.common import documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """``(id, its bytes)`` of each tokenizer; none if the bytes are not those of the text after a space."""
    a, b = libraries
    if not text:
        return [], []
    letter = {c: x for x, c in ((x, chr(x)) for x in [*range(33, 127), *range(161, 173), *range(174, 256)])}
    rest = [x for x in range(256) if x not in letter.values()]
    letter |= {chr(256 + i): x for i, x in enumerate(rest)}
    of_a = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = []
    for i in b.encode(text):
        name = b.id_to_piece(i)
        of_b.append((i, bytes([int(name[1:-1], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    good = all(b"".join(x for _, x in t) == whole for t in (of_a, of_b))
    return (of_a, of_b) if good else ([], [])


def until(side, end):
    """The ids up to the token that ends at ``end``."""
    for at, i in side:
        yield i
        if at == end:
            return


def aligned(libraries, rows):
    """The rows the operator must give, one token at a time."""
    found, count = [], collections.Counter()
    for doc_id, text in rows:
        of = tokens(libraries, text)
        ends = [dict() for _ in of]
        for side, seen in zip(of, ends):
            at = 0
            for i, x in side:
                at += len(x)
                seen[at] = i
        both = [e for e in ends[0] if e in ends[1]]
        links = [(ends[0][e], ends[1][e]) for e in both]
        count.update(links)
        sides = [iter(seen.items()) for seen in ends]
        groups = ["|".join(",".join(map(str, until(side, e))) for side in sides) for e in both]
        found.append((doc_id, len(of[0]), len(of[1]), links, ";".join(groups)))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = [(d, n_a, n_b, len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), text)
           for d, n_a, n_b, links, text in found]
    return sorted(out, key=str)


def test_cuts_are_on_the_merge_path_and_pieces_stitch_to_the_whole():
    rng = random.Random(5)
    for _ in range(60):
        a, b = (np.array(sorted(rng.sample(range(1, 120), rng.randrange(60))), np.int64) for _ in range(2))
        path = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for steps in (1, 2, 7, 1000):
            i, j = ta.path_cuts(a, b, steps)
            for n_a, n_b in zip(i, j):
                assert n_a == sum(1 for _, side in path[:n_a + n_b] if side == 0)
            assert set(np.diff(i + j)[:-1]) <= {steps} and (i[-1], j[-1]) == (len(a), len(b))
            cut_a, cut_b = ta.stitch([ta._piece(a[x:y], b[v:w]) for x, y, v, w in zip(i, i[1:], j, j[1:])])
            common = sorted(set(a) & set(b))
            assert a[cut_a].tolist() == common and b[cut_b].tolist() == common


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("steps,chars", [(1 << 16, 1 << 22), (64, 500), (7, 1)])
def test_alignment_equals_one_token_at_a_time(spark, libraries, monkeypatch, steps, chars):
    # With few steps nearly every document is cut into pieces that other tasks merge.
    monkeypatch.setattr(ta, "PIECE_STEPS", steps)
    monkeypatch.setattr(ta, "RUN_CHARS", chars)
    texts = ["it's we'll\n\n  x   y\t", "<|endoftext|> </s> <unk> <0x41>", "a▁b", "\x00\xa0 ", "ﬁ ½ é é", "   ", "\n", "日本語 😀 ñandú", "x" * 3000, " " * 700]
    docs = plain.odd_documents(spark).select("doc_id", "text").union(
        spark.createDataFrame([(None if i % 4 == 3 else 500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    assert collected(ta.align_tokens(docs, A, B)) == aligned(libraries, rows)


def test_alignment_of_no_rows_and_other_ids(spark, libraries):
    assert ta.align_tokens(plain.empty_documents(spark), A, B).count() == 0
    named = spark.createDataFrame([("x", "some words here", "clash", "clash", 1), ("y", None, None, None, None)], "doc_id string, text string, run string, pairs string, b int")
    assert collected(ta.align_tokens(named, A, B)) == aligned(libraries, [("x", "some words here"), ("y", None)])


def test_long_white_space_and_the_two_encoders_of_a(libraries):
    a = ta.ByteLevel(A)
    assert a.ranks is not None
    for text in ("x y  z\n" * 50, " " * 1_200_000 + "a"):
        assert a.encode(text) == libraries[0].encode(text, add_special_tokens=False).ids
    signs = "".join(chr(c) for c in range(0x20, 0x3000)) + " ".join(chr(c) for c in range(0x1F000, 0x1FB00))
    assert a.encode(signs) == libraries[0].encode(signs, add_special_tokens=False).ids


def test_op11_digests(spark, libraries):
    df = catalog.QUERIES["op11_token_alignment"](spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", **{n: "bigint" for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}, "groups_sha256": "string"}
    rows = [tuple(r) for r in documents(spark, SF).select("doc_id", "text").collect()]
    expected = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in aligned(libraries, rows)]
    assert sorted(map(tuple, df.collect())) == sorted(expected)
    assert df.filter(F.col("n_links") > 0).count() > 150
