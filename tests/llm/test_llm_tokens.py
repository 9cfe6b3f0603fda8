import hashlib
import random
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import byte_bpe, catalog, packing, token_counts, token_files

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def word_library():
    tokenizer = Tokenizer.from_file(WORDS)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_rank_queue_gives_lowest_rank_leftmost_first():
    rng = random.Random(1)
    queue, entries = byte_bpe.RankQueue(50_000), []
    for _ in range(500):
        entry = rng.choice([3, 64, 4095, 4096, rng.randrange(50_001)]), rng.randrange(1000)
        entries.append(entry)
        queue.push(*entry)
    out = []
    while (entry := queue.pop()) is not None:
        out.append(entry)
    assert out == sorted(entries)


def test_merges_equal_the_library_on_long_and_odd_pieces(library):
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(MULTI), PATTERN)
    rng = random.Random(2)
    texts = ["a" * 5000, "ab" * 999, "日本語" * 400, "it's we'll\n\n  x   y\t", "\x00\xa0 ", *["".join(rng.choice("abcd'\n ") for _ in range(900)) for _ in range(20)]]
    for text in texts:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_encode_and_decode_of_odd_documents(spark, library):
    docs = plain.odd_documents(spark)
    coded = byte_bpe.byte_bpe_decode(byte_bpe.byte_bpe_encode(docs, MULTI, PATTERN), MULTI, PATTERN)
    expected = sorted((r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in coded.collect()) == expected
    assert byte_bpe.byte_bpe_encode(plain.empty_documents(spark), MULTI, PATTERN).count() == 0


def test_op1_digests(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in catalog.QUERIES["op1_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_variable_length_codes_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 1001):
        ranks = rng.integers(0, 1 << 32, n) >> (8 * rng.integers(0, 4, n))
        control, data = token_files.pack(ranks)
        assert len(control) == -(-n // 4)
        assert token_files.unpack(control, data, n).tolist() == ranks.tolist()


def test_token_files_of_odd_documents(spark, shared, word_library):
    docs = plain.odd_documents(spark).union(plain.odd_documents(spark).limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    folder = shared("files")
    token_files.write_token_files(docs, folder, WORDS, end_id=2, block_ids=500)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    keys = [r.doc_id for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    expected = sorted((-1 if r.doc_id is None else r.doc_id, word_library(r.text) + [2]) for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == expected
    assert token_files.write_and_read(plain.empty_documents(spark), WORDS, 2).count() == 0


def test_op7_digests(spark, word_library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    at = 0
    for r in sorted(catalog.QUERIES["op7_token_files"](spark, "/root/testdata/sf0.001").collect()):
        ids = word_library(docs[r.doc_id]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_places_of_classes_are_as_few_as_best_fit():
    rng = random.Random(5)
    for capacity in (1, 7, 64, 2048):
        lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, -(-capacity // 9)) for _ in range(600)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        filled = {}
        ranks = {n: set() for n in counts}
        for length, rank, n, first, offset in packing.place_classes(counts, capacity):
            ranks[length].update(range(rank, rank + n))
            for sequence in range(first, first + n):
                filled.setdefault(sequence, []).append((offset, length))
        assert all(ranks[n] == set(range(counts[n])) for n in counts)
        for spans in filled.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(filled) <= best_fit(lengths, capacity) + 1


def check_packing(rows, expected, capacity):
    """``expected``: the ids of each document with the end id, by row."""
    spans, found = {}, []
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        found.append((r.doc_id, r.start, r.length, r.ids_crc32, r.piece))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    cut = [(d, s, len(ids[s:s + capacity]), zlib.crc32(np.array(ids[s:s + capacity], "<u4").tobytes()), n)
           for d, ids in expected for n, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(found) == sorted(cut)
    return len(spans), [c[2] for c in cut]


def test_packing_of_odd_documents(spark, word_library):
    docs = plain.odd_documents(spark)
    expected = [(r.doc_id, word_library(r.text) + [0]) for r in docs.collect()]
    n, lengths = check_packing(packing.pack_documents(docs, WORDS, capacity=64).collect(), expected, 64)
    assert n <= best_fit(lengths, 64)
    assert packing.pack_documents(plain.empty_documents(spark), WORDS).count() == 0


def test_op4_contract(spark, word_library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = catalog.QUERIES["op4_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    n, lengths = check_packing(rows, [(r.doc_id, word_library(r.text) + [0]) for r in docs], 2048)
    assert n <= best_fit(lengths, 2048)


def test_edits_keep_counts_equal_to_a_fresh_count(library):
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(MULTI), PATTERN)
    rng = random.Random(6)
    for n in (0, 1, 5, 40, 300):
        for _ in range(15):
            text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'s", "7", "!", "é"]) for _ in range(n))
            tree = token_counts.DocumentTree(text, bpe)
            for _ in range(10):
                at, cut = rng.randint(0, len(text) + 1), rng.choice([0, 0, 1, 2, 9])
                put = "".join(rng.choice(["x", " ", "\n", "'", "'ll", "5"]) for _ in range(rng.randint(0, 4)))
                place = min(at, len(text))
                text = text[:place] + put + text[min(place + cut, len(text)):]
                tree.edit(at, cut, put)
                assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), len(library.encode_ordinary(text)))


def test_short_merges_without_the_queue_equal_the_library(library):
    bpe = token_counts.ScannedBpe(byte_bpe.read_ranks(MULTI), PATTERN)
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abcdeéß日 ") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    pieces += ["a" * n for n in range(byte_bpe.INLINE_BYTES - 2, byte_bpe.INLINE_BYTES + 3)] + ["日" * 30, "ab" * 31, " Thentien", "\x00\x01"]
    for piece in pieces:
        assert list(bpe.merged(piece.encode())) == library._core_bpe.encode_single_piece(piece.encode())
    bpe.queue = bpe.leaf = None  # short ones need neither
    assert [len(bpe.merged(p.encode())) for p in ("a" * 60, " Thentien")] == [len(library._core_bpe.encode_single_piece(p)) for p in (b"a" * 60, b" Thentien")]


def test_edits_read_only_their_surroundings():
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(MULTI), PATTERN)
    tree = token_counts.DocumentTree("word " * 5000, bpe)
    tree.edit(12_000, 3, "other")
    assert tree.encoded < 12


def test_op6_counts_and_odd_edits(spark, library):
    docs = plain.odd_documents(spark)
    edited = token_counts.sample_edits(docs)
    got = sorted(token_counts.edited_token_counts(edited, MULTI, PATTERN).collect())
    expected = []
    for r in edited.collect():
        text = r.text or ""
        before = len(library.encode_ordinary(text))
        for e in r.edits:
            at = min(e["at"], len(text))
            text = text[:at] + e["put"] + text[min(at + e["cut"], len(text)):]
        expected.append((r.doc_id, before, len(library.encode_ordinary(text)), len(text)))
    assert [tuple(r[:4]) for r in got] == sorted(expected)
    none = docs.withColumn("edits", F.lit(None).cast("array<struct<at:bigint,cut:bigint,put:string>>"))
    assert all(r.tokens_before == r.tokens_after for r in token_counts.edited_token_counts(none, MULTI, PATTERN).collect())
    table = spark.createDataFrame([(3, 2, 0, 0, "B"), (3, 1, 0, 0, "A"), (None, 1, 0, 0, "x"), (5, 1, None, 3, None)],
                                  "doc_id long, seq int, at long, cut long, put string")
    got = {r.doc_id: r for r in token_counts.edited_token_counts(token_counts.with_edits(docs, table), MULTI, PATTERN).collect()}
    assert got[3].tokens_after == len(library.encode_ordinary("BAone")) and got[5].tokens_after == len(library.encode_ordinary(" words"))
    assert token_counts.edited_token_counts(token_counts.sample_edits(plain.empty_documents(spark)), MULTI, PATTERN).count() == 0


def test_a_full_cache_keeps_what_was_met_lately(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 20)
    bpe, merges = byte_bpe.ByteBpe(byte_bpe.read_ranks(MULTI), PATTERN), []
    merged = bpe.merged
    bpe.merged = lambda piece: merges.append(piece) or merged(piece)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    fresh = byte_bpe.ByteBpe(byte_bpe.read_ranks(MULTI), PATTERN)
    for word in words:
        # A word that comes between all others is merged once, and each word's ids are as without a cache.
        assert bpe["often"] == fresh["often"] and bpe[word] == fresh[word]
        assert len(bpe) + len(bpe.older) <= 20
    assert merges.count(b"often") == 1 and len(merges) == len(words) + 1
