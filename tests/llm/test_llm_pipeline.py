import zlib

import corpus_pipeline
import duckdb
import numpy as np
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marginalia.llm import catalog, substring_dedup
from marginalia.storage import materialize

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SMALL), name)
        out.append((name, docs, after))
        docs = after
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_keep_the_columns(steps):
    assert [name for name, *_ in steps] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_first_three_stages_equal_plain_versions(steps):
    _, before, after = steps[0]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    verdicts = con.sql(catalog.ORACLES["op8_quality_rules"]).fetchall()
    assert texts(after) == {d: t for d, t in texts(before).items() if d in {v[0] for v in verdicts if v[-1]}}

    _, before, after = steps[1]
    largest = {}
    for d, t in texts(before).items():
        largest[t.lower()] = max(largest.get(t.lower(), -1), d)
    assert set(texts(after)) == set(largest.values())

    _, before, after = steps[2]
    rows = sorted(texts(before).items())
    assert set(texts(after)) == {c for c, *_ in plain.jaccard_classes(rows)}


def test_passages_are_cut_and_the_rest_stays(steps):
    _, before, after = steps[3]
    old = {d: plain.words_of(t) for d, t in texts(before).items()}
    new = {d: t for d, t in texts(after).items()}
    n = substring_dedup.PASSAGE_WORDS + 1
    first, seeds = {}, {}
    for d in sorted(old):
        for i in range(len(old[d]) - n + 1):
            first.setdefault(tuple(old[d][i:i + n]), d)
        for i in range(len(old[d]) - 7):
            seeds.setdefault(tuple(old[d][i:i + 8]), set()).add(d)
    for d, t in new.items():
        words = plain.words_of(t)
        # What is left of a document is in its old order, and no passage that an earlier document had.
        rest = iter(old[d])
        assert all(w in rest for w in words)
    for d, words in old.items():
        if all(len(seeds[tuple(words[i:i + 8])]) == 1 for i in range(len(words) - 7)):
            assert new[d] == texts(before)[d]
    repeated = {d for d in old for i in range(len(old[d]) - n + 1) if first[tuple(old[d][i:i + n])] < d}
    assert all(d not in new or len(plain.words_of(new[d])) < len(old[d]) for d in repeated)


def test_last_stage_packs_the_texts_left(steps):
    _, before, after = steps[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for d, t in texts(before).items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        expected += [(d, s, zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)]
    rows = after.collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in rows) == sorted(expected)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.05 * total / 2048 + 1


def test_run_gives_the_rows_of_the_stages(spark, steps):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(key, steps[-1][2].collect()))


def test_stages_take_odd_and_empty_documents(spark):
    for docs in (plain.odd_documents(spark), plain.empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SMALL), "odd")
    assert docs.columns[:3] == ["doc_id", "piece", "start"] and docs.count() == 0
