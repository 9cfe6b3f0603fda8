import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import plain
from pyspark.sql import functions as F

from marginalia.llm import catalog, components, exact_dedup, lang_id, lm_scoring, ngram_join, quality, substring_dedup
from marginalia.llm.words import grams, hash_words

SMALL = "/root/testdata/sf0.001"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def sql_rows(name, frame):
    """The rows of an operator's SQL over the rows of ``frame``."""
    con = duckdb.connect()
    documents = frame.select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    documents["lang"] = documents["lang"].astype("object")
    con.register("documents", documents)
    result = con.sql(catalog.ORACLES[name])
    return sorted(tuple(r) for r in result.fetchall()), result.columns


# Language


def test_held_out_accuracy_and_inputs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in catalog.QUERIES["op2_language_id"](spark, SMALL).collect()}
    assert {d: r.held_out for d, r in got.items()} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in truth}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    # The label and source of a held-out row change nothing.
    other = docs.withColumn("source", F.lit("x")).withColumn("lang", F.when(lang_id._held_out(), F.lit("zz")).otherwise(F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.language_id(other).collect()}
    assert again == {d: (r.lang_pred, r.score) for d, r in got.items()}


def test_language_of_odd_documents(spark):
    docs = plain.odd_documents(spark)
    got = lang_id.language_id(docs).collect()
    assert len(got) == docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (0, 1, 2))
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert {r.lang_pred for r in lang_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.language_id(plain.empty_documents(spark)).count() == 0


def test_the_sample_is_bounded_however_rows_repeat(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(lang_id, "Model", lambda rows, langs: fitted.append(collections.Counter(langs)))
    one = spark.range(5000).selectExpr("0L as doc_id", "'the same words again' as text", "'en' as lang")
    many = spark.range(5000).selectExpr("1L as doc_id", "concat('words and more words ', repeat('a', int(id % 50)), chr(97 + id % 26)) as text", "'en' as lang")
    rest = spark.range(100, 900).selectExpr("id as doc_id", "'des mots et encore' as text", "'fr' as lang")
    lang_id.train(one.union(many).union(rest), train_rows=100)
    lang_id.train(rest.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id"))), train_rows=30)
    assert fitted[0] == {"en": 50, "fr": 50} and sum(fitted[1].values()) == 30 and len(fitted[1]) == 30


def test_families_come_before_languages(spark):
    rng = random.Random(8)
    alphabets = {"en": "abc", "de": "abd", "fr": "xyz", "es": "xyw", "qq": "mno"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(30)), lang)
            for i, lang in enumerate(list(alphabets) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(docs)
    assert model.families == ["germanic", "qq", "romance"] and set(model.pairs) == {("de", "en"), ("es", "fr")}
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in lang_id.language_id(docs).collect() if r.held_out]
    assert all(r.lang_pred == truth[r.doc_id] for r in held)


# Quality


def test_quality_equals_its_sql_on_odd_documents(spark):
    docs = plain.odd_documents(spark)
    # The SQL takes doc_id for the key of a row.
    once = docs.dropDuplicates(["doc_id"])
    expected, columns = sql_rows("op8_quality_rules", once)
    got = quality.quality_rules(once).select(*columns)
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert quality.quality_rules(docs).count() == docs.count()
    assert quality.quality_rules(plain.empty_documents(spark)).count() == 0
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns


def test_repeated_words_are_counted_once(spark):
    eight = "a b c d e f g h"
    texts = [eight, f"{eight} {eight}", f"{eight} x {eight}", "w " * 12, f"{eight} i {eight} i j"]
    got = {r.doc_id: r.n_repeat_words for r in quality.quality_rules(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 16, 2: 16, 3: 12, 4: 18}


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(9)
    clean = [plain.prose(rng, rng.randint(60, 300), 9000) for _ in range(300)]
    junk = [" ".join(w + "###" for w in plain.prose(rng, 100, 9000).split()) for _ in range(60)]
    kept = {r.doc_id for r in quality.kept_documents(documents(spark, clean + junk)).collect()}
    assert kept == set(range(300))


def test_each_rule_rejects_junk_that_passes_the_base_rules(spark):
    rng = random.Random(20)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(1000, 9999)) for _ in range(n)]
    lines = lambda rows: "\n".join(" ".join(r) for r in rows)
    clean = [lines([words(12) for _ in range(10)]) for _ in range(300)]
    symbols = [lines([[*words(11), "w##"] for _ in range(10)]) for _ in range(10)]
    length = [lines([[w + "abc" for w in words(12)] for _ in range(10)]) for _ in range(10)]
    double = words(4)
    doubled = [lines([*[words(14) for _ in range(6)], *[double] * 5]) for _ in range(10)]
    repeated = [lines([*[words(12) for _ in range(8)], eight + words(2), words(12) + eight, words(5) + eight + words(1)]) for eight in [words(13) for _ in range(10)]]
    got = {r.doc_id: r for r in quality.quality_rules(documents(spark, clean + symbols + length + doubled + repeated)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [d for d, r in got.items() if r.kept] == [d for d in got if d < 300] and len(got) == 340
    assert all(100 * r.n_repeat_words > 20 * r.n_words for d, r in got.items() if d >= 330)


# Exact dedup


def test_exact_dedup_equals_its_sql(spark, monkeypatch):
    docs = plain.odd_documents(spark)
    expected, columns = sql_rows("op3_exact_dedup", docs)
    for block_bytes, spread in ((4096, 1000), (7, 1000), (16, 2)):
        monkeypatch.setattr(exact_dedup, "SPREAD_ROWS", spread)
        got = exact_dedup.exact_dedup(docs, block_bytes).select(*columns)
        assert sorted(tuple(r) for r in got.collect()) == expected
    assert exact_dedup.exact_dedup(plain.empty_documents(spark)).count() == 0


def test_exact_dedup_without_ids_and_kept_rows(spark):
    docs = spark.createDataFrame([(None, "A"), (None, "a"), (None, "b"), (4, "B"), (4, "B"), (5, "É"), (6, "é")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert got == sorted([(None, None, 2, True)] * 2 + [(None, 4, 3, False)] + [(4, 4, 3, True)] * 2 + [(5, 5, 1, True), (6, 6, 1, True)], key=str)
    kept = [(r.doc_id, r.text.lower()) for r in exact_dedup.kept_documents(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a"), (4, "b"), (5, "é"), (6, "é")], key=str)


def test_exact_dedup_digest(spark):
    text = "AÉz" * 3000
    row = exact_dedup.exact_dedup(documents(spark, [text])).first()
    assert row.text_sha256 == hashlib.sha256(text.replace("A", "a").encode()).hexdigest()


# Jaccard join


def families(rng, n):
    texts = []
    for _ in range(n):
        words = plain.prose(rng, rng.choice([6, 30, 200])).split()
        for _ in range(rng.choice([1, 1, 2, 8])):
            changed = [plain.prose(rng, 1) if rng.random() < 0.012 else w for w in words]
            texts += [" ".join(changed)] * rng.choice([1, 1, 3])
    rng.shuffle(texts)
    return texts


def test_jaccard_join_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(10)
    texts = families(rng, 40)
    docs = plain.odd_documents(spark).select("doc_id", "text").union(documents(spark, texts).select(F.col("doc_id") + 1000, "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted((d, *c) for (d, _), c in zip(rows, plain.jaccard_classes(rows)))
    assert sum(r[2] > 0 for r in expected) > 20
    got = sorted(tuple(r) for r in ngram_join.ngram_jaccard_join(docs).collect())
    assert got == expected
    assert ngram_join.ngram_jaccard_join(plain.empty_documents(spark)).count() == 0
    kept = {r.doc_id for r in ngram_join.kept_documents(docs).collect()}
    assert kept == {r[1] for r in expected}


def test_kept_rows_without_ids_and_with_repeated_ids(spark):
    rng = random.Random(19)
    a, b, c, d, e, f = [plain.prose(rng, 80, 9000) for _ in range(6)]
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    docs = spark.createDataFrame([
        (None, a), (None, b), (None, b), (None, near(b)), (None, c), (5, near(c)), (7, d), (7, e), (7, e), (8, near(e)), (9, f), (None, f),
        (None, None), (None, ""), (4, ""), (4, ""), (4, None)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in ngram_join.kept_documents(docs).collect()]
    of_b = [k for k in kept if k in ((None, b), (None, near(b)))]
    assert len(of_b) == 1
    expected = [(None, a), *of_b, (5, near(c)), (7, d), (7, e), (9, f), (None, None), (None, ""), (4, ""), (4, None)]
    assert sorted(kept, key=str) == sorted(expected, key=str)


def test_tiles_of_one_group_count_every_link():
    rng = random.Random(11)
    words = plain.prose(rng, 150).split()
    sets = []
    for _ in range(60):
        text = " ".join(plain.prose(rng, 1) if rng.random() < 0.015 else w for w in words)
        sets.append(ngram_join.shingle_set(ngram_join.hash_words([text])[0]))
    exact = {(i, j) for i in range(60) for j in range(60) if i != j and
             len(set(sets[i].tolist()) & set(sets[j].tolist())) * 10 >= 8 * len(set(sets[i].tolist()) | set(sets[j].tolist()))}
    a, b = ngram_join.linked_pairs(sets, list(range(60)), list(range(60)))
    assert set(zip(a.tolist(), b.tolist())) == exact and exact
    halves = set()
    for left in (range(30), range(30, 60)):
        for right in (range(30), range(30, 60)):
            a, b = ngram_join.linked_pairs(sets, list(left), list(right))
            halves |= set(zip(a.tolist(), b.tolist()))
    assert halves == exact


def test_large_groups_are_split_into_tiles(spark, monkeypatch):
    rng = random.Random(12)
    words = plain.prose(rng, 120).split()
    docs = documents(spark, [" ".join(plain.prose(rng, 1) if rng.random() < 0.01 else w for w in words) for _ in range(60)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    got = sorted(tuple(r) for r in ngram_join.ngram_jaccard_join(docs).collect())
    assert got == sorted((d, *c) for (d, _), c in zip(rows, plain.jaccard_classes(rows)))


def test_pruning_bound_keeps_probable_pairs():
    assert ngram_join.least_matches(24, 0.8, 1e-6) < 24 * 0.8
    assert ngram_join.least_matches(240, 0.8, 1e-6) > 240 * 0.6


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)] + [(5, 5), (300, 300)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}


# Substring dedup


def test_chain_equals_the_best_over_all_predecessors():
    rng = random.Random(13)
    for _ in range(40):
        points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        x, y = [p[0] for p in points], [p[1] for p in points]
        best = []
        for j in range(len(points)):
            before = [best[i] - substring_dedup.GAP_COST * (x[j] - x[i] + y[j] - y[i]) for i in range(j) if x[i] < x[j] and y[i] < y[j]]
            best.append(substring_dedup.SEED_WORDS + max([0.0, *before]))
        paths = substring_dedup.chain(x, y)
        assert sorted(i for p in paths for i in p) == list(range(len(points)))
        first = paths[0]
        score = substring_dedup.SEED_WORDS * len(first) - substring_dedup.GAP_COST * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        assert abs(score - max(best)) < 1e-6


def passages_of(frame):
    found = {}
    for r in frame.collect():
        found.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    return found


def test_shared_passages_are_found_exact_and_fuzzy(spark):
    rng = random.Random(14)
    passage = plain.prose(rng, 70, 9000).split()
    fuzzy = list(passage)
    for at in (15, 33, 50):
        fuzzy[at] = "changed"
    del fuzzy[60]
    short = plain.prose(rng, 40, 9000)
    body = lambda: plain.prose(rng, 150, 9000)
    texts = [body(), f"{body()} {' '.join(passage)} {body()}", f"{body()} {short}", f"{short} {body()}",
             f"{body()} {' '.join(fuzzy)} {body()}", f"{' '.join(passage)}", f"{body()}\n{' '.join(passage).upper()}\n{body()}"]
    docs = documents(spark, texts)
    found = passages_of(substring_dedup.repeated_passages(docs))
    assert set(found) == {4, 5, 6}
    assert found[5] == set(range(70)) and found[6] == set(range(150, 220))
    assert set(range(150, 210)) <= found[4] <= set(range(148, 222))
    left = {r.doc_id: r for r in substring_dedup.without_passages(docs).collect()}
    assert set(left) == {0, 1, 2, 3, 4, 6}
    assert all(left[i].text == texts[i] for i in (0, 1, 2, 3))
    assert left[6].text.split() == [w for w in texts[6].split() if w.lower() not in passage or w in texts[6].split("\n")[0].split()] or len(left[6].text.split()) == 300
    assert left[6].n_chars == len(left[6].text)


def test_recall_of_changed_passages(spark):
    rng = random.Random(17)
    new, n = lambda: plain.prose(rng, 1, 9000), 60
    for every, least in ((5, 0.85), (7, 0.95), (8, 0.95), (10, 0.97)):
        texts, copies = [], []
        for _ in range(n):
            words = plain.prose(rng, 80, 9000).split()
            changed = [new() if i % every == every - 1 else w for i, w in enumerate(words)]
            texts.append(f"{plain.prose(rng, 40, 9000)} {' '.join(words)} {plain.prose(rng, 40, 9000)}")
            copies.append(f"{plain.prose(rng, 40, 9000)} {' '.join(changed)} {plain.prose(rng, 40, 9000)}")
        found = passages_of(substring_dedup.repeated_passages(documents(spark, texts + copies)))
        whole = [d for d in range(n, 2 * n) if len(set(range(40, 120)) & found.get(d, set())) >= 0.85 * 80]
        print(f"one word in {every} changed: {len(whole)} of {n} passages found")
        assert len(whole) >= least * n
        assert not any(d < n or not words <= set(range(30, 130)) for d, words in found.items())


def test_a_long_insertion_does_not_end_a_passage(spark):
    rng = random.Random(18)
    words = plain.prose(rng, 100, 9000).split()
    longer = words[:50] + plain.prose(rng, 18, 9000).split() + words[50:]
    found = passages_of(substring_dedup.repeated_passages(documents(spark, [" ".join(words), " ".join(longer)])))
    assert found == {1: set(range(118))}


def test_every_exact_passage_is_covered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = passages_of(catalog.QUERIES["op5_substring_dedup"](spark, SMALL))
    first, texts = {}, {r.doc_id: plain.words_of(r.text) for r in docs.collect()}
    n = substring_dedup.PASSAGE_WORDS + 1
    repeated = 0
    for d in sorted(texts):
        for i in range(len(texts[d]) - n + 1):
            if first.setdefault(tuple(texts[d][i:i + n]), d) < d:
                repeated += 1
                assert set(range(i, i + n)) <= found.get(d, set())
    assert repeated > 100


def test_repeated_ids_with_different_texts_are_different_documents(spark):
    rng = random.Random(21)
    body = lambda n: plain.prose(rng, n, 9000)
    passage, clean = body(80), body(200)
    rows = [(1, passage), (2, f"{body(40)} {passage} {body(40)}"), (2, clean), (2, clean), (3, body(90)), (-5, body(60))]
    docs = spark.createDataFrame([(i, t, "clash", len(t)) for i, t in rows], "doc_id long, text string, _id string, n_chars long").drop("_id")
    found = [tuple(r) for r in substring_dedup.repeated_passages(docs).collect()]
    # Of the two holders, one is the first; the clean text that shares its number with one is neither.
    assert len(found) == 1 and found[0][2] == 80 and {found[0][0], found[0][3]} == {1, 2} and found[0][6] == [found[0][3]]
    left = collections.Counter(tuple(r) for r in substring_dedup.without_passages(docs).collect())
    assert left[2, clean, len(clean)] == 2 and sum(left.values()) >= 5
    assert sum(passage in t for _, t, _ in left) == 1 and {t for _, t, _ in left} >= {rows[4][1], rows[5][1], clean}


def test_lines_that_adjoin_are_no_passage_unless_they_do_so_again(spark):
    rng = random.Random(22)
    body = lambda n: plain.prose(rng, n, 9000)
    one, two, three, four = (body(26) for _ in range(4))
    texts = [f"{body(30)} {one} {body(30)}", f"{body(30)} {two} {body(30)}", f"{body(30)} {one} {two} {body(30)}",
             f"{body(20)} {three} {body(20)}", f"{body(20)} {four} {body(20)}", f"{body(9)} {three} {four} {body(8)}", f"{body(5)} {three} {four} {body(9)}"]
    docs = documents(spark, texts)
    found = passages_of(substring_dedup.repeated_passages(docs))
    assert found == {6: set(range(5, 57))}
    assert {r.doc_id: r.text for r in substring_dedup.without_passages(docs).collect()} == {
        **dict(enumerate(texts[:6])), 6: " ".join(texts[6].split()[:5] + texts[6].split()[57:])}


def test_a_long_passage_beside_another_line_is_cut_without_it(spark):
    rng = random.Random(23)
    body = lambda n: plain.prose(rng, n, 9000)
    passage, line = body(90), body(30)
    texts = [f"{body(20)} {passage} {body(20)}", f"{body(20)} {line} {body(20)}", f"{body(10)} {passage} {line} {body(10)}"]
    assert passages_of(substring_dedup.repeated_passages(documents(spark, texts))) == {2: set(range(10, 100))}


def test_seeds_of_many_texts_are_those_of_each():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 3, 4, 5, 18, 19, 20, 21, 60, 0, 400, 7)]
    hashes, at = hash_words(texts)
    expected = []
    for i, (low, high) in enumerate(zip(at.tolist(), at[1:].tolist())):
        runs = grams(hashes[low:high], substring_dedup.SEED_WORDS).tolist()
        least = [runs[k:k + substring_dedup.WINDOW] for k in range(max(len(runs) - substring_dedup.WINDOW, 0) + 1) if runs]
        kept = {k + w.index(min(w)) for k, w in enumerate(least)} | {k for k, r in enumerate(runs) if r < (1 << 64) // substring_dedup.KEEP}
        expected += [(i, k, runs[k]) for k in sorted(kept)]
    assert list(zip(*[c.tolist() for c in substring_dedup.seeds_of(hashes, at)])) == expected


def test_chains_of_two_documents_are_one_row(spark):
    words = [f"w{i}" for i in range(8)]
    docs = documents(spark, [" ".join(words), " ".join(f"{' '.join(words)} x{i}" for i in range(40))])
    linked = substring_dedup.links(docs)
    pairs = substring_dedup.chains(linked, 2).collect()
    assert len(pairs) == 1 and len(pairs[0].ns) == len(pairs[0].sizes) > 1
    assert sum(pairs[0].sizes) == len(pairs[0].xs) == len(pairs[0].ys)


def test_windows_of_a_pair_that_overlap_are_one():
    pair, sizes, total = np.array([0, 0, 0, 1]), np.array([1, 2, 1, 1]), np.array([500, 500, 500, 30])
    pairs, first, end = substring_dedup._windows_of(pair, np.array([400, 20, 40, 60, 10]), sizes, total, 16)
    assert list(zip(pairs.tolist(), first.tolist(), end.tolist())) == [(0, 4, 80), (0, 384, 420), (1, 0, 30)]


def test_alignments_go_on_beyond_the_words_fetched_first(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MARGIN", 4)
    rng = random.Random(24)
    words = plain.prose(rng, 3000, 9000).split()
    # The beginnings of the passage's seeds stand elsewhere first, but for a few words in its middle.
    texts = [" ".join(words[i:i + 40]) for i in range(0, 1480, 37)] + [" ".join(words[i:i + 40]) for i in range(1520, 2960, 37)]
    texts += [" ".join(words), "x y z " + " ".join(words)]
    found = passages_of(substring_dedup.repeated_passages(documents(spark, texts)))
    assert found[len(texts) - 1] >= set(range(3, 2950))


def test_passages_of_odd_documents(spark):
    docs = plain.odd_documents(spark)
    found = passages_of(substring_dedup.repeated_passages(docs.union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))))
    assert found == {8: set(range(6000)), 100: set(range(60)), 101: set(range(60))}
    assert substring_dedup.without_passages(docs).columns == docs.columns
    assert substring_dedup.repeated_passages(plain.empty_documents(spark)).count() == 0


# Scores


def test_scores_equal_one_by_one_counts(spark, monkeypatch):
    rng = random.Random(15)
    texts = [plain.prose(rng, n, 12) for n in (1, 2, 3, 30, 200, 200)] + [None, "", "seen nowhere else"]
    texts += texts[3:4]
    monkeypatch.setattr(lm_scoring, "RUN_CHARS", 300)
    for order in (1, 2, 3):
        got = {r.doc_id: r for r in lm_scoring.lm_scores(documents(spark, texts), order).collect()}
        for i, score in enumerate(plain.backoff_scores(texts, order)):
            n = len(plain.words_of(texts[i]))
            assert got[i].n_words == n and abs(got[i].log_score - score) < 1e-5
            assert (got[i].mean_log_score is None) == (n == 0)


def test_registered_scores_have_two_words_of_context(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r.log_score for r in catalog.QUERIES["op10_lm_scoring"](spark, SMALL).collect()}
    for r, score in zip(docs, plain.backoff_scores([r.text for r in docs], 3)):
        assert abs(got[r.doc_id] - score) < 1e-4 * max(1, abs(score))


def test_scores_of_odd_documents(spark):
    docs = plain.odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    expected = sorted((r.doc_id, round(s, 3)) for r, s in zip(rows, plain.backoff_scores([r.text for r in rows], 2)))
    got = sorted((r.doc_id, round(r.log_score, 3)) for r in lm_scoring.lm_scores(docs).collect())
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 0.01 for a, b in zip(got, expected)) and len(got) == len(expected)
    assert lm_scoring.lm_scores(plain.empty_documents(spark)).count() == 0
