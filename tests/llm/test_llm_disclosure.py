import collections
import hashlib
import math
import random
import re

import plain
import pytest
from pyspark.sql import functions as F

from marginalia.llm import catalog, disclosure as ds
from marginalia.llm.common import documents

SF = "/root/testdata/sf0.001"
KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    """The patterns as they are written, tried one after another."""
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def words(text, spans):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\w+", text) if not any(a < m.end() and m.start() < b for a, b, _ in spans)]


def plain_disclosures(texts, window=8, threshold=0.95, least=3):
    """Per text its base spans and the added ones, by counts in dictionaries."""
    everywhere, near, contexts, covered = (collections.Counter() for _ in range(4))
    of = []
    for text in texts:
        spans = base(text)
        found = words(text, spans)
        of.append((spans, found))
        everywhere.update(w for _, _, w in found)
        seen = set()
        for a, b, k in spans:
            value = text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b])
            before, after = [i for i, w in enumerate(found) if w[0] < a], [i for i, w in enumerate(found) if w[0] >= a]
            close = before[-window:] + after[:window]
            for i in close:
                if (i, k, value) not in seen:
                    seen.add((i, k, value))
                    near[found[i][2], k, value] += 1
                    covered[k, value] += 1
                    contexts[found[i][2], k, value, " ".join(found[j][2] for j in close)] = 1
    total, treat = sum(everywhere.values()), {}
    distinct = collections.Counter(c[:3] for c in contexts)
    for (w, *e), n in near.items():
        own = math.log2(total / covered[tuple(e)])
        if distinct[(w, *e)] >= least and own > 0 and own - math.log2(everywhere[w] / n) >= threshold * own:
            treat[w] = max(treat.get(w, 0), int(everywhere[w] == n))
    return [(spans, [(a, b, treat[w]) for a, b, w in found if w in treat]) for spans, found in of]


def joined(spans, added=()):
    rows = sorted([(a, k, b) for a, b, k in spans] + [(a, 4 + t, b) for a, b, t in added])
    return ",".join(f"{(*KINDS, 'general', 'removed')[k]}:{a}:{b}" for a, k, b in rows)


ODD = ["", "@", "a@b", "a@b.", "a@b.c.", "x..y%+-@-.-", "a@b@c.d", "a@b.c@d.e", "a@b.ca@d.e", ".@a.b", "é@a.b", "a@b.c,d@e.f;g@h.i", "a.b@c.d.e..f",
       "1.2.3", "1.2.3.4", "1.2.3.4.5", "1.2.3.4.5.6.7.8", "256.1.1.1", "255.255.255.255", "001.002.003.0004", "0.0.0.0256", "1.2.3.x 4.5.6.7", "99999999999.1.1.1.1",
       "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "41111111111111111111", "411111111111 1111", "0000 0000 0000", "79927398713",
       "+1 (386) 555-3733", "+1", "+12", "+1 2", "+1 23456789-", "+1 23456789 ()..", "++12345678901", "+123456789012345678", "+49 (0) 30 1234567 x", "4+1 234567890",
       "+4111 1111 1111 1111", "mail x1@y.z at 10.0.0.1 or +1 234 567 8901 4111111111111111", "٣٤٥٦٧٨٩٠١٢٣٤ +٣٤٥٦٧٨٩٠١", "1.2.3.4@5.6"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab1.2@-+( )4 0") for _ in range(rng.randrange(60))) for _ in range(6000)]
    texts += [" ".join(rng.choice(ODD) for _ in range(6)) for _ in range(300)]
    for text in texts:
        assert ds.base_spans(text) == base(text), text


def test_base_spans_of_very_long_runs_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "+1" * 200_000, "1 " * 200_000, "a@" * 100_000, "-" * 300_000 + "@a.b"):
        ds.base_spans(text)


def people(n, seed=8):
    """Texts in which a name stands beside one address and nowhere else, another also elsewhere, among words that stand anywhere."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        said = plain.prose(rng, 20, 60)
        texts.append(f"{said} {['Contact', 'Ask', 'Write'][i % 3]} Ottoline Quill{'' if i % 4 else ' now'} o.quill@mail.example.com {plain.prose(rng, 15, 60)}")
        texts.append(f"{plain.prose(rng, 30, 60)} Berylla {'b.w@mail.example.com' if i % 20 else 'wrote'} {plain.prose(rng, 12, 60)}")
    # Copies of one text, which must say nothing of the words beside its address.
    texts += ["unique words stand here beside once@only.example.org as they always did"] * 9
    return texts + ["Berylla and Ottoline met without an address.", "QUILL"]


def as_docs(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, "clash", 1, "clash") for i, t in enumerate(texts)],
                                 "doc_id long, text string, word string, row int, entity string")


def found(df):
    rows = df.select("doc_id", ds.spans_text(F.col("base"), F.col("added")).alias("s")).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("threshold,least", [(0.95, 3), (0.8, 2), (1.0, 1)])
def test_disclosures_equal_plain_counts(spark, monkeypatch, threshold, least):
    texts = people(24) + ODD + ["İ ı ß ﬁ x@y.z " * 5]
    expected = plain_disclosures(texts, threshold=threshold, least=least)
    for held in (500_000, 10):
        monkeypatch.setattr(ds, "HELD_WORDS", held)
        df = ds.find_disclosures(as_docs(spark, texts), threshold=threshold, min_contexts=least)
        assert found(df) == sorted([(i if i % 7 else None, joined(*e)) for i, e in enumerate(expected)], key=str)


def test_names_are_found_and_copies_and_common_words_are_not(spark):
    texts = people(40)
    clean = {r.doc_id: r.text for r in ds.sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all("uill" not in t.lower() and "@" not in t for t in clean.values())
    assert clean[len(texts) - 1] == "[word]" and "[word] and [word] met" in clean[len(texts) - 2]
    copy = next(i for i, t in enumerate(texts) if t.startswith("unique"))
    assert clean[copy] == texts[copy].replace("once@only.example.org", "[email]")
    assert clean[1].split()[:30] == texts[1].split()[:30]


def test_a_word_that_stands_nowhere_else_is_removed(spark):
    texts = [t for t in people(30) if "Berylla" not in t and t != "QUILL"]
    clean = [r.text for r in ds.sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert sum("  [email]" in t or " now [email]" in t for t in clean) >= 30


def test_odd_and_empty_documents(spark):
    docs = plain.odd_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = plain_disclosures([t or "" for _, t in rows])
    assert found(ds.find_disclosures(docs)) == sorted([(d, joined(*e)) for (d, _), e in zip(rows, expected)], key=str)
    assert ds.find_disclosures(plain.empty_documents(spark)).count() == 0
    assert {r.text for r in ds.sanitised(docs.filter("text is null")).collect()} == {None}
    assert ds._NOT_DIGIT.sub("", "+1 2") == "12" and ds.entity("A@B.C", (0, 5, 0)) == "email a@b.c"


def test_op12_contract(spark):
    df = catalog.QUERIES["op12_disclosure"](spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in KINDS}, "base_sha256": "string", "spans": "string"}
    rows = [tuple(r) for r in documents(spark, SF).select("doc_id", "text").collect()]
    expected = []
    for (d, _), (spans, added) in zip(rows, plain_disclosures([t or "" for _, t in rows])):
        expected.append((d, *[sum(s[2] == k for s in spans) for k in range(4)], hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans, added)))
    assert sorted(map(tuple, df.collect())) == sorted(expected)
    assert df.filter("n_email > 0").count() > 0
