"""Personal data in texts, and the words that give it away.

1. Base: e-mail and network addresses, card and phone numbers by their patterns, in linear time for any text.
2. Each value found is a protected entity. Words near its mentions are counted with it over the corpus. Those seen in
   ``min_contexts`` different surroundings of one entity, so that copies of one text say nothing, are counted in all
   texts: of ``n`` places of a word, ``n_near`` lie near the entity.
3. A word tells PMI(entity; word) = log(P(entity | word) / P(entity)) of the entity's own information, -log P(entity).
   It discloses the entity if that is ``threshold`` of all its information or more. A word that stands nowhere else
   tells everything and is removed; the others are generalised.
4. Words that disclose are looked up in all texts, also in those that do not name the entity. For this and for the counts
   a filter of fixed size goes to the tasks, and what it lets through is joined to the words themselves.

Defined results: a null text counts as empty and has no spans; texts of any length are read whole; a value that is found
in many documents, or rows that repeat, is one entity with all its mentions; ties of equal disclosure give the same
treatment; rows without an id each give a row; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import materialize

KINDS = ("email", "ip", "card", "phone")
TREATMENTS = ("general", "removed")
WINDOW = 8
THRESHOLD = 0.95
MIN_CONTEXTS = 3
# Bits of the filter that the tasks get, whatever the number of words; it is collected as rows of 32,768 bits.
FILTER_BITS = 1 << 23
# Words a task counts, and answers it keeps, before it gives them out or starts anew.
HELD_WORDS = 100_000
LONG_TEXT = 1 << 20

_WORD = re.compile(r"\w+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits does, and a run is never given back in part.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address holds one @: what may stand before it, back to the last address, and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, end, kind`` in code points, end exclusive, in the order of start and kind."""
    spans = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part) <= 255 for part in (g.lstrip("0") or "0" for g in m.groups())):
            spans.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            spans.append((*m.span(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            spans.append((*m.span(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def entity(text: str, span: tuple[int, int, int]) -> str:
    """One name for a value however it is written."""
    value = text[span[0]:span[1]]
    return f"{KINDS[span[2]]} {value.lower() if span[2] < 2 else _NOT_DIGIT.sub('', value)}"


def _lower_words(text: str) -> Iterator[str]:
    found = _WORD.findall(text) if len(text) < LONG_TEXT else (m.group() for m in _WORD.finditer(text))
    return map(str.lower, found)


def _open_words(text: str, spans: list) -> list[tuple[int, int, str]]:
    """``start, end, word`` of the words that touch no span."""
    words, at, end = [], 0, -1
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            end = max(end, spans[at][1])
            at += 1
        if m.start() >= end:
            words.append((m.start(), m.end(), m.group().lower()))
    return words


def _counted(rows, names: list[str]):
    import pyarrow as pa

    columns = list(zip(*rows)) or [[]] * len(names)
    kinds = {"context": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns)], names=names)


def near_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``word, entity, context, n``: places of words near mentions of an entity; partial counts.

    ``context`` tells different surroundings of an entity apart.
    """

    def run(batches: Iterator):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                spans = base_spans(text)
                if spans:
                    counts.update(_near(text, spans, _open_words(text, spans), window))
                if len(counts) > HELD_WORDS:
                    yield _counted([(*k, n) for k, n in counts.items()], ["word", "entity", "context", "n"])
                    counts.clear()
        yield _counted([(*k, n) for k, n in counts.items()], ["word", "entity", "context", "n"])

    return docs.select("text").mapInArrow(run, "word string, entity string, context long, n long")


def _near(text: str, spans: list, words: list, window: int) -> Iterator[tuple[str, str, int]]:
    """``word, entity, context`` for each place near a mention, once per entity."""
    starts, seen = [w[0] for w in words], set()
    for span in spans:
        name, at = entity(text, span), bisect_left(starts, span[0])
        near = range(max(at - window, 0), min(at + window, len(words)))
        context = zlib.crc32(" ".join(words[i][2] for i in near).encode("utf-8", "replace"))
        for i in near:
            if (i, name) not in seen:
                seen.add((i, name))
                yield words[i][2], name, context


class _Filter:
    """Whether a word may be one of those that set the bits; keeps its answers."""

    def __init__(self, bits: bytes):
        self.bits, self.known, self.some = bits, {}, any(bits)

    def __call__(self, word: str) -> bool:
        answer = self.known.get(word)
        if answer is None:
            if len(self.known) >= HELD_WORDS:
                self.known.clear()
            at = zlib.crc32(word.encode("utf-8", "replace")) % FILTER_BITS
            answer = self.known[word] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return answer


def _word_filter(words: DataFrame) -> bytes:
    """A bit for the checksum of each word: a fixed number of bytes, however many words there are."""
    bits = bytearray(FILTER_BITS // 8)
    # Spark numbers the bits from 1.
    at = F.crc32(F.col("word").cast("binary")) % FILTER_BITS + 1
    rows = words.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    for row in rows.collect():
        start = (row["part"] - 1) * 4096
        bits[start:start + 4096] = row["bits"]
    return bytes(bits)


def word_counts(docs: DataFrame, bits: bytes) -> DataFrame:
    """``word, n``: places outside spans of the words that pass the filter, and of all words without a ``word``; partial."""

    def run(batches: Iterator):
        wanted, counts, total = _Filter(bits), Counter(), 0
        for batch in batches:
            for text in batch.column(0) if wanted.some else ():
                text = text.as_py() or ""
                spans = base_spans(text)
                words = Counter(w for _, _, w in _open_words(text, spans)) if spans else Counter(_lower_words(text))
                total += words.total()
                for word, n in words.items():
                    if wanted(word):
                        counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield _counted(list(counts.items()), ["word", "n"])
                    counts.clear()
        yield _counted([*counts.items(), (None, total)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long")


def disclosing_words(docs: DataFrame, threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS, window: int = WINDOW) -> DataFrame:
    """``word, treatment``: 0 to generalise, 1 to remove."""
    near = materialize(near_counts(docs, window), "near-counts")
    # First by context, so that no entity's contexts are gathered in one row.
    pairs = near.groupBy("word", "entity", "context").agg(F.sum("n").alias("n")).groupBy("word", "entity").agg(
        F.sum("n").alias("n_near"), F.count(F.lit(1)).alias("contexts"))
    pairs = materialize(pairs.filter(F.col("contexts") >= min_contexts), "near-pairs")
    counts = materialize(word_counts(docs, _word_filter(pairs)), "word-counts")
    total = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
    everywhere = counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    entities = near.groupBy("entity").agg(F.sum("n").alias("covered"))
    own = F.log2(F.lit(float(total)) / F.col("covered"))
    told = own - F.log2(F.col("n") / F.col("n_near"))
    found = pairs.join(entities, "entity").join(everywhere, "word").filter((own > 0) & (told >= F.lit(threshold) * own))
    return found.groupBy("word").agg(F.max((F.col("n") == F.col("n_near")).cast("int")).alias("treatment"))


def _spans_and_candidates(bits: bytes):
    def run(batches: Iterator):
        import pyarrow as pa

        discloses = _Filter(bits)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
        place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string())]))
        for batch in batches:
            bases, places = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans = base_spans(text)
                candidates = {w for w in set(_lower_words(text)) if discloses(w)} if discloses.some else ()
                bases.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                places.append([{"start": a, "end": b, "word": w} for a, b, w in _open_words(text, spans) if w in candidates] if candidates else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bases, span), pa.array(places, place)],
                                             names=[*batch.schema.names, "base", "places"])

    return run


def find_disclosures(docs: DataFrame, threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS, window: int = WINDOW,
                     with_text: bool = False) -> DataFrame:
    """``doc_id, base, added``: lists of ``start, end, kind`` (a place in ``KINDS``) and ``start, end, treatment``.

    Both in the order of their starts; one row per row of ``docs``, with its ``text`` if asked for.
    """
    given = docs.select("doc_id", "text")
    words = materialize(disclosing_words(given, threshold, min_contexts, window), "words")
    bits = _word_filter(words)
    kept = given.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    schema = f"{kept}, base array<struct<start:int,end:int,kind:int>>, places array<struct<start:int,end:int,word:string>>"
    spans = given.mapInArrow(_spans_and_candidates(bits), schema)
    spans = spans if with_text else spans.drop("text")
    spans = materialize(spans.withColumn("row", F.monotonically_increasing_id()), "spans")
    hits = spans.filter(F.size("places") > 0).select("row", F.explode("places").alias("p")).select("row", "p.*")
    added = hits.join(words, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "treatment"))).alias("added"))
    none = F.array().cast("array<struct<start:int,end:int,treatment:int>>")
    return spans.drop("places").join(added, "row", "left").withColumn("added", F.coalesce("added", none)).drop("row")


def spans_text(base: Column, added: Column | None = None) -> Column:
    """``kind:start:end`` of base spans, and of added ones after all base kinds, by start and kind, with commas between."""
    name = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i + 1)
    rows = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    if added is not None:
        rows = F.array_sort(F.concat(rows, F.transform(added, lambda s: F.struct(
            s["start"].alias("start"), (s["treatment"] + len(KINDS)).alias("kind"), s["end"].alias("end")))))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", name(KINDS + TREATMENTS, s["kind"]), s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, text`` with base spans and generalised words replaced by their kind in brackets, removed words left out.

    Of spans that overlap, the one that begins first is replaced, of those the longest, to the end of all of them.
    """
    found = find_disclosures(docs, with_text=True, **how)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text, base, added in zip(*(batch.column(n).to_pylist() for n in ("text", "base", "added"))):
                spans = [(s["start"], -s["end"], f"[{KINDS[s['kind']]}]") for s in base]
                spans += [(s["start"], -s["end"], "" if s["treatment"] else "[word]") for s in added]
                out, at = [], 0
                for start, end, put in sorted(spans):
                    if start >= at:
                        out += [text[at:start], put]
                    at = max(at, -end)
                texts.append(text and "".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return found.mapInArrow(run, docs.select("doc_id", "text").schema)
