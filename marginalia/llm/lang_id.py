"""Language of a text: first its family, then one-versus-one linear machines among its languages.

Features are counts of hashed runs of one to three letters (anything else is one space), scaled to
length one. All machines are linear support vector machines with squared hinge loss, fitted by dual
coordinate descent on a bounded sample of labelled rows: ``train_rows`` over all languages at most, evenly,
drawn by a hash of ``doc_id`` and text. Families are those of the ISO 639 codes below; any other label is a
family of its own. Scoring reads the text only.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text when no
row is labelled; rows without label or ``doc_id`` do not train; an empty table gives an empty table.
Only ``doc_id``, ``text`` and ``lang`` are read, so further columns of any name are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import worker_state

TRAIN_ROWS = 8_000
WIDTH = 1 << 13
EPOCHS = 8

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk ky uz tk tt".split(),
    "indo-aryan": "hi bn mr gu pa ne ur si".split(),
    "semitic": "ar he mt am".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def features(text: str | None):
    """Places and values of the text's features, or None if it has no letter."""
    import numpy as np

    letters = worker_state("letters", lambda: np.array([chr(i).isalpha() for i in range(0x110000)]))
    chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters[chars]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of a run of other characters the first stays, as a space
    c = np.concatenate([[32], np.where(is_letter, chars, 32)[keep], [32]]).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    hashed = np.concatenate([c * np.uint32(0xC2B2AE35), two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
    counts = np.bincount((hashed ^ (hashed >> 15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 13), minlength=WIDTH)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at])
    return at.astype(np.uint16), (values / np.linalg.norm(values)).astype(np.float32)


def _fit(rows: list, signs) -> object:
    """Weights of one machine, the bias last."""
    import numpy as np

    w, alpha, order = np.zeros(WIDTH + 1), np.zeros(len(rows)), np.random.default_rng(7)
    size = 2.0 + 0.5  # x.x with the bias, and 1/2C for C = 1
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, values = rows[i]
            slope = signs[i] * (w[at] @ values + w[-1]) - 1 + 0.5 * alpha[i]
            new = max(alpha[i] - slope / size, 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                w[at] += step * values
                w[-1] += step
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """Machines for the families (one against the rest) and for pairs of languages of one family."""

    def __init__(self, rows: list, langs: list[str]):
        import numpy as np

        self.langs = sorted(set(langs))
        family_of = {lang: FAMILY_OF.get(lang.lower(), lang) for lang in self.langs}
        self.families = sorted(set(family_of.values()))
        self.members = {f: [lang for lang in self.langs if family_of[lang] == f] for f in self.families}
        self.pairs = [(a, b) for m in self.members.values() for i, a in enumerate(m) for b in m[i + 1:]]
        weights = []
        if len(self.families) > 1:
            for family in self.families:
                weights.append(_fit(rows, [1 if family_of[lang] == family else -1 for lang in langs]))
        for a, b in self.pairs:
            mine = [i for i, lang in enumerate(langs) if lang in (a, b)]
            weights.append(_fit([rows[i] for i in mine], [1 if langs[i] == a else -1 for i in mine]))
        self.weights = np.stack(weights, 1) if weights else np.zeros((WIDTH + 1, 0), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        found = features(text) if self.langs else None
        if found is None:
            return "und", 0.0
        at, values = found
        sure = 1 / (1 + np.exp(-3 * (values @ self.weights[at] + self.weights[-1])))
        family, score = self.families[0], 1.0
        if len(self.families) > 1:
            own = sure[:len(self.families)]
            family, score = self.families[int(own.argmax())], float(own.max())
        votes = {lang: [0, 0.0] for lang in self.members[family]}
        for (a, b), p in zip(self.pairs, sure[len(sure) - len(self.pairs):].tolist()):
            if a in votes:
                votes[a if p >= 0.5 else b][0] += 1
                votes[a][1] += p
                votes[b][1] += 1 - p
        lang = max(votes, key=lambda name: (votes[name], name))
        return lang, score * (votes[lang][1] / (len(votes) - 1) if len(votes) > 1 else 1.0)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _rates(docs: DataFrame, rates: dict[str, float]) -> DataFrame:
    """The share of each language's rows that is looked at, as a table of one row per language."""
    return docs.sparkSession.createDataFrame(sorted(rates.items()), "lang string, _rate double")


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled rows that are not held out; only their features reach the driver.

    Each language gets an equal share, one row at least; of more than ``train_rows`` labels the most frequent are learned.
    The rows are those with the smallest hashes of number and text, so that a number that repeats is drawn like any other.
    """
    labelled = docs.filter("lang is not null and doc_id is not null").filter(~_held_out()).select("doc_id", "lang", "text")
    most = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(train_rows)
    counts = {r["lang"]: r["count"] for r in most.collect()}  # one row per language
    if not counts:
        return Model([], [])
    share = train_rows // len(counts)
    # About twice the share passes by its hash; the rank among those is the bound, kept by each task before the shuffle.
    rates = _rates(labelled, {lang: min(1.0, 2 * share / n + 100 / n) for lang, n in counts.items()})
    drawn = labelled.join(F.broadcast(rates), "lang").withColumn("_hash", F.xxhash64("doc_id", "text"))
    drawn = drawn.filter(F.pmod("_hash", F.lit(1_000_000)) < F.col("_rate") * 1_000_000)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_hash", F.xxhash64("text")))
    sample = drawn.withColumn("_rank", rank).filter(F.col("_rank") <= share).select("doc_id", "lang", "text")

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            found = [(lang.as_py(), features(text.as_py())) for lang, text in zip(batch.column(1), batch.column(2))]
            kept = [(lang, f) for lang, f in found if f]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang for lang, _ in kept], pa.string()), pa.array([f[0].tobytes() for _, f in kept], pa.binary()),
                pa.array([f[1].tobytes() for _, f in kept], pa.binary())], names=["lang", "at", "value"])

    import numpy as np

    got = sample.mapInArrow(run, "lang string, at binary, value binary").orderBy("lang", "at", "value").collect()
    rows = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["value"], np.float32)) for r in got]
    return Model(rows, [r["lang"] for r in got])


def language_id(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``."""
    model = train(docs, train_rows)
    given = docs.select("doc_id", _held_out().alias("held_out"), "text")

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:2], pa.array([lang for lang, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    schema = given.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return given.mapInArrow(run, schema)
