"""Which tokens of two tokenizers cover the same bytes: merge-path alignment of their byte ends.

1. A task encodes its texts with both tokenizers and turns ids into ascending byte ends. Short documents are laid one
   after another into a run; a document ends both sequences, so nothing crosses it. A long document is a run of its own.
2. Merging the ends of A and B is a path of ``len(A) + len(B)`` steps. Binary searches on its diagonals cut it into
   pieces of equal work that need nothing of each other. The pieces of long documents are rows that Spark deals out;
   those of short ones are merged where they are.
3. A piece emits the tokens of A and B that end together. A pair of equal ends may lie on both sides of a cut, and a
   group may run over several pieces: pieces are stitched in their order.
4. Links are counted per run, then in the corpus as rows ``(pair, count)``; each run asks for the counts of its own
   distinct pairs and adds them up per document.

Defined results: a text that is null or empty, or of which either tokenizer does not give back the bytes of the text
after a space, has no tokens and zeros throughout. Texts of any length are encoded whole. Rows that repeat, ties and
rows without an id each give a row; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..storage import materialize
from .common import worker_state

# Steps of the path in a piece; characters of short documents in a run.
PIECE_STEPS = 1 << 16
RUN_CHARS = 1 << 21
# Longer texts go to the tokenizer file's own library, which is slower and takes any text.
RANKED_CHARS = 200_000
SEPARATORS = (b",", b"|", b";")


def _byte_values() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(free)): b for b in range(256)}


class ByteLevel:
    """Ids and token bytes of a byte-level tokenizer file; special tokens in a text are text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        values = _byte_values()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (1 + max(self.tokenizer.get_vocab().values()))
        for token, i in vocabulary.items():
            # A token outside the byte letters is an added one; no text gives it.
            self.bytes[i] = bytes(values[c] for c in token) if all(c in values for c in token) else b""
        self.ranks = self._as_ranks(path)

    def _as_ranks(self, path: str):
        """The same tokenizer by its ranks, which is faster, if ids are the order of merges and the split is the usual one."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split, added = spec["model"], spec["pre_tokenizer"] or {}, {t["id"] for t in spec["added_tokens"]}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        at = [model["vocab"].get(m, -1) for m in merges]
        usual = (model["type"] == "BPE" and spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split.get("add_prefix_space") and not model.get("ignore_merges") and at == list(range(256, 256 + len(at))))
        if not usual:
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in added}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        # The rank encoder's regular expression ends the process's thread on white space of about a million characters.
        if self.ranks is not None and len(text) <= RANKED_CHARS:
            return self.ranks.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and token bytes of a sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = model.encode
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


class _Coders:
    def __init__(self, a_path: str, b_path: str):
        import numpy as np

        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in c.bytes], np.int64) for c in (self.a, self.b))
        # Each id as text with each separator after it: first those of A, then those of B.
        ids = [*range(len(self.a.bytes)), *range(len(self.b.bytes))]
        self.texts = [b"%d%s" % (i, s) for i in ids for s in SEPARATORS]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        a, b = self.a.encode(" " + text), self.b.encode(text)
        whole = b" " + text.encode()
        if b"".join([self.a.bytes[i] for i in a]) != whole or b"".join([self.b.bytes[i] for i in b]) != whole:
            return [], []
        return a, b


def _coders(a_path: str, b_path: str) -> _Coders:
    return worker_state(f"alignment {a_path} {b_path}", lambda: _Coders(a_path, b_path))


def path_cuts(a_ends, b_ends, steps: int):
    """Where the merge path of two ascending sequences crosses the diagonals at 0, ``steps``, 2 * ``steps``, ... and its end:
    how many of A and of B lie before. Of equal ends A's comes first. All diagonals are searched at once."""
    import numpy as np

    n = len(a_ends) + len(b_ends)
    diagonal = np.append(np.arange(0, n, steps), n)
    low, high = np.maximum(diagonal - len(b_ends), 0), np.minimum(diagonal, len(a_ends))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        ahead = np.zeros(len(mid), bool)
        ahead[open_] = a_ends[mid[open_]] <= b_ends[(diagonal - mid - 1)[open_]]
        low, high = np.where(ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
    return low, diagonal - low


def merge_piece(a_ends, b_ends):
    """The places in A and in B of ends that both have."""
    import numpy as np

    at = np.searchsorted(b_ends, a_ends)
    a = np.flatnonzero(at < len(b_ends))
    a = a[b_ends[at[a]] == a_ends[a]]
    return a, at[a]


def stitch(pieces: list[tuple]):
    """Places in the whole sequences of ends both have. A piece is ``(places in A, places in B, tokens of A, tokens of B,
    its last end in A, its first end in B)``; an end is -1 where there is none."""
    import numpy as np

    found_a, found_b, a_from, b_from, last = [], [], 0, 0, -1
    for a, b, n_a, n_b, last_a, first_b in pieces:
        if first_b >= 0 and first_b == last:
            found_a.append(np.array([a_from - 1]))
            found_b.append(np.array([b_from]))
        found_a.append(a + a_from)
        found_b.append(b + b_from)
        a_from, b_from, last = a_from + n_a, b_from + n_b, last_a if n_a else last
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))


def _ends(ids, sizes, base: int = 0):
    import numpy as np

    return np.cumsum(sizes[ids]) + base


def _piece(a_ends, b_ends) -> tuple:
    return (*merge_piece(a_ends, b_ends), len(a_ends), len(b_ends), int(a_ends[-1]) if len(a_ends) else -1, int(b_ends[0]) if len(b_ends) else -1)


RUN_SCHEMA = ("n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, pairs array<long>, uses array<long>, links binary, "
              "width int")
PIECE_SCHEMA = "piece int, a binary, b binary, a_base long, b_base long"


def _finished(coders: _Coders, run: int, doc_ids, sizes, a, b, cut_a, cut_b, digest: bool) -> dict:
    """One row for a run: per document its counts and groups, and its links by their number among the run's distinct pairs."""
    import numpy as np

    # Groups one after another, in each the tokens of A, then those of B; an id and its separator are one code.
    code = np.empty(len(a) + len(b), np.int64)
    in_a, in_b = np.arange(len(a)), np.arange(len(b))
    group_a, group_b = np.searchsorted(cut_a, in_a), np.searchsorted(cut_b, in_b)
    before = np.concatenate([[0], cut_b + 1])
    code[in_a + before[group_a]] = 3 * a + (cut_a[group_a] == in_a)
    code[in_b + cut_a[group_b] + 1] = 3 * (len(coders.a.bytes) + b) + 2 * (cut_b[group_b] == in_b)
    ends = np.cumsum([x + y for x, y in sizes], dtype=np.int64)
    groups = []
    for (n_a, n_b), end in zip(sizes, ends.tolist()):
        text = b"".join([coders.texts[c] for c in code[end - n_a - n_b:end].tolist()])[:-1]
        groups.append(text.decode() if not digest else hashlib.sha256(text).hexdigest() if text else "")
    upto = np.concatenate([[0], np.searchsorted(cut_a, np.cumsum([x for x, _ in sizes], dtype=np.int64))])
    pairs, links, uses = np.unique(a[cut_a] << 32 | b[cut_b], return_inverse=True, return_counts=True)
    width = 2 if len(pairs) <= 1 << 16 else 4
    return {"run": run, "doc_ids": doc_ids, "n_a": [x for x, _ in sizes], "n_b": [y for _, y in sizes], "n_groups": np.diff(upto).tolist(),
            "groups": groups, "pairs": pairs, "uses": uses, "links": links.astype(f"<u{width}").tobytes(), "width": width}


def _arrow(rows: list[dict], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _encode(a_path: str, b_path: str, digest: bool, schema):
    def run(batches: Iterator):
        import numpy as np
        from pyspark import TaskContext

        coders = _coders(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        held, chars = [], 0

        def close():
            nonlocal held, chars, number
            a, b = (np.concatenate([d[k] for d in held]).astype(np.int64) for k in (1, 2))
            a_ends, b_ends = _ends(a, coders.a_sizes), _ends(b, coders.b_sizes)
            i, j = path_cuts(a_ends, b_ends, PIECE_STEPS)
            cuts = list(zip(i.tolist(), j.tolist()))
            if len(held) == 1 and len(cuts) > 3:
                rows = [{"run": number, "doc_ids": [held[0][0]], "piece": k, "a": a[i0:i1].astype("<i4").tobytes(), "b": b[j0:j1].astype("<i4").tobytes(),
                         "a_base": int(a_ends[i0 - 1]) if i0 else 0, "b_base": int(b_ends[j0 - 1]) if j0 else 0}
                        for k, ((i0, j0), (i1, j1)) in enumerate(zip(cuts, cuts[1:]))]
            else:
                cut_a, cut_b = stitch([_piece(a_ends[i0:i1], b_ends[j0:j1]) for (i0, j0), (i1, j1) in zip(cuts, cuts[1:])])
                rows = [_finished(coders, number, [d[0] for d in held], [(len(d[1]), len(d[2])) for d in held], a, b, cut_a, cut_b, digest)]
            held, chars, number = [], 0, number + 1
            return _arrow(rows, schema)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                document = key.as_py(), *(np.array(ids, np.int32) for ids in coders.tokens(text))
                if len(document[1]) + len(document[2]) > 2 * PIECE_STEPS:
                    if held:
                        yield close()
                    held = [document]
                    yield close()
                    continue
                held.append(document)
                chars += len(text or "")
                if chars >= RUN_CHARS:
                    yield close()
        if held:
            yield close()

    return run


def _merge(a_path: str, b_path: str, schema):
    """Pieces of long documents: the ends that both tokenizers have, each piece by itself."""

    def run(batches: Iterator):
        import numpy as np

        coders = _coders(a_path, b_path)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[k], "<i4") for k in "ab")
                cut_a, cut_b, _, _, last, first = _piece(_ends(a, coders.a_sizes, row["a_base"]), _ends(b, coders.b_sizes, row["b_base"]))
                rows.append(row | {"cut_a": cut_a.astype("<i4").tobytes(), "cut_b": cut_b.astype("<i4").tobytes(), "last_a": last, "first_b": first})
            yield _arrow(rows, schema)

    return run


def _stitched(a_path: str, b_path: str, digest: bool, schema):
    """The merged pieces of one long document to its row."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        numbers = lambda name: [np.frombuffer(r[name], "<i4").astype(np.int64) for r in rows]
        a, b = numbers("a"), numbers("b")
        cut_a, cut_b = stitch([(x, y, len(i), len(j), r["last_a"], r["first_b"])
                               for x, y, i, j, r in zip(numbers("cut_a"), numbers("cut_b"), a, b, rows)])
        a, b = np.concatenate(a), np.concatenate(b)
        row = _finished(_coders(a_path, b_path), rows[0]["run"], rows[0]["doc_ids"], [(len(a), len(b))], a, b, cut_a, cut_b, digest)
        return pa.Table.from_batches([_arrow([row], schema)])

    return run


def _sums(schema):
    """Runs with the counts of their distinct pairs to one row per document."""

    def run(batches: Iterator):
        import numpy as np

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                links = np.frombuffer(r["links"], f"<u{r['width']}").astype(np.int64)
                values = np.array(r["values"] or [], np.int64)[links]
                doc = np.repeat(np.arange(len(r["n_groups"])), r["n_groups"])
                best, count = (np.zeros(len(r["n_groups"]), np.int64) for _ in range(2))
                np.add.at(best, doc, values & 1)
                np.add.at(count, doc, values >> 1)
                rows += [{"doc_id": d, "n_a": a, "n_b": b, "n_groups": g, "n_links": g, "n_best": int(n), "count_sum": int(c), "groups": t}
                         for d, a, b, g, n, c, t in zip(r["doc_ids"], r["n_a"], r["n_b"], r["n_groups"], best, count, r["groups"])]
            yield _arrow(rows, schema)

    return run


def align_tokens(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids between two byte offsets where tokens of both end. A link is a token of A
    and one of B that end together. ``n_best`` counts links whose id pair is linked as often as any with its id of B in
    the corpus, ``count_sum`` adds up how often each link's id pair is linked. With ``digest``, ``groups`` holds the
    SHA-256 of that text (empty without tokens), so that the text, longer than the document's, is never written.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    head = f"run long, doc_ids array<{kind}>, "
    arrow = lambda ddl: _arrow_schema(spark, ddl)
    runs = materialize(given.mapInArrow(_encode(a_path, b_path, digest, arrow(f"{head}{RUN_SCHEMA}, {PIECE_SCHEMA}")),
                                        f"{head}{RUN_SCHEMA}, {PIECE_SCHEMA}"), "runs")
    merged = f"{head}{PIECE_SCHEMA}, cut_a binary, cut_b binary, last_a long, first_b long"
    pieces = runs.filter("piece is not null").select("run", "doc_ids", "piece", "a", "b", "a_base", "b_base")
    shards = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    long_ = pieces.repartition(shards, "run", "piece").mapInArrow(_merge(a_path, b_path, arrow(merged)), merged)
    long_ = long_.groupBy("run").applyInArrow(_stitched(a_path, b_path, digest, arrow(f"{head}{RUN_SCHEMA}")), f"{head}{RUN_SCHEMA}")
    long_ = materialize(long_, "long-documents")
    finished = runs.filter("piece is null").select(*long_.columns).unionByName(long_)

    asked = finished.select("run", F.explode(F.arrays_zip("pairs", "uses")).alias("p")).select("run", "p.pairs", "p.uses")
    counts = asked.groupBy("pairs").agg(F.sum("uses").alias("count")).withColumn("b", F.col("pairs").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = materialize(counts, "pair-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    # The count and whether it is the highest of its id of B, in one number.
    value = F.col("count") * 2 + (F.col("count") == F.col("most")).cast("long")
    rated = materialize(counts.join(best, "b").select("pairs", value.alias("value")), "pair-values")
    answers = asked.select("run", "pairs").join(rated, "pairs").groupBy("run").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pairs", "value"))), lambda p: p["value"]).alias("values"))
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return finished.drop("pairs", "uses").join(answers, "run", "left").mapInArrow(_sums(arrow(schema)), schema)


def _arrow_schema(spark, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)
