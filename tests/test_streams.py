import os

import brute
from pyspark.sql import functions as F

from marginalia.operators import reports
from marginalia.streaming import flows
from marginalia.streaming.tree_stream import SourceTreeReader
from test_walk import random_records


def drain(writer, checkpoint):
    writer.trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()


def test_chunks_of_new_files_only(spark, shared, tmp_path):
    root, out, state = tmp_path / "src", shared("chunks"), shared("state")
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/__init__.py").write_text("a\nb\n")
    (root / "skip.txt").write_text("no")

    def run():
        stream = flows.stream_source_chunks(spark, str(root), 20)
        drain(stream.writeStream.format("parquet").option("path", out), state)
        return sorted((os.path.basename(r["path"]), r["chunk_no"], r["content"]) for r in spark.read.parquet(out).collect())

    first = [("__init__.py", 0, "     1: a\n     2: b\n")]
    assert run() == first
    (root / "pkg/.later.rs").write_text("c")
    assert run() == sorted(first + [(".later.rs", 0, "     1: c\n")])
    assert run() == sorted(first + [(".later.rs", 0, "     1: c\n")])


def test_listing_shares_cover_every_file_once(tmp_path):
    for i in range(30):
        (tmp_path / f"d{i}/deep/deeper").mkdir(parents=True)
        (tmp_path / f"d{i}/deep/deeper/f{i}.py").write_text("x")
        (tmp_path / f"f{i}.py").write_text("x")
    expect = sorted(str(p) for p in tmp_path.rglob("*.py"))
    for wanted in (1, 4, 29, 40, 500):
        reader = SourceTreeReader({"path": str(tmp_path), "list_partitions": str(wanted)})
        shares = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert len(shares) <= max(2 * wanted, 1) + 1
        assert sorted(row[0] for share in shares for row in reader.read(share)) == expect


def sections(spark, rows):
    return spark.createDataFrame(
        [("p", n, f"/s/{p}.rs", 1, 2, f"{{{n}``1``text {n}}}", "now", step) for p, n, step in rows],
        "project string, name string, path string, start_line bigint, end_line bigint, review_message string, "
        "modified_label string, step bigint",
    )


def test_reports_grow_and_a_repeated_batch_changes_nothing(spark, shared, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "SNAPSHOT_EVERY", 2)
    source, state, offsets = shared("in"), shared("ledger"), shared("offsets")
    batches = [[("a", f"f{b}{i}", 10 * b + i) for i in range(3)] + [("b", f"g{b}", 10 * b)] for b in range(6)]
    seen, stream = [], None
    for rows in batches:
        sections(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        drain(flows.stream_reviews_to_reports(stream, str(tmp_path), state, ["step"], 200), offsets)
        seen += rows
        expect = reports.assemble_reports(reports.render_markdown(sections(spark, seen)), ["step"]).collect()
        for r in expect:
            assert (tmp_path / r["report_path"]).read_text() == r["markdown"]
    before = (tmp_path / "review_output/s/a.md").read_text()
    # The last batch once more, as after a failure between its work and its commit.
    os.unlink(f"{offsets}/commits/5")
    crc = f"{offsets}/commits/.5.crc"
    if os.path.exists(crc):
        os.unlink(crc)
    drain(flows.stream_reviews_to_reports(stream, str(tmp_path), state, ["step"], 200), offsets)
    assert (tmp_path / "review_output/s/a.md").read_text() == before


def test_known_reports_are_found_once_a_batch(spark, shared, tmp_path, monkeypatch):
    source, state, offsets = shared("in"), shared("ledger"), shared("offsets")
    write, plans = flows.write_reports, []

    def watched(parts, root, known):
        plans.append(known._jdf.queryExecution().optimizedPlan().toString())
        return write(parts, root, known)

    monkeypatch.setattr(flows, "write_reports", watched)
    rows = [("a", "f", 0)], [("a", "g", 1), ("b", "h", 2)]
    for some in rows:
        sections(spark, some).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        drain(flows.stream_reviews_to_reports(stream, str(tmp_path), state, ["step"]), offsets)
    assert plans[0].startswith("LocalRelation <empty>")
    assert not any(step in plans[1] for step in ("Join", "Aggregate")) and "parquet" in plans[1]
    for r in reports.assemble_reports(reports.render_markdown(sections(spark, sum(rows, []))), ["step"]).collect():
        assert (tmp_path / r["report_path"]).read_text() == r["markdown"]


def test_routing_state_lasts_over_batches(spark, shared, monkeypatch):
    monkeypatch.setattr(flows, "SNAPSHOT_EVERY", 2)
    records = random_records(7, 4, 24, 6)
    index = {}
    for r in records:
        index.setdefault(r["project"], {})[f"{r['path']}:{r['name']}"] = r["path"]
    messages = [(r["project"], r["record_no"], r["review_message"]) for r in records]
    source, out, offsets = shared("in"), shared("out"), shared("offsets")
    keys = spark.createDataFrame([(p, k, v) for p, ks in index.items() for k, v in ks.items()], "project string, key string, path string")
    schema = "project string, seq bigint, review_message string"
    for low in (0, 8, 16):
        spark.createDataFrame([m for m in messages if low <= m[1] < low + 8], schema).write.mode("append").parquet(source)
        drain(flows.stream_review_state(spark.readStream.schema(schema).parquet(source), keys, out), offsets)
    got = spark.read.parquet(f"{out}/signals")
    assert got.select("batch").distinct().count() == 3
    rows = sorted((r["project"], r["seq"], r["status"], r["key"]) for r in got.collect())
    assert rows == brute.serve(messages, index)
    assert got.filter(F.col("key").isNotNull()).groupBy("project", "key").count().filter("count > 1").isEmpty()
