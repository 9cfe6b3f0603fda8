"""Following the chain "review this function next" through many projects at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..plans.ranks import with_place
from ..storage import materialize, run_dir
from .code import code_functions, find_in, name_lookups
from .model import ModelFn, review_functions
from .records import function_index
from .reviews import next_signal, parse_reviews, remaining_functions, suffix_index

# A round runs a project ahead by at most 2^MAX_JUMP_BITS moves.
MAX_JUMP_BITS = 16


def _jump(table: DataFrame) -> DataFrame:
    """Twice the jump of ``table`` (node, to)."""
    onward = table.select(F.col("node").alias("to"), F.col("to").alias("_to"))
    return table.join(onward, "to").select("node", F.col("_to").alias("to"))


def _run_ahead(frontier: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """The nodes 0, 1, ... ``2^len(jumps) - 1`` moves after each frontier row.

    Every row applies the jumps of the bits of its own distance: one join per bit.
    """
    ahead = frontier.withColumn("far", F.explode(F.sequence(F.lit(0), F.lit((1 << len(jumps)) - 1))))
    for bit, jump in enumerate(jumps):
        moves = F.col("far").bitwiseAND(F.lit(1 << bit)) != 0
        hop = jump.withColumnRenamed("node", "_from")
        ahead = (
            # Rows that stay get a key that nothing matters for, spread over the partitions.
            ahead.withColumn("_from", F.when(moves, F.col("node")).otherwise(-1 - F.col("far")))
            .join(hop, "_from", "left")
            .withColumn("node", F.when(moves, F.col("to")).otherwise(F.col("node")))
            .filter(F.col("node").isNotNull())
            .drop("_from", "to")
        )
    return ahead


def _walk_nodes(reviews: DataFrame, seeds: DataFrame) -> DataFrame:
    """The places a walk can be at: ``node, project, name, key, place, record_no, ask, exact, to``.

    One per name and key that ends with it, ``place`` being that of the key among the name's keys, and one per seed,
    without a name. Whoever asks for the name and gets the key is led to ``record_no``; ``ask`` is what that record's
    review asks for in turn, ``exact`` the key it names, if there is one. ``to`` is a guess at the next node: the exact
    key's, else the one after it when it asks for its own name, else the first of the name.
    """
    index = materialize(function_index(reviews), "walk-index")
    parsed = parse_reviews(reviews).select("project", "record_no", "n_parts", "continue_flag", "next_name", "next_path")
    live = (F.col("n_parts") >= tx.MIN_PARTS) & (F.col("continue_flag") == "1")
    asks = parsed.select("project", "record_no", F.struct(
        live.alias("live"), F.when(live, F.col("next_name")).alias("name"),
        F.when(live, tx.index_key(F.col("next_path"), F.col("next_name"))).alias("probe")).alias("ask"))
    keys = with_place(suffix_index(index), ["project", "suffix"], ["key"], "place", "walk-names")
    wanted = keys.select("project", F.col("suffix").alias("next_key"), F.col("path").alias("next_path"), "key", "place")
    led = find_in(wanted, *name_lookups(reviews)).select(
        "project", F.col("next_key").alias("name"), "key", "place", F.col("found_record_no").alias("record_no"))
    none = lambda kind: F.lit(None).cast(kind)
    start = seeds.select("project", none("string").alias("name"), none("string").alias("key"), none("bigint").alias("place"), "record_no")
    nodes = led.unionByName(start).join(asks, ["project", "record_no"], "left")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "walk-places")
    named = nodes.filter(F.col("name").isNotNull())
    exact = named.select("project", F.col("name").alias("_name"), F.col("key").alias("_key"), F.col("node").alias("_exact"))
    at = named.select("project", F.col("name").alias("_name"), F.col("place").alias("_place"), F.col("node").alias("_next"))
    # After its own key a name goes on with the next one; any other name begins with its first.
    place = F.when(F.col("ask.name") == F.col("name"), F.col("place") + 1).otherwise(F.lit(1))
    guessed = (
        nodes.withColumns({"_name": F.col("ask.name"), "_key": F.col("ask.probe"), "_place": place})
        .join(exact, ["project", "_name", "_key"], "left").join(at, ["project", "_name", "_place"], "left")
        .select("node", "project", "name", "key", "place", "record_no", "ask",
                F.when(F.col("_exact").isNotNull(), F.col("_key")).alias("exact"), F.coalesce("_exact", "_next").alias("to"))
    )
    return materialize(guessed, "walk-nodes")


def review_walk(reviews: DataFrame, max_steps: int | None = None, drop_seed: bool = False) -> DataFrame:
    """Which reviews are visited, in which order: ``project, step, record_no``.

    ``reviews`` has one row per record (``project, path, name, record_no, review_message``, with
    ``record_no`` unique in its project). Each project starts at its smallest ``record_no``; every
    move takes a key from the index, and a key can be taken once. ``drop_seed`` takes the seed's own
    key at the start.

    Every round guesses the next moves of all projects with jump tables of doubling length and settles
    them together. Who asks for a key that is free and that nobody before asked for gets it. Of the
    others, the k-th that asks for a name gets the k-th of its keys that are free. That is what they get
    one after another, up to the first row whose key an earlier row has under another name; so is the path, up to
    the first row that is led to a review that asks for something else than the guessed one. What comes
    before is kept, and the next round starts there. So names that many functions share cost no rounds,
    as long as the reviews under a name ask for the same name; else rounds grow with the changes.
    A round goes ahead as far as the last ones were right.
    """
    spark = reviews.sparkSession
    seeds = reviews.groupBy("project").agg(F.min("record_no").alias("record_no"))
    nodes = _walk_nodes(reviews, seeds)
    jumps = [nodes.filter(F.col("to").isNotNull()).select("node", "to")]
    base = run_dir(spark, "walk")
    taken_schema = "project string, key string, name string, place bigint"
    taken = spark.createDataFrame([], taken_schema)
    if drop_seed:
        own = seeds.join(reviews.select("project", "record_no", "path", "name"), ["project", "record_no"])
        own.select("project", tx.index_key(F.col("path"), F.col("name")).alias("key"), F.lit(None).cast("string").alias("name"),
                   F.lit(None).cast("bigint").alias("place")).write.parquet(f"{base}/taken/round=0")

    frontier = nodes.filter(F.col("name").isNull()).select("project", F.lit(0).cast("bigint").alias("step"), "node")
    total, rounds, bits = nodes.count(), 0, 4
    named = nodes.filter(F.col("name").isNotNull()).select("project", "name", "key", "place", "node", "record_no", "ask")
    while True:
        rounds += 1
        while len(jumps) < bits:
            jumps.append(materialize(_jump(jumps[-1]), "walk-jump"))
        if rounds > 1 or drop_seed:
            taken = spark.read.schema(taken_schema).parquet(f"{base}/taken").select("project", "key", "name", "place")
        gone = taken.select("project", F.col("key").alias("exact"), F.lit(True).alias("_gone"))
        ahead = _run_ahead(frontier, jumps[:bits]).join(nodes.select("node", "record_no", "ask", "exact"), "node")
        # A project has one frontier row, so a window over a project or less holds at most 2^bits rows.
        ask = F.col("ask.name")
        ahead = (
            ahead.join(gone, ["project", "exact"], "left")
            .withColumn("_free", F.col("exact").isNotNull() & F.col("_gone").isNull())
            .withColumn("_first", F.row_number().over(W.partitionBy("project", "exact").orderBy("far")) == 1)
            .withColumn("_exactly", F.col("_free") & F.col("_first"))
            .withColumn("_queue", F.when(F.coalesce("ask.live", F.lit(False)) & ~F.col("_exactly"), ask))
            .withColumn("_rank", F.row_number().over(W.partitionBy("project", "_queue").orderBy("far")))
            .withColumn("_rank", F.when(F.col("_queue").isNotNull(), F.col("_rank")))
        )
        asked = materialize(ahead.drop("_gone", "_free", "_first"), "walk-ahead")
        # The keys still free of the names asked for, from the last one taken in turn; no more than can be asked for.
        marks = taken.filter(F.col("place").isNotNull()).groupBy("project", "name").agg(F.max("place").alias("_mark"))
        names = asked.filter("ask.live").select("project", ask.alias("name")).distinct()
        free = (
            named.join(names, ["project", "name"], "left_semi").join(marks, ["project", "name"], "left")
            .filter(F.col("_mark").isNull() | (F.col("place") > F.col("_mark")))
            .join(taken.select("project", "key"), ["project", "key"], "left_anti")
            .withColumn("_rank", F.row_number().over(W.partitionBy("project", "name").orderBy("place")))
            .filter(F.col("_rank") <= (1 << bits) + 1)
        )
        free = materialize(free.drop("_mark"), "walk-free")
        by_rank = free.select("project", F.col("name").alias("_queue"), "_rank", F.struct("key", "name", "place", "node", "record_no", "ask").alias("_next"))
        # Only a key taken in turn has a place: those before it are taken as well.
        out_of_turn = F.lit(None).cast("bigint").alias("place")
        by_key = named.select("project", F.col("name").alias("_name"), F.col("key").alias("exact"),
                              F.struct("key", "name", out_of_turn, "node", "record_no", "ask").alias("_named"))
        moved = (
            asked.withColumn("_name", F.when(F.col("_exactly"), ask))
            .join(by_rank, ["project", "_queue", "_rank"], "left").join(by_key, ["project", "_name", "exact"], "left")
            .withColumn("got", F.coalesce("_named", "_next"))
        )
        project = W.partitionBy("project").orderBy("far")
        twice = F.col("got.key").isNotNull() & (F.row_number().over(W.partitionBy("project", "got.key").orderBy("far")) > 1)
        next_far, next_ask = F.lead("far").over(project), F.lead("ask").over(project)
        stays = (next_far == F.col("far") + 1) & F.col("got.ask").eqNullSafe(next_ask)
        what = (
            F.when(~F.coalesce("ask.live", F.lit(False)), "end").when(twice, "stuck").when(F.col("got").isNull(), "end")
            .when(F.coalesce(stays, F.lit(False)), None).otherwise("onward")
        )
        led = F.lag("got.record_no").over(project)
        moved = moved.withColumn("what", what).withColumn("_led", F.when(F.col("far") == 0, F.col("record_no")).otherwise(led))
        cut = F.min(F.when(F.col("what").isNotNull(), F.col("far"))).over(W.partitionBy("project"))
        rows = moved.withColumn("_cut", cut).filter(F.col("far") <= F.col("_cut")).select(
            "project", (F.col("step") + F.col("far")).alias("step"), F.col("_led").alias("record_no"), "what", ask.alias("next_name"),
            *[F.col(f"got.{c}").alias(f"got_{c}") for c in ("key", "name", "place", "node", "record_no")])
        if max_steps is not None:
            rows = rows.filter(F.col("step") < max_steps)
        rows.write.parquet(f"{base}/rows/round={rounds}")
        rows = spark.read.schema(rows.schema).parquet(f"{base}/rows/round={rounds}")

        # A stuck row gets the first key of the name that nobody before it has.
        stuck = F.coalesce(F.col("what") == "stuck", F.lit(False))
        new = rows.filter(~stuck & F.col("got_key").isNotNull()).select(
            "project", F.col("got_key").alias("key"), F.col("got_name").alias("name"), F.col("got_place").alias("place"))
        settled = (
            rows.filter(stuck).select("project", "step", F.col("next_name").alias("name"))
            .join(free, ["project", "name"]).join(new.select("project", "key"), ["project", "key"], "left_anti")
            .groupBy("project", "step", "name").agg(F.min(F.struct("place", "key", "node", "record_no")).alias("c"))
            .select("project", (F.col("step") + 1).alias("step"), "name", "c.*")
        )
        settled = materialize(settled, "walk-settled")
        new.unionByName(settled.select("project", "key", "name", "place")).write.parquet(f"{base}/taken/round={rounds}")
        onward = rows.filter(F.col("what") == "onward").select(
            "project", (F.col("step") + 1).alias("step"), F.col("got_node").alias("node"), F.col("got_record_no").alias("record_no"))
        due = onward.unionByName(settled.select("project", "step", "node", "record_no")).filter(F.col("record_no").isNotNull())
        if max_steps is not None:
            due = due.filter(F.col("step") < max_steps)
        active, made = due.count(), rows.count()
        if not active:
            break
        before = rows.select("project").distinct().count()
        # Ahead as far as the last round was right, and a little further; never more moves than there are keys.
        bits = max(2, min((made // before).bit_length() + 2, MAX_JUMP_BITS, (total // active).bit_length()))
        frontier = due.select("project", "step", "node")
    return spark.read.schema("project string, step bigint, record_no bigint").parquet(f"{base}/rows").select(
        "project", "step", "record_no"
    )


def model_walk(records: DataFrame, files: DataFrame | Callable[[DataFrame], DataFrame], model_fn: ModelFn, seeds: DataFrame | None = None,
               max_steps: int | None = None, drop_seed: bool = False, concurrency: int | None = None, **asking) -> DataFrame:
    """The same walk when every review is still to be asked for.

    All projects with a function due are reviewed in one job per step: their prompts list the keys
    that are left, the answers name the next functions, and those are cut from the files. A project
    ends when its answer says so, is malformed, fails, or asks for something that is not there.
    ``seeds`` (``project, path, name``) chooses the first functions, else it is the first record.
    ``files`` is a table of contents, or a function that reads the files of the records it is given:
    then a step reads the files of the functions due and no others. ``asking`` goes to ``complete_prompts``.
    Returns ``project, step, path, name, start_line, end_line, review_message, error, status``.
    """
    spark = records.sparkSession
    base = run_dir(spark, "model-walk")
    index = materialize(function_index(records), "walk-index")
    if seeds is None:
        first = F.min(F.struct("record_no", "path", "name")).alias("s")
        seeds = records.groupBy("project").agg(first).select("project", "s.path", "s.name")
    asked = seeds.select("project", F.col("path").alias("next_path"), F.col("name").alias("next_key"))
    lookups = [materialize(t, "walk-names") for t in name_lookups(records)]
    taken = seeds.select("project", tx.index_key(F.col("path"), F.col("name")).alias("key"))
    if not drop_seed:
        taken = taken.filter(F.lit(False))

    step, found_schema, gone = 0, None, taken
    while max_steps is None or step < max_steps:
        found = find_in(asked, *lookups).filter(F.col("found_name").isNotNull()).select(
            "project", F.col("next_path").alias("path"), F.col("found_name").alias("name"),
            F.col("found_start_line").alias("start_line"), F.col("found_end_line").alias("end_line"),
        )
        found = materialize(found, "walk-found")
        due = materialize(code_functions(found, files(found) if callable(files) else files), "walk-due")
        if due.isEmpty():
            break
        left = remaining_functions(index.join(due.select("project"), "project", "left_semi"), gone)
        reviewed = review_functions(due, left, model_fn, concurrency, **asking)
        signals = next_signal(parse_reviews(reviewed), left).withColumn(
            "status", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status"))
        )
        rows = signals.select(
            "project", F.lit(step).cast("bigint").alias("step"), "path", "name", "start_line", "end_line",
            "review_message", "error", "status", "key", "next_key", "next_path",
        )
        rows.write.parquet(f"{base}/rows/at={step}")
        found_schema = rows.schema
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found_schema)
        moved = spark.read.schema(f"{ddl}, at int").parquet(f"{base}/rows").filter(F.col("key").isNotNull())
        gone = taken.unionByName(moved.select("project", "key"))
        asked = moved.filter(F.col("at") == step).select("project", "next_path", "next_key")
        step += 1
    columns = ["project", "step", "path", "name", "start_line", "end_line", "review_message", "error", "status"]
    if found_schema is None:
        schema = ("project string, step bigint, path string, name string, start_line bigint, end_line bigint, "
                  "review_message string, error string, status string")
        return spark.createDataFrame([], schema)
    return spark.read.schema(found_schema).parquet(f"{base}/rows").select(*columns)
