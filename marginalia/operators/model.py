"""The model call: a function of the user, run in Arrow batches on the executors."""

from __future__ import annotations

import inspect
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.ordered_text import whole_texts
from ..storage import materialize, run_dir
from .prompts import FUNCTION_KEY, review_prompt
from .records import completion_content

# Takes prompts, and if it has a second parameter their settings (``system``, ``max_tokens``, ``temperature``);
# returns a response document, or an exception, for each prompt.
ModelFn = Callable[..., list]
SETTINGS = ("system", "max_tokens", "temperature")
ANSWERS = "_digest string, response string, error string"
# Calls of a task, about: what is repeated when it is lost.
BLOCK = 64
# Blocks that a task may have at once where calls are quick.
MOST_BLOCKS = 64
# Prompts that a task deals out to jobs, about.
SHARE = 32_768


def _takes_settings(model_fn: ModelFn) -> bool:
    return len(inspect.signature(model_fn).parameters) > 1


def _answers(model_fn: ModelFn, with_settings: bool, settings: list[str], batch: int, retries: int, wait: float):
    """Prompts to ``_digest, response, error``; those that fail are sent again, after a wait that doubles."""

    def said(error: BaseException) -> str:
        return str(error) or type(error).__name__

    def ask(prompts: list[str], given: list[dict]) -> list[tuple[str | None, str | None]]:
        try:
            responses = list(model_fn(prompts, given) if with_settings else model_fn(prompts))
            if len(responses) != len(prompts):
                raise ValueError(f"{len(responses)} responses for {len(prompts)} prompts")
        except Exception as error:
            return [(None, said(error))] * len(prompts)
        return [(None, said(r)) if isinstance(r, BaseException) else (r, None) for r in responses]

    def run(batches):
        for rows in batches:
            frame = rows.to_pandas()
            # Lists once, as a slice of the frame costs more than a quick call.
            prompts, given = frame["_prompt"].tolist(), frame[settings].to_dict("records") if with_settings else []
            found: list = [None] * len(prompts)
            due = list(range(len(prompts)))
            for attempt in range(retries + 1):
                if attempt and due:
                    time.sleep(wait * 2 ** (attempt - 1))
                for at in range(0, len(due), batch):
                    some = due[at:at + batch]
                    for i, pair in zip(some, ask([prompts[i] for i in some], [given[i] for i in some] if with_settings else [])):
                        found[i] = pair
                due = [i for i in due if found[i][1] is not None]
            said_so = [pa.array(column, pa.string(), from_pandas=True) for column in ([r for r, _ in found], [e for _, e in found])]
            yield pa.RecordBatch.from_arrays([rows.column("_digest"), *said_so], ["_digest", "response", "error"])

    return run


def complete_prompts(df: DataFrame, model_fn: ModelFn, prompt: str = "prompt", concurrency: int | None = None, batch: int = 1,
                     ledger: str | None = None, block: int = BLOCK, retries: int = 0, wait: float = 1.0,
                     quick: float = 2.0) -> DataFrame:
    """Call ``model_fn`` once per prompt; adds ``response`` and ``error`` and drops the prompt and its settings.

    ``model_fn`` gets up to ``batch`` prompts at a time: an exception in its place is the error of that prompt, and one
    that is raised is the error of all prompts of the call. A prompt that failed is sent again up to ``retries`` times,
    after ``wait`` seconds, then twice as long, and so on. ``concurrency`` bounds the calls in flight.

    Answers are kept in a ledger, a folder of tables, by a hash of the prompt and its settings: equal ones are
    asked once, and no later job pays for a call twice. Prompts go out in jobs in which a task has one ``block`` of them, about, and
    a job's answers are written before the next begins. A task that is lost repeats the calls of its block; a run
    that ended half way and is started again with the same ``ledger`` repeats the blocks it had open, and asks again
    what failed. After a job that took less than ``quick`` seconds in all a task has twice as many blocks, up to 64, and half as
    many after one of more than twice that time: so what is repeated is one block or the quick calls of a few seconds. With
    ``quick=0`` it is one block always.
    """
    spark = df.sparkSession
    settings = [c for c in SETTINGS if c in df.columns]
    kept = [c for c in df.columns if c != prompt and c not in settings]
    folder = ledger or run_dir(spark, "ledger")
    # A field's length keeps two lists of texts with one concatenation apart.
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (prompt, *settings)]
    sized = F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in fields])
    digest = F.when(F.col(prompt).isNotNull(), F.sha2(sized.cast("binary"), 256))
    numbered = df.withColumns({"_digest": digest, "_row": F.monotonically_increasing_id()}).withColumnRenamed(prompt, "_prompt")
    rows = materialize(numbered, "prompts")
    known = _known(spark, folder)
    due = rows.filter(F.col("_digest").isNotNull())
    # Of equal prompts one row is taken by its number, so that no prompt is shuffled for it.
    first = due.groupBy("_digest").agg(F.min("_row").alias("_row")).join(known, "_digest", "left_anti")
    first = materialize(first.select("_row"), "due")
    n, cores = first.count(), spark.sparkContext.defaultParallelism
    tasks = concurrency or cores
    if n:
        # Prompts are shuffled once, to shares of bounded size, and a job's lot is some shares or a part of one: a task
        # that deals out writes a bounded number of files, however many lots there are.
        lots, shares = -(-n // (tasks * block)), max(cores, -(-n // SHARE))
        split = -(-lots // shares)
        if split > 1:
            lots = shares * split
        else:
            shares = lots * -(-shares // lots)
        lot = F.pmod(F.spark_partition_id() + shares * F.pmod(F.xxhash64("_row"), F.lit(split)), F.lit(lots)).cast("int")
        waiting, schema = run_dir(spark, "waiting"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in settings)
        dealt = due.repartition(shares, "_row").join(first, "_row", "left_semi")
        dealt.select("_digest", "_prompt", *settings, lot.alias("_lot")).write.partitionBy("_lot").parquet(waiting)
        columns = "_digest string, _prompt string" + (f", {schema}" if schema else "")
        # Listed once; the filter on the lot prunes folders.
        dealt = spark.read.schema(f"{columns}, _lot int").parquet(waiting)
        answer = _answers(model_fn, _takes_settings(model_fn), settings, batch, retries, wait)
        at, blocks = 0, 1
        while at < lots:
            share = dealt.filter((F.col("_lot") >= at) & (F.col("_lot") < at + blocks)).drop("_lot")
            began = time.monotonic()
            asked = share.repartition(tasks).mapInArrow(answer, ANSWERS)
            asked.write.parquet(f"{folder}/answers-{uuid.uuid4().hex}")
            spent, at = time.monotonic() - began, at + blocks
            if spent < quick:
                blocks = min(2 * blocks, MOST_BLOCKS)
            elif spent > 2 * quick:
                blocks = max(blocks // 2, 1)
    given = _answered(spark, folder)
    response = F.when(F.col("_digest").isNull(), "no prompt").otherwise(F.col("_said.error"))
    return rows.select("_digest", *kept).join(given, "_digest", "left").select(*kept, F.col("_said.response").alias("response"), response.alias("error"))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(ANSWERS).parquet(f"{folder}/answers-*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts that have an answer; those whose call failed are to be asked again."""
    return _ledger(spark, folder).filter(F.col("error").isNull()).select("_digest").distinct()


def _answered(spark: SparkSession, folder: str) -> DataFrame:
    """One answer for each prompt of the ledger, a response before an error."""
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "response", "error")).alias("_said")
    return _ledger(spark, folder).groupBy("_digest").agg(best)


def review_functions(functions: DataFrame, remaining: DataFrame, model_fn: ModelFn,
                     concurrency: int | None = None, **asking) -> DataFrame:
    """Review each function once. Adds nothing but ``review_message`` and ``error`` to its key.

    A missing message in the response is an error. ``asking`` goes to ``complete_prompts``.
    """
    prompts = whole_texts(review_prompt(functions, remaining), FUNCTION_KEY, carried=SETTINGS).withColumnRenamed("text", "prompt")
    answered = completion_content(complete_prompts(prompts, model_fn, concurrency=concurrency, **asking), out="review_message")
    no_text = F.col("review_message").isNull() & F.col("error").isNull()
    return answered.select(
        *FUNCTION_KEY, "review_message", F.when(no_text, "no content in response").otherwise(F.col("error")).alias("error")
    )
