import os
import sys

import pytest
from pyspark import cloudpickle

from marginalia.operators.model import complete_prompts

# Model functions use helpers of this module, which workers cannot import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_each_prompt_is_sent_once_with_its_settings(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def model(prompts, settings):
        with open(calls, "a") as log:
            log.writelines(f"{p}\n" for p in prompts)
        return [ValueError("refused") if p == "p3" else f"{p} {s['system']} {s['max_tokens']}" for p, s in zip(prompts, settings)]

    df = spark.createDataFrame([(i, f"p{i}", "s", 7) for i in range(9)], "i int, prompt string, system string, max_tokens long")
    got = sorted(map(tuple, complete_prompts(df.coalesce(1), model, batch=4).collect()))
    assert got == [(i, None, "refused") if i == 3 else (i, f"p{i} s 7", None) for i in range(9)]
    assert sorted(open(calls).read().split()) == [f"p{i}" for i in range(9)]


def test_errors_stay_with_their_prompt(spark):
    def model(prompts):
        if any(p == "bad" for p in prompts):
            raise ValueError("status 429")
        return [p.upper() for p in prompts]

    rows = [(i, p) for i, p in enumerate(["a", "bad", "c", None, "d"])]
    df = spark.createDataFrame(rows, "i int, prompt string")
    got = sorted(map(tuple, complete_prompts(df, model, concurrency=2).collect()))
    assert got == [
        (0, "A", None), (1, None, "status 429"), (2, "C", None), (3, None, "no prompt"), (4, "D", None),
    ]


def test_wrong_number_of_answers_is_an_error(spark):
    df = spark.createDataFrame([(0, "a")], "i int, prompt string")
    assert complete_prompts(df, lambda prompts: []).first()["error"] == "0 responses for 1 prompts"


def logged(path):
    return sorted(open(path).read().split()) if os.path.exists(path) else []


def test_a_run_that_ended_half_way_repeats_only_its_open_block(spark, tmp_path, shared):
    calls, broken, ledger = str(tmp_path / "calls"), str(tmp_path / "broken"), shared("ledger")
    open(broken, "w").close()

    def model(prompts):
        with open(calls, "a") as log:
            log.writelines(f"{p}\n" for p in prompts)
        # After 20 calls the worker dies, once.
        if os.path.exists(broken) and len(open(calls).read().split()) > 20:
            os.unlink(broken)
            os._exit(1)
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "i int, prompt string")
    ask = lambda: sorted(map(tuple, complete_prompts(df, model, concurrency=1, ledger=ledger, block=8).collect()))
    with pytest.raises(Exception):
        ask()
    assert len(logged(calls)) == 21
    assert ask() == [(i, f"P{i}", None) for i in range(40)]
    sent = logged(calls)
    # A block has 8 prompts, about: jobs are dealt by hash.
    assert sorted(set(sent)) == sorted(f"p{i}" for i in range(40)) and len(sent) - 40 <= 20 and len(sent) < 60
    assert ask() == [(i, f"P{i}", None) for i in range(40)] and logged(calls) == sent


def test_equal_prompts_are_asked_once_and_failed_ones_again(spark, tmp_path, shared):
    calls, ledger = str(tmp_path / "calls"), shared("ledger")

    def model(prompts, settings):
        out = []
        for p, s in zip(prompts, settings):
            with open(calls, "a") as log:
                log.write(f"{p}/{s['system']}\n")
            tries = logged(calls).count(f"{p}/{s['system']}")
            out.append(RuntimeError("busy") if p == "late" and tries < 3 or p == "never" else f"{p} {s['system']}")
        return out

    rows = [(1, "a", "s"), (2, "a", "s"), (3, "a", "t"), (4, "late", "s"), (5, "never", "s"), (6, None, "s"), (7, "", None)]
    df = spark.createDataFrame(rows, "i int, prompt string, system string")
    ask = lambda **how: sorted(map(tuple, complete_prompts(df, model, ledger=ledger, wait=0.01, **how).collect()))
    good = [(1, "a s", None), (2, "a s", None), (3, "a t", None), (4, "late s", None)]
    rest = [(5, None, "busy"), (6, None, "no prompt"), (7, " None", None)]
    assert ask(retries=1) == [*good[:3], (4, None, "busy"), *rest]
    # The two that failed were sent twice, and are asked again later; the others are not.
    assert logged(calls) == sorted(["a/s", "a/t", "late/s", "late/s", "never/s", "never/s", "/None"])
    assert ask() == good + rest
    assert logged(calls).count("a/s") == 1 and logged(calls).count("late/s") == 3 and logged(calls).count("never/s") == 3


def test_quick_calls_go_out_in_few_jobs_and_a_block_can_be_kept(spark, shared):
    def answers(**how):
        ledger = shared("ledger")
        df = spark.createDataFrame([(i, f"p{i}") for i in range(400)], "i int, prompt string")
        got = sorted(map(tuple, complete_prompts(df, lambda ps: [p.upper() for p in ps], concurrency=2, ledger=ledger, block=4, **how).collect()))
        assert got == [(i, f"P{i}", None) for i in range(400)]
        # A job writes one folder of answers.
        return [spark.read.parquet(f"{ledger}/{name}").count() for name in os.listdir(ledger.removeprefix("file://"))]

    jobs = answers(quick=60)
    assert len(jobs) < 10 and sum(jobs) == 400
    # About four prompts for each of two tasks, dealt by hash.
    jobs = answers(quick=0)
    assert len(jobs) >= 50 and max(jobs) <= 24 and sum(jobs) == 400
