import json
import random
import re

import brute
import pytest

from marginalia.operators.walk import model_walk, review_walk
from marginalia.plans.ranks import with_place

SCHEMA = "project string, path string, record_no bigint, name string, review_message string"


def random_records(seed, projects, size, names):
    """Records whose messages ask for each other, with many equal names so that moves meet."""
    rng = random.Random(seed)
    out = []
    for p in range(projects):
        own = [(f"f{rng.randint(0, 2)}", rng.choice(["", "K:", "J:"]) + f"n{rng.randint(0, names)}") for _ in range(size)]
        for no, (path, name) in enumerate(own):
            to_path, to_name = rng.choice(own)
            if rng.random() < 0.4:
                to_path = "nowhere"
            if rng.random() < 0.4:
                to_name = to_name.split(":")[-1]
            flag = "0" if rng.random() < 0.02 else "1"
            message = "{short``2}" if rng.random() < 0.02 else f"{{{name}``1``x``{flag}``{to_name}``{to_path}}}"
            out.append({"project": f"p{p}", "path": path, "record_no": no, "name": name, "review_message": message})
    return out


@pytest.fixture(params=["broadcast", "sorted"])
def joins(spark, request):
    """Joins of either kind; the order of rows after a join is not to matter."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    if request.param == "sorted":
        for name in names:
            spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("seed,size,names,drop_seed,max_steps", [
    (1, 12, 4, False, None), (2, 60, 60, True, None), (3, 40, 8, False, 7), (5, 60, 20, False, None),
])
def test_walk_matches_one_project_at_a_time(spark, joins, seed, size, names, drop_seed, max_steps):
    records = random_records(seed, 8, size, names)
    df = spark.createDataFrame([tuple(r[c] for c in ("project", "path", "record_no", "name", "review_message")) for r in records], SCHEMA)
    got = sorted(map(tuple, review_walk(df, max_steps, drop_seed).collect()))
    assert got == brute.walk(records, drop_seed, max_steps)


def test_long_chain_takes_few_rounds(spark):
    records = [
        {"project": "p", "path": "f", "record_no": i, "name": f"n{i}", "review_message": f"{{n{i}``1``x``1``n{i + 1}``f}}"}
        for i in range(300)
    ]
    df = spark.createDataFrame([tuple(r[c] for c in ("project", "path", "record_no", "name", "review_message")) for r in records], SCHEMA)
    assert sorted(map(tuple, review_walk(df).collect())) == brute.walk(records)


def frame(spark, records):
    return spark.createDataFrame([tuple(r[c] for c in ("project", "path", "record_no", "name", "review_message")) for r in records], SCHEMA)


def rounds(df):
    return max(int(re.search(r"round=(\d+)", f).group(1)) for f in df.inputFiles())


def test_a_name_that_all_share_takes_few_rounds(spark, joins):
    records = [
        {"project": "p", "path": f"f{i:04}", "record_no": i, "name": "K:main" if i % 3 else "main", "review_message": "{main``1``x``1``main``gone}"}
        for i in range(1000)
    ]
    walked = review_walk(frame(spark, records))
    assert sorted(map(tuple, walked.collect())) == brute.walk(records)
    assert walked.count() == 1001 and rounds(walked) <= 6


def test_names_that_ask_for_each_other_in_turn_take_few_rounds(spark):
    asks = {"a": "b", "b": "c", "c": "a"}
    records = [
        {"project": p, "path": f"f{i:04}", "record_no": i, "name": "abc"[(i * 7 + i // 5) % 3],
         "review_message": "{x``1``x``1``%s``gone}" % asks["abc"[(i * 7 + i // 5) % 3]]}
        for p, n in (("p", 300), ("q", 90)) for i in range(n)
    ]
    # One key of a name is also asked for by its full name, in the midst of the turns.
    records[150]["review_message"] = "{x``1``x``1``%s``%s}" % (records[20]["name"], records[20]["path"])
    walked = review_walk(frame(spark, records))
    assert sorted(map(tuple, walked.collect())) == brute.walk(records)
    assert rounds(walked) <= 12


def test_places_in_groups_over_many_ranges(spark):
    rows = [("big", i * 37 % 1000) for i in range(1000)] + [("small", i) for i in range(5)] + [("one", 7)]
    got = with_place(spark.createDataFrame(rows, "g string, v long"), ["g"], ["v"], "place").collect()
    plain = {(g, v): sorted(x for h, x in rows if h == g).index(v) + 1 for g, v in rows}
    assert {(r.g, r.v): r.place for r in got} == plain and len(got) == len(rows)


def test_model_walk(spark):
    body = "\n".join(f"line {i}" for i in range(1, 40))
    files = spark.createDataFrame([("p", "a.py", body), ("q", "b.py", body), ("r", "c.py", body)], "project string, path string, content string")
    rows = [("p", "a.py", f"f{i}", 3 * i + 1, 3 * i + 3, i) for i in range(5)]
    rows += [("q", "b.py", "K:g", 1, 2, 0), ("q", "b.py", "h", 3, 99, 1), ("r", "c.py", "boom", 1, 1, 0)]
    records = spark.createDataFrame(rows, "project string, path string, name string, start_line bigint, end_line bigint, record_no bigint")

    def model(prompts):
        out = []
        for prompt in prompts:
            path = prompt.split("\n\nFile: ")[1].split("\n")[0]
            left = [k for k in prompt.split("path:name:\n")[1].split("\n\n")[0].split("\n") if k.startswith(path)]
            if path == "c.py":
                raise RuntimeError("busy")
            code = prompt.split("Function:\n")[1].split("\n\n")[0].replace("\n", "/")
            nxt = left[-1].split(":")[-1] if left else "gone"
            out.append(json.dumps({"choices": [{"message": {"content": f"{{x``1``{code}``1``{nxt}``{path}}}"}}]}))
        return out

    got = [tuple(r) for r in model_walk(records, files, model).orderBy("project", "step").select(
        "project", "step", "name", "status", "error").collect()]
    # The seed's own key stays in the list until it is chosen; the list is sorted, so f4 comes first.
    assert got == [
        ("p", 0, "f0", "exact", None), ("p", 1, "f4", "exact", None), ("p", 2, "f3", "exact", None),
        ("p", 3, "f2", "exact", None), ("p", 4, "f1", "exact", None), ("p", 5, "f0", "not_found", None),
        ("q", 0, "K:g", "exact", None),  # asks for h, whose range is not in the file
        ("r", 0, "boom", "error", "busy"),
    ]
    first = model_walk(records, files, model, max_steps=1, drop_seed=True).filter("project = 'p'").first()
    assert first["review_message"].split("``")[2] == "line 1/line 2/line 3"
