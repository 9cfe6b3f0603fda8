import random

import brute
import pytest

from marginalia.operators.reviews import parse_reviews
from marginalia.plans.routing import route_reviews


@pytest.mark.parametrize("seed", range(3))
def test_serving_all_at_once_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    index, messages = {}, []
    for p in range(5):
        names = [rng.choice(["", "K:"]) + f"n{rng.randint(0, 3)}" for _ in range(12)]
        keys = {f"f{rng.randint(0, 3)}:{n}": None for n in names}
        index[f"p{p}"] = {k: k.split(":")[0] for k in keys}
        for seq in range(25):
            want = rng.choice(names)
            message = f"{{a``1``b``{rng.choice('1110')}``{rng.choice([want, want.split(':')[-1]])}``f{rng.randint(0, 5)}}}"
            messages.append((f"p{p}", seq, "{bad" if rng.random() < 0.05 else message))
    taken = [(p, k) for p, keys in index.items() for k in list(keys)[:2]]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = route_reviews(
        parse_reviews(table(messages, "project string, seq bigint, review_message string")),
        table([(p, k, v) for p, keys in index.items() for k, v in keys.items()], "project string, key string, path string"),
        table(taken, "project string, key string"),
    )
    rows = sorted((r["project"], r["seq"], r["status"], r["key"]) for r in got.collect())
    assert rows == brute.serve(messages, index, taken)


def test_reviews_of_one_name_take_few_rounds(spark, monkeypatch):
    from marginalia.plans import routing

    n, written = 200, []
    keep = routing.materialize
    monkeypatch.setattr(routing, "materialize", lambda df, label: written.append(label) or keep(df, label))
    index = {"p": {f"f{i:03}:n": f"f{i:03}" for i in range(n)}}
    messages = [("p", seq, "{a``1``b``1``n``nowhere}") for seq in range(n + 5)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = route_reviews(
        parse_reviews(table(messages, "project string, seq bigint, review_message string")),
        table([("p", k, v) for k, v in index["p"].items()], "project string, key string, path string"),
        table([], "project string, key string"),
    )
    assert sorted((r["project"], r["seq"], r["status"], r["key"]) for r in got.collect()) == brute.serve(messages, index, [])
    assert written.count("asked") == 1
