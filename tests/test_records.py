from marginalia.operators import records


def cleaned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    return [r["cleaned"] for r in records.clean_completion(df).orderBy("i").collect()]


def test_fence_and_brackets_go_only_in_pairs(spark):
    texts = ["```json\n[\n{a}\n]\n```", "```json\n{a}", "[{a}", "{a}]", "```json\n```", "[]", "[", "\u00a0\t x \u3000", "```\nx```"]
    assert cleaned(spark, texts) == ["{a}", "```json\n{a}", "[{a}", "{a}]", "", "", "[", "x", "```\nx```"]


def test_content_of_responses(spark):
    bodies = ['{"choices":[{"message":{"content":"a\\nb"}}]}', '{"choices":[]}', '{"error":"x"}', "no json", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, response string")
    assert [r["content"] for r in records.completion_content(df).orderBy("i").collect()] == ["a\nb", None, None, None, None]


def test_records_of_the_documented_format(spark):
    text = '  {"run", "/lib/a.go",1,4},,\n\n{"K:sum",\t"lib/a.go", 5 , 7}\n{ "f", "p", 1, 2 }\n{f, p, 1, 2}\n{"big", "p", 1, 99999999999999999999}'
    df = spark.createDataFrame([("q", text)], "project string, cleaned string")
    exploded = records.explode_records(df)
    assert [r["record_no"] for r in exploded.orderBy("record_no").collect()] == [0, 2, 3, 4, 5]
    got = records.parse_records(exploded).orderBy("record_no").select("name", "path", "start_line", "end_line").collect()
    assert [tuple(r) for r in got] == [("run", "/lib/a.go", 1, 4), ("f", "p", 1, 2), ("big", "p", 1, None)]


def test_seed_is_found_inside_other_text(spark):
    rows = [("p", 2, 'first {"b", "x", 1, 2}'), ("p", 1, 'I pick\n{"a",\n"y", 3, 4} and {"c", "z", 5, 6}'), ("q", 1, "nothing")]
    df = spark.createDataFrame(rows, "project string, record_no bigint, content string")
    assert [tuple(r) for r in records.seed_function(df).collect()] == [("p", "a", "y", 3, 4)]


def test_index_keeps_one_row_per_key(spark):
    rows = [("p", "a:b", "c", 1), ("p", "a", "b:c", 2), ("p", "a", "f", 3), ("p", "a", "f", 4), ("q", "a", "f", 1)]
    df = spark.createDataFrame(rows, "project string, path string, name string, record_no bigint")
    assert sorted(map(tuple, records.function_index(df).collect())) == [("p", "a:b:c", "a"), ("p", "a:f", "a"), ("q", "a:f", "a")]
    plan = records.function_index(df)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
