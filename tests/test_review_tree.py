import json
import sys

from pyspark import cloudpickle

from marginalia.plans.review_tree import review_tree

# Model functions use helpers of this module, which workers cannot import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


def reviewer(prompts):
    """Reviews anything and goes on with the last function of the list that was not reviewed."""
    out = []
    for prompt in prompts:
        left = prompt.split("path:name:\n")[1].split("\n\n")[0].strip().split("\n")
        path, _, name = left[-1].partition(":") if left[-1] else ("", "", "")
        size = len(prompt.split("Function:\n")[1].split("\n\nFile: ")[0].split("\n"))
        out.append(answer(f"{{it``2``{size} lines``{1 if name else 0}``{name}``{path}}}"))
    return out


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_detected_functions_of_two_projects(spark, tmp_path):
    write(tmp_path / "one", {"a.py": "def f():\n    return 1\n", "pkg/__init__.py": "class K:\n    def m(self):\n        pass\n"})
    write(tmp_path / "two", {"x.rs": "fn main() {\n}\n", "notes.md": "fn no() {}\n"})
    write(tmp_path / "two", {"old.f90": "! nothing here\n"})
    (tmp_path / "two/bad.py").write_bytes(b"\xff\xfe")
    roots = {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")}
    done = review_tree(spark, roots, str(tmp_path / "out"), reviewer)
    walked = [(r["project"], r["name"], r["review_message"].split("``")[2]) for r in done.reviews.orderBy("project", "step").collect()]
    # The first function's own key stays in the list, so it is reviewed a second time.
    assert walked == [("one", "f", "2 lines"), ("one", "K:m", "2 lines"), ("one", "f", "2 lines"), ("two", "main", "2 lines"), ("two", "main", "2 lines")]
    report = (tmp_path / "out/review_output" / str(tmp_path / "one/a.md")[1:]).read_text()
    assert report.count("## Function: `f`") == 2 and report.count("\n---\n\n") == 1 and "Error" not in report
    assert {r["report_path"].rsplit("/", 1)[1] for r in done.reports.collect()} == {"a.md", "__init__.md", "x.md"}
    texts = lambda name: [r["value"] for r in spark.read.text(str(tmp_path / "out" / name)).collect()]
    skipped = {(r["project"], r["path"].rsplit("/", 1)[1], r["reason"]) for r in done.skipped.collect()}
    assert skipped == {("two", "bad.py", "not readable as UTF-8")}
    assert len(texts("function_records")) == 3 and len(texts("review_log")) == 5
    assert f"Key: {tmp_path}/two/x.rs:main | Value: {tmp_path}/two/x.rs" in texts("function_index")


def test_extraction_and_seed_by_model(spark, tmp_path):
    write(tmp_path / "src", {"a.c": "int f() {\n}\nint g() {\n}\n", "b.c": "int h() {\n}\n"})
    a, b = str(tmp_path / "src/a.c"), str(tmp_path / "src/b.c")

    def extract(prompts):
        out = []
        for prompt in prompts:
            path = prompt.split("File Path: ")[1].split("\n")[0]
            if path == b:
                raise RuntimeError("down")
            out.append(answer(f'```json\n[\n{{"f", "{path}", 1, 2}},\n{{"g", "{path}", 3, 4}},\n]\n```'))
        return out

    seed = lambda prompts: [answer(p.split("Functions:\n")[1].strip().split("\n")[-1]) for p in prompts]
    done = review_tree(spark, {"p": str(tmp_path / "src")}, str(tmp_path / "out"), reviewer, extract, seed, max_steps=2)
    assert [r["name"] for r in done.records.orderBy("record_no").collect()] == ["f", "g"]
    assert [(r["step"], r["name"], r["path"]) for r in done.reviews.orderBy("step").collect()] == [(0, "g", a), (1, "g", a)]


def test_a_stored_run_is_taken_up_again(spark, tmp_path):
    write(tmp_path / "src", {"a.c": "int f() {\n}\nint g() {\n}\n", "b.c": "int h() {\n}\n"})
    calls = str(tmp_path / "calls")

    def extract(prompts):
        with open(calls, "a") as log:
            log.write("x" * len(prompts))
        path = [p.split("File Path: ")[1].split("\n")[0] for p in prompts]
        return [answer("\n".join(f'{{"{n}", "{p}", {i}, {i + 1}}}' for n, i in (("z", 1), ("a", 1)))) for p in path]

    roots, out = {"p": str(tmp_path / "src")}, str(tmp_path / "out")
    first = review_tree(spark, roots, out, reviewer, extract, max_steps=2, run_id="r1")
    sent = len(open(calls).read())
    again = review_tree(spark, roots, out, reviewer, extract, max_steps=2, run_id="r1")
    assert sent == 2 and len(open(calls).read()) == sent
    rows = lambda df, order: [(r["project"], r["path"], r["name"], r["start_line"]) for r in df.orderBy("project", order).collect()]
    assert rows(first.records, "record_no") == rows(again.records, "record_no") and len(rows(again.records, "record_no")) == 4
    assert rows(first.reviews, "step") == rows(again.reviews, "step")
    review_tree(spark, roots, out, reviewer, extract, max_steps=1, run_id="r2")
    assert len(open(calls).read()) == 2 * sent
