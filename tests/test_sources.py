import json

from tracemill.sources import traces as S
from tracemill.streaming.append import append_stream


def test_questions(spark, tmp_path):
    rows = [{"question": f"q{i}", "options": {"A": "x", "B": "y"}, "answer_idx": "B"} | ({"question_id": "own"} if i == 1 else {}) for i in range(3)]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    q = S.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert [(r.question_id, r.clinical_vignette, r.correct_answer) for r in q.orderBy("clinical_vignette").collect()] == [("medqa_0000", "q0", "B"), ("own", "q1", "B"), ("medqa_0002", "q2", "B")]
    S.write_questions(q, str(tmp_path / "out"))
    assert sorted(map(tuple, S.read_questions(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, q.collect()))


def test_hub_rows(spark):
    rows = [("a", [("A", "one"), ("B", "two")], "B", None, None, None, None, None), ("b", [], None, "C", "w", "x", "y", None), ("c", None, None, None, "w", "x", "y", "z")]
    got = {r.clinical_vignette: (r.options, r.correct_answer) for r in S.normalise_hub(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], S.HUB_SCHEMA + ", place long"), "place").collect()}
    assert got == {"a": ({"A": "one", "B": "two"}, "B"), "b": ({"A": "w", "B": "x", "C": "y", "D": ""}, "C"), "c": ({"A": "w", "B": "x", "C": "y", "D": "z"}, "A")}


def trace(q, m, **more):
    return {"question_id": q, "model_name": m, "raw_output": "r", "thinking_text": "some text", "final_answer": "The answer is B", "correct_option": "B", "is_correct": True} | more


def test_traces_and_resume(spark, tmp_path):
    for m in ("m1", "m2"):
        (tmp_path / "in" / m).mkdir(parents=True)
        (tmp_path / "in" / m / "traces.jsonl").write_text("\n\n".join(json.dumps(trace(f"q{i}", m)) for i in range(3)) + "\n")
    t = S.read_traces(spark, str(tmp_path / "in"))
    assert t.count() == 6 and {r.thinking_char_count for r in t.collect()} == {9} and {r.output_tokens for r in t.collect()} == {0}
    out = str(tmp_path / "out")
    assert S.append_traces(t.filter("question_id <> 'q2'"), out) == 4 and S.append_traces(t, out) == 2 and S.append_traces(t, out) == 0
    assert spark.read.parquet(out).count() == 6


def test_merge_and_grade(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert {(r.k, r.v) for r in S.merged(old, new, ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    t = spark.createDataFrame([("q", "A"), ("q", None), ("q", "B")], "question_id string, predicted_option string")
    got = S.graded(t, spark.createDataFrame([("q", "A")], "question_id string, correct_answer string")).collect()
    assert {(r.predicted_option, r.is_correct) for r in got} == {("A", True), (None, False), ("B", False)}


def test_stream(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(trace(f"q{i}", "m")) for i in range(3)))
    append_stream(spark, str(source), out, mark).awaitTermination(120)
    (source / "2.json").write_text("\n".join(json.dumps(trace(f"q{i}", "m")) for i in range(1, 5)))
    append_stream(spark, str(source), out, mark).awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert sorted(r.question_id for r in got) == [f"q{i}" for i in range(5)] and {r.predicted_option for r in got} == {"B"}


def rows_in(spark, path):
    return sorted((r.model_name, r.question_id) for r in spark.read.parquet(path).collect())


def test_stream_with_rows_that_were_there(spark, tmp_path):
    """Rows of the target from before the stream, repeated keys in a file, rows without a prediction, and a null key."""
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (tmp_path / "old.jsonl").write_text("\n".join(json.dumps(trace(f"q{i}", "m")) for i in range(2)))
    old = S.read_traces(spark, str(tmp_path / "old.jsonl"))
    assert S.append_traces(old, out) == 2
    more = [trace("q1", "m"), trace("q2", "m"), trace("q2", "m") | {"raw_output": "other"}, trace("q1", "n"), {"question_id": "q5", "model_name": "n", "final_answer": "none", "thinking_text": "-"}]
    (source / "1.json").write_text("\n".join(map(json.dumps, more)))
    append_stream(spark, str(source), out, mark).awaitTermination(120)
    want = [("m", "q0"), ("m", "q1"), ("m", "q2"), ("n", "q1"), ("n", "q5")]
    assert rows_in(spark, out) == want
    assert {r.is_correct for r in spark.read.parquet(out).filter("question_id = 'q5'").collect()} == {False}
    assert spark.read.parquet(out).filter("is_correct is null").isEmpty()
    append_stream(spark, str(source), out, mark).awaitTermination(120)  # nothing new
    (source / "2.json").write_text("\n".join(map(json.dumps, more)))
    append_stream(spark, str(source), out, mark).awaitTermination(120)  # all there
    assert rows_in(spark, out) == want


def test_stream_runs_a_batch_again(spark, tmp_path):
    """A batch whose commit is lost is run again under its number: it replaces what it wrote, and the target isn't read."""
    import os

    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(trace(f"q{i}", "m")) for i in range(4)))
    append_stream(spark, str(source), out, mark).awaitTermination(120)
    before = rows_in(spark, out)
    last = max(int(f) for f in os.listdir(f"{mark}/commits") if f.isdigit())
    for f in (f"{mark}/commits/{last}", f"{mark}/commits/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)
    query = append_stream(spark, str(source), out, mark)
    query.awaitTermination(120)
    assert rows_in(spark, out) == before and len(before) == 4
    plans = " ".join(str(p["sources"]) for p in query.recentProgress)
    assert "out" not in plans.replace(str(tmp_path), "").split("/")


def test_merge_in_place(spark, tmp_path):
    from tracemill.sources.results import merge_results, read_results, versions

    path, keys = str(tmp_path / "set"), ["m", "e"]
    frame = lambda rows: spark.createDataFrame(rows, "m string, e string, n long")
    got = lambda: sorted(map(tuple, read_results(spark, path).collect()), key=str)
    assert read_results(spark, path) is None
    merge_results(frame([("a", "x", 1), ("b", None, 2)]), path, keys)
    held = read_results(spark, path)  # a reader of the first version
    for _ in range(2):  # twice the same
        merge_results(frame([("b", None, 3), ("c", "y", 4), ("c", "y", 5)]), path, keys)
        assert got() == [("a", "x", 1), ("b", None, 3), ("c", "y", 5)]
        if _ == 0:
            assert sorted(map(tuple, held.collect()), key=str) == [("a", "x", 1), ("b", None, 2)]
    assert versions(spark, path) == [2, 3]
    (tmp_path / "set" / "v00000004").mkdir()  # a run that broke off
    (tmp_path / "set" / "v00000004" / "part-0.parquet").write_text("half")
    assert got() == [("a", "x", 1), ("b", None, 3), ("c", "y", 5)]
    merge_results(frame([("a", "x", 9)]), path, keys)
    assert got() == [("a", "x", 9), ("b", None, 3), ("c", "y", 5)]
