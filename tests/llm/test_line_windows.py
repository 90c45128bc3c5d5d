"""Line dedup by windows, against a plain pass over the lines."""

import random

from passagework.llm.line_windows import remove_repeated_windows

import brute


def test_against_plain_pass(spark):
    rng = random.Random(4)
    lines = ["a", "b", "c c", "", " ", "d"]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    df = spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, row string, N_LINES int")
    got = {r["doc_id"]: r for r in remove_repeated_windows(df).collect()}
    for (key, text), kept in zip(docs, brute.kept_lines(docs)):
        row = got[key]
        n = len(text.split("\n"))
        left = len(kept.split("\n")) if row["n_removed"] < n else 0
        assert (row["text"], row["n_lines"], n - left, row["row"]) == (kept, n, row["n_removed"], "x")


def test_edges(spark):
    long = "\n".join(f"line {i}" for i in range(5_000))
    docs = [(None, "x\ny\nz"), (1, None), (2, ""), (3, "x\ny"), (4, "x\ny\nz\nx\ny\nz"), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, long), (8, long), (9, "q\nr\ns"), (9, "q\nr\ns")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_removed"]) for r in remove_repeated_windows(df).collect() if r["text"] is not None)
    assert (0, "x\ny\nz", 3, 0) in got and (4, "", 6, 6) in got and (3, "x\ny", 2, 0) in got
    assert (5, "\n\n\n\n", 5, 0) in got and (6, "\n\n\n\n", 5, 0) in got and (2, "", 1, 0) in got
    assert (7, long, 5_000, 0) in got and (8, "", 5_000, 5_000) in got
    assert got.count((9, "q\nr\ns", 3, 0)) == 2  # rows that repeat an id and a text are one document
    assert [r["n_lines"] for r in remove_repeated_windows(df).where("doc_id = 1").collect()] == [0]
    assert remove_repeated_windows(df.where("false")).collect() == []


def test_windows_of_blank_lines_on_request(spark):
    df = spark.createDataFrame([(5, "\n\n\n\n"), (6, " \n\n\n\nx"), (7, "x\n\n")], "doc_id long, text string")
    got = [tuple(r) for r in remove_repeated_windows(df, blank=True).orderBy("doc_id").collect()]
    assert got == [(5, "", 5, 4), (6, " \nx", 5, 3), (7, "x\n\n", 3, 0)]
    assert {r["n_removed"] for r in remove_repeated_windows(df).collect()} == {0}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    plan = remove_repeated_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
