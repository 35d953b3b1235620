"""Keyed state over restarts, against the batch forms."""

import json

from pyspark.sql import functions as F

from kiln.streaming import resume, state

SCHEMA = "run string, n long, good boolean"


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("run", "n", "good"), r))) for r in rows))


def make(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    files = [
        [("a", 1, True), ("a", 2, False), ("b", 1, True)],
        [("a", 4, True), ("a", 3, True), ("b", 7, True)],
        [("a", 5, False)],
        [("a", 6, True), ("a", 8, True), ("c", 1, True)],
    ]
    return folder, files


def test_replay_buffer_over_restarts(spark, tmp_path):
    folder, files = make(tmp_path)
    for i, rows in enumerate(files):
        put(folder, f"{i}.json", rows)
        if i in (1, 3):  # two files, stop, two more
            stream = state.files(spark, str(folder), SCHEMA)
            state.drained(state.replay_buffer(stream, "run", "n", 3), str(tmp_path / "out"), str(tmp_path / "check"))
    found = spark.read.parquet(str(tmp_path / "out"))
    last = found.groupBy("run").agg(F.max("turn").alias("turn"))
    got = sorted((r.run, r.n, r.good) for r in found.join(last, ["run", "turn"]).collect())
    every = [r for rows in files for r in rows]
    want = sorted(x for run in "abc" for x in sorted((r for r in every if r[0] == run), key=lambda r: r[1])[-3:])
    assert got == want
    assert {r.run: r.turn for r in last.collect()} == {"a": 3, "b": 1, "c": 0}


def test_refill_over_restarts(spark, tmp_path):
    folder, files = make(tmp_path)
    for i, rows in enumerate(files):
        put(folder, f"{i}.json", rows)
        if i in (0, 3):
            stream = state.files(spark, str(folder), SCHEMA)
            state.drained(state.refilled(stream, "run", "n", "good", 2), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("run", "batch", "n").collect():
        got.setdefault((r.run, r.batch), []).append(r.n)
    assert got == {("a", 0): [1, 3], ("a", 1): [4, 6], ("b", 0): [1, 7]}


def test_running_averages(spark, tmp_path):
    folder, files = make(tmp_path)
    for i, rows in enumerate(files):
        put(folder, f"{i}.json", rows)
    resume.running_averages(spark, str(folder), SCHEMA, "n", "kiln_means")
    every = [r[1] for rows in files for r in rows]
    assert [tuple(r) for r in spark.table("kiln_means").collect()] == [(len(every), sum(every) / len(every))]
