"""Readers, blends, seeds and sinks on small files."""

import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kiln.operators import records
from kiln.sources import readers


def test_workbooks(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr(
            "xl/sharedStrings.xml",
            f"<sst {space}><si><t>question</t></si><si><t>answer</t></si><si><r><t> what</t></r><r><t> is </t></r></si></sst>",
        )
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7</v></c></row><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{rows}</sheetData></worksheet>")
    got = readers.read(spark, str(tmp_path / "a.xlsx"))
    assert [tuple(r) for r in got.collect()] == [("what is", "7"), ("", "x")]
    assert [tuple(r) for r in readers.entries(spark, str(tmp_path / "a.xlsx")).collect()] == [("what is", "7")]


def test_formats_and_blends(spark, tmp_path):
    tbl = pa.table({"id": [1, 2, 3], "text": ["a", "b", None]})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, tbl.schema) as w:
        w.write_table(tbl)
    assert [
        tuple(r) for r in readers.read(spark, str(tmp_path / "a.arrow")).collect()
    ] == [(1, "a"), (2, "b"), (3, None)]
    (tmp_path / "b.jsonl").write_text('{"id": 4, "more": "x"}\n{"id": 5}\n')
    (tmp_path / "c.csv").write_text('id,text\n6,"a ""b"", c\nd"\n')
    spark.range(3).write.parquet(str(tmp_path / "saved"))
    both = readers.blended(spark, [str(tmp_path / "a.arrow"), str(tmp_path / "b.jsonl")])
    assert sorted(r.id for r in both.collect()) == [1, 2, 3, 4, 5] and set(both.columns) == {"id", "text", "more"}
    assert readers.read(
        spark, str(tmp_path / "c.csv")
    ).first().text == 'a "b", c\nd' and readers.read(spark, str(tmp_path / "saved")).count() == 3
    drawn = readers.blended(spark, [str(tmp_path / "a.arrow"), str(tmp_path / "b.jsonl")], [0.5, 0.5], "id", 40)
    assert drawn.count() == 40 and {r.id for r in drawn.collect()} == {1, 2, 3, 4, 5}
    with pytest.raises(ValueError):
        readers.read(spark, str(tmp_path / "x.bin"))


def test_seeds(spark, tmp_path):
    (tmp_path / "a_train.jsonl").write_text(
        "".join(json.dumps({"problem": f"a long problem {i}"}) + "\n" for i in range(9)) + '{"problem": "short"}\n'
    )
    entry = {
        "name": "a",
        "path": str(tmp_path / "a_{split}.jsonl"),
        "key": "text",
        "split": "test",
        "difficulty": "easy",
        "max_seeds": 4,
        "evol_rounds": 2,
    }
    skipped = []
    got = readers.seeds(
        spark, [entry, entry | {"name": "b", "path": str(tmp_path / "b_{split}.jsonl")}], skipped=skipped
    ).collect()
    assert [r.text for r in got] == [
        f"a long problem {i}" for i in range(4)
    ] and skipped == ["b"] and got[0].evol_rounds == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "7", "7", True), (2, "8", None, False)], "idx int, ground_truth string, predicted string, correct boolean"
    )
    readers.write_report(df, {"model": "m", "dataset": "d"}, str(tmp_path / "r"))
    found = spark.read.json(str(tmp_path / "r/summary")).first()
    assert (found.accuracy, found.total, found.model) == (0.5, 2, "m")
    assert sorted((r.idx, r.correct) for r in spark.read.json(str(tmp_path / "r/json")).collect()) == [(1, True), (2, False)]
    parts = sorted((tmp_path / "r/txt").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[2] == "Accuracy: 1/2 = 50.0%" and lines[4] == "[O] # 1  gt=7  pred=7"
    readers.write_csv(df, str(tmp_path / "c"), bom=True)
    raw = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfidx,")
    readers.write_jsonl(df, str(tmp_path / "j"))
    readers.rewritten(spark, str(tmp_path / "j"), lambda x: x.withColumn("idx", F.col("idx") + 1))
    assert sorted(r.idx for r in spark.read.json(str(tmp_path / "j")).collect()) == [2, 3]
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for expected in (3, 3, 4):
        assert readers.cached_phase(make, str(tmp_path / "p"), expected, spark).count() == 3
    assert len(made) == 2  # kept once, then too short


def test_lectures_by_number(spark, tmp_path):
    for name in ("第10讲 a.pdf", "第2讲 b.pdf", "other.pdf"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.number for r in readers.lectures(spark, str(tmp_path)).collect()] == [2, 10, 999]


def test_registry_and_zip(spark):
    names = spark.createDataFrame([("a",), ("z",), ("z",)], "name string")
    known, unknown = records.registered(names, spark.createDataFrame([("a", 1)], "name string, size int"), "name")
    assert [tuple(r) for r in known.collect()] == [("a", 1)] and [r.name for r in unknown.collect()] == ["z"]


def test_one_arrow_file_by_many_tasks(spark, tmp_path):
    import pyarrow as pa

    from kiln.sources import formats

    formats.register(spark)
    table = pa.table({"n": list(range(1000)), "text": [None if i % 7 == 0 else f"t{i}" for i in range(1000)], "f": [i / 2 for i in range(1000)]})
    path = str(tmp_path / "a.arrow")
    with pa.ipc.new_file(path, table.schema) as out:
        out.write_table(table, max_chunksize=50)
    found = spark.read.format("kiln_arrow").option("batches", 3).load(path)
    assert found.rdd.getNumPartitions() == 7 and found.schema == readers.read(spark, path).schema
    assert sorted(found.collect()) == sorted(readers.read(spark, path).collect())
    with pa.ipc.new_stream(str(tmp_path / "b.arrow"), table.schema) as out:
        out.write_table(table, max_chunksize=50)
    both = spark.read.format("kiln_arrow").load(str(tmp_path))
    assert both.count() == 2000 and both.where("text IS NULL").count() == 2 * 143
    assert spark.read.format("kiln_arrow").schema("text string").load(path).distinct().count() == 858


def test_one_sheet_by_many_tasks(spark, tmp_path):
    import zipfile

    from kiln.sources import formats

    formats.register(spark)
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    row = lambda i: f'<row r="{i + 2}"><c r="A{i + 2}" t="s"><v>{i % 3 + 2}</v></c><c r="C{i + 2}"><v>{i}</v></c></row>'
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>mid</t></is></c><c r="C1" t="s"><v>1</v></c></row>'
    path = str(tmp_path / "a.xlsx")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{x}</t></si>" for x in ("name", "last", " a ", "b", "c")) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><dimension ref="A1:C501"/><sheetData>{head}' + "".join(map(row, range(500))) + "</sheetData></worksheet>")
    found = spark.read.format("kiln_sheet").option("rows", 100).load(path)
    assert found.columns == ["name", "mid", "last"] and found.rdd.getNumPartitions() == 5
    assert sorted(found.collect()) == sorted(readers.read(spark, path).collect()) and found.count() == 500
    assert found.where("last = '499'").first().name == "b"


def test_blends_stop_by_mode(spark, tmp_path):
    for name, n in (("a", 5), ("b", 50)):
        spark.range(n).select(F.lit(name).alias("s"), "id").write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / name) for name in "ab"]
    count = lambda **how: {r.s: r["count"] for r in readers.blended(spark, paths, [0.5, 0.5], "id", **how).groupBy("s").count().collect()}
    assert count(stopping="first_exhausted")["a"] == 5
    assert count(stopping="all_exhausted")["b"] == 50
    assert readers.blended(spark, paths, key="id", most=4).count() == 8


def test_test_sets_and_entries(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"question": "q", "answer": 5}\n{"question": "", "answer": 6}\n')
    assert [r.answer for r in readers.test_set(spark, str(tmp_path / "t.jsonl")).collect()] == ["5", "6"]
    assert [r.question for r in readers.entries(spark, str(tmp_path / "t.jsonl")).collect()] == ["q"]


def test_whole_texts_by_many_tasks(spark, tmp_path):
    from kiln.sources import formats

    formats.register(spark)
    for i in range(9):
        (tmp_path / f"{i}.md").write_text(f"# é {i}\n\n" + "x" * 40 * i)
    (tmp_path / "other.txt").write_text("no")
    found = spark.read.format("kiln_text").option("bytes", 500).load(str(tmp_path))
    assert found.rdd.getNumPartitions() > 2
    want = spark.read.option("pathGlobFilter", "*.md").text(str(tmp_path), wholetext=True)
    assert sorted(r.value for r in found.collect()) == sorted(r.value for r in want.collect())
    assert {r.path.rsplit("/", 1)[-1] for r in found.collect()} == {f"{i}.md" for i in range(9)}
    (tmp_path / "none").mkdir()
    assert spark.read.format("kiln_text").load(str(tmp_path / "none")).count() == 0
