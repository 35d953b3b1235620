"""Readers chosen by extension, blends, seeds by registry, and sinks."""

from __future__ import annotations

import io
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.functions.text import file_number
from kiln.operators.curation import interleave, interleave_until
from kiln.operators.lineage import running
from kiln.sources.workbook import sheet_rows

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """json, jsonl, csv, xlsx, parquet, orc, arrow, text formats by extension; a folder without one is a saved Parquet
    table; anything else is an error. Cells of CSV and XLSX are strings."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind == "csv":
        return reader.options(**CSV).csv(path)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    if kind == "xlsx":
        return sheet(spark, path)
    if kind == "arrow":
        return arrow_files(spark, path)
    if "." not in path.rstrip("/").rsplit("/", 1)[-1]:
        return reader.parquet(path)
    if kind in ("txt", "md"):
        return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    raise ValueError(f"unknown suffix: {path}")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Rows that have both question and answer."""
    return read(spark, path).filter(" and ".join(f"coalesce(cast({c} as string), '') <> ''" for c in ("question", "answer")))


def test_set(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path).withColumn("answer", F.col("answer").cast("string"))


def cells(raw: bytes) -> list[list[str]]:
    """Rows of the first sheet of a workbook: stripped texts, empty ones where cells are absent."""
    return list(sheet_rows(io.BytesIO(raw)))


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of workbooks' first sheets under the names in their first row; a workbook is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    head = cells(files.limit(1).first()["content"])[0]

    def run(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                rows = [r + [""] * (len(head) - len(r)) for r in cells(raw)[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.string()) for i in range(len(head))], names=head
                )

    return files.mapInArrow(run, ", ".join(f"`{h}` string" for h in head))


def arrow_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Arrow files or streams; a file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def tables(raw: bytes) -> pa.Table:
        opened = pa.ipc.open_file if raw[:6] == b"ARROW1" else pa.ipc.open_stream
        return opened(pa.BufferReader(raw)).read_all()

    schema = spark.createDataFrame(tables(files.limit(1).first()["content"]).slice(0, 0)).schema

    def run(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                yield from tables(raw).to_batches()

    return files.mapInArrow(run, schema)


def lectures(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(path, number, content) of a folder's files by the lecture number in their names, those without one last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder)
    return files.select("path", file_number(F.url_decode("path")).alias("number"), "content").orderBy("number", "path")


def blended(
    spark: SparkSession,
    paths: list[str],
    probabilities: list[float] | None = None,
    key: str | None = None,
    total: int | None = None,
    seed: int = 0,
    stopping: str = "first_exhausted",
    most: int | None = None,
) -> DataFrame:
    """Sets one after another, each with its first `most` rows by key; with probabilities drawn from in turn until `total`
    rows, in order of key, or without a total until one set is used up or all are (stopping)."""
    sets = [read(spark, p) for p in paths]
    if most is not None:
        sets = [running(df, [key]).where(F.col("i") < most).drop("i") for df in sets]
    if probabilities is None:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
    parts = list(zip(sets, probabilities))
    return interleave_until(parts, key, stopping, seed) if total is None else interleave(parts, key, total, seed)


def any_split(spark: SparkSession, path: str, splits: list[str]) -> tuple[DataFrame, str] | None:
    """The first of the splits that is there, and its name."""
    for split in dict.fromkeys(splits):
        try:
            return read(spark, path.format(split=split)), split
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def seeds(
    spark: SparkSession,
    registry: list[dict],
    fallback=("test", "train", "validation"),
    skipped: list[str] | None = None,
) -> DataFrame:
    """(text, source, difficulty, evol_rounds) of registered sets: name, path with {split}, key, split, difficulty, max_seeds, evol_rounds.

    A split that is absent falls back to the others in turn. Sets without any, or without a text column, are skipped and
    their names put into `skipped`. max_seeds takes the first rows in the order of the set's files and of the rows in them.
    """
    found = []
    for entry in registry:
        at = any_split(spark, entry["path"], [entry["split"], *fallback])
        key = at and next((k for k in (entry["key"], "question", "problem", "query") if k in at[0].columns), None)
        if not key:
            if skipped is not None:
                skipped.append(entry["name"])
            continue
        own = at[0].withColumn("_row", F.monotonically_increasing_id())
        own = own.select(F.col(key).cast("string").alias("text"), "_row").filter(F.length(F.trim("text")) >= 10)
        own = own if entry["max_seeds"] < 0 else own.orderBy("_row").limit(entry["max_seeds"])
        found.append(
            own.select(
                "text",
                F.lit(entry["name"]).alias("source"),
                F.lit(entry["difficulty"]).alias("difficulty"),
                F.lit(entry["evol_rounds"]).alias("evol_rounds"),
            )
        )
    empty = spark.createDataFrame([], "text string, source string, difficulty string, evol_rounds int")
    return reduce(lambda a, b: a.unionByName(b), found, empty)


def results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/*.json", multiLine=True)


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, prefix, step, values map) of lines "[ts] prefix step=N | k=v | ..."."""
    line = F.col("value")
    parts = F.slice(F.split(line, r" \| "), 2, 1 << 20)
    return spark.read.text(path).filter("value <> ''").select(
        F.regexp_extract(line, r"^\[([^\]]*)\]", 1).alias("ts"),
        F.regexp_extract(line, r"^\[[^\]]*\] (\S+) step=", 1).alias("prefix"),
        F.regexp_extract(line, r"step=(\d+)", 1).try_cast("long").alias("step"),
        F.map_from_entries(
            F.transform(
                parts,
                lambda p: F.struct(
                    F.split_part(p, F.lit("="), F.lit(1)), F.split_part(p, F.lit("="), F.lit(2)).try_cast("double")
                ),
            )
        ).alias("values"),
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """With bom the header of every file begins with the byte order mark that spreadsheets look for."""
    names = [f"\ufeff{c}" if bom and i == 0 else c for i, c in enumerate(df.columns)]
    df.toDF(*names).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_report(results: DataFrame, summary: dict, path: str) -> None:
    """path/summary: one object; path/json: the results, an object a line; path/txt: head and results for people, a line a
    result in order of idx, a file a range. results: idx, ground_truth, predicted, correct.
    """
    rows = results.select("idx", "ground_truth", "predicted", "correct")
    counts = rows.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("right")
    ).first()
    share = counts["right"] / counts["total"] if counts["total"] else 0.0
    head = summary | {"accuracy": share, "correct": counts["right"], "total": counts["total"]}
    one = results.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in head.items()])
    one.write.mode("overwrite").json(f"{path}/summary", ignoreNullFields=False)
    rows.orderBy("idx").write.mode("overwrite").json(f"{path}/json", ignoreNullFields=False)
    line = F.format_string(
        "[%s] #%2d  gt=%s  pred=%s",
        F.when(F.col("correct"), "O").otherwise("X"),
        F.col("idx"),
        F.col("ground_truth"),
        F.col("predicted"),
    )
    lines = [f"{k.replace('_', ' ').capitalize()}: {v}" for k, v in summary.items()] + [
        f"Accuracy: {counts['right']}/{counts['total']} = {share:.1%}", "=" * 60
    ]
    first = results.sparkSession.createDataFrame([(-1, "\n".join(lines))], "idx long, value string")
    both = first.unionByName(rows.select(F.col("idx").cast("long").alias("idx"), line.alias("value")))
    both.orderBy("idx").select("value").write.mode("overwrite").text(f"{path}/txt")


def cached_phase(make, path: str, expected: int, spark: SparkSession) -> DataFrame:
    """What make() gives, kept at path; a table there with fewer rows than expected is made anew."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        kept = spark.read.parquet(path)
        if kept.count() >= expected:
            return kept
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rewritten(spark: SparkSession, path: str, change, form: str = "json") -> None:
    """The files at path with change(df) in their place: written beside them first, then swapped by renaming."""
    beside, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    change(spark.read.format(form).load(path)).write.format(form).save(beside)
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.rename(to(path), to(old)) and fs.rename(to(beside), to(path))):
        raise OSError(f"{path} could not be swapped")
    fs.delete(to(old), True)
