"""What the operators of this folder share: tables, the shared folder, words, hashes, buckets."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Words of the contracts: runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Odd multipliers of the polynomial and of the finaliser.
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Parquet bytes that one bucket of documents should hold, so that a Python worker stays small.
BUCKET_BYTES = 1 << 20
#: Groups of rows into which a key's rows are dealt where one key may be hot.
SALTS = 256
#: Estimates from here on are Catalyst's word for not knowing.
UNKNOWN = 1 << 50
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Bytes of groups after which a worker gives memory back.
LEAN_BYTES = 1 << 20
#: Bytes whose running sums are held at a time, and bytes of the longest word that they serve.
CHUNK, LONG = 1 << 20, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only in local mode where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = f"file://{tempfile.mkdtemp(prefix='kiln-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str, narrow: bool = False, by: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, and lost executors cost nothing.

    narrow: for rows of a few numbers, which need fewer files than there are shuffle partitions. by: a column of few
    values, each of which gets a folder, so that a reader's filter on it leaves the others unread.
    """
    spark = df.sparkSession
    df = df.repartition(max(1, partitions(spark) // 16)) if narrow else df
    path = f"{shared_dir(spark)}/kiln-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df: for files, their bytes. Where it knows none, the texts are added up.

    It sets partition counts only, never results.
    """
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if found < UNKNOWN:
        return found
    texts = [
        F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`"))), F.lit(0)) for f in df.schema if f.dataType.typeName()
        == "string"
    ]
    return int(df.agg(sum(texts, F.count("*") * 8)).first()[0])


def bucket_count(df: DataFrame, each: int = BUCKET_BYTES) -> int:
    return max(8, math.ceil(input_bytes(df) / each))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(b, doc_id, text, rest) dealt by b, a hash of the id and the text. rest: the other columns, under their own names."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    b = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    dealt = df.select(
        b.alias("b"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest")
    )
    return dealt.repartition(partitions(df.sparkSession), "b")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """bytes.split() splits on exactly the six characters of the contracts."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


#: A random value for each byte, the same with A-Z as a-z, and powers of the word polynomial's base and of its inverse.
VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
LOWERED = VALUES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
UP, DOWN = powers(int(MULTIPLIER), CHUNK), powers(pow(int(MULTIPLIER), -1, 1 << 64), CHUNK)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


class Words:
    """The words of an Arrow array of texts: hashes, document bounds (ends) among them, and each word's bytes in raw.

    A word's hash is a polynomial of its bytes modulo 2^64, from running sums over whole chunks; words over LONG bytes
    are hashed one by one. Nulls have no words.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[
            texts.offset : texts.offset + len(texts) + 1
        ] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(
            data, np.uint8
        )[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        self.raw = raw
        inner = ~SPACE[raw]
        first, last = inner.copy(), inner.copy()
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        some = np.flatnonzero(at[1:] > at[:-1])  # texts that are not empty: words end with them
        first[at[:-1][some]] = inner[at[:-1][some]]
        last[at[1:][some] - 1] = inner[at[1:][some] - 1]
        self.first, self.last = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ends = np.searchsorted(self.first, at)
        self.flat = self._hashes(LOWERED if lower else VALUES, lower)

    def _hashes(self, values: np.ndarray, lower: bool) -> np.ndarray:
        n = self.last - self.first
        out, short, i = np.zeros(len(n), np.uint64), np.flatnonzero(n <= LONG), 0
        first, last = self.first[short], self.last[short]
        while i < len(short):
            j = max(i + 1, int(np.searchsorted(last, first[i] + CHUNK, side="right")))
            base = first[i]
            x = values[self.raw[base : last[j - 1]]]
            x *= UP[: len(x)]
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x, out=sums[1:])
            out[short[i:j]] = (sums[last[i:j] - base] - sums[first[i:j] - base]) * DOWN[first[i:j] - base]
            i = j
        for k in np.flatnonzero(n > LONG).tolist():
            word = self.raw[self.first[k] : self.last[k]].tobytes()
            out[k] = xxh3_64_intdigest(word.lower() if lower else word)
        return finalise(out + n.astype(np.uint64) * MIX)

    def text(self, i: int, j: int) -> bytes:
        """Bytes from word i to word j - 1."""
        return self.raw[self.first[i] : self.last[j - 1]].tobytes()


def finalise(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= MIX
    x ^= x >> np.uint64(29)
    return x


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, documents run together; the caller drops those that cross an end."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = words[:n].copy()
    for j in range(1, k):
        x *= MULTIPLIER
        x += words[j : n + j]
    return finalise(x)


def inside(ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-word windows that lie within one document, and the document of each."""
    counts = np.maximum(np.diff(ends) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - first[doc] + ends[:-1][doc], doc


def split_runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in a sorted array, with the end appended."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def to_blobs(b: int, part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """A row for each part that occurs: its share of every column as bytes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = split_runs(part)
    out = {
        "p": pa.array(part[at[:-1]].astype(np.int32), pa.int32()),
        "b": pa.array(np.full(len(at) - 1, b, dtype=np.int32), pa.int32()),
    }
    for name, values in columns.items():
        values = values[order]
        out[name] = pa.array([values[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
    return pa.table(out)


def from_blobs(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=dtype)


def spread_join(rows: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with small, which has one row a key, where one key may hold a third of all rows.

    Rows of a key are dealt to SALTS groups by a hash of `by`. small is joined to the groups first, of which a key has
    SALTS at most, and then to the rows by key and group. Keys that small lacks go (inner) or have nulls (left).
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    groups = salted.select(key, "__salt").distinct().join(small, key, how)
    return salted.join(groups, [key, "__salt"]).drop("__salt")


def null_safe_text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def discard(*frames: DataFrame) -> None:
    """Deletes tables that materialise() wrote and nothing needs any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            target = jvm.org.apache.hadoop.fs.Path(path)
            if target.getName().startswith("kiln-"):
                target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the rows of an Arrow batch at BATCH_ROWS, so that long texts do not fill a Python worker.

    The session has one such bound. All operators ask for the same, and a smaller one that is set already holds.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system: Spark keeps workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


#: What one operator keeps in a worker from task to task; the next operator that runs there lets it go.
HELD: dict = {}


def held(key, make):
    """make(), kept in this worker until another operator runs in it. Its tasks must be wrapped with holds=True."""
    if key not in HELD:
        HELD[key] = make()
    return HELD[key]


def let_go() -> None:
    if HELD:
        HELD.clear()
        release()


def lean_batches(run, at_end=lambda: None, holds: bool = False):
    def wrapped(batches):
        if not holds:
            let_go()
        try:
            yield from run(batches)
        finally:
            at_end()
            release()

    return wrapped


GROUPED = [0]


def seen(*tables: pa.Table) -> None:
    GROUPED[0] += sum(t.nbytes for t in tables)
    if GROUPED[0] >= LEAN_BYTES:
        GROUPED[0] = 0
        release()


def lean_group(run):
    def wrapped(key, tbl):
        let_go()
        try:
            return run(key, tbl)
        finally:
            seen(tbl)

    return wrapped


def lean_pair(run):
    def wrapped(key, left, right):
        let_go()
        try:
            return run(key, left, right)
        finally:
            seen(left, right)

    return wrapped
