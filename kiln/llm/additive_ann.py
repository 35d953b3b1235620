"""Nearest neighbours by inner product: additive quantisation, lookup-table scoring, exact reranking.

A vector's direction is the sum of one word from each of LEVELS full-dimensional codebooks, each fitted to what the ones
before leave over, and chosen by beam search. Its stored norm is the factor that brings the sum to the vector's length;
its stored slack is the length of what the sum leaves over, over the root of the dimension: how far a score may be off.

1. A query's score for a vector is the norm times the sum of LEVELS table entries (inner products of the query with the
   words). Queries and codes meet in blocks, the one fixed set of queries with all rows; vectors stay behind.
2. A block keeps for each query the rows whose score plus SLACKS times the slack reaches its bar: the k-th largest score
   less as much. The best bar of all blocks then holds for the query. So a crowd of near copies that codes cannot tell
   apart is kept whole, and there is no cap. Of rows with equal vectors those that k others with smaller ids precede in
   every list are left out before.
3. The survivors are joined with their vectors and ranked by exact inner products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import common as C

LEVELS, WORDS, BEAM = 48, 256, 3
#: Bound of the sample on which codebooks are fitted, and their rounds of k-means.
SAMPLE, ROUNDS = 8192, 5
#: Rows of a block of queries and of a block of codes; queries and candidates of one group that is ranked.
QUERY_BLOCK, ROW_BLOCK, RANKED, CANDIDATES = 2048, 32_768, 16, 4096
#: Slacks by which a score may be off.
SLACKS = 1.5


def fit(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """LEVELS codebooks of at most WORDS words: k-means on what the levels before leave over, by beam of one."""
    rng, rest, books = np.random.default_rng(seed), x.astype(np.float32).copy(), []
    k = min(WORDS, len(x))
    for _ in range(LEVELS):
        words = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(ROUNDS):
            near = np.argmin((words**2).sum(1) - 2 * rest @ words.T, axis=1)
            count = np.bincount(near, minlength=k)
            sums = np.zeros_like(words)
            np.add.at(sums, near, rest)
            words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
        near = np.argmin((words**2).sum(1) - 2 * rest @ words.T, axis=1)
        rest -= words[near]
        books.append(words)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by beam search, stored norms (length of x to projection of its direction on the sum of its words), slacks."""
    n, d = x.shape
    length = np.linalg.norm(x.astype(np.float64), axis=1)
    rest = (x / length[:, None]).astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for words in books:
        beams = rest.shape[1]
        gain = (words**2).sum(1) - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, beams, -1)
        cost = ((rest**2).sum(2)[:, :, None] + gain).reshape(n, -1)
        keep = min(BEAM, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        beam, word = best // len(words), best % len(words)
        row = np.arange(n)[:, None]
        rest = rest[row, beam] - words[word]
        codes = np.concatenate([codes[row, beam], word[:, :, None].astype(np.uint8)], axis=2)
    pick = np.argmin((rest**2).sum(2), axis=1)
    row = np.arange(n)
    codes = codes[row, pick]
    near = sum(books[m][codes[:, m]] for m in range(len(books)))
    square = np.einsum("ij,ij->i", near, near)
    unit = (x / length[:, None]).astype(np.float32)
    scale = np.einsum("ij,ij->i", unit, near) / np.maximum(square, 1e-12)
    scale = np.where(scale > 0, scale, 1.0)
    slack = length * np.linalg.norm(unit - near * scale[:, None], axis=1) / math.sqrt(d)
    return codes, (length * scale).astype(np.float32), slack.astype(np.float32)


def scores(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """(queries, rows): table lookups, added over the levels."""
    tables = np.einsum("mkd,qd->mkq", books, queries.astype(np.float32), optimize=True)
    total = tables[0][codes[:, 0]]
    for m in range(1, len(books)):
        total += tables[m][codes[:, m]]
    return (total * norms[:, None]).T


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, added from the first component to the last."""
    return np.cumsum(x * q, axis=1)[:, -1]


def survivors(qid, queries, ids, codes, norms, slacks, books, k):
    """(query, row index, upper, bar) of all rows of a block that may be among a query's k nearest."""
    out, found = [], scores(queries, books, codes, norms)
    for i, q in enumerate(qid):
        off = SLACKS * slacks * np.linalg.norm(queries[i])
        other = ids != q
        low = np.where(other, found[i] - off, -np.inf)
        bar = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        at = np.flatnonzero(other & (found[i] + off >= bar))
        out.append((np.full(len(at), q), at, (found[i] + off)[at], np.full(len(at), bar)))
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows whose vector takes part: not null, not zero, no null, NaN or infinite component; and whose id is not null."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    some = F.exists(v, lambda e: e != 0)
    return df.filter(
        F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & some
    ).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def matrix(column, d: int) -> np.ndarray:
    """Vectors of a list column, zeros behind those shorter than d."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out, flat = np.zeros((len(column), d)), column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    out[np.arange(d)[None, :] < sizes[:, None]] = flat
    return out


def crowded_out(narrow: DataFrame, k: int) -> DataFrame:
    """(row) that can be in nobody's k nearest: rows of equal vectors behind k + 1 smaller ids, or k rows of their own id."""
    many = narrow.groupBy("name").agg(F.count("*").alias("c")).filter(F.col("c") > k).select("name")
    crowd = C.spread_join(narrow, many, "name", by="vec_id").withColumn(
        "salt", F.pmod(F.xxhash64("vec_id"), F.lit(C.SALTS))
    )
    kept = crowd
    for keys in (["name", "salt"], ["name"]):  # a part of a crowd first, then what is left of it
        by = Window.partitionBy(*keys).orderBy("vec_id")
        own = Window.partitionBy(*keys, "vec_id").orderBy("row")
        kept = kept.withColumn("ids", F.dense_rank().over(by)).withColumn("own", F.row_number().over(own)).filter(
            (F.col("ids") <= k + 1) & (F.col("own") <= k)
        )
    return crowd.join(kept.select("row"), "row", "left_anti").select("row")


def nearest(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k rows of largest inner product.

    score is the inner product of the stored vectors in double precision; ties go to the smaller id. All rows are indexed
    and candidates; rows with the query's own id are not. Fewer than k candidates: all of them. Vectors that are null,
    zero, or hold null or non-finite components, and rows without an id, take no part. Shorter vectors count as if zeros
    followed. Repeated rows: each is a candidate; a repeated query id is searched once, with one of its vectors. Empty
    table: no rows. Other columns, under any names, are not read.
    """
    spark = df.sparkSession
    good = usable(df, id_col, vec_col)
    total, d = good.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    # the same rows every time: a sample ordered by a hash of id and vector
    sample = good.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow()
    x = matrix(sample.column("v"), d)
    books = fit((x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32))
    rows, asked = max(1, math.ceil(total / ROW_BLOCK)), max(1, math.ceil(total / every / QUERY_BLOCK))
    shipped = spark.sparkContext.broadcast(books)  # LEVELS x WORDS vectors, whatever the input

    def code(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), d)
                codes, norms, slacks = encode(v, shipped.value)
                raw = [r.tobytes() for r in v]
                columns = [
                    pa.array(np.arange(row, row + len(v))),
                    batch.column("vec_id"),
                    pa.array(raw, pa.binary()),
                    pa.array([xxh3_128_digest(r) for r in raw], pa.binary()),
                ]
                columns += [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(slacks)]
                row += len(v)
                yield pa.RecordBatch.from_arrays(
                    columns, names=["row", "vec_id", "v", "name", "codes", "norm", "slack"]
                )

    kind = "row long, vec_id long, v binary, name binary, codes binary, norm float, slack float"
    coded = C.materialise(C.small_batches(good).mapInArrow(C.lean_batches(code), kind), "codes")
    gone = crowded_out(coded.select("row", "vec_id", "name"), k)
    part = F.pmod(F.xxhash64("row"), F.lit(rows)).cast("int").alias("r")
    left = coded.join(gone, "row", "left_anti").select(
        "row", "vec_id", "codes", "norm", "slack", part, F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("q")
    )
    queries = coded.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("v", "row").alias("v"))
    queries = C.materialise(queries, "queries")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asked)).cast("int").alias("q")
    right = queries.select("vec_id", "v", block, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"))

    def meet(key, rows_, queries_):
        out = []
        if rows_.num_rows and queries_.num_rows:
            ids, row = rows_.column("vec_id").to_numpy(), rows_.column("row").to_numpy()
            codes = np.frombuffer(b"".join(rows_.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            norms, slacks = rows_.column("norm").to_numpy(), rows_.column("slack").to_numpy()
            qid, q = queries_.column("vec_id").to_numpy(), np.frombuffer(
                b"".join(queries_.column("v").to_pylist())
            ).reshape(-1, d)
            for i in range(0, len(qid), 64):
                out += [(a, row[b], u, t) for a, b, u, t in survivors(qid[i : i + 64], q[i : i + 64], ids, codes, norms, slacks, shipped.value, k)]
        cat = lambda j, t: pa.array(np.concatenate([o[j] for o in out]) if out else np.zeros(0), t)
        return pa.table(
            {
                "query_id": cat(0, pa.int64()),
                "row": cat(1, pa.int64()),
                "upper": cat(2, pa.float32()),
                "bar": cat(3, pa.float32()),
            }
        )

    met = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(
        C.lean_pair(meet), "query_id long, row long, upper float, bar float"
    )
    whole = Window.partitionBy("query_id")
    kept = met.withColumn(
        "best", F.max("bar").over(whole)
    ).filter("upper >= best").withColumn("c", F.count("*").over(whole))
    salt = F.pmod(F.xxhash64("row"), F.floor(F.col("c") / CANDIDATES) + 1)
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(total / every / RANKED)))).cast("int").alias("g")
    kept = C.materialise(kept.select("query_id", "row", group, salt.cast("int").alias("s")), "survivors")
    pairs = kept.join(coded.select("row", "vec_id", "v"), "row")
    whom = queries.withColumnRenamed("vec_id", "query_id").join(
        kept.select("query_id", F.col("g").alias("to"), F.col("s").alias("salt")).distinct(), "query_id"
    )

    def rank(key, pairs_, queries_):
        out = []
        if pairs_.num_rows:
            vectors = {q: np.frombuffer(v) for q, v in zip(queries_.column("query_id").to_pylist(), queries_.column("v").to_pylist())}
            qid, ids = pairs_.column("query_id").to_numpy(), pairs_.column("vec_id").to_numpy()
            x_ = np.frombuffer(b"".join(pairs_.column("v").to_pylist())).reshape(-1, d)
            order = np.argsort(qid, kind="stable")
            cut = C.split_runs(qid[order])
            for i, j in zip(cut[:-1], cut[1:]):
                own = order[i:j]
                exact = inner(x_[own], vectors[int(qid[own[0]])])
                best = np.lexsort((ids[own], -exact))[:k]
                out.append((qid[own][best], ids[own][best], exact[best]))
        cat = lambda j, t: pa.array(np.concatenate([o[j] for o in out]) if out else np.zeros(0), t)
        return pa.table({"query_id": cat(0, pa.int64()), "vec_id": cat(1, pa.int64()), "score": cat(2, pa.float64())})

    found = pairs.groupBy("g", "s").cogroup(whom.groupBy("to", "salt")).applyInArrow(
        C.lean_pair(rank), "query_id long, vec_id long, score double"
    )
    # each group sends k rows a query at most
    ranked = found.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k).alias("best")
    )
    ranked = ranked.select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.down")).alias("score"),
    )
