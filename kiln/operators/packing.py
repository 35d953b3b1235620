"""Balancing, packing, sharding and sequential grouping."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.operators.lineage import running


def number_rows(df: DataFrame, *order) -> DataFrame:
    """Adds i, from 0 in the given order. Rows with null keys come first and are numbered like others."""
    return running(df, list(order))


def rank_shard(df: DataFrame, i: str, total: int, replicas: int, drop_last: bool = False) -> DataFrame:
    """(row, rank, place): strided shards of equal size. Rows wrap round to fill the last stride, or the tail is dropped."""
    size = max(0, -(-(total - replicas) // replicas)) if drop_last and total % replicas else -(-total // replicas)
    whole = size * replicas
    if drop_last or whole == total or not total:
        out = df.filter(F.col(i) < whole).withColumn("slot", F.col(i))
    else:
        times = -(-whole // total)
        out = df.withColumn(
            "slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda t: F.col(i) + t * total))
        ).filter(F.col("slot") < whole)
    return out.withColumn(
        "rank", (F.col("slot") % replicas).cast("int")
    ).withColumn("place", F.floor(F.col("slot") / replicas))


def chunk_shard(i: Column, total: int, actors: int) -> Column:
    """Contiguous chunks over actors; an error if there are fewer rows than actors."""
    if total < actors:
        raise ValueError(f"{total} rows cannot be dealt to {actors} actors")
    return F.floor(i / -(-total // actors)).cast("int")


def snake(df: DataFrame, length: str, pos: str, ranks: int) -> DataFrame:
    """(rank, turn): sorted by length, cut in groups of `ranks`; the groups of the last half are reversed and laid
    between those of the first, so that sums are near equal. A last group that is not full is left out.
    """
    own = number_rows(df, F.desc(length), pos).withColumnRenamed("i", "_i")
    own = own.join(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    groups = F.ceil(F.col("_n") / ranks)
    half = F.floor(groups / 2)
    g, at = F.floor(F.col("_i") / ranks), F.col("_i") % ranks
    size = F.least(F.lit(ranks), F.col("_n") - g * ranks)
    # zip() of the groups stops at the shortest one
    width = F.col("_n") - (groups - 1) * ranks
    place = F.when(g < half, at).otherwise(size - 1 - at)
    turn = F.when(g < half, 2 * g).otherwise(
        F.when(groups - 1 - g < half, 2 * (groups - 1 - g) + 1).otherwise(2 * half)
    )
    return own.withColumn(
        "rank", place.cast("int")
    ).withColumn("turn", turn.cast("int")).filter(F.col("rank") < width).drop("_i", "_n")


def first_fit(lengths: list[int], most: int) -> list[int]:
    """Bin of each length, each into the first bin with room; one that is longer than a bin gets a bin of its own.

    A tournament tree over the bins holds the largest room below each node, so a bin is found in logarithmic time. Bins
    that are not open yet have all their room.
    """
    width = 1
    while width < len(lengths):
        width *= 2
    room, out, opened = [most] * (2 * width), [], 0
    for n in lengths:
        at = 1
        if n > most:
            at = width + opened  # no bin has room: the next one
        while at < width:
            at = 2 * at if room[2 * at] >= n else 2 * at + 1
        out.append(at - width)
        opened = max(opened, at - width + 1)
        room[at] -= n
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return out


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k parts of near equal sums, by largest differencing: states are merged, the largest parts of one with the smallest of the other."""
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} items cannot fill {k} parts")
    if equal_size and len(lengths) % k:
        raise ValueError("parts of equal size need a multiple of their number")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal_size else [[i] for i in order]
    heap = []
    for n, group in enumerate(groups):
        parts = [(lengths[i], [i]) for i in group] + [(0, [])] * (k - len(group))
        parts.sort(key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
    n = len(groups)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], n, merged))
        n += 1
    return [sorted(p[1]) for p in heap[0][2]]


def checked(parts: list[list[int]], items: int, k: int, equal_size: bool = False) -> list[list[int]]:
    """The parts, if there are k, none empty, and together they hold each item once (and equally many); else an error."""
    if len(parts) != k or any(not p for p in parts):
        raise ValueError(f"{k} parts that are not empty were asked for")
    if sorted(i for p in parts for i in p) != list(range(items)):
        raise ValueError("the parts do not hold each item once")
    if equal_size and len({len(p) for p in parts}) > 1:
        raise ValueError("the parts differ in size")
    return [sorted(p) for p in parts]


def balanced_parts(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k checked parts of near equal sums, by differencing."""
    return checked(differencing(lengths, k, equal_size), len(lengths), k, equal_size)


def in_order(lengths: list[int], k: int) -> list[list[int]]:
    """k parts, each item to the part of least sum, in the order given."""
    heap = [(0, p) for p in range(k)]
    out: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        total, p = heapq.heappop(heap)
        out[p].append(i)
        heapq.heappush(heap, (total + n, p))
    return out


def balanced(df: DataFrame, batch: str, key: str, length: str, k: int, method=differencing) -> DataFrame:
    """(batch, key, part) within each batch; a batch is what one step trains on, so it fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        part = {i: p for p, own in enumerate(method(pdf[length].tolist(), min(k, len(pdf)))) for i in own}
        return pd.DataFrame(
            {batch: pdf[batch].values, key: pdf[key].values, "part": [part[i] for i in range(len(pdf))]}
        )

    return df.select(batch, key, length).groupBy(batch).applyInPandas(
        run, f"{batch} {dict(df.dtypes)[batch]}, {key} {dict(df.dtypes)[key]}, part int"
    )


def first_fit_bins(df: DataFrame, batch: str, key: str, length: str, most: int) -> DataFrame:
    """(batch, key, bin) by first fit in order of key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame(
            {batch: pdf[batch].values, key: pdf[key].values, "bin": first_fit(pdf[length].tolist(), most)}
        )

    return df.select(batch, key, length).groupBy(batch).applyInPandas(
        run, f"{batch} {dict(df.dtypes)[batch]}, {key} {dict(df.dtypes)[key]}, bin int"
    )


def fewest_bins(lengths: list[int], most: int) -> int:
    return max(first_fit(lengths, most), default=-1) + 1


def micro_batches(df: DataFrame, step: str, rank: str, pos: str, length: str, most: int) -> DataFrame:
    """(step, rank, pos, micro, loss_scale, optimizer_step): each rank's rows of a step in as many micro-batches as the
    rank that needs most has by first fit, balanced by differencing. loss_scale: the micro-batch's share of the rank's
    rows; optimizer_step: 1 in the last one. A (step, rank) is what one device trains on, so it fits a task.
    """
    kinds = dict(df.dtypes)
    keys = f"{step} {kinds[step]}, {rank} {kinds[rank]}"

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        return pd.DataFrame(
            {
                step: pdf[step].iloc[:1].values,
                rank: pdf[rank].iloc[:1].values,
                "_most": [fewest_bins(pdf[length].tolist(), most)],
            }
        )

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos).reset_index(drop=True)
        parts = differencing(pdf[length].tolist(), min(int(pdf["_most"].iloc[0]), len(pdf)))
        micro = {i: j for j, own in enumerate(parts) for i in own}
        at = [micro[i] for i in range(len(pdf))]
        scale = [len(parts[j]) / len(pdf) for j in at]
        return pdf[[step, rank, pos]].assign(
            micro=at, loss_scale=scale, optimizer_step=[int(j == len(parts) - 1) for j in at]
        )

    rows = df.select(step, rank, pos, length)
    need = rows.groupBy(step, rank).applyInPandas(count, f"{keys}, _most int").groupBy(step).agg(
        F.max("_most").alias("_most")
    )
    kind = f"{keys}, {pos} {kinds[pos]}, micro int, loss_scale double, optimizer_step int"
    return rows.join(need, step).groupBy(step, rank).applyInPandas(deal, kind)


def rollout_batches(df: DataFrame, batch: str, pos: str, length: str, most: int, actors: int) -> DataFrame:
    """(batch, pos, micro): as many balanced micro-batches as first fit needs, rounded down to a multiple of the actors,
    one an actor at least."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos).reset_index(drop=True)
        lengths = pdf[length].tolist()
        n = max(fewest_bins(lengths, most) // actors * actors, actors)
        micro = {i: j for j, own in enumerate(differencing(lengths, n)) for i in own}
        return pdf[[batch, pos]].assign(micro=[micro[i] for i in range(len(pdf))])

    return df.select(batch, pos, length).groupBy(batch).applyInPandas(
        run, f"{batch} {kinds[batch]}, {pos} {kinds[pos]}, micro int"
    )


def round_robin(i: Column, engines: int) -> Column:
    return (i % engines).cast("int")


def least_loaded(i: Column, pending: list[int], each: int) -> Column:
    """The engine of the i-th prompt, each taken by the least loaded engine (ties to the first) and adding `each` to it.

    Until the loads are level the order is worked out here, from the engines alone; then it goes round and round.
    """
    heap = [(n, e) for e, n in enumerate(pending)]
    heapq.heapify(heap)
    first: list[int] = []
    while max(heap)[0] - heap[0][0] >= each:
        n, e = heapq.heappop(heap)
        first.append(e)
        heapq.heappush(heap, (n + each, e))
    ring = [e for _, e in sorted(heap)]
    begin = F.get(F.array(*[F.lit(e) for e in first]), i) if first else F.lit(None).cast("int")
    return F.when(i < len(first), begin).otherwise(
        F.get(F.array(*[F.lit(e) for e in ring]), (i - len(first)) % len(ring))
    ).cast("int")


def ceildiv(a: Column, b: int) -> Column:
    return F.ceil(a / b)


def reverse_index(df: DataFrame, i: str, target: str) -> DataFrame:
    """(i, target) turned round: for each target the place it came from."""
    return df.select(F.col(target).alias(i), F.col(i).alias(target))
