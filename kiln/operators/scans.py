"""Running values along ordered segments, where one segment may hold most rows.

Rows are dealt to ranges of (segment, order). Each range tells in one row what it does to a value that comes in from the
range before; these rows, one a range, are folded on the driver, and a second pass over the ranges fills the values in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.operators.lineage import cut


def ranged(df: DataFrame, segment: str, order: list) -> DataFrame:
    """df in ranges of (segment, order), sorted, with the number of its range in _p."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, segment, *order).withColumn("_p", F.spark_partition_id())
    return cut(dealt.sortWithinPartitions(segment, *order))


def begins(segment: pa.Array, before: object = None, first: bool = False) -> np.ndarray:
    """Whether each row starts a segment; before: the segment of the row ahead, unless first. Nulls are one segment."""
    codes = segment.dictionary_encode(null_encoding="encode").indices.to_numpy()
    head = first or (len(segment) > 0 and segment[0].as_py() != before)
    return np.r_[head, codes[1:] != codes[:-1]][: len(codes)]


def composed(a: np.ndarray, b: np.ndarray, y: float) -> np.ndarray:
    """y_k = b_k + a_k y_(k-1) from y on, in as many vector steps as the length has binary digits."""
    a, b = a.copy(), b.copy()
    b[0] += a[0] * y
    a[0], s = 0.0, 1
    while s < len(a) and a[s:].any():
        b[s:] += a[s:] * b[:-s]
        a[s:] = a[s:] * a[:-s]
        s *= 2
    return b


def affine(df: DataFrame, segment: str, order: list, scans: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df with, for each name, the value before each row of y = b + a * (y of the row before), from 0 at the start of a
    segment. scans: name to (a, b). Null a or b counts as 0. Ties of the order are in no fixed order; null segments are one.
    """
    names = list(scans)
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    own = df.withColumns({f"_{x}_{name}": number(c) for name, pair in scans.items() for x, c in zip("ab", pair)})
    own = ranged(own, segment, order)
    kind = own.schema[segment].dataType.simpleString()

    def values(batch, head):
        a, b = ([batch.column(f"_{x}_{n}").to_numpy() for n in names] for x in "ab")
        return [np.where(head, 0.0, v) for v in a], b

    def summary(batches):
        p = first = last = None
        slopes, offsets = [1.0] * len(names), [0.0] * len(names)
        for batch in batches:
            if len(batch):
                keys = batch.column(segment)
                head = begins(keys, last)
                if p is None:
                    p, first, head[0] = batch.column("_p")[0].as_py(), keys[0].as_py(), False
                last = keys[-1].as_py()
                for i, (a, b) in enumerate(zip(*values(batch, head))):
                    slopes[i], offsets[i] = slopes[i] * float(np.prod(a)), float(composed(a, b, offsets[i])[-1])
        if p is not None:
            row = {"p": [p], "first": [first], "last": [last], "slopes": [slopes], "offsets": [offsets]}
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    schema = pa.schema(
        [("p", pa.int32()), *[(n, arrow_type(own, segment)) for n in ("first", "last")]]
        + [(n, pa.list_(pa.float64())) for n in ("slopes", "offsets")]
    )
    told = own.mapInArrow(summary, f"p int, first {kind}, last {kind}, slopes array<double>, offsets array<double>")
    carried, state, at = {}, [0.0] * len(names), None
    for row in sorted(told.collect(), key=lambda r: r.p):  # one row a range
        coming = state if at is not None and at[0] == row.first else [0.0] * len(names)
        carried[row.p] = (row.first, coming)
        state, at = [b + a * y for a, b, y in zip(row.slopes, row.offsets, coming)], (row.last,)

    columns = [c for c in df.columns if c not in names]

    def fill(batches):
        last, ys = None, None
        for batch in batches:
            if len(batch):
                keys = batch.column(segment)
                if ys is None:
                    last, ys = carried[batch.column("_p")[0].as_py()]
                head = begins(keys, last)
                last = keys[-1].as_py()
                made = []
                for i, (a, b) in enumerate(zip(*values(batch, head))):
                    y = composed(a, b, ys[i])
                    made.append(pa.array(np.where(head, 0.0, np.r_[ys[i], y[:-1]])))
                    ys = [*ys[:i], float(y[-1]), *ys[i + 1 :]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names=[*columns, *names])

    return own.mapInArrow(fill, schema_of(own, columns, names))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def schema_of(df: DataFrame, columns: list[str], doubles: list[str]) -> str:
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns] + [f"`{n}` double" for n in doubles])


def returns(df: DataFrame, segment: str, order: list[str], reward: Column, gamma: float, name: str = "togo") -> DataFrame:
    """Adds the discounted sum of rewards from each row to the end of its segment."""
    out = affine(df.withColumn("_r", reward), segment, backwards(order), {name: (F.lit(gamma), F.col("_r"))})
    return out.withColumn(name, F.coalesce("_r", F.lit(0.0)) + gamma * F.col(name)).drop("_r")


def advantages(
    df: DataFrame, segment: str, order: list[str], reward: Column, value: Column, gamma: float, lam: float, name: str = "advantage"
) -> DataFrame:
    """Adds generalised advantages along each segment; the value behind its last row is 0. Null values and rewards count as 0.

    What a row hands to the one before it is gamma v + gamma lam A, and A = r - v + that of the row behind.
    """
    both = {"_r": F.coalesce(reward.cast("double"), F.lit(0.0)), "_v": F.coalesce(value.cast("double"), F.lit(0.0))}
    hand = gamma * F.col("_v") + gamma * lam * (F.col("_r") - F.col("_v"))
    out = affine(df.withColumns(both), segment, backwards(order), {name: (F.lit(gamma * lam), hand)})
    return out.withColumn(name, F.col("_r") - F.col("_v") + F.col(name)).drop("_r", "_v")


def positions(df: DataFrame, segment: str, order: list, name: str = "p") -> DataFrame:
    """Adds the place of each row in its segment, from 0."""
    out = affine(df, segment, order, {name: (F.lit(1.0), F.lit(1.0))})
    return out.withColumn(name, F.col(name).cast("long"))


def backwards(order: list[str]) -> list[Column]:
    return [F.desc(c) for c in order]


def next_breaks(upto: np.ndarray, budget: int) -> np.ndarray:
    """For a group that begins at each row, the row that begins the next one. upto: sums before each row, and of all."""
    start = upto[:-1]
    over = np.searchsorted(upto, start + budget, side="right") - 1
    return np.minimum(np.maximum(over, np.searchsorted(upto, start, side="right")), len(start))


def first_break(upto: np.ndarray, budget: int, used: int) -> int:
    """The row that begins the next group where `used` of the budget is taken before the first row."""
    over = int(np.searchsorted(upto, budget - used, side="right")) - 1
    return min(max(over, 0 if used > 0 else int(np.searchsorted(upto, 0, side="right"))), len(upto) - 1)


def ends(upto: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For a group that begins at each row: what is used at the end of all rows, and groups begun after it."""
    n = len(upto) - 1
    pointer = np.r_[next_breaks(upto, budget), n]
    count, last = (pointer < n).astype(np.int64), np.where(pointer < n, pointer, np.arange(n + 1))
    while (pointer < n).any():  # doubling
        count, last = count + np.where(pointer < n, count[pointer], 0), np.where(pointer < n, last[pointer], last)
        pointer = pointer[pointer]
    return upto[-1] - upto[last], count


def budget_groups(df: DataFrame, doc: str, pos: str, length: str, budget: int) -> DataFrame:
    """(doc, pos, grp): blocks of a document in order, a new group begun when the budget would be passed. Null length: 0.

    A range that lies inside a document is a step function of what is used before it: the row at which the first new
    group begins, and from there on everything is fixed. Next groups are found by binary search in running sums. Steps with
    the same end are one, so a range's row has as many steps as ends differ, and no more than its first group has blocks.
    """
    own = df.select(doc, pos, F.coalesce(F.col(length), F.lit(0)).cast("long").alias("_n"))
    own = ranged(own, doc, [F.col(pos), F.col("_n")])
    kind = own.schema[doc].dataType.simpleString()
    schema = pa.schema(
        [("p", pa.int32()), *[(n, arrow_type(own, doc)) for n in ("first", "last")], ("whole", pa.bool_()), ("fresh", pa.list_(pa.int64()))]
        + [(n, pa.list_(pa.int64())) for n in ("limits", "used", "groups")]
        + [("total", pa.int64())]
    )

    def state(upto: np.ndarray, used: int) -> list[int]:
        """Used at the end, and groups begun, from `used` before the first row."""
        at = first_break(upto, budget, used)
        if at == len(upto) - 1:
            return [used + int(upto[-1]), 0]
        end, count = ends(upto, budget)
        return [int(end[at]), int(count[at]) + 1]

    def gathered(batches) -> pa.Table | None:
        found = [b for b in batches if len(b)]
        return pa.Table.from_batches(found).combine_chunks() if found else None

    def summary(batches):
        table = gathered(batches)
        if table is None:
            return
        keys = table.column(doc).combine_chunks()
        at = np.flatnonzero(begins(keys, first=True))
        sums = np.r_[0, np.cumsum(table.column("_n").to_numpy()[at[-1] :])]
        limits, used, groups = [], [], []
        if len(at) == 1:
            end, count = ends(sums, budget)
            rows = np.arange(first_break(sums, budget, 1 << 62), first_break(sums, budget, 1) + 1)
            rows = rows[rows < len(sums) - 1]
            limits, used, groups = budget - sums[rows + 1], end[rows], count[rows] + 1
            keep = np.r_[True, (used[1:] != used[:-1]) | (groups[1:] != groups[:-1])] if len(rows) else np.zeros(0, bool)
            # the last limit of a run of equal ends is the lowest
            tail = np.r_[keep[1:], True] if len(rows) else keep
            limits, used, groups = limits[tail].tolist(), used[tail].tolist(), groups[tail].tolist()
        row = (table.column("_p")[0].as_py(), keys[0].as_py(), keys[-1].as_py(), len(at) == 1, state(sums, 0), limits, used, groups, int(sums[-1]))
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, [[x] for x in row])), schema=schema)

    lists = ", ".join(f"{n} array<long>" for n in ("fresh", "limits", "used", "groups"))
    told = own.mapInArrow(summary, f"p int, first {kind}, last {kind}, whole boolean, {lists}, total long")
    carried, at, used, grp = {}, None, 0, 0
    for row in sorted(told.collect(), key=lambda r: r.p):  # one row a range
        if at is None or at[0] != row.first:
            used, grp = 0, 0
        carried[row.p] = (used, grp)
        if not row.whole or used == 0:
            used, grp = row.fresh[0], row.fresh[1] + (grp if row.whole else 0)
        else:
            step = next((i for i, limit in enumerate(row.limits) if used > limit), None)
            used, grp = (used + row.total, grp) if step is None else (row.used[step], grp + row.groups[step])
        at = (row.last,)

    def fill(batches):
        table = gathered(batches)
        if table is None:
            return
        keys, lengths = table.column(doc).combine_chunks(), table.column("_n").to_numpy()
        at, out = np.flatnonzero(begins(keys, first=True)), []
        used, grp = carried[table.column("_p")[0].as_py()]
        for begin, stop in zip(at, [*at[1:], len(keys)]):
            sums = np.r_[0, np.cumsum(lengths[begin:stop])]
            following, marks = next_breaks(sums, budget), np.zeros(stop - begin, np.int64)
            row = first_break(sums, budget, used)
            while row < stop - begin:
                marks[row] = 1
                row = int(following[row])
            out.append(np.cumsum(marks) + grp)
            used, grp = 0, 0
        made = pa.array(np.concatenate(out).astype(np.int32))
        yield from pa.table([table.column(doc), table.column(pos), made], names=[doc, pos, "grp"]).to_batches()

    return own.mapInArrow(fill, f"`{doc}` {kind}, `{pos}` {own.schema[pos].dataType.simpleString()}, grp int")
