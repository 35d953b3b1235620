"""Keyed state in streams: a buffer that drops its oldest rows, and batches that fill up from accepted groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Buffer(StatefulProcessor):
    """Holds the last `limit` rows of a key, by order; a batch tells which rows came in and which went."""

    def __init__(self, columns: str, names: list[str], order: str, limit: int):
        self.columns, self.names, self.order, self.limit = columns, names, order, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.columns)
        self.turns = handle.getValueState("turns", "turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        turn = int(self.turns.get()[0]) + 1 if self.turns.exists() else 0
        came = [tuple(r) for pdf in rows for r in pdf[self.names].itertuples(index=False)]
        at = self.names.index(self.order)
        kept = sorted([*held, *came], key=lambda r: r[at])[-self.limit :]
        self.rows.put(kept)
        self.turns.update((turn,))
        out = pd.DataFrame(kept, columns=self.names)
        out.insert(0, "turn", turn)
        yield out

    def close(self) -> None:
        pass


class Refill(StatefulProcessor):
    """Holds the accepted groups of a key that fill no batch yet; a batch goes out as soon as it has `size` groups."""

    def __init__(self, name: str, group: str, accepted: str, size: int):
        self.name, self.group, self.accepted, self.size = name, group, accepted, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "g long")
        self.made = handle.getValueState("made", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [int(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        made = int(self.made.get()[0]) if self.made.exists() else 0
        came = pd.concat(list(rows))
        waiting += sorted(came[came[self.accepted].astype(bool)][self.group].tolist())
        out = []
        while len(waiting) >= self.size:
            out += [(key[0], made, g) for g in waiting[: self.size]]
            waiting, made = waiting[self.size :], made + 1
        if waiting:
            self.waiting.put([(g,) for g in waiting])
        else:
            self.waiting.clear()
        self.made.update((made,))
        yield pd.DataFrame(out, columns=[self.name, "batch", self.group])

    def close(self) -> None:
        pass


def files(spark: SparkSession, source: str, schema: str, per_batch: int = 1) -> DataFrame:
    """The JSON files of a folder as a stream, oldest first."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(source)


def replay_buffer(stream: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """(turn, columns of the stream): after each batch the last `limit` rows of every key that it had rows of, by order.

    turn counts a key's batches from 0; its buffer is the rows of its last turn. A key's state is `limit` rows at most. It
    is kept in the checkpoint, so a stopped query goes on with the buffers as they were. Rows of equal order: the ones
    that came first go first.
    """
    names = stream.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.groupBy(key).transformWithStateInPandas(
        Buffer(kinds, names, order, limit), f"turn long, {kinds}", outputMode="Append", timeMode="None"
    )


def refilled(stream: DataFrame, key: str, group: str, accepted: str, size: int) -> DataFrame:
    """(key, batch, group): batches of `size` accepted groups of each key, in order of arrival, within a file by group.

    group: a long. What fills no batch waits in the state, over restarts too.
    """
    kind = dict(stream.dtypes)[key]
    return stream.select(key, group, accepted).groupBy(key).transformWithStateInPandas(
        Refill(key, group, accepted, size), f"`{key}` {kind}, batch long, `{group}` long", outputMode="Append", timeMode="None"
    )


def drained(out: DataFrame, sink: str, checkpoint: str) -> None:
    """Takes all files that are there, appends Parquet to sink, and ends."""
    query = out.writeStream.format("parquet").outputMode("append").option("path", sink).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    query.awaitTermination()
