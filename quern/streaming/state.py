"""Streaming forms of the event operators: latest value, staleness, sliding buffer, change detection.

The batch forms in quern.operators.events give the same answers over the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.runtime import new_folder


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """A row per key with the values of its last event; state is one row per key."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in columns])


def staleness(last_seen: DataFrame, at: str, now, stale_after: float, dead_after: float) -> DataFrame:
    """active, stale or dead by the age of the last event at ``now``, in seconds."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    return last_seen.withColumn("status", F.when(age < stale_after, "active").when(age < dead_after, "stale").otherwise("dead"))


def sliding_buffer(events: DataFrame, key: str, at: str, order: str, seconds: int, most: int) -> DataFrame:
    """Each key's buffer of at most ``most`` events, none older than ``seconds``, given out whenever it changes.

    Out come key, version (how many events the key has had) and ids, oldest first. The state of a key is its buffer.
    """
    key_type, id_type = dict(events.dtypes)[key], dict(events.dtypes)[order]
    slim = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(order).alias("_id"))

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, times, ids = state.get if state.exists else (0, [], [])
        held = list(zip(times, ids, strict=True))
        for frame in frames:
            held += list(zip(frame["_at"].tolist(), frame["_id"].tolist(), strict=True))
            version += len(frame)
            held.sort()
            held = held[-most:]
        newest = held[-1][0]
        held = [x for x in held if newest - x[0] < seconds * 1_000_000]
        state.update((version, [x[0] for x in held], [x[1] for x in held]))
        yield pd.DataFrame({key: [group[0]], "version": [version], "ids": [[x[1] for x in held]]})

    out = f"{key} {key_type}, version bigint, ids array<{id_type}>"
    return slim.groupBy(key).applyInPandasWithState(update, out, f"version bigint, times array<bigint>, ids array<{id_type}>", "update", GroupStateTimeout.NoTimeout)


def changes(events: DataFrame, key: str, at: str, order: str, value: str) -> DataFrame:
    """The events whose value differs from the one before of their key; events must come in order across batches."""
    types = dict(events.dtypes)
    slim = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(order).alias("_id"), value)

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["_at", "_id"])
        last = state.get[0] if state.exists else None
        kept = []
        for i, v in zip(frame["_id"], frame[value], strict=True):
            if v != last:
                kept.append((group[0], i, v))
            last = v
        state.update((last,))
        yield pd.DataFrame(kept, columns=[key, order, value])

    out = f"{key} {types[key]}, {order} {types[order]}, {value} {types[value]}"
    return slim.groupBy(key).applyInPandasWithState(update, out, f"last {types[value]}", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """Run a stream over what is there and read the result back from the shared folder.

    ``append`` and ``update`` keep the rows of all batches; with ``key``, the last row of each key. ``complete`` keeps
    the last batch.
    """
    spark = stream.sparkSession
    base = new_folder(spark, "stream")
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        batches.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = batches[-1:] if mode == "complete" else batches
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    read = reduce(DataFrame.unionByName, [spark.read.schema(stream.schema).parquet(f"{base}/out/batch={n}").withColumn("_batch", F.lit(n)) for n in wanted])
    if key is None:
        return read.drop("_batch")
    others = [c for c in stream.columns if c != key]
    return read.groupBy(key).agg(F.max_by(F.struct(*others), "_batch").alias("_v")).select(key, "_v.*")


def fan_out(batch: DataFrame, paths: list[str]) -> None:
    """The same rows to several JSON logs; a path that is named twice is written once. For use in foreachBatch."""
    batch.persist()
    try:
        for path in dict.fromkeys(paths):
            batch.write.mode("append").json(path)
    finally:
        batch.unpersist()


def expired(events: DataFrame, key: str, at: str, seconds: int, delay: str) -> DataFrame:
    """key, last, events: what is known of each key when it has been silent for ``seconds`` of event time; its state is
    removed then, so state holds the keys of the last ``seconds`` and ``delay`` only. A key that comes back starts anew.
    """
    key_type = dict(events.dtypes)[key]
    timed = events.select(key, F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", delay)

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], "last": pd.to_datetime([last], unit="ms"), "events": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for frame in frames:
            last, n = max(last, int(frame["_at"].max().value // 1_000_000)), n + len(frame)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    out = f"{key} {key_type}, last timestamp, events bigint"
    return timed.groupBy(key).applyInPandasWithState(update, out, "last bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
