"""Limits on events by key: windows that open at a key's first event, as a stream and as a batch fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Limits in use, as (most, seconds).
LOGIN_BY_ADDRESS, LOGIN_FAILURES, CONTACT = (30, 900), (5, 900), (5, 600)


def _folded(events: DataFrame, key: str, columns: list[Column], schema: str, run) -> DataFrame:
    """Each key's events in order of time, batch by batch, so that a task holds one batch and a key's state is two numbers."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = events.select(F.col(key).alias("k"), *columns).repartition(parts, "k").sortWithinPartitions("k", "t", "o")
    return keyed.mapInArrow(run, schema)


def _runs(keys: pa.Array) -> Iterator[tuple[int, int]]:
    """First and end of each run of equal keys."""
    codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(codes)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(codes)])


def fold_hits(events: DataFrame, key: str, at: str, order: str, most: int, seconds: float) -> DataFrame:
    """(key, order, at, n, limited) for each event: n is its number in its window, limited if beyond `most`.

    A window opens at a key's first event and at the first one later than `seconds` after the last window opened.
    Events of a key are read in order and forgotten; a search finds each window's end.
    """
    width = int(seconds * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened, n = object(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, numbers = batch.column(1).to_numpy(), np.empty(batch.num_rows, np.int64)
            for a, b in _runs(batch.column(0)):
                name = batch.column(0)[a].as_py()
                if name != last:
                    last, opened, n = name, int(t[a]), 0
                while a < b:
                    end = a + int(np.searchsorted(t[a:b], opened + width, side="right"))
                    numbers[a:end] = np.arange(n + 1, n + 1 + end - a)
                    n, a = n + end - a, end
                    if a < b:
                        opened, n = int(t[a]), 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(numbers)], ["k", "o", "at", "n"])

    kind = lambda c: events.schema[c].dataType.simpleString()
    columns = [F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(order).alias("o"), F.col(at).alias("at")]
    out = _folded(events.where(F.col(at).isNotNull()), key, columns, f"k {kind(key)}, o {kind(order)}, at {kind(at)}, n long", run)
    return out.select(F.col("k").alias(key), F.col("o").alias(order), F.col("at").alias(at), "n", (F.col("n") > most).alias("limited"))


def fold_failures(events: DataFrame, key: str, at: str, order: str, kind: Column, most: int, seconds: float) -> DataFrame:
    """(key, order, n, limited) for each event of kind failure, clear or other: n failures in the window after it.

    A failure counts, a success clears, others only look; limited if n is `most` or more.
    """
    width = int(seconds * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened, n = object(), None, 0
        for batch in batches:
            times, kinds, numbers = batch.column(1).to_pylist(), batch.column(3).to_pylist(), []
            for a, b in _runs(batch.column(0)) if batch.num_rows else ():
                name = batch.column(0)[a].as_py()
                if name != last:
                    last, opened, n = name, None, 0
                for t, what in zip(times[a:b], kinds[a:b]):
                    if opened is None or t - opened > width:
                        opened, n = None, 0
                    if what == "failure":
                        opened, n = t if opened is None else opened, n + 1
                    elif what == "clear":
                        opened, n = None, 0
                    numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(numbers, pa.int64())], ["k", "o", "n"])

    type_of = lambda c: events.schema[c].dataType.simpleString()
    columns = [F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(order).alias("o"), kind.alias("kind")]
    out = _folded(events.where(F.col(at).isNotNull()), key, columns, f"k {type_of(key)}, o {type_of(order)}, n long", run)
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "n", (F.col("n") >= most).alias("limited"))


def stream_hits(events: DataFrame, most: int, seconds: float) -> DataFrame:
    """events(key string, at timestamp, order long), a stream with a watermark on `at` -> (key, order, n, limited) in append mode.

    A key's state is a window's start and count. It goes once the watermark has passed its end, so that keys
    need no cap. Events of a micro-batch are taken in order of time; one that comes in a later batch counts on arrival.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["at", "order"], kind="stable")
        opened, n = state.get if state.exists else (None, 0)
        counts = []
        for t in pdf["at"].astype("datetime64[us]").astype("int64").tolist():
            if opened is None or t - opened > seconds * 1e6:
                opened, n = t, 0
            n += 1
            counts.append(n)
        state.update((opened, n))
        state.setTimeoutTimestamp(max(int(opened / 1e3 + seconds * 1e3) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "order": pdf["order"].to_numpy(), "n": counts, "limited": [c > most for c in counts]})

    return events.groupBy("key").applyInPandasWithState(run, "key string, order long, n long, limited boolean", "opened long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_failures(events: DataFrame, most: int, seconds: float) -> DataFrame:
    """events(key string, at timestamp, order long, kind string), a stream with a watermark on `at` -> (key, order, n, limited) in append mode.

    As fold_failures: a failure counts, a clear forgets, others only look. A key without a failure in its window has no
    state; otherwise that is the window's start and count, and goes when the watermark has passed the window's end. Events of a
    micro-batch are taken in order of time; batches that follow one another in time give what the fold gives.
    """
    width = int(seconds * 1e6)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["at", "order"], kind="stable")
        opened, n = state.get if state.exists else (None, 0)
        counts = []
        for t, what in zip(pdf["at"].astype("datetime64[us]").astype("int64").tolist(), pdf["kind"].tolist()):
            if opened is not None and t - opened > width:
                opened, n = None, 0
            if what == "failure":
                opened, n = t if opened is None else opened, n + 1
            elif what == "clear":
                opened, n = None, 0
            counts.append(n)
        if opened is not None:
            state.update((opened, n))
            state.setTimeoutTimestamp(max((opened + width) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": key[0], "order": pdf["order"].to_numpy(), "n": counts, "limited": [c >= most for c in counts]})

    return events.groupBy("key").applyInPandasWithState(run, "key string, order long, n long, limited boolean", "opened long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def access_log(events: DataFrame, path: str, checkpoint: str, columns: list[str] | None = None):
    """Append a stream of access events to JSON lines; each is written once. Returns the query."""
    return events.select(*(columns or events.columns)).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def valid_grants(grants: DataFrame, now: Column) -> DataFrame:
    """grants(exp seconds) that haven't run out."""
    return grants.where(F.timestamp_seconds("exp") > now)
