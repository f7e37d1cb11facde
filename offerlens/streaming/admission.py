"""Sliding-window admission per key, in batch and as a stateful stream.

A request is admitted while fewer than ``limit`` admitted requests lie in the window before
it; rejected requests do not occupy the window.  Each decision depends on the earlier ones
of its key, so one key is a sequence.

The batch form sorts all requests by key and time over range partitions, so a hot key spans
many of them.  A partition is one slice: it is walked in its own task, holding one window,
and starts with a *carry*, the admitted times that the slice before left for the same key.
The first pass guesses empty carries.  Only a slice that lies wholly in one key can pass a
carry on, and only slices whose carry turned out different are walked again, until none is.
The driver holds one row per slice: its first and last key and at most ``limit`` times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from offerlens.session import materialize

MICROS = 1_000_000


def admit(times: list[int], window: int, limit: int, stored: list[int] | None = None):
    """Decisions (allowed, remaining, reset seconds) for sorted times in microseconds."""
    bucket = deque(stored or [])
    out = []
    for now in times:
        while bucket and bucket[0] < now - window:
            bucket.popleft()
        allowed = len(bucket) < limit
        if allowed:
            bucket.append(now)
        reset = max(int((window - (now - bucket[0])) / MICROS), 1)
        out.append((allowed, max(limit - len(bucket), 0) if allowed else 0, reset))
    return out, list(bucket)


class Walk:
    """Walks sorted requests slice by slice; holds the window of the current key."""

    def __init__(self, window: int, limit: int, carries: dict[int, list[int]]):
        self.window, self.limit, self.carries = window, limit, carries
        self.slice: int | None = None
        self.key: str | None = None
        self.first: tuple[str, int] = ("", 0)
        self.bucket: list[int] = []

    def end(self) -> dict:
        """Where the slice that has just been walked began and what it leaves."""
        return {"slice": self.slice, "first_key": self.first[0], "first_time": self.first[1], "last_key": self.key, "bucket": self.bucket}

    def pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[bool, list[tuple[bool, int, int]]]]:
        """Per run of one slice and key: whether a new slice begins, and the decisions."""
        slices, keys, times = (batch.column(c).to_pylist() for c in ("_slice", "_key", "_t"))
        at = 0
        while at < len(times):
            upto = at + 1
            while upto < len(times) and slices[upto] == slices[at] and keys[upto] == keys[at]:
                upto += 1
            opens = slices[at] != self.slice
            if opens:
                yield True, []
                self.slice, self.key, self.first = slices[at], keys[at], (keys[at], times[at])
                self.bucket = list(self.carries.get(slices[at], ()))
            elif keys[at] != self.key:
                self.key, self.bucket = keys[at], []
            decisions, self.bucket = admit(times[at:upto], self.window, self.limit, self.bucket)
            yield False, decisions
            at = upto


ENDS = pa.schema([("slice", pa.int32()), ("first_key", pa.string()), ("first_time", pa.int64()), ("last_key", pa.string()), ("bucket", pa.list_(pa.int64()))])


def _ends(batches: Iterator[pa.RecordBatch], window: int, limit: int, carries: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    walk = Walk(window, limit, carries)
    for batch in batches:
        for opens, _ in walk.pieces(batch):
            if opens and walk.slice is not None:
                yield pa.RecordBatch.from_pylist([walk.end()], schema=ENDS)
    if walk.slice is not None:
        yield pa.RecordBatch.from_pylist([walk.end()], schema=ENDS)


def _decisions(batches: Iterator[pa.RecordBatch], window: int, limit: int, carries: dict[int, list[int]], kept: list[str]) -> Iterator[pa.RecordBatch]:
    walk = Walk(window, limit, carries)
    for batch in batches:
        rows = [d for _, decisions in walk.pieces(batch) for d in decisions]
        columns = list(zip(*rows)) or [(), (), ()]
        made = [pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "allowed", "remaining", "reset_seconds"])


def settled_carries(walked, window: int) -> dict[int, list[int]]:
    """Carry of every slice; ``walked(carries, slices)`` gives the ends of the slices asked for (None: all)."""
    ends = {r["slice"]: r for r in walked({}, None)}
    order = sorted(ends)
    used: dict[int, list[int]] = {n: [] for n in order}
    while True:
        wanted = {}
        for before, n in zip(order, order[1:]):
            if ends[before]["last_key"] == ends[n]["first_key"]:
                wanted[n] = [t for t in ends[before]["bucket"] if t >= ends[n]["first_time"] - window]
        changed = {n: c for n, c in wanted.items() if c != used[n]}
        if not changed:
            return {n: c for n, c in used.items() if c}
        used |= changed
        # A slice in which another key begins leaves the same whatever it was given.
        again = [n for n in changed if ends[n]["first_key"] == ends[n]["last_key"]]
        if again:
            ends |= {r["slice"]: r for r in walked({n: used[n] for n in again}, again)}


def admission_batch(df: DataFrame, *, key: str, ts: str, order: str, limit: int, window_seconds: int = 60, slices: int | None = None) -> DataFrame:
    """(key, order, allowed, remaining, reset_seconds) for every request of a table.

    Requests of equal time stand by ``order``.  ``slices`` sets their number, else the shuffle does.
    Null keys are one key; requests without a time are left out.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    window, types = window_seconds * MICROS, dict(df.dtypes)
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = df.select(key, order, named.alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).filter("_t is not null")
    by = ["_key", "_t", order]
    dealt = rows.repartitionByRange(slices, *by) if slices else rows.repartitionByRange(*by)
    rows = materialize(dealt.withColumn("_slice", F.spark_partition_id()), "admission-slices")
    sorted_rows = lambda part: part.repartition(F.col("_slice")).sortWithinPartitions("_slice", *by)

    def walked(carries: dict[int, list[int]], some: list[int] | None) -> list:
        part = rows if some is None else rows.filter(F.col("_slice").isin(some))
        run = partial(_ends, window=window, limit=limit, carries=carries)
        found = sorted_rows(part.select("_slice", "_key", "_t", order)).mapInArrow(run, "slice int, first_key string, first_time long, last_key string, bucket array<long>")
        return [r.asDict() for r in found.collect()]  # one row for each slice

    run = partial(_decisions, window=window, limit=limit, carries=settled_carries(walked, window), kept=[key, order])
    schema = f"{key} {types[key]}, {order} {types[order]}, allowed boolean, remaining int, reset_seconds int"
    return sorted_rows(rows).mapInArrow(run, schema)


class SlidingAdmission(StatefulProcessor):
    """Keeps the admitted times of a key; an event-time timer clears idle keys."""

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getListState("bucket", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "id"])
        stored = [r[0] for r in self.bucket.get()]
        decisions, left = admit(pdf["t"].tolist(), self.window, self.limit, stored)
        self.bucket.put([(t,) for t in left])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        self.handle.registerTimer((int(pdf["t"].max()) + self.window) // 1000 + 1)
        yield pd.DataFrame(
            [(key[0], int(i), *d) for i, d in zip(pdf["id"], decisions)],
            columns=["key", "id", "allowed", "remaining", "reset_seconds"],
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter([])

    def close(self) -> None:
        pass


def admission_stream(stream: DataFrame, *, key: str, ts: str, id: str, limit: int, window_seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Stateful form; equals the batch replay for input in order within the watermark delay."""
    shaped = stream.select(
        F.col(key).cast("string").alias("key"), F.col(id).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(ts).cast("timestamp").alias("ts")
    ).withWatermark("ts", delay)
    return shaped.groupBy("key").transformWithStateInPandas(
        SlidingAdmission(limit, window_seconds),
        outputStructType="key string, id long, allowed boolean, remaining int, reset_seconds int",
        outputMode="Append",
        timeMode="EventTime",
    )
