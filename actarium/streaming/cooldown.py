"""K3 - alerts with a pause per key: a key whose events fill a third of the table is spread over tasks.

An alert passes if its key has passed none within the pause. Time is cut into chunks of several pauses. Whatever passed
last before a chunk, the chunk only needs to know from when on an event may pass again; as two walks that pass the same event
go on alike, a chunk is summed up by few steps ("allowed up to this time: last passed at that time"), found in one sorted
pass over (key, chunk). The steps of a key are then chained in order of the chunks, which gives every chunk the state it
starts with, and a second pass over the chunks marks the events.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Pauses per chunk.
CHUNK = 16
NEVER = -(1 << 62)
_ROWS = 8192


def chunk_steps(times: Iterable[int], start: int, gap: int) -> list[tuple[int, int]]:
    """(allowed up to, last passed) of a chunk that begins at `start`, its events given in order: a walk that may pass from
    time a on ends at the last passed time of the first step whose bound is not below a (none: the chunk passes nothing of it)."""
    walks: deque[tuple[int, int, list[list[int]]]] = deque()  # next allowed time, last passed, their entries as [first, last, time of the last]
    entering, n = True, 0
    for t in times:
        entries: list[list[int]] = []
        while walks and walks[0][0] <= t:
            for first, last, at in walks.popleft()[2]:
                if entries and entries[-1][1] + 1 == first:
                    entries[-1][1:] = last, at
                else:
                    entries.append([first, last, at])
        if entering:
            entries.append([n, n, t])
            entering, n = t < start + gap, n + 1  # the first event past the first pause is the last possible entry
        if entries:
            walks.append((t + gap, t, entries))
    return sorted((at, passed) for _, passed, entries in walks for _, _, at in entries)


def _by_group(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal (key, chunk) in sorted batches; a run may go on in the next batch and is never gathered."""
    rows = (row for b in batches for row in zip(*(b[n].array for n in names), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        group = ahead[:2]

        def run() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[:2] == group:
                yield ahead[2:]
                ahead = next(rows, None)

        here = run()
        yield group, here
        for _ in here:
            pass


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= _ROWS:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def cooldown_alerts(events: DataFrame, minutes: int = 60, chunk: int = CHUNK) -> DataFrame:
    """K3 (batch twin) - key, ts, emitted of every event (key, ts). A null key is a key of its own; an event without a time
    never passes."""
    gap = minutes * 60 * 1_000_000
    width = gap * chunk
    e = events.select(F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit("-")).alias("k"), "ts", F.unix_micros("ts").alias("t"))
    timed = e.where("t is not null").withColumn("chunk", F.floor(F.col("t") / width).cast("long"))

    def summed(batches):
        def rows():
            for (k, c), times in _by_group(batches, ["k", "chunk", "t"]):
                for entry, last in chunk_steps((t for t, in times), c * width, gap):
                    yield k, c, entry, last

        yield from _frames(rows(), ["k", "chunk", "entry", "last"])

    def chained(batches):
        def rows():
            key, allowed = None, NEVER
            for (k, c), steps in _by_group(batches, ["k", "chunk", "entry", "last"]):
                if k != key:
                    key, allowed = k, NEVER
                yield k, c, allowed
                for entry, last in steps:
                    if entry >= allowed:
                        allowed = last + gap
                        break

        yield from _frames(rows(), ["k", "chunk", "allowed"])

    def marked(batches):
        group, allowed = None, NEVER
        for b in batches:
            out = np.zeros(len(b), bool)
            for i, (k, c, t, start) in enumerate(zip(b["k"].array, b["chunk"].array, b["t"].array, b["allowed"].array, strict=True)):
                if (k, c) != group:
                    group, allowed = (k, c), start
                if t >= allowed:
                    out[i], allowed = True, t + gap
            yield pd.DataFrame({"k": b["k"], "ts": b["ts"], "emitted": out})

    sorted_events = timed.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "t")
    steps = sorted_events.select("k", "chunk", "t").mapInPandas(summed, "k string, chunk long, entry long, last long")
    starts = steps.repartition("k").sortWithinPartitions("k", "chunk", "entry").mapInPandas(chained, "k string, chunk long, allowed long")
    begun = timed.join(starts, ["k", "chunk"]).repartition("k", "chunk").sortWithinPartitions("k", "chunk", "t")
    done = begun.mapInPandas(marked, "k string, ts timestamp, emitted boolean")
    done = done.unionByName(e.where("t is null").select("k", "ts", F.lit(False).alias("emitted")))
    return done.select(F.when(F.col("k") != "-", F.substring("k", 2, 1 << 30)).alias("key"), "ts", "emitted")


def cooldown_stream(events: DataFrame, minutes: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """K3 - passed alerts per key (key, ts), final once the watermark has passed them, so that events may come in any order
    and in any number of batches within it. The state of a key is its last passed time and the sorted times that the
    watermark has not reached yet; it expires when both are done with."""
    gap = minutes * 60 * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (NEVER, [])
        final = state.getCurrentWatermarkMs() * 1000
        times = sorted([*held, *(t for b in batches for t in b["t"])])
        end = int(np.searchsorted(np.array(times, np.int64), final, side="right"))
        out = []
        for t in times[:end]:
            if t >= last + gap:
                out.append(t)
                last = t
        rest = times[end:]
        if not rest and last + gap <= final:
            state.remove()
        else:
            state.update((last, rest))
            state.setTimeoutTimestamp(max((rest[0] if rest else last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "t": out})

    timed = events.select("key", "ts", F.unix_micros("ts").alias("t")).withWatermark("ts", watermark)
    passed = timed.groupBy("key").applyInPandasWithState(step, "key string, t long", "last long, held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return passed.select("key", F.timestamp_micros("t").alias("ts"))
