"""A sliding log limiter by key, over tables and over streams."""

from __future__ import annotations

from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.runtime import in_order


def limit_batch(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """hits(key, t, seq) with allowed: under `limit` accepted hits in the last `window` seconds; denied ones aren't logged.

    One ordered pass over each key's hits, which remembers `limit` times at most.
    """
    rows = hits.select("key", F.col("t").cast("double").alias("t"), F.col("seq").cast("long").alias("seq"))

    def fold(batches):
        key, log = object(), deque()
        for b in batches:
            out = []
            for k, t in zip(b.column("key").to_pylist(), b.column("t").to_pylist(), strict=True):
                if k != key:
                    key, log = k, deque()
                out.append(_allow(log, t, limit, window))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("seq"), pa.array(out, pa.bool_())], names=["key", "seq", "allowed"])

    return in_order(rows, "key", ["t", "seq"], fold, f"key {rows.schema['key'].dataType.simpleString()}, seq long, allowed boolean")


def _allow(log: deque, t: float, limit: int, window: float) -> bool:
    while log and t - log[0] >= window:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(t)
    return True


def limit_stream(hits: DataFrame, limit: int, window: float, idle: float | None = None) -> DataFrame:
    """The same over a stream of hits(key, t, seq), with each key's accepted times as state.

    Hits are taken in order of t within a batch, and batches as they come. A key without a
    hit for `idle` seconds of processing time (three windows, if not given) is forgotten.
    """
    wait = int(1000 * (3 * window if idle is None else idle))

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        log, rows = deque(state.get[0] if state.exists else []), []
        for pdf in batches:
            rows.extend(zip(pdf["t"].tolist(), pdf["seq"].tolist(), strict=True))
        out = [(key[0], seq, _allow(log, float(t), limit, window)) for t, seq in sorted(rows)]
        state.update((list(log),))
        state.setTimeoutDuration(max(1, wait))
        yield pd.DataFrame(out, columns=["key", "seq", "allowed"])

    kind = hits.schema["key"].dataType.simpleString()
    return hits.groupBy("key").applyInPandasWithState(step, f"key {kind}, seq long, allowed boolean", "log array<double>", "append", "ProcessingTimeTimeout")
