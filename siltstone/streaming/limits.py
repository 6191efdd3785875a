"""Rate limits: token buckets and concurrency, as batch replays and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step(tokens: float, last: float, now: float, rate: float) -> tuple[float, bool]:
    """A bucket with burst 2 x rate at time `now`: what is left, and whether the request passes."""
    tokens = min(2 * rate, tokens + max(now - last, 0.0) * rate)
    return (tokens - 1, True) if tokens >= 1 else (tokens, False)


def token_bucket(events: DataFrame, rate: float, key: str = "user_id", at: str = "seconds") -> DataFrame:
    """events with `passed`, each key's requests in the order of (seconds, event_id)."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, "event_id"], kind="stable")
        tokens, last, out = 2 * rate, None, []
        for now in pdf[at]:
            tokens, ok = step(tokens, now if last is None else last, now, rate)
            last = now
            out.append(ok)
        return pdf.assign(passed=out)[["event_id", key, at, "passed"]]

    return events.select("event_id", key, F.col(at).cast("double").alias(at)).groupBy(key).applyInPandas(replay, f"event_id long, {key} long, {at} double, passed boolean")


def token_bucket_stream(events: DataFrame, rate: float, key: str = "user_id", at: str = "seconds") -> DataFrame:
    """The same over a stream, state by key; a key idle long enough to be full again loses its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (2 * rate, None)
        for pdf in frames:
            pdf, out = pdf.sort_values([at, "event_id"], kind="stable"), []
            for now in pdf[at]:
                tokens, ok = step(tokens, now if last is None else last, now, rate)
                last = now
                out.append(ok)
            yield pdf.assign(passed=out)[["event_id", key, at, "passed"]]
        state.update((tokens, last))
        state.setTimeoutDuration(max(1, int(2000 / rate)) + 1000)

    rows = events.select("event_id", key, F.col(at).cast("double").alias(at))
    return rows.groupBy(key).applyInPandasWithState(update, f"event_id long, {key} long, {at} double, passed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def concurrency(sessions: DataFrame, key: str) -> DataFrame:
    """The most sessions (begin, finish) of each key at once; one that ends as another begins is no longer there."""
    marks = sessions.select(key, F.explode(F.array(F.struct(F.col("begin").alias("t"), F.lit(1).alias("d")), F.struct(F.col("finish").alias("t"), F.lit(-1).alias("d")))).alias("m")).select(key, "m.t", "m.d")
    w = Window.partitionBy(key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("live", F.sum("d").over(w)).groupBy(key).agg(F.max("live").cast("long").alias("most"))


def bandwidth(slices: DataFrame, rate: float, key: str = "server") -> DataFrame:
    """slices (key, seconds, bytes) with the time each has to wait: a shared bucket that may go into debt."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seconds", kind="stable")
        free, last, wait = rate, None, []
        for now, n in zip(pdf["seconds"], pdf["bytes"]):
            free = min(rate, free + (now - last) * rate if last is not None else free) - n
            last = now
            wait.append(max(0.0, -free / rate))
        return pdf.assign(wait=wait)

    return slices.select(key, "seconds", "bytes").groupBy(key).applyInPandas(replay, f"{key} long, seconds double, bytes long, wait double")
