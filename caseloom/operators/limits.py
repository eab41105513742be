"""Limits on calls, replayed over a log: circuit breakers, adaptive delays and running ratios, one caller at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def circuit(log: DataFrame, by: str, failures: int = 5, timeout_s: float = 60.0, successes: int = 2) -> DataFrame:
    """log (by, ts, event_id, success) with `state` before each call and whether it was `allowed`.

    So many failures in a row open the circuit; after the timeout one call at a time is let through, and so many
    successes close it again. Calls that aren't allowed change nothing.
    """

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        state, bad, good, opened, states, allowed = "closed", 0, 0, None, [], []
        for ts, ok in zip(rows["ts"], rows["success"], strict=True):
            if state == "open" and (ts - opened).total_seconds() >= timeout_s:
                state, good = "half_open", 0
            states.append(state)
            allowed.append(state != "open")
            if state == "open":
                continue
            if ok:
                bad, good = 0, good + 1
                if state == "half_open" and good >= successes:
                    state = "closed"
            else:
                bad += 1
                if state == "half_open" or bad >= failures:
                    state, opened, bad = "open", ts, 0
        return rows.assign(state=states, allowed=allowed)

    return log.groupBy(by).applyInPandas(replay, log.withColumns({"state": F.lit(""), "allowed": F.lit(True)}).schema)


def delays(log: DataFrame, by: str, target_ms: float, rate: float = 0.1, most_ms: float = 5000.0, samples: int = 3, keep: int = 10) -> DataFrame:
    """log (by, ts, event_id, ms) with `delay_ms` after each call: raised by a share of what the mean of the last calls is over the target, lowered by half that below."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        mean, delay, out = rows["ms"].rolling(keep, min_periods=samples).mean(), 0.0, []
        for m in mean:
            if m == m:
                delay = min(most_ms, delay + (m - target_ms) * rate) if m > target_ms else max(0.0, delay - (target_ms - m) * rate / 2)
            out.append(delay)
        return rows.assign(delay_ms=out)

    return log.groupBy(by).applyInPandas(replay, log.withColumn("delay_ms", F.lit(0.0)).schema)


def timeout_bands(requests: DataFrame, limit_s: float) -> DataFrame:
    """Open requests (started, now) with the highest band of their limit that they have passed: 90, 75, 50, or null."""
    share = (F.col("now").cast("double") - F.col("started").cast("double")) / limit_s
    return requests.withColumn("band", F.when(share >= 0.9, 90).when(share >= 0.75, 75).when(share >= 0.5, 50))


def cache_key(text: Column, mode: Column, strategy: Column, options: Column) -> Column:
    """Under which an answer is cached: hashes of the text and of the options, with mode and strategy."""
    return F.concat_ws(":", F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16), mode, F.coalesce(strategy, F.lit("none")), F.substring(F.md5(options), 1, 8))


def cache_reads(reads: DataFrame, ttl_s: float) -> DataFrame:
    """reads (key, ts) with `hit`: whether the key was read within its time to live before, each read renewing it."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    return reads.withColumn("hit", F.coalesce(F.col("ts").cast("double") - before.cast("double") <= ttl_s, F.lit(False)))
