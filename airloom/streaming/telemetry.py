"""Telemetry as a stateful stream: the phase engine of operators.tracking, one state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from airloom.operators.tracking import STALE_S, Phase, count_up, phase_candidates

OUTPUT = "session_id long, event_id long, phase string, flown_nm double, status string"
STATE = "phase string, ticks int, airborne boolean, lat double, lon double, flown double, event_id long"


def _nm(a: float, b: float, c: float, d: float) -> float:
    import math

    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3440.065 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def track(stream: DataFrame, dep: float = 0.0, dest: float = 0.0, cruise: float = 35_000.0, stale_ms: int = int(STALE_S * 1000)) -> DataFrame:
    """A row per sample, and a STALE row for a session that has been silent.

    Samples of a micro-batch are taken in order of time; one that is not later than the last sample is ignored.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            phase, _, _, _, _, flown, last = state.get
            state.setTimeoutDuration(24 * 3600 * 1000)
            yield pd.DataFrame([(key[0], last, phase, flown, "STALE")], columns=["session_id", "event_id", "phase", "flown_nm", "status"])
            return
        phase, ticks, air, lat, lon, flown, last = state.get if state.exists else ("preflight", 0, False, None, None, 0.0, -1)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        newest = rows["event_id"].cummax().shift(fill_value=last).clip(lower=last)
        rows = rows[rows["event_id"] > newest]
        s, phases, _ = count_up(Phase(phase, ticks, air), rows["fresh"].to_numpy(), rows["flown"].to_numpy())
        for r, now in zip(rows.itertuples(index=False), phases):
            if lat is not None and (hop := _nm(lat, lon, r.lat, r.lon)) < 50:
                flown += hop
            lat, lon, last = float(r.lat), float(r.lon), int(r.event_id)
            out.append((key[0], last, now, flown, "LIVE"))
        state.update((s.phase, s.ticks, s.airborne, lat, lon, flown, last))
        state.setTimeoutDuration(stale_ms)
        yield pd.DataFrame(out, columns=["session_id", "event_id", "phase", "flown_nm", "status"])

    return phase_candidates(stream, dep, dest, cruise).groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def ring(events: DataFrame, keep: int = 200) -> DataFrame:
    """The last ``keep`` events of each session, newest first by id."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy(F.desc("event_id"))
    return events.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= keep).drop("nth")


def minute_counts(stream: DataFrame, late: str = "5 seconds") -> DataFrame:
    """Events per type and minute with a watermark; what comes later than ``late`` after the newest event is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n"))


def upsert_latest(path: str, keys: list[str], order: str):
    """A foreachBatch function that keeps the newest row per key in a versioned Parquet folder."""
    from airloom.operators.commit import Store

    def write(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, path)
        both = batch if store.version() == 0 else store.table("latest").unionByName(batch)
        cols = both.columns
        newest = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(order, *keys)).alias("r")).select("r.*")
        store.publish({"latest": newest})

    return write
