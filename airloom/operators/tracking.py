"""Live flight tracking: a pure step per telemetry sample, used alike in batch replay and in the stateful stream."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.geo import haversine_nm

#: Samples of another phase in a row that are needed to enter a phase; two for those not named.
TICKS = {"takeoff": 1, "landing": 1, "initial_climb": 1, "go_around": 1, "climb": 3, "descent": 3, "cruise": 3}
AIRBORNE = {"initial_climb", "climb", "cruise", "descent", "approach", "go_around"}
TELEPORT_NM, OFF_ROUTE_NM, STALE_S = 50.0, 5.0, 5.0
RADIUS_NM = {"approach": 0.8, "terminal": 1.5}


@dataclass
class Phase:
    phase: str = "preflight"
    ticks: int = 0
    airborne: bool = False


#: Phase, on the ground, flown before, and what else must hold; the first row that holds is the phase.
PHASES = [
    ("preflight", True, False, "speed < 5"),
    ("taxi_out", True, False, "speed < 40"),
    ("takeoff", True, False, "true"),
    ("landing", True, True, "speed > 35"),
    ("taxi_in", True, True, "speed > 3"),
    ("parked", True, True, "true"),
    ("initial_climb", False, False, "over_departure < 1500 and vs > 300"),
    ("go_around", False, True, "to_go < 15 and over_destination < 3000 and vs > 700"),
    ("approach", False, None, "to_go < 25 and vs <= 100 and (over_destination < 4500 or agl < 4000)"),
    ("descent", False, None, "vs < -350 and (to_go < 150 or under_cruise > 1000)"),
    ("climb", False, None, "vs > 350 and under_cruise > 500"),
    ("cruise", False, None, "true"),
]


def phase_candidates(events: DataFrame, dep: float, dest: float, cruise: float) -> DataFrame:
    """Add ``fresh`` and ``flown``: the phase that a sample looks like before and after the flight has been in the air.

    Which of them counts depends on the samples before; the conditions themselves do not and stay in the JVM. A missing
    measurement meets no condition on it.
    """
    seen = events.withColumns({
        "over_departure": F.col("altitude") - dep, "over_destination": F.col("altitude") - dest, "under_cruise": F.lit(cruise) - F.col("altitude"),
    })
    seen = seen.withColumn("agl", F.coalesce("agl", "over_departure") if "agl" in events.columns else F.col("over_departure"))

    def first(flown: bool) -> Column:
        rows = [F.when((F.coalesce("on_ground", F.lit(False)) == ground) & F.expr(rule), phase) for phase, ground, when, rule in PHASES if when in (flown, None)]
        return F.coalesce(*rows)

    return seen.withColumns({"fresh": first(False), "flown": first(True)}).select(*events.columns, "fresh", "flown")


def step(s: Phase, raw: str) -> tuple[Phase, bool]:
    """The next state and whether the phase changed. Any sample of a phase other than the current one counts."""
    if raw == s.phase:
        return Phase(s.phase, 0, s.airborne), False
    if s.ticks + 1 < TICKS.get(raw, 2):
        return Phase(s.phase, s.ticks + 1, s.airborne), False
    return Phase(raw, 0, s.airborne or raw in AIRBORNE), True


def efb_phase(prev: dict, row: dict) -> tuple[dict, str]:
    """The other phase engine: climbs and descents by rate alone, two samples to change, reset when the aircraft is moved
    (over 10,000 ft in under 5 s)."""
    if prev and abs(row["altitude"] - prev["altitude"]) > 10_000 and row["t"] - prev["t"] < 5:
        prev = {}
    speed, vs, ground = row["speed"], row["vs"], row["on_ground"]
    flown = prev.get("flown", False) or not ground
    if ground:
        cand = ("parked" if flown else "gate") if speed < 3 else ("taxi_in" if flown else "taxi_out") if speed < 35 else ("rollout" if flown and prev.get("phase") != "takeoff_roll" else "takeoff_roll")
    else:
        cand = "climb" if vs > 500 else "descent" if vs < -500 else "level"
    seen = prev.get("seen", 0) + 1 if cand == prev.get("cand") else 1
    phase = cand if seen >= 2 or not prev else prev.get("phase", cand)
    return {"altitude": row["altitude"], "t": row["t"], "flown": flown, "cand": cand, "seen": seen, "phase": phase}, phase


def advance(leg: int, along_nm: float, length_nm: float, to_fix_nm: float, kind: str) -> int:
    """The active leg after a sample: the next one when its end is passed (0.2 NM slack) or within its radius; one at most."""
    return leg + 1 if along_nm >= length_nm - 0.2 or to_fix_nm <= RADIUS_NM.get(kind, 2.5) else leg


def _run_ends(x: np.ndarray) -> np.ndarray:
    """For each position the end of the run of equal values that it lies in."""
    cuts = np.append(np.nonzero(x[1:] != x[:-1])[0] + 1, len(x))
    return cuts[np.searchsorted(cuts, np.arange(len(x)), side="right")]


def count_up(state: Phase, fresh: np.ndarray, flown: np.ndarray) -> tuple[Phase, np.ndarray, np.ndarray]:
    """(state after, phase of each sample, whether it changed there); samples that confirm the phase are taken in runs."""
    n = len(fresh)
    out, changed = np.empty(n, dtype=object), np.zeros(n, dtype=bool)
    if not n:
        return state, out, changed
    ends = {False: _run_ends(fresh), True: _run_ends(flown)}
    i = 0
    while i < n:
        raw = flown if state.airborne else fresh
        if raw[i] == state.phase:
            j = int(ends[state.airborne][i])
            out[i:j] = state.phase
            state, i = Phase(state.phase, 0, state.airborne), j
        else:
            state, changed[i] = step(state, raw[i])
            out[i], i = state.phase, i + 1
    return state, out, changed


def replay(events: DataFrame, dep: float = 0.0, dest: float = 0.0, cruise: float = 35_000.0) -> DataFrame:
    """Phase of every sample of every session (session_id, ts, event_id, on_ground, speed, altitude, vs, to_go).

    Sessions are sorted within partitions and streamed with their state, so none is gathered whole however long it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, Phase()
        for b in batches:
            ids = b["session_id"].to_numpy()
            fresh, flown = b["fresh"].to_numpy(), b["flown"].to_numpy()
            starts = np.append(0, np.nonzero(ids[1:] != ids[:-1])[0] + 1) if len(ids) else np.empty(0, dtype=int)
            phases, changed = np.empty(len(b), dtype=object), np.zeros(len(b), dtype=bool)
            for i, j in zip(starts, np.append(starts[1:], len(ids))):
                if ids[i] != session:
                    session, state = ids[i], Phase()
                state, phases[i:j], changed[i:j] = count_up(state, fresh[i:j], flown[i:j])
            yield pd.DataFrame({"session_id": ids, "event_id": b["event_id"], "phase": phases, "changed": changed})

    kind = events.schema["session_id"].dataType.simpleString()
    seen = phase_candidates(events, dep, dest, cruise).select("session_id", "ts", "event_id", "fresh", "flown")
    spread = seen.repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id")
    return spread.mapInPandas(run, f"session_id {kind}, event_id long, phase string, changed boolean")


def progress(events: DataFrame) -> DataFrame:
    """Running distance flown of each session (session_id, ts, event_id, lat, lon); jumps of 50 NM and more do not count."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    hop = haversine_nm(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    hops = events.withColumn("hop_nm", F.coalesce(hop, F.lit(0.0)))
    flown = F.sum(F.when(F.col("hop_nm") < TELEPORT_NM, F.col("hop_nm")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return hops.withColumn("flown_nm", flown)


def remaining(fixes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``remaining_nm``: the distance along the fixes (lat, lon) of a key that follow this one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    legs = fixes.withColumn("__nm", haversine_nm(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    ahead = F.sum("__nm").over(w.rowsBetween(1, Window.unboundedFollowing))
    return legs.withColumn("remaining_nm", F.coalesce(ahead, F.lit(0.0))).drop("__nm")


def deltas(snapshots: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Add ``fields``: the names of those that differ from the snapshot before of the same key, none for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = snapshots.withColumn("__p", F.lag(F.struct(*fields)).over(w))
    names = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__p.{f}")), F.lit(f)) for f in fields]))
    return before.withColumn("fields", F.when(F.col("__p").isNotNull(), names).otherwise(F.array().cast("array<string>"))).drop("__p")


def estimates(distance_nm, groundspeed, paused):
    """Seconds to fly a distance; null under 15 kt or when paused."""
    return F.when((groundspeed >= 15) & ~paused, F.round(distance_nm / groundspeed * 3600).cast("long"))


def state_dict(s: Phase) -> dict:
    return asdict(s)


def finite(x: float) -> bool:
    return x is not None and math.isfinite(x)
