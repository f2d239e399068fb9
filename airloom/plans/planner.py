"""Flight planning: pieces found with queries, one plan put together on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions.geo import bearing, haversine_nm, wind_components
from airloom.operators.graph import shortest

#: Distances of procedure legs, which carry no position, in NM.
SID_NM, STAR_NM, APPROACH_NM = 5.0, 5.0, 3.0
#: Aircraft -> runway ft, width ft, least and most NM, hard surface, cruise kt.
AIRCRAFT = {
    "B744": (8500, 150, 1000, 7500, True, 490), "A320": (6000, 100, 250, 3200, True, 450), "E190": (5000, 90, 150, 1800, True, 420), "B350": (3500, 0, 80, 1200, False, 280), "C172": (1800, 0, 30, 500, False, 120),
    "T154": (7500, 120, 250, 2800, True, 460), "IL76": (6500, 120, 400, 3600, False, 430), "IL96": (8500, 150, 800, 6200, True, 470), "AN24": (4500, 0, 80, 1200, False, 240), "YK40": (4000, 0, 60, 950, False, 280),
}


@dataclass
class Request:
    origin: str
    destination: str
    aircraft: str = "A320"
    wind_from: float | None = None
    wind_kt: float = 0.0


@dataclass
class Leg:
    to: str
    distance_nm: float
    kind: str
    via: str = ""


@dataclass
class Plan:
    request: Request
    legs: list[Leg] = field(default_factory=list)
    runways: dict[str, str] = field(default_factory=dict)
    issues: list[str] = field(default_factory=list)

    @property
    def distance_nm(self) -> float:
        return sum(x.distance_nm for x in self.legs)

    @property
    def minutes(self) -> int:
        return round(self.distance_nm / AIRCRAFT.get(self.request.aircraft, (0, 0, 0, 0, False, 450))[5] * 60) + 20

    def route(self) -> str:
        """Fixes with the airways between them, an airway named once for the legs it holds."""
        out = [self.request.origin]
        for i, leg in enumerate(self.legs):
            nxt = self.legs[i + 1] if i + 1 < len(self.legs) else None
            if leg.via and nxt and nxt.via == leg.via:
                continue
            out += [leg.via or "DCT", leg.to]
        return " ".join(out)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, x.to, float(x.distance_nm), x.kind, x.via) for i, x in enumerate(self.legs)]
        return spark.createDataFrame(rows, "leg int, to_fix string, distance_nm double, kind string, via string")


def suggest_runway(runways: DataFrame, wind_from: float | None, wind_kt: float) -> DataFrame:
    """(airport_ident, runway): the end with most headwind, of equals the longer and then the first by name; the longest without wind."""
    ends = runways.select("airport_ident", "length_ft", F.explode(F.array(F.struct(F.col("le_ident").alias("rwy"), F.col("heading").alias("h")), F.struct(F.col("he_ident").alias("rwy"), F.pmod(F.col("heading") + 180, F.lit(360.0)).alias("h")))).alias("e")).select("airport_ident", "length_ft", "e.*").filter("rwy is not null")
    head = F.lit(0.0) if wind_from is None else F.round(wind_components(F.col("h"), F.lit(float(wind_from)), F.lit(float(wind_kt)))["headwind"], 3)
    g = ends.groupBy("airport_ident").agg(F.min_by("rwy", F.struct((-head).alias("w"), (-F.col("length_ft")).alias("l"), "rwy")).alias("runway"))
    return g


def plan(airports: DataFrame, runways: DataFrame, nodes: DataFrame, edges: DataFrame, req: Request) -> Plan:
    """Airports (ident, lat, lon), runways, graph nodes (node, lat, lon) and edges (src, dst, route_ident, cost)."""
    p = Plan(req)
    ends = {r["ident"]: r for r in airports.filter(F.col("ident").isin(req.origin, req.destination)).dropDuplicates(["ident"]).collect()}
    missing = [i for i in (req.origin, req.destination) if i not in ends]
    if missing:
        p.issues += [f"unknown airport {i}" for i in missing]
        return p
    p.runways = {r["airport_ident"]: r["runway"] for r in suggest_runway(runways.filter(F.col("airport_ident").isin(req.origin, req.destination)), req.wind_from, req.wind_kt).collect()}
    o, d = ends[req.origin], ends[req.destination]

    def gate(a) -> tuple | None:
        nm = haversine_nm(F.lit(float(a["lat"])), F.lit(float(a["lon"])), F.col("lat"), F.col("lon"))
        return nodes.withColumn("nm", nm).orderBy("nm", "node").select("node", "nm").first()

    g0, g1 = gate(o), gate(d)
    way = shortest(edges, edges.sparkSession.createDataFrame([(g0["node"], g1["node"])], "origin string, destination string")).first() if g0 and g1 and g0["node"] != g1["node"] else None
    if way is None:
        direct = airports.sparkSession.range(1).select(haversine_nm(F.lit(float(o["lat"])), F.lit(float(o["lon"])), F.lit(float(d["lat"])), F.lit(float(d["lon"])))).first()[0]
        p.legs = [Leg(req.destination, direct, "direct")]
        p.issues.append("no airway route")
        return p
    hops = list(zip(way["path"], way["path"][1:]))
    named = {(r["src"], r["dst"]): (r["via"], r["cost"]) for r in edges.filter(F.struct("src", "dst").isin([F.struct(F.lit(a), F.lit(b)) for a, b in hops])).groupBy("src", "dst").agg(F.min("route_ident").alias("via"), F.min("cost").alias("cost")).collect()} if hops else {}
    p.legs = [Leg(g0["node"], g0["nm"], "sid")]
    p.legs += [Leg(b, named[(a, b)][1], "enroute", named[(a, b)][0]) for a, b in hops]
    p.legs.append(Leg(req.destination, g1["nm"], "arrival"))
    lo, hi = AIRCRAFT.get(req.aircraft, (0, 0, 0, 10**6))[2:4]
    if not lo <= p.distance_nm <= hi:
        p.issues.append("distance outside the aircraft's range")
    return p


def revalidate(p: Plan) -> list[str]:
    """What no longer holds of a plan."""
    out = list(p.issues)
    if not p.legs or p.legs[-1].to != p.request.destination:
        out.append("the last leg does not end at the destination")
    out += [f"leg {i} has no length" for i, x in enumerate(p.legs) if x.distance_nm < 0]
    return out


def direct_to(p: Plan, fix: str, distance_nm: float) -> Plan:
    """The plan from here straight to one of its fixes."""
    at = next((i for i, x in enumerate(p.legs) if x.to == fix), None)
    if at is None:
        raise ValueError(f"{fix} is not on the route")
    return Plan(p.request, [Leg(fix, distance_nm, "direct"), *p.legs[at + 1 :]], p.runways, [])


def random_pairs(seed: int, idents: list[str], n: int) -> list[tuple[str, str]]:
    """Pairs of different idents by a 64-bit xorshift of ``seed``."""
    x, out, mask = seed or 0x9E3779B97F4A7C15, [], (1 << 64) - 1
    for _ in range(2000):
        picks = []
        for _ in range(2):
            x ^= (x << 13) & mask
            x ^= x >> 7
            x ^= (x << 17) & mask
            picks.append(idents[x % len(idents)])
        if picks[0] != picks[1]:
            out.append((picks[0], picks[1]))
        if len(out) == n:
            break
    return out


class PlanStore:
    """Plans as JSON files, one each."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def save(self, name: str, p: Plan) -> None:
        (self.folder / f"{name}.json").write_text(json.dumps(asdict(p)))

    def load(self, name: str) -> Plan:
        d = json.loads((self.folder / f"{name}.json").read_text())
        return Plan(Request(**d["request"]), [Leg(**x) for x in d["legs"]], d["runways"], d["issues"])

    def names(self) -> list[str]:
        return sorted(f.stem for f in self.folder.glob("*.json"))

    def delete(self, name: str) -> None:
        (self.folder / f"{name}.json").unlink()


def track_of(legs: DataFrame) -> DataFrame:
    """Bearing and length of legs with positions at both ends."""
    c = [F.col(x) for x in ("lat1", "lon1", "lat2", "lon2")]
    return legs.withColumn("track_deg", bearing(*c)).withColumn("length_nm", haversine_nm(*c))
