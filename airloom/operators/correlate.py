"""Weather and online traffic against routes and airports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.geo import NM_RADIUS, corridor_hits, haversine_nm, planar_segment_nm
from airloom.functions.text import callsign_airport, facility
from airloom.tables import small_side

GROUND_NM = 5.0
#: Degrees; height of a cell that pairs airports with aircraft on the ground.
CELL = 0.1


def airborne(groundspeed: Column, altitude: Column) -> Column:
    return (groundspeed >= 40) | (altitude > 500)


def traffic_on_route(points: DataFrame, route: list[tuple[float, float]], limit_nm: float) -> DataFrame:
    """Points (lat, lon) within ``limit_nm`` of a route, with their distance; the route's segments are literals."""
    legs = [planar_segment_nm(F.col("lat"), F.col("lon"), F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1])) for a, b in zip(route, route[1:])]
    d = F.least(*legs) if len(legs) > 1 else legs[0]
    return points.withColumn("distance_nm", d).filter(F.col("distance_nm") <= limit_nm)


def route_sigmets(areas: DataFrame, route: list[tuple[float, float]], corridor_nm: float, at: Column) -> DataFrame:
    """Areas valid at an instant (both ends included) that the corridor meets."""
    path = F.array(*[F.struct(F.lit(lon).alias("lon"), F.lit(lat).alias("lat")) for lat, lon in route])
    return areas.filter(at.between(F.col("valid_from"), F.col("valid_to"))).filter(corridor_hits(path, F.col("area"), corridor_nm))


def period_at(tafs: DataFrame, eta: Column) -> DataFrame:
    """The period of each forecast that holds at ``eta``, else its first one."""
    hit = F.get(F.filter("periods", lambda p: (eta >= p["from"]) & (eta < p["to"])), F.lit(0))
    return tafs.withColumn("period", F.coalesce(hit, F.get("periods", F.lit(0))))


def route_controllers(controllers: DataFrame, departure: str, arrival: str, enroute: list[tuple[str, str]]) -> DataFrame:
    """Controllers a flight meets with the rule that says so: its airports first, then enroute callsign prefixes."""
    c = controllers.withColumn("airport", callsign_airport(F.col("callsign"))).withColumn("facility", facility(F.col("callsign")))
    rule = F.when(F.col("airport") == departure, "departure").when(F.col("airport") == arrival, "arrival")
    for prefix, name in enroute:
        rule = rule.when(F.col("callsign").startswith(prefix) & F.col("facility").isin("CTR", "FSS"), name)
    order = F.when(F.col("facility") == "DEL", 0).when(F.col("facility") == "GND", 1).when(F.col("facility") == "TWR", 2).when(F.col("facility") == "DEP", 3).when(F.col("facility") == "CTR", 4).otherwise(5)
    return c.withColumn("rule", rule).filter("rule is not null").orderBy(F.when(F.col("rule") == "departure", 0).when(F.col("rule") == "arrival", 2).otherwise(1), order, "callsign")


def _row(lat: Column) -> Column:
    return F.floor(lat / CELL)


def _column(lon: Column, row: Column) -> Column:
    """The column of a longitude in its row, not yet taken around the globe."""
    return F.floor(lon * _columns(row) / 360)


def _columns(row: Column) -> Column:
    """Cells around the globe in a row: about ``CELL`` wide at its edge nearer to the pole, one at the pole itself."""
    r = row.cast("double")
    edge = F.least(F.greatest(F.abs(r), F.abs(r + 1)) * CELL, F.lit(90.0))
    return F.greatest(F.floor(F.cos(F.radians(edge)) * (360 / CELL)), F.lit(1))


def airport_traffic(pilots: DataFrame, airports: DataFrame) -> DataFrame:
    """Per airport: flights filed in and out, and aircraft on the ground within 5 NM; airports without an ident fall away.

    An airport stands in one cell and a ground aircraft in all that its circle touches, also beyond the antimeridian and
    around the poles, so the work follows local density. Sizes are estimated as if no cells had been exploded; the hint
    therefore keeps the join from being a broadcast, and the counts are added up in one aggregation instead of joined.
    """
    reach = math.degrees(GROUND_NM / NM_RADIUS) + 1e-6
    lat, lon, row = F.col("lat"), F.col("lon"), F.col("cy")
    wide = F.when(F.abs(lat) + reach >= 90, 180.0).otherwise(F.degrees(F.asin(math.sin(math.radians(reach)) / F.cos(F.radians(lat)))) + 1e-6)
    around = F.array_distinct(F.transform(F.sequence(_column(lon - wide, row), _column(lon + wide, row)), lambda x: F.pmod(x, _columns(row))))
    a = airports.select("ident", F.col("lat").alias("la"), F.col("lon").alias("lo"), _row(lat).alias("cy")).withColumn("cx", F.pmod(_column(F.col("lo"), row), _columns(row)))
    p = pilots.filter(~airborne(F.col("groundspeed"), F.col("altitude")) & ~F.isnan("lat") & ~F.isnan("lon")).select("callsign", "lat", "lon", F.explode(F.sequence(_row(lat - reach), _row(lat + reach))).alias("cy"))
    p = p.select("callsign", "lat", "lon", "cy", F.explode(around).alias("cx"))
    near = a.join(p.hint("merge"), ["cy", "cx"]).filter(haversine_nm(F.col("la"), F.col("lo"), lat, lon) <= GROUND_NM)
    ground = near.filter("callsign is not null").select("ident", "callsign").distinct()

    filed = pilots.select(F.explode(F.array(F.struct(F.col("departure").alias("ident"), F.lit("filed_out").alias("what")), F.struct(F.col("arrival").alias("ident"), F.lit("filed_in").alias("what")))).alias("f")).select("f.*")
    rows = filed.unionByName(ground.select("ident", F.lit("on_ground").alias("what"))).unionByName(airports.select("ident", F.lit("airport").alias("what"))).filter("ident is not null")
    counts = rows.groupBy("ident").agg(*[F.count_if(F.col("what") == c).alias(c) for c in ("filed_out", "filed_in", "on_ground", "airport")])
    return counts.filter("airport > 0").drop("airport")


def runway_ils(runways: DataFrame, ils: DataFrame) -> DataFrame:
    """Runways with the localizers of their ends; the course is aligned (< 5), offset (to 30) or suspicious."""
    ends = runways.select("id", "airport_ident", F.explode(F.array(F.struct(F.col("le_ident").alias("rwy"), F.col("heading").alias("course")), F.struct(F.col("he_ident").alias("rwy"), F.pmod(F.col("heading") + 180, F.lit(360.0)).alias("course")))).alias("e")).select("id", "airport_ident", "e.*")
    j = ends.join(ils.select("airport_ident", F.col("runway").alias("rwy"), F.col("localizer_ident"), F.col("bearing_deg")), ["airport_ident", "rwy"])
    delta = F.abs(F.pmod(F.col("bearing_deg") - F.col("course") + 540, F.lit(360.0)) - 180)
    return j.withColumn("delta_deg", delta).withColumn("class", F.when(delta < 5, "ALIGNED").when(delta <= 30, "OFFSET").otherwise("SUSPICIOUS"))


def ttl_latest(rows: DataFrame, keys: list[str], order: str, now: Column, ttl: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key, of equals the one with the highest ``tie``, that has not expired at ``now``."""
    cols = rows.columns
    g = rows.filter(F.col(order) <= now).groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(order, *([tie] if tie else []))).alias("r")).select("r.*")
    return g.filter(F.col(order) + F.expr(f"interval {ttl}") > now)


def nearest_per(points: DataFrame, targets: DataFrame, n: int, within_nm: float) -> DataFrame:
    """The ``n`` nearest targets of each point within a distance, by one-degree latitude bands."""
    band = within_nm / 60 + 1e-6
    a = points.withColumn("b", F.explode(F.array(*[F.floor(F.col("lat") / band) + i for i in (-1, 0, 1)])))
    t = small_side(targets.select(F.col("id").alias("target"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), F.floor(F.col("lat") / band).alias("b")))
    j = a.join(t, "b").withColumn("distance_nm", haversine_nm(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"))).filter(F.col("distance_nm") <= within_nm)
    w = Window.partitionBy("id").orderBy("distance_nm", "target")
    return j.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).select("id", "target", "distance_nm", "nth")


#: Code, severity and condition of the advisories.
ADVISORIES = [
    ("OFF_ROUTE", "warning", "abs(xtk_nm) > 5"), ("TELEMETRY_STALE", "warning", "stale"), ("TOD_NEAR", "info", "tod_nm between 0 and 10"), ("TOD_PASSED", "warning", "tod_nm = 0 and vs > -200 and to_go < 120"),
    ("HIGH_ON_PROFILE", "warning", "profile_ft > 200 and to_go < 120"), ("LOW_ON_PROFILE", "warning", "profile_ft < -200 and to_go < 120"), ("SPEED_LIMIT", "warning", "altitude < 10000 and speed > 250"), ("SOURCE_REQUIRED", "info", "source_required"),
]


def advisories(state: DataFrame) -> DataFrame:
    """A row per advisory that the latest state of a session asks for."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in ADVISORIES]))
    return state.select("session_id", F.explode(found).alias("a")).select("session_id", "a.*")
