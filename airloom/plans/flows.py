"""Queries of the operators that work on documents, flights, routes and the versioned store, with their SQL.

Weather and network documents are written as JSON from a table's numbers, read by the sources and handed to the operators;
the SQL works the result out of the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.operators import correlate, graph, temporal
from airloom.plans.functions import _A, _LEGS, _airports, procedure_legs
from airloom.plans.reference import _hav
from airloom.sources import documents
from airloom.streaming import telemetry
from airloom.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: 2025-06-01 00:00:00 UTC
EPOCH = 1_748_736_000
ROUTE = [(48.0, 11.0), (50.0, 8.0), (51.5, 0.0), (53.0, -6.0)]


def _json(c: Column) -> Column:
    """A struct as a JSON array of one object."""
    return F.concat(F.lit("["), F.to_json(c), F.lit("]"))


# --- weather ----------------------------------------------------------------------------------------------------------


def _metar_docs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    clouds = F.when(i % 4 > 0, F.array(F.struct(F.lit("FEW").alias("cover"), F.lit(300).alias("base")), F.struct(F.when(i % 4 == 1, "SCT").otherwise("BKN").alias("cover"), (i * 13 % 60 * 100).cast("int").alias("base")), F.struct(F.lit("OVC").alias("cover"), F.lit(5500).alias("base"))))
    m = F.struct(
        F.col("ident").alias("icaoId"), (i * 60 + EPOCH).alias("obsTime"), (i % 40).cast("double").alias("temp"), F.when(i % 5 == 0, "VRB").otherwise((i % 360).cast("string")).alias("wdir"), (i % 30).cast("int").alias("wspd"),
        F.when(i % 3 == 0, "10+").otherwise((i % 9).cast("string")).alias("visib"), F.lit(1013.25).alias("altim"), clouds.alias("clouds"),
    )
    return _airports(spark, d).select(F.when(i % 2 == 0, _json(m)).otherwise(F.to_json(m)).alias("value"))


_CEIL = "case when id % 4 = 0 then null when id % 4 = 1 then 5500 else least(id * 13 % 60 * 100, 5500) end"
_VIS = "case when id % 3 = 0 then 10.0 else id % 9 end"


@query(f"""with {_A}, m as (select id, ident station, {EPOCH} + id * 60 at_, case when id % 5 > 0 then id % 360 end wind_dir, {_CEIL} c, {_VIS} v from a)
select station, at_ observed_s, wind_dir, c ceiling_ft, v::double visibility_sm, round(1013.25 * 0.0295299830714, 6)::double altimeter_inhg,
case when coalesce(c, 10000) < 500 or v < 1 then 'LIFR' when coalesce(c, 10000) < 1000 or v < 3 then 'IFR' when coalesce(c, 10000) <= 3000 or v <= 5 then 'MVFR' else 'VFR' end category from m""")
def metar_reports(spark: SparkSession, d: str) -> DataFrame:
    """SRC17, F18: reports from JSON, single objects and arrays alike, with ceiling, visibility and category."""
    m = documents.metars(_metar_docs(spark, d))
    return m.select("station", F.unix_seconds("observed_at").alias("observed_s"), "wind_dir", "ceiling_ft", "visibility_sm", F.round("altimeter_inhg", 6).alias("altimeter_inhg"), "category")


def _taf_docs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    start = i % 24 * 3600 + EPOCH
    period = lambda k: F.struct((start + k * 21_600).alias("timeFrom"), (start + k * 21_600 + F.when(i % 3 == 0, 10_800).otherwise(21_600)).alias("timeTo"), ((i + k) % 40).cast("int").alias("wspd"), F.lit("6+").alias("visib"))
    t = F.struct(F.col("ident").alias("icaoId"), F.lit("TAF").alias("rawTAF"), start.alias("validTimeFrom"), F.when(i % 2 == 0, start + 86_400).alias("validTimeTo"), F.array(*[period(k) for k in range(4)]).alias("fcsts"))
    return _airports(spark, d).select(_json(t).alias("value"))


@query(f"""with {_A}, t as (select id, ident, {EPOCH} + id % 24 * 3600 s, {EPOCH} + 50000 - (id % 24 * 3600 + {EPOCH}) into_ from a),
p as (select *, case when into_ >= 0 and into_ < 86400 and into_ % 21600 < case when id % 3 = 0 then 10800 else 21600 end then into_ // 21600 end k from t)
select ident station, s + coalesce(k, 0) * 21600 period_from_s, (id + coalesce(k, 0)) % 40 wind_kt, s + 86400 valid_to_s from p""")
def taf_period_at_eta(spark: SparkSession, d: str) -> DataFrame:
    """J24, SRC18: the forecast period that holds at an instant, else the first one; gaps between periods happen."""
    t = correlate.period_at(documents.tafs(_taf_docs(spark, d)), F.timestamp_seconds(F.lit(EPOCH + 50_000)))
    return t.select("station", F.unix_seconds("period.from").alias("period_from_s"), F.col("period.wind_kt").alias("wind_kt"), F.unix_seconds("valid_to").alias("valid_to_s"))


def _areas(spark: SparkSession, d: str) -> DataFrame:
    """One area a document: a diamond about each airport."""
    i, la, lo = F.col("id"), F.col("latitude_deg"), F.col("longitude_deg")
    size = (i % 7 + 1) * 2.0
    corner = lambda y, x: F.array((lo + size * x).cast("double"), (la + size * y).cast("double"))
    props = F.struct(i.cast("string").alias("isigmetId"), F.lit("SEV ICE").alias("hazard"), (i % 10 * 3600 + EPOCH).alias("validTimeFrom"), F.when(i % 2 == 0, i % 10 * 3600 + EPOCH + 18_000).alias("validTimeTo"))
    f = F.struct(props.alias("properties"), F.struct(F.array(F.array(corner(-1, 0), corner(0, 1), corner(1, 0), corner(0, -1))).alias("coordinates")).alias("geometry"))
    return documents.sigmets(_airports(spark, d).select(F.to_json(F.struct(F.array(f).alias("features"))).alias("value")))


def _areas_sql() -> str:
    corners = [("(lat - s)", "lon"), ("lat", "(lon + s)"), ("(lat + s)", "lon"), ("lat", "(lon - s)")]
    edges = list(zip(corners, corners[1:] + corners[:1]))
    inside = " or ".join("(" + " + ".join(f"case when ({a[0]} > {y}) <> ({b[0]} > {y}) and {x} < ({b[1]} - {a[1]}) * ({y} - {a[0]}) / ({b[0]} - {a[0]}) + {a[1]} then 1 else 0 end" for a, b in edges) + ") % 2 = 1" for y, x in ROUTE)
    near = " or ".join(f"{_hav(str(y), str(x), c[0], c[1])} <= 30" for y, x in ROUTE for c in corners)

    def ccw(p, q, r):
        return f"(({r[0]} - {p[0]}) * ({q[1]} - {p[1]}) > ({q[0]} - {p[0]}) * ({r[1]} - {p[1]}))"

    cross = " or ".join(f"({ccw(a, c, e)} <> {ccw(b, c, e)} and {ccw(a, b, c)} <> {ccw(a, b, e)})" for a, b in zip(ROUTE, ROUTE[1:]) for c, e in edges)
    return f"({inside}) or ({near}) or ({cross})"


@query(f"""with {_A}, p as (select id, lat::double lat, lon::double lon, (id % 7 + 1) * 2.0::double s, id % 10 * 3600 f, id % 10 * 3600 + case when id % 2 = 0 then 18000 else 14400 end u from a)
select id::varchar id, 'ICING' hazard from p where 20000 between f and u and ({_areas_sql()})""")
def route_sigmet_areas(spark: SparkSession, d: str) -> DataFrame:
    """J21, G8, SRC19: areas valid at an instant that the corridor of a route meets: inside, near a corner, or crossed."""
    return correlate.route_sigmets(_areas(spark, d), ROUTE, 30.0, F.timestamp_seconds(F.lit(EPOCH + 20_000))).select("id", "hazard")


@query(f"""with {_A} select coalesce(case when id % 9 > 0 then round(lat, 4) end, 0) lat, {EPOCH} + id observed_s, (id % 400) * 100 altitude_ft, case when id % 2 = 0 then 'SEV' else 'CHOP' end turbulence from a""")
def pilot_reports(spark: SparkSession, d: str) -> DataFrame:
    """SRC20: a missing position is 0, intensity stands before type."""
    i = F.col("id")
    p = F.struct(F.when(i % 9 > 0, F.round("latitude_deg", 4)).alias("lat"), F.round("longitude_deg", 4).alias("lon"), (i + EPOCH).alias("obsTime"), F.lpad((i % 400).cast("string"), 3, "0").alias("fltLvl"), F.lit("CHOP").alias("tbType"), F.when(i % 2 == 0, "SEV").alias("tbInt"))
    r = documents.pireps(_airports(spark, d).select(_json(p).alias("value")))
    return r.select("lat", F.unix_seconds("observed_at").alias("observed_s"), "altitude_ft", "turbulence")


# --- network ----------------------------------------------------------------------------------------------------------


def _network(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """One document per airport: a pilot near it, filed to the next ident of its country, and a controller."""
    i = F.col("id")
    pilot = F.struct(
        i.alias("cid"), F.concat(F.lit("PIL"), i.cast("string")).alias("callsign"), (F.col("latitude_deg") + (i % 5) * 0.04).alias("latitude"), F.col("longitude_deg").alias("longitude"), (i % 900).cast("int").alias("altitude"),
        (i % 80).cast("int").alias("groundspeed"), F.struct(F.col("ident").alias("departure"), F.when(i % 3 == 0, F.col("ident")).otherwise(F.lit("ZZZZ")).alias("arrival")).alias("flight_plan"),
    )
    call = F.concat(F.element_at(F.array(F.lit("EDDM"), F.lit("EIDW"), F.lit("LON"), F.lit("EURI"), F.lit("BOS")), (i % 5 + 1).cast("int")), F.element_at(F.array(F.lit("_TWR"), F.lit("_CTR"), F.lit("_GND"), F.lit("_FSS")), (i % 4 + 1).cast("int")))
    doc = F.struct(
        F.struct(F.lit("2025-06-01T00:00:00Z").alias("update_timestamp"), F.lit(1).alias("connected_clients")).alias("general"), F.array(pilot).alias("pilots"),
        F.array(F.struct(i.alias("cid"), call.alias("callsign"), F.lit("118.0").alias("frequency"), F.lit(4).alias("facility"))).alias("controllers"),
    )
    return documents.network(_airports(spark, d).select(F.to_json(doc).alias("value")))


@query(f"""with {_A}, p as (select id, ident, lat + (id % 5) * 0.04 plat, lon plon, id % 80 gs, id % 900 alt from a),
g as (select a.ident, count(distinct p.id) n from a join p on abs(a.lat - p.plat) < 0.1 and {_hav('a.lat', 'a.lon', 'p.plat', 'p.plon')} <= 5 and not (gs >= 40 or alt > 500) group by 1),
f as (select ident, count(*) n, count(*) filter (id % 3 = 0) m from a group by 1)
select i.ident, f.n filed_out, f.m filed_in, coalesce(g.n, 0) on_ground from (select distinct ident from a) i join f using (ident) left join g using (ident)""")
def airport_online_traffic(spark: SparkSession, d: str) -> DataFrame:
    """J23, SRC21, P12: flights filed in and out of each airport and aircraft on the ground within 5 NM."""
    p = _network(spark, d)["pilots"].select("callsign", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "altitude", "groundspeed", "flight_plan.departure", "flight_plan.arrival")
    a = _airports(spark, d).select("ident", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
    return correlate.airport_traffic(p, a)


@query(f"""with {_A}, c as (select id cid, (array['EDDM', 'EIDW', 'LON', 'EURI', 'BOS'])[id % 5 + 1] h, (array['TWR', 'CTR', 'GND', 'FSS'])[id % 4 + 1] f from a)
select cid, h || '_' || f callsign, f facility, case when h = 'EDDM' then 'departure' when h = 'EIDW' then 'arrival' else 'london' end "rule" from c
where h in ('EDDM', 'EIDW') or (h = 'LON' and f in ('CTR', 'FSS'))""")
def route_controllers(spark: SparkSession, d: str) -> DataFrame:
    """Controllers that a flight meets and the rule that says so, the first that holds."""
    c = _network(spark, d)["controllers"].select("cid", "callsign")
    return correlate.route_controllers(c, "EDDM", "EIDW", [("LON", "london")]).select("cid", "callsign", "facility", "rule")


def _route_distance_sql() -> str:
    def seg(a, b):
        dx, dy = b[1] - a[1], b[0] - a[0]
        t = f"greatest(0, least(1, ((lon - ({a[1]})) * ({dx}) + (lat - ({a[0]})) * ({dy})) / {dx * dx + dy * dy}))"
        return _hav("lat", "lon", f"({a[0]} + {t} * ({dy}))", f"({a[1]} + {t} * ({dx}))")

    return "least(" + ", ".join(seg(a, b) for a, b in zip(ROUTE, ROUTE[1:])) + ")"


@query(f"with {_A}, p as (select id, lat + (id % 5) * 0.04 lat, lon from a) select id cid, round({_route_distance_sql()}, 5) distance_nm from p where {_route_distance_sql()} <= 500")
def online_traffic_on_route(spark: SparkSession, d: str) -> DataFrame:
    """Aircraft within a distance of a route."""
    p = _network(spark, d)["pilots"].select("cid", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return correlate.traffic_on_route(p, ROUTE, 500.0).select("cid", F.round("distance_nm", 5).alias("distance_nm"))


@query("""select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) n from events where ts <= timestamp '2024-01-20') where n = 1 and ts + interval 5 day > timestamp '2024-01-20'""")
def cache_unexpired(spark: SparkSession, d: str) -> DataFrame:
    """SNK17, SNK18, ST9: the newest row of each key, whole, unless it has expired."""
    newest = correlate.ttl_latest(read(spark, d, "events"), ["user_id", "event_type"], "ts", F.lit("2024-01-20").cast("timestamp_ntz"), "5 days", "event_id")
    return newest.select("event_id", "user_id", "event_type", "value")


@query("""with l as (select user_id, event_type, max(ts) t from events where ts <= timestamp '2024-01-20' group by 1, 2)
select event_type, count(*) entries, count_if(t + interval 5 day > timestamp '2024-01-20') live, count_if(t + interval 5 day <= timestamp '2024-01-20') expired from l group by 1""")
def cache_status(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a cache, live and expired, by kind."""
    t = F.lit("2024-01-20").cast("timestamp_ntz")
    e = read(spark, d, "events").filter(F.col("ts") <= t).groupBy("user_id", "event_type").agg(F.max("ts").alias("at"))
    live = F.col("at") + F.expr("interval 5 days") > t
    return e.groupBy("event_type").agg(F.count("*").alias("entries"), F.count_if(live).alias("live"), F.count_if(~live).alias("expired"))


@query("select user_id session_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 20")
def event_ring(spark: SparkSession, d: str) -> DataFrame:
    """ST5: the last events of each session in a ring of bounded size."""
    e = read(spark, d, "events").withColumnRenamed("user_id", "session_id")
    return telemetry.ring(e, 20).select("session_id", "event_id")


@query("""with e as (select event_id, event_type <> lag(event_type) over w t, value is distinct from lag(value) over w v, props is distinct from lag(props) over w p, row_number() over w n from events window w as (partition by user_id order by ts, event_id))
select event_id, concat_ws(',', case when n > 1 and t then 'event_type' end, case when n > 1 and v then 'value' end, case when n > 1 and p then 'props' end) fields from e""")
def state_deltas(spark: SparkSession, d: str) -> DataFrame:
    """ST6: which fields differ from the snapshot before; nothing for the first one."""
    from airloom.operators.tracking import deltas

    return deltas(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value", "props"]).select("event_id", F.array_join("fields", ",").alias("fields"))


def _session_states(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return read(spark, d, "events").select(
        i.alias("session_id"), (i % 13 - 6).cast("double").alias("xtk_nm"), (i % 17 == 0).alias("stale"), F.when(i % 3 > 0, (i % 40).cast("double")).otherwise(0.0).alias("tod_nm"), (i % 9 * -100).cast("double").alias("vs"),
        (i % 200).cast("double").alias("to_go"), F.when(i % 5 > 0, (i % 800 - 400).cast("double")).alias("profile_ft"), (i % 20_000).cast("double").alias("altitude"), (i % 300).cast("double").alias("speed"), (i % 23 == 0).alias("source_required"),
    )


@query("""with s as (select event_id i, event_id % 13 - 6 x, case when event_id % 3 > 0 then event_id % 40 else 0 end tod, event_id % 9 * -100 vs, event_id % 200 go, case when event_id % 5 > 0 then event_id % 800 - 400 end pr, event_id % 20000 alt, event_id % 300 sp from events)
select i session_id, 'OFF_ROUTE' code, 'warning' severity from s where abs(x) > 5 union all select i, 'TELEMETRY_STALE', 'warning' from s where i % 17 = 0 union all select i, 'TOD_NEAR', 'info' from s where tod between 0 and 10
union all select i, 'TOD_PASSED', 'warning' from s where tod = 0 and vs > -200 and go < 120 union all select i, 'HIGH_ON_PROFILE', 'warning' from s where pr > 200 and go < 120 union all select i, 'LOW_ON_PROFILE', 'warning' from s where pr < -200 and go < 120
union all select i, 'SPEED_LIMIT', 'warning' from s where alt < 10000 and sp > 250 union all select i, 'SOURCE_REQUIRED', 'info' from s where i % 23 = 0""")
def flight_advisories(spark: SparkSession, d: str) -> DataFrame:
    """The advisories that the state of a session asks for."""
    return correlate.advisories(_session_states(spark, d))


# --- routes -----------------------------------------------------------------------------------------------------------

_PLACED = _LEGS + ", q as (select *, row_number() over (partition by pr order by sq, i) nth from l)"


@query(_PLACED + f""", h as (select *, {_hav('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} nm from q where lat is not null window w as (partition by pr order by nth))
select i segment_id, round(coalesce(sum(nm) over (partition by pr order by nth rows between 1 following and unbounded following), 0), 4) remaining_nm from h""")
def route_remaining_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance along each route still to fly behind every fix."""
    from airloom.operators.tracking import remaining

    legs = procedure_legs(spark, d).filter("lat is not null").select(F.col("procedure_ident").alias("route"), "sequence_number", "segment_id", "lat", "lon")
    return remaining(legs, ["route"], ["sequence_number", "segment_id"]).select("segment_id", F.round("remaining_nm", 4).alias("remaining_nm"))


@query("""with s as (select distinct on (segment_id) segment_id, route_ident, sequence_number, nullif(upper(trim(coalesce(start_ident, ''))), '') a, nullif(upper(trim(coalesce(end_ident, ''))), '') b, level_code from airway_segments order by segment_id, upper(trim(coalesce(start_ident, ''))), upper(trim(coalesce(end_ident, '')))),
p as (select *, lag(b) over (partition by route_ident order by sequence_number, segment_id) pb from s)
select segment_id, route_ident, pb previous_end, a "start" from p where a is not null and pb is not null and a <> pb and level_code <> 'H'""")
def route_discontinuities(spark: SparkSession, d: str) -> DataFrame:
    """Legs that do not begin where the one before ended; blank fixes and connectors (here the legs of high level) are left out."""
    from airloom.operators.procedures import discontinuities

    clean = lambda c: F.nullif(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    s = read(spark, d, "airway_segments").groupBy("segment_id").agg(F.min(F.struct(F.upper(F.trim(F.coalesce("start_ident", F.lit("")))).alias("a"), F.upper(F.trim(F.coalesce("end_ident", F.lit("")))).alias("b"), "route_ident", "sequence_number", "level_code")).alias("r"))
    s = s.select("segment_id", F.col("r.route_ident").alias("route_ident"), F.col("r.sequence_number").alias("sequence_number"), clean(F.col("r.a")).alias("start"), clean(F.col("r.b")).alias("end"), (F.col("r.level_code") == "H").alias("connector"))
    return discontinuities(s, ["route_ident"], ["sequence_number", "segment_id"]).select("segment_id", "route_ident", "previous_end", "start")


@query("""with s as (select distinct segment_id, upper(trim(start_ident)) || '/' || start_region a, upper(trim(end_ident)) || '/' || end_region b from airway_segments where trim(start_ident) <> '' and trim(end_ident) <> ''),
n as (select distinct upper(trim(ident)) || '/' || iso_country node from ourairports_navaids), e as (select a node from s union all select b from s)
select node, count(*) legs from e where node not in (select node from n where node is not null) group by 1""")
def graph_missing_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ends of legs that are no node of the graph, with the legs that ask for them."""
    node = lambda i, r: F.concat_ws("/", F.upper(F.trim(i)), r)
    s = read(spark, d, "airway_segments").filter("trim(start_ident) <> '' and trim(end_ident) <> ''").select("segment_id", node("start_ident", "start_region").alias("start"), node("end_ident", "end_region").alias("end")).distinct()
    n = read(spark, d, "ourairports_navaids").select(F.concat(F.upper(F.trim("ident")), F.lit("/"), "iso_country").alias("node"))
    return graph.unresolved(s, n)


@query("""select distinct segment_id, coalesce(minimum_altitude_ft, 0) <= 9000 and coalesce(maximum_altitude_ft, 99999) >= 9000 and route_ident not in (select min(route_ident) from airway_segments) and (level_code <> 'H') eligible from airway_segments""")
def edge_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """P5: edges that may be flown: equipment, altitude band, excluded routes. High-level routes stand for those that ask for RNAV."""
    s = read(spark, d, "airway_segments").withColumn("route_type", F.when(F.col("level_code") == "H", "R").otherwise("O"))
    first = s.agg(F.min("route_ident")).first()[0]
    return s.select("segment_id", graph.eligible(False, 9000, [first] if first else None).alias("eligible")).distinct()


# --- the versioned store ----------------------------------------------------------------------------------------------

_U = """u as (select airport_id id, valid_from, arg_max({n: name, e: elevation_ft, s: update_id}, update_id) r from airport_updates where not withdrawn group by 1, 2),
t as (select id, valid_from, r, lead(valid_from) over (partition by id order by valid_from) valid_until from u)"""
NOW = "2025-06-01 00:00:00"


def _table(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    u = read(spark, d, "airport_updates").filter("not withdrawn").groupBy(F.col("airport_id").alias("id"), "valid_from").agg(F.max_by(F.struct("name", "elevation_ft"), "update_id").alias("r"))
    return u.select("id", "valid_from", "r.*", F.lead("valid_from").over(Window.partitionBy("id").orderBy("valid_from")).alias("valid_until"))


@query(f"with {_U}, gone as (select distinct airport_id id, valid_from from airport_updates where not withdrawn and valid_from > timestamp '{NOW}' and source_snapshot_id in (select snapshot_id from raw_source_snapshots where retrieved_at >= timestamp '{NOW}')) select id, valid_from from t where (id, valid_from) not in (select id, valid_from from gone)")
def future_corrections_replaced(spark: SparkSession, d: str) -> DataFrame:
    """T5: what snapshots retrieved later say of a revision that has not begun takes its place; what has begun stays."""
    late = read(spark, d, "raw_source_snapshots").filter(F.col("retrieved_at") >= F.lit(NOW).cast("timestamp_ntz")).select(F.col("snapshot_id").alias("source_snapshot_id")).distinct()
    c = read(spark, d, "airport_updates").filter("not withdrawn").join(late, "source_snapshot_id", "left_semi").select(F.col("airport_id").alias("id"), "valid_from")
    return temporal.replace_future(_table(spark, d), c, NOW).select("id", "valid_from")


@query(f"""with {_U}, gone as (select id, max(valid_from) f from t where valid_from > timestamp '{NOW}' group by 1)
select t.id, t.valid_from, case when t.valid_until = g.f then null else t.valid_until end valid_until from t left join gone g on g.id = t.id where g.f is null or t.valid_from <> g.f""")
def future_revisions_withdrawn(spark: SparkSession, d: str) -> DataFrame:
    """The last revision of each airport that has not begun is withdrawn and the one before is open again."""
    t = _table(spark, d)
    gone = t.filter(F.col("valid_from") > F.lit(NOW).cast("timestamp_ntz")).groupBy("id").agg(F.max("valid_from").alias("valid_from"))
    return temporal.withdraw_future(t, gone, NOW).select("id", "valid_from", "valid_until")


_RB = "timestamp '2025-05-15'"


@query(f"""with {_U}, pre as (select * from t where valid_from < {_RB} and (valid_until is null or valid_until >= {_RB})), cur as (select * from t where valid_from <= {_RB} and (valid_until is null or valid_until > {_RB})),
d as (select coalesce(p.id, c.id) id, case when p.id is null then 'added' when c.id is null then 'removed' when p.r.n is distinct from c.r.n or p.r.e is distinct from c.r.e then 'changed' end k from pre p full join cur c on p.id = c.id)
select t.id, t.valid_from, false republished from t left join d on d.id = t.id and d.k in ('added', 'changed') where not (d.id is not null and starts_with(t.id, 'nva:') and t.valid_from = {_RB})
union all select p.id, {_RB}, true from pre p join d on d.id = p.id where d.k in ('removed', 'changed') and starts_with(p.id, 'nva:')""")
def cycle_rolled_back(spark: SparkSession, d: str) -> DataFrame:
    """One provider's state of just before a cycle published again at its start; others stay as they are."""
    t = _table(spark, d).withColumn("republished", F.lit(False))
    out = temporal.rollback(t, "2025-05-15 00:00:00", ["name", "elevation_ft"], "nva")
    was = t.select("id", "valid_from", "name", "elevation_ft", F.lit(True).alias("there"))
    same = (out["id"] == was["id"]) & (out["valid_from"] == was["valid_from"]) & out["name"].eqNullSafe(was["name"]) & out["elevation_ft"].eqNullSafe(was["elevation_ft"])
    return out.join(was, same, "left").select(out["id"], out["valid_from"], F.col("there").isNull().alias("republished"))


@query(f"""with p as (select source_snapshot_id, (array{['Discovered', 'Downloaded', 'Preloaded', 'Active', 'Superseded', 'Expired', 'RolledBack']})[(length(provider_name) + length(source_uri)) % 7 + 1] from_status, (array{['Discovered', 'Downloaded', 'Preloaded', 'Active', 'Superseded', 'Expired', 'RolledBack']})[length(source_uri) % 7 + 1] to_status from fetched_datasets)
select source_snapshot_id "cycle", from_status, to_status from p where (from_status || '>' || to_status) not in ({", ".join(f"'{a}>{b}'" for a, b in temporal.TRANSITIONS)})""")
def illegal_cycle_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a cycle's status that no rule allows."""
    names = F.array(*[F.lit(s) for s in ("Discovered", "Downloaded", "Preloaded", "Active", "Superseded", "Expired", "RolledBack")])
    e = read(spark, d, "fetched_datasets").select(
        F.col("source_snapshot_id").alias("cycle"), F.element_at(names, (F.length("provider_name") + F.length("source_uri")) % 7 + 1).alias("from_status"), F.element_at(names, F.length("source_uri") % 7 + 1).alias("to_status")
    )
    return temporal.illegal_transitions(e).select("cycle", "from_status", "to_status")


@query("""with s as (select snapshot_id from raw_source_snapshots), t(entity_table, id, sid) as (select 'airports', id::varchar, source_snapshot_id from ourairports_airports union all select 'runways', id::varchar, source_snapshot_id from ourairports_runways
  union all select 'navaids', id::varchar, source_snapshot_id from ourairports_navaids union all select 'airway_segments', segment_id::varchar, source_snapshot_id from airway_segments union all select 'aixm', record_id::varchar, source_snapshot_id from aixm_airports)
select entity_table, count(distinct id) entities, count(distinct case when sid in (select snapshot_id from s) then null else id end) orphans from t group by 1""")
def doctor_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table the entities and those whose snapshot is missing."""
    parts = [("airports", "ourairports_airports", "id"), ("runways", "ourairports_runways", "id"), ("navaids", "ourairports_navaids", "id"), ("airway_segments", "airway_segments", "segment_id"), ("aixm", "aixm_airports", "record_id")]
    rows = None
    for name, t, key in parts:
        one = read(spark, d, t).select(F.lit(name).alias("entity_table"), F.col(key).cast("string").alias("id"), F.col("source_snapshot_id").alias("sid"))
        rows = one if rows is None else rows.unionByName(one)
    s = read(spark, d, "raw_source_snapshots").select(F.col("snapshot_id").alias("sid"), F.lit(True).alias("known")).distinct()
    j = rows.join(s, "sid", "left")
    return j.groupBy("entity_table").agg(F.count_distinct("id").alias("entities"), F.count_distinct(F.when(F.col("known").isNull(), F.col("id"))).alias("orphans"))


_PREFIXES = [("north", "X[A-H]"), ("south", "X[I-Z]"), ("q", "Q"), ("other", ".")]


@query(f"""with {_A}, r as (select id, ident, case when regexp_matches(upper(ident), '^X[A-H]') then 'north' when regexp_matches(upper(ident), '^X[I-Z]') then 'south' when regexp_matches(upper(ident), '^Q') then 'q' else 'other' end g, airport_type from a),
w as (select airport_ref, count(distinct id) n, count(distinct case when le_heading_degt is not null then id end) h, max(length_ft) m from ourairports_runways group by 1)
select g region, count(*) airports, count(*) filter (n > 0) with_runways, coalesce(sum(n), 0)::bigint runways, coalesce(sum(h), 0)::bigint with_heading, count(*) filter (airport_type = 'heliport') heliports, count(*) filter (m >= 5000) long_runway from r left join w on w.airport_ref = r.id group by 1""")
def coverage_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Six counts for each region of ident prefixes."""
    group = F.coalesce(*[F.when(F.upper("ident").rlike(f"^{p}"), g) for g, p in _PREFIXES])
    w = read(spark, d, "ourairports_runways").groupBy("airport_ref").agg(F.count_distinct("id").alias("n"), F.count_distinct(F.when(F.col("le_heading_degt").isNotNull(), F.col("id"))).alias("h"), F.max("length_ft").alias("m"))
    j = _airports(spark, d).withColumn("region", group).join(w, F.col("airport_ref") == F.col("id"), "left")
    return j.groupBy("region").agg(
        F.count("*").alias("airports"), F.count_if(F.col("n") > 0).alias("with_runways"), F.coalesce(F.sum("n"), F.lit(0)).alias("runways"), F.coalesce(F.sum("h"), F.lit(0)).alias("with_heading"),
        F.count_if(F.col("airport_type") == "heliport").alias("heliports"), F.count_if(F.col("m") >= 5000).alias("long_runway"),
    )


@query(_LEGS + " select kind procedure_kind, term path_terminator, count(*) legs, count(distinct pr) procedures, count(distinct valid_from) revisions from l group by all")
def procedure_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Legs by terminator, with the procedures and revisions they are of."""
    return procedure_legs(spark, d).groupBy("procedure_kind", "path_terminator").agg(F.count("*").alias("legs"), F.count_distinct("procedure_ident").alias("procedures"), F.count_distinct("valid_from").alias("revisions"))


@query("select lower(trim(dataset_name)) dataset, count(*) deliveries, min(case when lower(revision_kind) = 'correction' then retrieved_at end) first_correction, count(*) = count(*) filter (regexp_matches(lower(coverage), 'full')) + count(*) filter (regexp_matches(lower(coverage), 'partial')) + count(*) filter (not regexp_matches(lower(coverage), 'full|partial')) adds_up from fetched_datasets group by 1")
def delivery_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Conditional aggregates over deliveries, and whether their kinds add up to all of them."""
    c, kind = F.lower("coverage"), F.lower("revision_kind")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    return read(spark, d, "fetched_datasets").groupBy(F.lower(F.trim("dataset_name")).alias("dataset")).agg(
        F.count("*").alias("deliveries"), F.min(F.when(kind == "correction", F.col("retrieved_at"))).alias("first_correction"),
        (F.count("*") == n(c.rlike("full")) + n(c.rlike("partial")) + n(~c.rlike("full|partial"))).alias("adds_up"),
    )


@query(f"""with a as (select distinct on (id) id, iso_country c, latitude_deg lat, longitude_deg lon from ourairports_airports order by id, valid_from, latitude_deg, longitude_deg),
box as (select iso_country g, min(latitude_deg) a, max(latitude_deg) b, min(longitude_deg) x, max(longitude_deg) y from ourairports_airports where iso_country is not null group by 1)
select id, g region_id from (select distinct id, latitude_deg lat, longitude_deg lon from ourairports_navaids where latitude_deg between -90 and 90 and longitude_deg between -180 and 180 and not (latitude_deg = 0 and longitude_deg = 0)) n join box on lat >= a and lat < b and lon >= x and lon < y""")
def navaids_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions (here the box around the airports of a country) that hold each navaid."""
    from airloom.operators.nearby import containing

    b = read(spark, d, "ourairports_airports").filter("iso_country is not null").groupBy(F.col("iso_country").alias("region_id")).agg(F.min("latitude_deg").alias("a"), F.max("latitude_deg").alias("b"), F.min("longitude_deg").alias("x"), F.max("longitude_deg").alias("y"))
    corner = lambda la, lo: F.struct(F.col(la).alias("lat"), F.col(lo).alias("lon"))
    rings = b.select("region_id", F.array(corner("a", "x"), corner("a", "y"), corner("b", "y"), corner("b", "x")).alias("ring"))
    n = read(spark, d, "ourairports_navaids").select("id", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
    return containing(n, rings)
