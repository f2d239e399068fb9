"""Queries of whole files of fixed-width records, written from the test tables and loaded by the library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions.text import reciprocal_designator
from airloom.plans.functions import _A, _airports, _degrees_sql, _fixed
from airloom.session import cut
from airloom.sources import arinc
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


#: navaid_type -> class of its record in columns 28 to 30
CLASSES = {"VOR": "V", "VOR-DME": "VD", "VORTAC": "VT", "DME": " D", "TACAN": " T"}


def _file(spark: SparkSession, d: str) -> DataFrame:
    """(line_no, value): waypoints from airports, stations from navaids, route records and runway ends, and short lines."""
    t = F.lit
    lat, lon = (lambda c: _fixed(F.col(c), "N", "S", 2, 2)), (lambda c: _fixed(F.col(c), "E", "W", 3, 2))
    num = lambda c, w: F.lpad(c.cast("int").cast("string"), w, "0")
    a = _airports(spark, d).select((F.col("id") * 10).alias("line_no"), arinc.line({
        1: t("S"), 5: t("EA"), 7: t("ENRT"), 14: F.substring("ident", 1, 5), 20: F.col("iso_country"), 27: t("W  "), 33: F.when(F.col("id") % 50 > 0, lat("latitude_deg")), 42: lon("longitude_deg"), 96: F.substring("name", 1, 25),
    }).alias("value"))
    n = read(spark, d, "ourairports_navaids").select("id", F.upper(F.trim("ident")).alias("ident"), "iso_country", "navaid_type", "frequency_khz", "latitude_deg", "longitude_deg", "name", "valid_from").distinct()
    n = n.groupBy("id").agg(F.min(F.struct("ident", "iso_country", "navaid_type", "frequency_khz", "latitude_deg", "longitude_deg", "name")).alias("r")).select("id", "r.*")
    here = lambda x, c: F.when(F.col("latitude_deg").between(-90, 90) & F.col("longitude_deg").between(-180, 180), x(c))
    low = F.col("navaid_type").startswith("NDB")
    cls = F.coalesce(*[F.when(F.col("navaid_type") == k, v) for k, v in CLASSES.items()])
    n = n.filter(F.col("navaid_type").isin(*CLASSES) | low).select((F.col("id") * 10 + 10**9).alias("line_no"), arinc.line({
        1: t("S"), 5: F.when(low, "DB").otherwise("D"), 14: F.substring("ident", 1, 4), 20: F.col("iso_country"), 23: F.when(low, num(F.col("frequency_khz"), 4)).otherwise(num(F.floor(F.col("frequency_khz") / 10), 5)), 28: F.when(~low, cls),
        33: here(lat, "latitude_deg"), 42: here(lon, "longitude_deg"), 95: F.substring("name", 1, 20),
    }).alias("value"))
    s = _segments(spark, d)
    s = s.select((F.col("sequence_number").cast("long") * 10**7 + F.col("segment_id") + 10**12).alias("line_no"), arinc.line({
        1: t("S"), 5: t("ER"), 14: F.substring("route_ident", 1, 5), 26: num(F.col("sequence_number"), 4), 30: F.substring("fix", 1, 5), 35: F.col("start_region"), 45: t("O"), 46: F.col("level_code"),
        84: F.when(F.col("lo").isNotNull(), num(F.col("lo"), 5)), 94: F.when(F.col("hi").isNotNull(), F.concat(t("FL"), num(F.floor(F.col("hi") / 100), 3))),
    }).alias("value"))
    e = _ends(spark, d).select((F.col("id") * 10 + F.col("side") + 10**14).alias("line_no"), arinc.line({
        1: t("S"), 5: t("P"), 7: F.col("apt"), 11: t("XX"), 13: t("G"), 14: F.concat(t("RW"), F.col("designator")), 23: num(F.col("length_ft"), 5), 33: lat("lat"), 42: lon("lon"),
    }).alias("value"))
    short = read(spark, d, "chart_documents").select((F.abs(F.hash("id")).cast("long") + 10**16).alias("line_no"), F.concat(t("SEA "), "id").alias("value")).distinct()
    # the file as it lies in the shared folder, so that decoding does not work its lines out anew for each field
    return cut(a.unionByName(n).unionByName(s).unionByName(e).unionByName(short))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "airway_segments").groupBy("segment_id").agg(F.min(F.struct("route_ident", "sequence_number", F.coalesce(F.upper(F.trim("start_ident")), F.lit("")).alias("fix"), "start_region", "level_code", F.col("minimum_altitude_ft").alias("lo"), F.col("maximum_altitude_ft").alias("hi"))).alias("r"))
    return s.select("segment_id", "r.*")


def _ends(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of the runways with a number from 01 to 18 at one end, one row per airport and designator."""
    r = read(spark, d, "ourairports_runways").filter("length_ft between 1 and 99999 and airport_ref is not null").withColumn("apt", F.concat(F.lit("A"), F.lpad((F.col("airport_ref") % 1000).cast("string"), 3, "0")))
    low = F.regexp_extract(F.upper("le_ident"), r"^(0[1-9]|[12]\d|3[0-6])[LRC]?$", 0)
    r = r.withColumn("le", low).filter("le <> ''").groupBy("apt", "le").agg(F.min(F.struct("id", "length_ft", "le_latitude_deg", "le_longitude_deg", "he_latitude_deg", "he_longitude_deg")).alias("r")).select("apt", "le", "r.*")
    r = r.filter(F.substring("le", 1, 2).cast("int") <= 18).withColumn("he", reciprocal_designator(F.col("le")))
    end = lambda side, name, la, lo: F.struct(F.lit(side).alias("side"), F.col(name).alias("designator"), F.col(la).alias("lat"), F.col(lo).alias("lon"))
    both = r.withColumn("e", F.explode(F.array(end(0, "le", "le_latitude_deg", "le_longitude_deg"), end(1, "he", "he_latitude_deg", "he_longitude_deg"))))
    # every seventh far end says another length, and so has no partner
    return both.select("id", "apt", F.col("e.side").alias("side"), F.col("e.designator").alias("designator"), F.when((F.col("e.side") == 1) & (F.col("id") % 7 == 0), F.col("length_ft") - 1).otherwise(F.col("length_ft")).alias("length_ft"), "e.lat", "e.lon")


_W = f"""{_A}, w as (select id, left(ident, 5) ident, left(country, 2) region, trim(left(name, 25)) nm, case when id % 50 > 0 then {_degrees_sql('lat', 100)} end lat, {_degrees_sql('lon', 100)} lon from a),
wk as (select * from w where lat is not null qualify row_number() over (partition by trim(ident), region order by id) = 1)"""


@query(f"with {_W} select trim(ident) ident, region, lat, lon, nm \"name\" from wk")
def cifp_waypoints(spark: SparkSession, d: str) -> DataFrame:
    """SRC4, SRC5, F1, W3: waypoints of a file, the first record of a key."""
    w = arinc.load(_file(spark, d)).entities["waypoints"]
    return w.select("ident", "region", F.round("latitude_deg", 9).alias("lat"), F.round("longitude_deg", 9).alias("lon"), "name")


_N = f"""n as (select distinct on (id) id, upper(trim(ident)) ident, iso_country region, navaid_type t, frequency_khz f, case when latitude_deg between -90 and 90 and longitude_deg between -180 and 180 then {_degrees_sql('latitude_deg', 100)} end lat,
 case when latitude_deg between -90 and 90 and longitude_deg between -180 and 180 then {_degrees_sql('longitude_deg', 100)} end lon from ourairports_navaids where starts_with(navaid_type, 'NDB') or navaid_type in ({", ".join(f"'{k}'" for k in CLASSES)})
 order by id, upper(trim(ident)), iso_country, navaid_type, frequency_khz, latitude_deg nulls first, longitude_deg nulls first, name),
m as (select id, left(ident, 4) ident, region, case when starts_with(t, 'NDB') then 'NDB' else t end t, case when starts_with(t, 'NDB') then f else f // 10 * 10 end f, lat, lon from n),
k as (select * from m where lat is not null union all select id, ident, region, 'DME', f, lat, lon from m where lat is not null and t in ('VORTAC', 'VOR-DME'))"""


@query(f"with {_N} select trim(ident) ident, region, t navaid_type, f frequency_khz, lat, lon from k qualify row_number() over (partition by trim(ident), region, t order by id) = 1")
def cifp_navaids(spark: SparkSession, d: str) -> DataFrame:
    """SRC6, F7, W3: stations of sections D and DB, the DME half on its own, the first record of a key."""
    n = arinc.load(_file(spark, d)).entities["navaids"]
    return n.select("ident", "region", "navaid_type", "frequency_khz", F.round("latitude_deg", 9).alias("lat"), F.round("longitude_deg", 9).alias("lon"))


@query(f"with {_N}, g as (select trim(ident) || '/' || region || '/' || t \"key\", count(distinct f || '|' || lat || '|' || lon) n from k group by 1) select \"key\" from g where n > 1")
def cifp_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose later records say something else than the first."""
    lines = _file(spark, d)
    n = arinc.load(lines)
    # keys whose records differ by name alone are left out here
    same = arinc.vhf_navaids(arinc.records(lines)).select("ident", "region", "navaid_type", "frequency_khz", "latitude_deg", "longitude_deg").unionByName(
        arinc.ndb_navaids(arinc.records(lines)).withColumn("navaid_type", F.lit("NDB")).select("ident", "region", "navaid_type", "frequency_khz", "latitude_deg", "longitude_deg")
    )
    alone = same.groupBy(F.concat_ws("/", "ident", "region", "navaid_type").alias("key")).agg(F.count_distinct(F.struct("frequency_khz", "latitude_deg", "longitude_deg")).alias("n")).filter("n > 1").select("key")
    return n.conflicts.filter("table_name = 'navaids'").select("key").join(alone, "key", "left_semi")


_S = """s as (select distinct on (segment_id) segment_id, left(route_ident, 5) route, sequence_number sq, trim(left(coalesce(upper(trim(start_ident)), ''), 5)) fix, start_region region, level_code lv, minimum_altitude_ft lo, maximum_altitude_ft // 100 * 100 hi from airway_segments
  order by segment_id, route_ident, sequence_number, coalesce(upper(trim(start_ident)), ''), start_region, level_code, minimum_altitude_ft nulls first, maximum_altitude_ft nulls first)"""


@query(f"with {_S}, p as (select *, lag(segment_id) over w prev, lag(nullif(fix, '')) over w pf, lag(lo) over w plo, lag(hi) over w phi from s window w as (partition by route order by sq, segment_id)) select route route_ident, sq sequence_number, pf start_fix, nullif(fix, '') end_fix, case when plo > 0 then plo end minimum_altitude_ft, case when phi > 0 then phi end maximum_altitude_ft from p where prev is not null")
def cifp_airway_legs(spark: SparkSession, d: str) -> DataFrame:
    """SRC7, W1: successive records of a route make legs with the altitudes of the earlier one."""
    g = arinc.load(_file(spark, d)).entities["airway_legs"]
    return g.select("route_ident", "sequence_number", "start_fix", "end_fix", "minimum_altitude_ft", "maximum_altitude_ft")


_E = """r as (select distinct on (apt, le) 'A' || lpad((airport_ref % 1000)::varchar, 3, '0') apt, regexp_extract(upper(le_ident), '^(0[1-9]|[12][0-9]|3[0-6])[LRC]?$', 0) le, id, length_ft len from ourairports_runways
  where length_ft between 1 and 99999 and airport_ref is not null and regexp_extract(upper(le_ident), '^(0[1-9]|[12][0-9]|3[0-6])[LRC]?$', 0) <> '' order by apt, le, id, length_ft),
q as (select *, lpad((left(le, 2)::int + 18)::varchar, 2, '0') || case substr(le, 3, 1) when 'L' then 'R' when 'R' then 'L' when 'C' then 'C' else '' end he from r where left(le, 2)::int <= 18)"""


@query(f"with {_E} select apt airport_ident, le || '/' || he official_designator, len length_ft from q where id % 7 > 0")
def cifp_runways(spark: SparkSession, d: str) -> DataFrame:
    """Ends and their reciprocals of the same length make a runway, the lower number first."""
    return arinc.load(_file(spark, d)).entities["runways"].select("airport_ident", "official_designator", "length_ft")


@query(f"with {_E}, e as (select apt, le designator, len length_ft from q where id % 7 = 0 union all select apt, he, len - 1 from q where id % 7 = 0) select apt airport_ident, designator, length_ft from e")
def cifp_unpaired_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ends without a partner of their length."""
    return arinc.load(_file(spark, d)).entities["unpaired_ends"]


@query(f"""with {_W}, {_N}, {_S}, {_E} select 'EA' record_class, count(*) seen, count(*) filter (lat is null) rejected from w having count(*) > 0
union all select case when t = 'NDB' then 'DB' else 'D' end, count(*), count(*) filter (lat is null or f <= 0) from m group by 1
union all select 'ER', count(*), 0 from s having count(*) > 0 union all select 'PG', 2 * count(*), 0 from q having count(*) > 0
union all select 'short', count(distinct id), count(distinct id) from chart_documents having count(*) > 0""")
def cifp_scan_report(spark: SparkSession, d: str) -> DataFrame:
    """Records seen and rejected by class; a line of another width is one."""
    return arinc.load(_file(spark, d)).report


@query(f"with {_W}, {_N}, {_S}, {_E} select 'waypoints' table_name, count(*) filter (lat is null) > 0 masked from w having count(*) > 0 union all select 'navaids', count(*) filter (lat is null or f <= 0) > 0 from m having count(*) > 0 union all select 'airway_legs', false from s having count(*) > 0 union all select 'runways', false from q having count(*) > 0")
def cifp_masked_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables in which absence must not close anything, as records that did not decode may hide rows."""
    return arinc.load(_file(spark, d)).masked()
