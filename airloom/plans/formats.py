"""Queries of sources and sinks over the test tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions import text
from airloom.operators import correlate, rejects
from airloom.sinks import text_layers as sink
from airloom.sources import csv_tables
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


def _cells(spark: SparkSession, d: str, dataset: str, columns: str) -> DataFrame:
    """Well-formed records of raw lines under the names of a CSV header."""
    names = [c.split()[0] for c in columns.split(", ")]
    rows = rejects.parse(read(spark, d, "raw_csv_lines").filter(F.col("dataset_name") == dataset)).filter((F.size("cells") == len(names)) & (F.get("cells", F.lit(0)) != "id"))
    return rows.select("line_id", *[F.regexp_replace(F.get("cells", F.lit(i)), "^﻿", "").alias(n) for i, n in enumerate(names)])


_F = '(?:"(?:[^"]|"")*"|[^",]*)'
_C = f"""with t as (select line_id, dataset_name, regexp_replace(coalesce(raw_line, ''), '(\\r\\n|\\n|\\r)$', '') txt from raw_csv_lines),
w as (select line_id, dataset_name, list_transform(regexp_extract_all(',' || txt, '(?s),({_F})', 1), lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) c
  from t where regexp_full_match(txt, '(?s){_F}(?:,{_F})*')),
g as (select * from w where len(c) = 20 and c[1] <> 'id' and c[1] <> chr(65279) || 'id')"""


@query(_C + """, r as (select *, case when regexp_full_match(trim(c[4]), '[0-9]+') then try_cast(trim(c[4]) as int) end len_ft, trim(c[8]) = '1' closed, try_cast(trim(c[10]) as double) a, try_cast(trim(c[11]) as double) b, try_cast(trim(c[16]) as double) e, try_cast(trim(c[17]) as double) f from g where dataset_name = 'runways'),
q as (select line_id, case when trim(c[3]) = '' then 'empty airport' when trim(c[9]) = '' then 'empty designator' end rej, case when closed then 'closed' when len_ft is null or len_ft <= 0 then 'no length' when a is null or b is null or e is null or f is null then 'ends without position' end held from r)
select line_id, case when rej is not null then 'rejected' when held is not null then 'quarantined' else 'accepted' end disposition, coalesce(rej, held) reason from q""")
def csv_runways_scan(spark: SparkSession, d: str) -> DataFrame:
    """SRC2: runway records accepted, quarantined or rejected."""
    raw = _cells(spark, d, "runways", csv_tables.RUNWAY_COLUMNS)
    ids = raw.select("line_id", *csv_tables_columns(raw))
    return csv_tables.runways(ids.withColumn("id", F.col("line_id").cast("string"))).select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("line_id"), "disposition", "reason")


def csv_tables_columns(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != "line_id"]


@query(_C + """, n as (select line_id, upper(regexp_replace(trim(c[5]), '[^A-Za-z]', '', 'g')) k, upper(trim(c[5])) t, case when regexp_full_match(trim(c[6]), '[0-9]+') then try_cast(trim(c[6]) as int) end khz, try_cast(trim(c[7]) as double) lat, try_cast(trim(c[8]) as double) lon, trim(c[3]) i from g where dataset_name = 'navaids'),
m as (select *, case when k in ('NDB', 'NDBDME') then 'NDB' when k in ('VOR', 'DVOR') then 'VOR' when k in ('VORDME', 'DVORDME') then 'VOR-DME' when k in ('VORTAC', 'DME', 'TACAN') then k end kind from n),
z as (select *, case when i = '' then 'empty ident' when kind is null then 'unknown type' when khz is null then 'bad frequency' when not (case kind when 'NDB' then khz between 190 and 1800 when 'TACAN' then khz between 108000 and 136000 else khz between 108000 and 118000 end) then 'frequency outside its band'
  when lat is null or lat not between -90 and 90 then 'bad latitude' when lon is null or lon not between -180 and 180 then 'bad longitude' end reason from m)
select line_id, kind navaid_type, case when reason is null then 'accepted' else 'rejected' end disposition, reason from z
union all select line_id, 'DME', 'accepted', null from z where reason is null and t in ('VOR-DME', 'VORTAC', 'NDB-DME')""")
def csv_navaids_scan(spark: SparkSession, d: str) -> DataFrame:
    """SRC3: navaid records, a station with DME as two rows."""
    raw = _cells(spark, d, "navaids", csv_tables.NAVAID_COLUMNS)
    n = csv_tables.navaids(raw.withColumn("id", F.col("line_id").cast("string")))
    return n.select(F.regexp_extract("id", r":(\d+)", 1).cast("long").alias("line_id"), "navaid_type", "disposition", "reason")


@query("select distinct on (id) printf('%12.9f %13.9f %5s ENRT %s %d %s', latitude_deg, longitude_deg, ident, 'K1', 87, name) as \"value\" from ourairports_airports where ident is not null order by id, valid_from, name, latitude_deg, longitude_deg")
def export_fix_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK1: lines of the fix layer, numbers rounded from their binary value."""
    a = read(spark, d, "ourairports_airports").filter("ident is not null").groupBy("id").agg(F.min_by(F.struct("ident", "name", "latitude_deg", "longitude_deg"), F.struct("valid_from", "name", "latitude_deg", "longitude_deg")).alias("r")).select("id", "r.*")
    w = a.withColumn("region", F.lit("K1")).withColumn("waypoint_type", F.lit(87)).withColumn("is_enroute", F.lit(True))
    return sink.fixes(w)[0]


_AWY = """with e as (select distinct upper(trim(ident)) i, iso_country r, max(case when starts_with(navaid_type, 'NDB') then 2 else 3 end) over (partition by upper(trim(ident)), iso_country) t from ourairports_navaids),
l as (select distinct segment_id, route_ident, upper(trim(start_ident)) a, start_region ar, upper(trim(end_ident)) b, end_region br, direction d, level_code v, minimum_altitude_ft lo, maximum_altitude_ft hi from airway_segments)"""


def _layer(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = read(spark, d, "ourairports_navaids").select(F.upper(F.trim("ident")).alias("ident"), F.col("iso_country").alias("region"), F.when(F.col("navaid_type").startswith("NDB"), 2).otherwise(3).alias("type")).distinct()
    s = read(spark, d, "airway_segments").select(
        F.col("segment_id").alias("ord"), "route_ident", F.upper(F.trim("start_ident")).alias("start_fix"), F.col("start_region").alias("start_icao_code"), F.upper(F.trim("end_ident")).alias("end_fix"), F.col("end_region").alias("end_icao_code"), "direction", F.col("level_code").alias("level"), "minimum_altitude_ft", "maximum_altitude_ft",
    ).distinct()
    return sink.airways(s, n)


@query(_AWY + """, k as (select l.*, x.t at_, y.t bt from l join e x on x.i = l.a and x.r = l.ar join e y on y.i = l.b and y.r = l.br where lo is not null and hi is not null)
select printf('%5s %s %2d %5s %s %2d %s %d %3d %3d ', a, ar, at_, b, br, bt, d, case when v = 'H' then 2 else 1 end, lo // 100, hi // 100) || array_to_string([x.route_ident for x in list(distinct {o: first_, route_ident: route_ident} order by {o: first_, route_ident: route_ident})], '-') as "value"
from (select *, min(segment_id) over (partition by a, ar, at_, b, br, bt, d, case when v = 'H' then 2 else 1 end, lo, hi, route_ident) first_ from k) group by a, ar, at_, b, br, bt, d, case when v = 'H' then 2 else 1 end, lo, hi""")
def export_airway_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK3, J18: airway lines between exported ends, routes of one segment merged in first-seen order."""
    return _layer(spark, d)[0]


@query(_AWY + """ select route_ident ident, case when lo is null or hi is null then 'missing altitudes' when not coalesce(regexp_full_match(ar, '[A-Z][A-Z0-9 ]'), false) then 'invalid start region' when not coalesce(regexp_full_match(br, '[A-Z][A-Z0-9 ]'), false) then 'invalid end region'
 when not exists (select 1 from e where i = a and r = ar) then 'start not in the exported layer' else 'end not in the exported layer' end reason, count(*) n from l
where lo is null or hi is null or not coalesce(regexp_full_match(ar, '[A-Z][A-Z0-9 ]'), false) or not coalesce(regexp_full_match(br, '[A-Z][A-Z0-9 ]'), false) or not exists (select 1 from e where i = a and r = ar) or not exists (select 1 from e where i = b and r = br) group by all""")
def export_airway_skips(spark: SparkSession, d: str) -> DataFrame:
    """SNK3: what the airway layer leaves out, and why."""
    return _layer(spark, d)[1].groupBy("ident", "reason").agg(F.count("*").alias("n"))


@query("select distinct concat_ws('|', ident, replace(coalesce(name, ''), '|', ' '), latitude_deg::decimal(12, 6)::varchar, longitude_deg::decimal(12, 6)::varchar, coalesce(elevation_ft::int::varchar, '')) as \"value\" from ourairports_airports")
def export_delimited(spark: SparkSession, d: str) -> DataFrame:
    """SNK11 to SNK13: delimited airport lines."""
    dec = lambda c: F.col(c).cast("decimal(12,6)").cast("string")
    a = read(spark, d, "ourairports_airports")
    return sink.delimited(a, ["ident", F.replace(F.coalesce("name", F.lit("")), F.lit("|"), F.lit(" ")), dec("latitude_deg"), dec("longitude_deg"), F.rint("elevation_ft").cast("int")]).distinct()


@query("select id, row_number() over (order by id) row_id from (select distinct id from ourairports_navaids)")
def export_surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    """SNK9: dense ids in a natural order, numbered in parallel."""
    return sink.surrogate_ids(read(spark, d, "ourairports_navaids").select("id").distinct(), ["id"])


@query("""select distinct id, case when chart_type = 'sid' then 'sid' when chart_type = 'star' then 'star' when chart_type = 'approach' then 'approach' when chart_type = 'airport' then 'airport' else 'other' end kind,
nullif(regexp_extract(upper(title), '\\bRWY\\s*(\\d{2}[LRC]?)\\b', 1), '') runway from chart_documents""")
def chart_normalize(spark: SparkSession, d: str) -> DataFrame:
    """chart kinds, and the runway named in a title."""
    kind = text.chart_type(F.col("chart_type"))
    return read(spark, d, "chart_documents").select("id", F.when(kind.isin("sid", "star", "approach", "airport"), kind).otherwise("other").alias("kind"), text.runway_in_title(F.col("title")).alias("runway")).distinct()


@query("""with r as (select distinct id, airport_ident, le_ident, he_ident, le_heading_degt h from ourairports_runways where le_heading_degt is not null),
i as (select distinct on (airport_ident, le_ident) airport_ident, le_ident runway, (id % 50)::double off, le_heading_degt b, id ils_id from ourairports_runways where le_heading_degt is not null order by airport_ident, le_ident, id, le_heading_degt),
j as (select r.id, i.ils_id, abs(((((i.b + i.off) - r.h + 540) % 360) + 360) % 360 - 180) d from r join i on i.airport_ident = r.airport_ident and i.runway = r.le_ident
 union all select r.id, i.ils_id, abs(((((i.b + i.off) - ((r.h + 180) % 360) + 540) % 360) + 360) % 360 - 180) from r join i on i.airport_ident = r.airport_ident and i.runway = r.he_ident)
select id, ils_id, case when round(d, 6) < 5 then 'ALIGNED' when round(d, 6) <= 30 then 'OFFSET' else 'SUSPICIOUS' end "class" from j""")
def runway_ils(spark: SparkSession, d: str) -> DataFrame:
    """Localizers against runway ends by course. There is no table of them: one stands at each airport and designator."""
    r = read(spark, d, "ourairports_runways").filter("le_heading_degt is not null").select("id", "airport_ident", "le_ident", "he_ident", F.col("le_heading_degt").alias("heading")).distinct()
    one = r.groupBy("airport_ident", F.col("le_ident").alias("runway")).agg(F.min(F.struct("id", "heading")).alias("m"))
    i = one.select("airport_ident", "runway", F.col("m.id").alias("localizer_ident"), (F.col("m.heading") + F.col("m.id") % 50).alias("bearing_deg"))
    out = correlate.runway_ils(r, i)
    delta = F.round("delta_deg", 6)
    return out.select("id", F.col("localizer_ident").alias("ils_id"), F.when(delta < 5, "ALIGNED").when(delta <= 30, "OFFSET").otherwise("SUSPICIOUS").alias("class"))
