"""Queries of the general operators for training-data tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.operators import history, nearby, references, rejects, snapshot_diff
from airloom.session import cut
from airloom.tables import read, second


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = snapshot_diff.navaid_changes(read(spark, d, "dataset_rows"), read(spark, d, "fetched_datasets"))
    return out.select("source_snapshot_id", "record_id", "change_kind")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes per delivery and kind."""
    return p1_found(spark, d).groupBy("source_snapshot_id", "change_kind").agg(F.count("*").alias("records"))


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each field changed from delivery to delivery."""
    out = snapshot_diff.navaid_changes(read(spark, d, "dataset_rows"), read(spark, d, "fetched_datasets"), fields=True)
    return out.filter("change_kind = 'changed'").select("source_snapshot_id", F.explode("fields").alias("field_name")).groupBy("source_snapshot_id", "field_name").agg(F.count("*").alias("records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return history.airport_history(read(spark, d, "airport_updates"), read(spark, d, "raw_source_snapshots"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The same history from two loads: what snapshots before June 2025 say, then all that came later."""
    u, s = read(spark, d, "airport_updates"), read(spark, d, "raw_source_snapshots")
    early = s.filter(F.col("retrieved_at") < F.lit("2025-06-01").cast("timestamp_ntz")).select(F.trim("snapshot_id").alias("__e")).distinct()
    mine = F.trim("source_snapshot_id") == F.col("__e")
    first, later = u.join(F.broadcast(early), mine, "left_semi"), u.join(F.broadcast(early), mine, "left_anti")
    one, split = history.load(None, None, first, s, 1)
    one = {k: cut(v) for k, v in one.items()}
    two, _ = history.load(one, first, later, s, 2, split)
    v = history.stored_versions({k: one[k].unionByName(two[k]) for k in one})
    return v.select("airport_id", second("valid_from").alias("valid_from"), F.coalesce(second("valid_until"), F.lit("open")).alias("valid_until"))


def p3_hub(spark: SparkSession, d: str) -> DataFrame:
    """When each airport was first seen."""
    v = history.build_vault(read(spark, d, "airport_updates"), read(spark, d, "raw_source_snapshots"))
    return v.hub().select("airport_id", second("first_seen").alias("first_seen"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = references.navigation_references(
        read(spark, d, "chart_associations"), read(spark, d, "ourairports_runways"), read(spark, d, "airway_segments")
    )
    held = references.navigation_parents(
        read(spark, d, "chart_documents"), read(spark, d, "ourairports_airports"), read(spark, d, "ourairports_navaids")
    )
    return references.orphans(refs, held).withColumn("period", F.substring(F.col("at").cast("string"), 1, 7))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "field_name", "row_key", "period").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, period and reason."""
    return _orphans(spark, d).groupBy("table_name", "field_name", "period", "reason").agg(F.count_distinct("row_key").alias("orphans"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.failures(read(spark, d, "raw_csv_lines"), rejects.rule_table(spark)).select("line_id", "reason")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """The loadable rows, by dataset and line, with their first cell."""
    clean = rejects.split_lines(read(spark, d, "raw_csv_lines"))[0]
    return clean.select("line_id", "dataset_name", F.size("cells").cast("long").alias("cells"), F.get("cells", F.lit(2)).alias("third_cell"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "ourairports_navaids").select("id", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
    return nearby.near_pairs(p, 2.0).select(F.col("id_a").alias("navaid_id_a"), F.col("id_b").alias("navaid_id_b"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_fields, p3_found, p3_loaded, p3_hub, p5_found, p5_report, p6_found, p6_clean, p7_found)}

_PLAIN = "nullif(trim(regexp_replace(lower({0}), '[\\s\\p{{Z}}]+', ' ', 'g')), '')"
_KEY = "nullif(upper(regexp_replace(cast({0} as varchar), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"


def _plain(c: str) -> str:
    return _PLAIN.format(c)


def _key(c: str) -> str:
    return _KEY.format(c)


_P1 = f"""
with full_ones as (
  select source_snapshot_id sid, concat({_plain('provider_name')}, '|', {_plain('dataset_name')}) series,
         regexp_replace(lower(trim(content_sha256)), '^sha256:', '') sha, coalesce(valid_from, retrieved_at) at_, retrieved_at got
  from fetched_datasets where regexp_replace(lower(coverage), '[^a-z]', '', 'g') in ('full', 'fullsnapshot')),
firsts as (select * from (select *, row_number() over (partition by series, sha order by at_, got, sid) nth from full_ones) where nth = 1),
seqs as (select sid, series, row_number() over (partition by series order by at_, got, sid) seq from firsts),
known as (
  select s.series, s.seq, lower(regexp_replace(r.record_id, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) k, r.row_id,
    {_plain('r.ident')} a, {_plain('r.name')} b, {_plain('r.navaid_type')} c, {_plain('r.iso_country')} e, {_plain('r.associated_airport')} f,
    r.frequency_khz g, r.elevation_ft h, r.latitude_deg lat, r.longitude_deg lon
  from dataset_rows r join seqs s on r.source_snapshot_id = s.sid),
one as (select * from (select *, row_number() over (partition by series, seq, k order by row_id) nth from known) where nth = 1),
found as (
  select s.sid source_snapshot_id, n.k record_id, 'added' change_kind from one n join seqs s on s.series = n.series and s.seq = n.seq
  where n.seq > 1 and not exists (select 1 from one o where o.series = n.series and o.seq = n.seq - 1 and o.k = n.k)
  union all
  select s.sid, o.k, 'removed' from one o join seqs s on s.series = o.series and s.seq = o.seq + 1
  where not exists (select 1 from one n where o.series = n.series and o.seq = n.seq - 1 and o.k = n.k)
  union all
  select s.sid, n.k, 'changed' from one n join one o on o.series = n.series and o.seq = n.seq - 1 and o.k = n.k
    join seqs s on s.series = n.series and s.seq = n.seq
  where n.a is distinct from o.a or n.b is distinct from o.b or n.c is distinct from o.c or n.e is distinct from o.e or n.f is distinct from o.f
    or n.g is distinct from o.g or n.h is distinct from o.h or abs(n.lat - o.lat) >= 0.0000099999 or abs(n.lon - o.lon) >= 0.0000099999)
"""

_P5 = f"""
with refs as (
  select 'chart_associations' table_name, 'chart_id' field_name, assoc_id row_key, 'c' target, {_key('chart_id')} k, valid_from at_ from chart_associations
  union all select 'ourairports_runways', 'airport_ref', id, 'a', {_key('airport_ref')}, valid_from from ourairports_runways
  union all select 'airway_segments', 'start_ident', segment_id, 'n', {_key('start_ident')} || '|' || coalesce({_key('start_region')}, ''), valid_from from airway_segments
  union all select 'airway_segments', 'end_ident', segment_id, 'n', {_key('end_ident')} || '|' || coalesce({_key('end_region')}, ''), valid_from from airway_segments),
held as (
  select 'c' target, {_key('id')} k, coalesce(effective_from, timestamp '0001-01-01') f, coalesce(effective_to, timestamp '9999-12-31') u from chart_documents
  union all select 'a', {_key('id')}, valid_from, coalesce(valid_until, timestamp '9999-12-31') from ourairports_airports
  union all select 'n', {_key('ident')} || '|' || coalesce({_key('iso_country')}, ''), valid_from, coalesce(valid_until, timestamp '9999-12-31') from ourairports_navaids),
lost as (
  select r.*, strftime(at_, '%Y-%m') period,
    case when not exists (select 1 from held h where h.target = r.target and h.k = r.k and h.u > h.f) then 'missing'
         when not exists (select 1 from held h where h.target = r.target and h.k = r.k and h.u > h.f and h.f <= r.at_) then 'late'
         when exists (select 1 from held h where h.target = r.target and h.k = r.k and h.u > h.f and h.f > r.at_) then 'gap' else 'deleted' end reason
  from refs r where k is not null and not exists (select 1 from held h where h.target = r.target and h.k = r.k and h.f <= r.at_ and h.u > r.at_))
"""

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_P6 = f"""
with t as (select line_id, dataset_name, regexp_replace(coalesce(raw_line, ''), '(\\r\\n|\\n|\\r)$', '') txt from raw_csv_lines),
w as (select *, regexp_full_match(txt, '(?s){_FIELD}(?:,{_FIELD})*') ok, regexp_extract_all(',' || txt, '(?s),({_FIELD})', 1) cells from t),
c as (select *, case when ok then len(cells) end n,
  case when starts_with(cells[4], '"') then replace(substr(cells[4], 2, length(cells[4]) - 2), '""', '"') else cells[4] end c4,
  case when starts_with(cells[13], '"') then replace(substr(cells[13], 2, length(cells[13]) - 2), '""', '"') else cells[13] end c13,
  case when starts_with(cells[5], '"') then replace(substr(cells[5], 2, length(cells[5]) - 2), '""', '"') else cells[5] end c5,
  case when starts_with(cells[6], '"') then replace(substr(cells[6], 2, length(cells[6]) - 2), '""', '"') else cells[6] end c6 from w),
v as (select *, trim(c4) len_, trim(c13) hdg, lower(trim(c5)) kind, trim(c6) khz from c),
f as (select *, case when not ok then 'quoting' when n <> 20 then 'column_count'
  when dataset_name = 'runways' and (not regexp_full_match(len_, '[0-9]+') or try_cast(len_ as double) not between 1 and 30000
     or (hdg <> '' and (not regexp_full_match(hdg, '[0-9]+(\\.[0-9]+)?') or try_cast(hdg as double) not between 0 and 360))) then 'value'
  when dataset_name = 'navaids' and (not regexp_full_match(khz, '[0-9]+') or
     (case when kind in ('ndb', 'ndb-dme') then try_cast(khz as double) not between 190 and 1800 else try_cast(khz as double) not between 108000 and 118000 end)) then 'value' end reason from v)
"""

SQL = {
    "p1_found": _P1 + "select distinct * from found",
    "p1_counts": _P1 + "select source_snapshot_id, change_kind, count(*) records from (select distinct * from found) group by all",
    "p3_found": f"""
with rows_ as (
  select u.*, s.retrieved_at got from airport_updates u left join raw_source_snapshots s on s.snapshot_id = u.source_snapshot_id
  where valid_until is null or valid_until > valid_from),
held as (select * from (select *, row_number() over (partition by airport_id, valid_from order by got desc nulls last, update_id desc) nth from rows_) where nth = 1),
ended as (select *, least(coalesce(valid_until, timestamp '9999-12-31'), coalesce(lead(valid_from) over (partition by airport_id order by valid_from), timestamp '9999-12-31')) ends from held),
live as (select airport_id, valid_from, ends, {_plain('name')} n, {_plain('airport_type')} t, elevation_ft e, {_plain('municipality')} m from ended where not withdrawn),
flagged as (select *, case when lag(ends) over w = valid_from and lag(n) over w is not distinct from n and lag(t) over w is not distinct from t
   and lag(e) over w is not distinct from e and lag(m) over w is not distinct from m then 0 else 1 end starts from live window w as (partition by airport_id order by valid_from)),
grouped as (select *, sum(starts) over (partition by airport_id order by valid_from) g from flagged)
select airport_id, strftime(min(valid_from), '%Y-%m-%d %H:%M:%S') valid_from,
  case when max(ends) = timestamp '9999-12-31' then 'open' else strftime(max(ends), '%Y-%m-%d %H:%M:%S') end valid_until from grouped group by airport_id, g""",
    "p5_found": _P5 + "select distinct table_name, field_name, row_key, period from lost",
    "p5_report": _P5 + "select table_name, field_name, period, reason, count(distinct row_key) orphans from lost group by all",
    "p6_found": _P6 + "select line_id, reason from f where reason is not null",
    "p6_clean": _P6 + """select line_id, dataset_name, cast(n as bigint) cells,
  case when starts_with(cells[3], '"') then replace(substr(cells[3], 2, length(cells[3]) - 2), '""', '"') else cells[3] end third_cell from f where reason is null""",
    "p7_found": """
with p as (select distinct id, latitude_deg lat, longitude_deg lon from ourairports_navaids
  where latitude_deg between -90 and 90 and longitude_deg between -180 and 180 and not (latitude_deg = 0 and longitude_deg = 0))
select distinct a.id navaid_id_a, b.id navaid_id_b from p a join p b on a.id < b.id and abs(a.lat - b.lat) < 0.019
where 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lon - b.lon) / 2), 2)))) <= 2""",
}

SQL["p3_loaded"] = SQL["p3_found"]
SQL["p3_hub"] = "select airport_id, strftime(min(valid_from), '%Y-%m-%d %H:%M:%S') first_seen from airport_updates where valid_until is null or valid_until > valid_from group by 1"

_FIELDS = {"ident": "a", "name": "b", "navaid_type": "c", "iso_country": "e", "associated_airport": "f", "frequency_khz": "g", "elevation_ft": "h"}
SQL["p1_fields"] = _P1 + ", j as (select s.sid, n.*, o.* from one n join one o on o.series = n.series and o.seq = n.seq - 1 and o.k = n.k join seqs s on s.series = n.series and s.seq = n.seq)".replace("n.*, o.*", ", ".join(f"n.{c} n_{c}, o.{c} o_{c}" for c in [*_FIELDS.values(), "lat", "lon"])) + (
    ", u as (" + " union all ".join(f"select sid, '{name}' field_name from j where n_{c} is distinct from o_{c}" for name, c in _FIELDS.items())
    + " union all select sid, 'latitude_deg' from j where abs(n_lat - o_lat) >= 0.0000099999 union all select sid, 'longitude_deg' from j where abs(n_lon - o_lon) >= 0.0000099999) select sid source_snapshot_id, field_name, count(*) records from u group by all"
)
