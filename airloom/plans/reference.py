"""Queries of the engine's own operators over the test tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.functions import geo, text
from airloom.operators import graph, quality, reconcile, temporal, tracking
from airloom.tables import read, small_side

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_PT = "((({0} * 7919) % 17000) / 100.0 - 85)::double", "((({0} * 104729) % 35900) / 100.0 - 179.5)::double"


def _pt(k: str) -> tuple[str, str]:
    return _PT[0].format(k), _PT[1].format(k)


def _hav(a: str, b: str, c: str, d: str, r: str = "3440.065") -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * {r} * atan2(sqrt({h}), sqrt(greatest(0, 1 - {h}))))"


_BEARING = (
    "((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360) % 360)"
)

# --- temporal ---------------------------------------------------------------------------------------------------------

AT = "2025-06-01 00:00:00"


@query(f"""select distinct id, ident, name, elevation_ft from ourairports_airports
where valid_from <= timestamp '{AT}' and (valid_until is null or valid_until > timestamp '{AT}')""")
def asof_airports(spark: SparkSession, d: str) -> DataFrame:
    """The airports as of an instant."""
    return temporal.as_of(read(spark, d, "ourairports_airports"), AT).select("id", "ident", "name", "elevation_ft").distinct()


_REV = """with one as (select o_custkey id, o_orderdate valid_from, max(o_orderkey) k, arg_max(o_orderstatus, o_orderkey) status, arg_max(o_orderpriority, o_orderkey) prio from orders group by 1, 2),
rev as (select *, lead(valid_from) over (partition by id order by valid_from) valid_until from one)"""


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    one = o.groupBy(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("valid_from")).agg(
        F.max("o_orderkey").alias("k"), F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_orderpriority", "o_orderkey").alias("prio")
    )
    return one.withColumn("valid_until", F.lead("valid_from").over(Window.partitionBy("id").orderBy("valid_from")))


@query(_REV + " select id, k, status from rev where valid_from <= timestamp '1998-01-01' and (valid_until is null or valid_until > timestamp '1998-01-01')")
def asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """T1 over the order revisions of customers."""
    return temporal.as_of(_revisions(spark, d), "1998-01-01 00:00:00").select("id", "k", "status")


@query("""select id, ident, name, valid_from from ourairports_airports where ident = 'QXHB' and valid_from <= timestamp '2026-01-01'
and (valid_until is null or valid_until > timestamp '2026-01-01') order by valid_from desc limit 1""")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The revision of one ident at an instant."""
    return temporal.lookup(read(spark, d, "ourairports_airports"), "QXHB", "2026-01-01 00:00:00").select("id", "ident", "name", "valid_from")


@query(_REV + ", l as (select *, lag(status) over w ps, lag(prio) over w pp, row_number() over w n from rev window w as (partition by id order by valid_from)) select id, valid_from, status, prio from l where n = 1 or status is distinct from ps or prio is distinct from pp")
def scd2_compact(spark: SparkSession, d: str) -> DataFrame:
    """Revisions without those that say what the one before said."""
    return temporal.compact(_revisions(spark, d), ["id"], ["valid_from"], ["status", "prio"]).select("id", "valid_from", "status", "prio")


def _airport_rows(spark: SparkSession, d: str, before: bool) -> DataFrame:
    cutoff = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    u = read(spark, d, "airport_updates").filter("not withdrawn")
    part = u.filter(F.col("valid_from") < cutoff) if before else u.filter(F.col("valid_from") >= cutoff)
    pick = F.max_by if before else F.min_by
    return part.groupBy(F.col("airport_id").alias("id")).agg(
        pick(F.struct("valid_from", "name", "elevation_ft", "municipality", "source_snapshot_id"), F.struct("valid_from", "update_id")).alias("r")
    ).select("id", "r.*").withColumn("valid_until", F.lit(None).cast("timestamp_ntz"))


_UP = """with cur as (select airport_id id, arg_max({valid_from: valid_from, name: name, e: elevation_ft, m: municipality}, {f: valid_from, u: update_id}) r from airport_updates
  where not withdrawn and valid_from < timestamp '2025-06-01' group by 1),
inc as (select airport_id id, arg_min({valid_from: valid_from, name: name, e: elevation_ft, m: municipality}, {f: valid_from, u: update_id}) r from airport_updates
  where not withdrawn and valid_from >= timestamp '2025-06-01' group by 1),
j as (select i.id, i.r ir, c.r cr, case when c.id is null then 'created' when c.r.name is not distinct from i.r.name and c.r.e is not distinct from i.r.e and c.r.m is not distinct from i.r.m then 'unchanged' else 'updated' end outcome
  from inc i left join cur c on c.id = i.id)"""


@query(_UP + """, closed as (select id from j where outcome = 'updated')
select c.id, c.r.valid_from valid_from, case when c.id in (select id from closed) then j.ir.valid_from end valid_until from cur c left join j on j.id = c.id
union all select id, ir.valid_from, null from j where outcome in ('created', 'updated')""")
def scd2_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The airport table after an upsert of later states."""
    pay = ["name", "elevation_ft", "municipality"]
    return temporal.upsert(_airport_rows(spark, d, True), _airport_rows(spark, d, False), pay).select("id", "valid_from", "valid_until")


@query(_UP + " select outcome, count(*) n from j group by 1")
def upsert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Created, updated and unchanged rows of an upsert."""
    c = temporal.classify(_airport_rows(spark, d, True), _airport_rows(spark, d, False), ["name", "elevation_ft", "municipality"])
    return c.groupBy("outcome").agg(F.count("*").alias("n"))


@query("select distinct 'airports' entity_table, id::varchar entity_id, valid_from, source_snapshot_id from ourairports_airports")
def observation_log(spark: SparkSession, d: str) -> DataFrame:
    """T4: one line per entity, revision and snapshot although rows come twice."""
    a = read(spark, d, "ourairports_airports").select(F.col("id").cast("string").alias("id"), "valid_from", "source_snapshot_id")
    empty = a.select(F.lit("").alias("entity_table"), F.col("id").alias("entity_id"), "valid_from", "source_snapshot_id").limit(0)
    return temporal.observe(empty, a, "airports")


@query("""with cur as (select 'sup:' || s_suppkey id from supplier), seen as (select distinct 'sup:' || l_suppkey id from lineitem where l_shipdate >= timestamp '2001-10-20')
select id, case when id not in (select id from seen) then timestamp '2001-10-20' end valid_until from cur""")
def close_absent(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers not seen any more end."""
    cur = read(spark, d, "supplier").select(
        F.concat(F.lit("sup:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("1995-01-01 00:00:00").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until")
    )
    seen = read(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("2001-10-20").cast("timestamp_ntz")).select(F.concat(F.lit("sup:"), F.col("l_suppkey").cast("string")).alias("id"))
    return temporal.close_absent(cur, seen, "sup", "2001-10-20 00:00:00").select("id", "valid_until")


@query("""with s as (select airport_id id, arg_max({u: valid_until}, {f: valid_from, k: update_id}) r from airport_updates where not withdrawn group by 1),
t as (select airport_id id, valid_from effective_from, update_id from airport_updates where withdrawn)
select t.id, t.effective_from, t.update_id, case when not starts_with(t.id, 'nva:') then 'foreign' when s.id is null then 'unknown' when s.r.u is not null then 'already_closed' else 'closed' end outcome
from t left join s on s.id = t.id""")
def tombstone_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What the withdrawals of airports do to a provider's table."""
    u = read(spark, d, "airport_updates")
    state = u.filter("not withdrawn").groupBy(F.col("airport_id").alias("id")).agg(F.max_by(F.struct("valid_from", "valid_until"), F.struct("valid_from", "update_id")).alias("r")).select("id", "r.*")
    stones = u.filter("withdrawn").select(F.col("airport_id").alias("id"), F.col("valid_from").alias("effective_from"), "update_id")
    return temporal.apply_tombstones(state, stones, "nva")[1].select("id", "effective_from", "update_id", "outcome")


_GUARD = """with p as (select publication_id, source_snapshot_id, lower(trim(provider_name)) owner, regexp_replace(lower(trim(content_sha256)), '^sha256:', '') content, revision_kind kind, retrieved_at
  from fetched_datasets where publication_id is not null),
o as (select *, row_number() over w n, first_value(owner) over w first_owner from p window w as (partition by publication_id order by retrieved_at, source_snapshot_id))
select source_snapshot_id, case when n = 1 then 'recorded' when owner <> first_owner then 'owner_conflict'
 when exists (select 1 from o q where q.publication_id = o.publication_id and q.n < o.n and q.content = o.content) then 'duplicate'
 when lower(kind) = 'correction' then 'correction' else 'content_conflict' end decision from o"""


@query(_GUARD)
def publication_guard(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each delivery of a publication."""
    p = read(spark, d, "fetched_datasets").filter("publication_id is not null").select(
        "publication_id", "source_snapshot_id", F.lower(F.trim("provider_name")).alias("owner"),
        F.regexp_replace(F.lower(F.trim("content_sha256")), "^sha256:", "").alias("content"), F.col("revision_kind").alias("kind"), "retrieved_at",
    )
    return temporal.publication_guard(p).select("source_snapshot_id", "decision")


@query(_REV + """, a as (select id, k from rev where valid_from < timestamp '1998-01-01' and (valid_until is null or valid_until >= timestamp '1998-01-01')),
b as (select id, k from rev where valid_from <= timestamp '1998-01-01' and (valid_until is null or valid_until > timestamp '1998-01-01'))
select coalesce(a.id, b.id) id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end change from a full join b on a.id = b.id where a.k is distinct from b.k""")
def rollback_diff(spark: SparkSession, d: str) -> DataFrame:
    """What changed between just before an instant and the instant."""
    return temporal.rollback_diff(_revisions(spark, d), "1998-01-01 00:00:00", ["k"])


@query("""with r as (select id, {e: elevation_ft, n: name, t: airport_type, m: municipality, a: latitude_deg, o: longitude_deg} v, valid_from f, coalesce(valid_until, timestamp '9999-12-31') u from ourairports_airports),
p as (select id, arg_max(v, f) v from r where f < timestamp '2025-05-15' and u >= timestamp '2025-05-15' group by 1), c as (select id, arg_max(v, f) v from r where f <= timestamp '2025-05-15' and u > timestamp '2025-05-15' group by 1)
select coalesce(p.id, c.id) id, case when p.id is null then 'added' when c.id is null then 'removed' else 'changed' end change from p full join c on p.id = c.id where p.v is distinct from c.v""")
def cycle_change_airports(spark: SparkSession, d: str) -> DataFrame:
    """What cycle 2505 changed in the airport table."""
    payload = ["elevation_ft", "name", "airport_type", "municipality", "latitude_deg", "longitude_deg"]
    return temporal.rollback_diff(read(spark, d, "ourairports_airports").distinct(), "2025-05-15 00:00:00", payload)


@query("""select o_orderkey, cast(floor((date_diff('day', date '2020-01-30', o_orderdate::date)) / 28.0) as bigint) cycle_index,
lpad(((2020 + cast(floor(floor(date_diff('day', date '2020-01-30', o_orderdate::date) / 28.0) / 13.0) as int)) % 100)::varchar, 2, '0') ||
lpad((((cast(floor(date_diff('day', date '2020-01-30', o_orderdate::date) / 28.0) as int) % 13 + 13) % 13) + 1)::varchar, 2, '0') label,
date '2020-01-30' + cast(floor(date_diff('day', date '2020-01-30', o_orderdate::date) / 28.0) as int) * 28 starts from orders""")
def airac_cycle_of_date(spark: SparkSession, d: str) -> DataFrame:
    """Cycle index, label and start of each order date, negative before the epoch."""
    i = text.cycle_index(F.col("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", i.alias("cycle_index"), text.cycle_label(i).alias("label"), text.cycle_start(i).alias("starts"))


@query("""with c as (select regexp_replace(upper(trim(airac_cycle)), '^AIRAC|[\\s/]', '', 'g') id, min(effective_from) f, max(effective_until) u from raw_source_snapshots where airac_cycle is not null group by 1),
r as (select *, f <= timestamp '2025-09-10' reached, row_number() over (order by (f <= timestamp '2025-09-10') desc, f desc, id desc) n from c)
select id, case when not reached then 'Preloaded' when n = 1 then case when u < timestamp '2025-09-10' then 'Expired' else 'Active' end else 'Superseded' end status from r""")
def cycle_status(spark: SparkSession, d: str) -> DataFrame:
    """The catalog of cycles as seen at an instant."""
    c = read(spark, d, "raw_source_snapshots").filter("airac_cycle is not null").groupBy(F.regexp_replace(F.upper(F.trim("airac_cycle")), r"^AIRAC|[\s/]", "").alias("id")).agg(
        F.min("effective_from").alias("effective_from"), F.max("effective_until").alias("effective_until")
    )
    return temporal.observe_cycles(c, "2025-09-10 00:00:00").select("id", "status")


_TABLES = (("airports", "ourairports_airports"), ("runways", "ourairports_runways"), ("navaids", "ourairports_navaids"))


@query(" union all ".join(
    f"select '{n}' table_name, count(*) revisions, count(distinct id) entities, count(distinct id) filter (valid_from <= timestamp '{AT}'"
    + ("" if n == "runways" else f" and (valid_until is null or valid_until > timestamp '{AT}')") + f") \"current\" from {t}" for n, t in _TABLES))
def world_summary(spark: SparkSession, d: str) -> DataFrame:
    """Revisions, entities and those valid at an instant, per table."""
    return temporal.summary({n: read(spark, d, t) for n, t in _TABLES}, AT)


@query("""select lower(trim(provider_name)) provider, dataset_name, arg_max(source_snapshot_id, {r: retrieved_at, s: source_snapshot_id}) source_snapshot_id from fetched_datasets group by 1, 2""")
def latest_dataset_version(spark: SparkSession, d: str) -> DataFrame:
    """The newest delivery of each provider and dataset."""
    f = read(spark, d, "fetched_datasets").withColumn("provider", F.lower(F.trim("provider_name")))
    return temporal.latest(f, ["provider", "dataset_name"], [F.desc("retrieved_at"), F.desc("source_snapshot_id")]).select("provider", "dataset_name", "source_snapshot_id")


# --- filters, nearby, joins -------------------------------------------------------------------------------------------


@query("""with p as (select distinct id, ident, name from ourairports_airports where starts_with(upper(ident), 'XA') or contains(upper(name), 'XA')) select * from p order by ident, id, name limit 25""")
def airport_search(spark: SparkSession, d: str) -> DataFrame:
    """Prefix or substring search in order of ident."""
    a = read(spark, d, "ourairports_airports").select("id", "ident", "name").distinct()
    return a.filter(F.upper("ident").startswith("XA") | F.upper("name").contains("XA")).orderBy("ident", "id", "name").limit(25)


_NEAR = f"""with p as (select distinct 'airport' kind, id, ident, latitude_deg lat, longitude_deg lon from ourairports_airports where valid_from <= timestamp '{AT}' and (valid_until is null or valid_until > timestamp '{AT}')
 union select distinct case when navaid_type like 'NDB%' then 'NDB' when navaid_type = 'DME' then 'DME' else 'VOR' end, id, ident, latitude_deg, longitude_deg from ourairports_navaids
 where valid_from <= timestamp '{AT}' and (valid_until is null or valid_until > timestamp '{AT}') and latitude_deg is not null and longitude_deg is not null),
q as (select kind, id, ident, round({_hav('48.0', '11.0', 'lat', 'lon')}, 6) distance_nm from p)
select * from q where distance_nm <= 3000 order by distance_nm, kind, id limit 50"""


@query(_NEAR)
def nearby_topk(spark: SparkSession, d: str) -> DataFrame:
    """Airports and navaids within a radius of a point at an instant, nearest first."""
    a = temporal.as_of(read(spark, d, "ourairports_airports"), AT).select(F.lit("airport").alias("kind"), "id", "ident", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
    n = temporal.as_of(read(spark, d, "ourairports_navaids"), AT).filter("latitude_deg is not null and longitude_deg is not null")
    kind = F.when(F.col("navaid_type").startswith("NDB"), "NDB").when(F.col("navaid_type") == "DME", "DME").otherwise("VOR")
    n = n.select(kind.alias("kind"), "id", "ident", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
    # latitude bounds the radius first, so that row groups far away are not read
    box = F.col("lat").between(48.0 - 3000 / 60 - 1, 48.0 + 3000 / 60 + 1)
    both = a.filter(box).unionByName(n.filter(box)).distinct()
    nm = F.round(geo.haversine_nm(F.lit(48.0), F.lit(11.0), F.col("lat"), F.col("lon")), 6)
    return both.select("kind", "id", "ident", nm.alias("distance_nm")).filter("distance_nm <= 3000").orderBy("distance_nm", "kind", "id").limit(50)


@query("select split_part(airport_id, ':', 1) namespace, count(*) n, count(distinct airport_id) entities from airport_updates group by 1")
def coverage_providers(spark: SparkSession, d: str) -> DataFrame:
    """Rows and entities by id namespace."""
    return read(spark, d, "airport_updates").groupBy(F.split("airport_id", ":")[0].alias("namespace")).agg(F.count("*").alias("n"), F.count_distinct("airport_id").alias("entities"))


@query("select id, navaid_type, frequency_khz, (latitude_deg between -90 and 90 and longitude_deg between -180 and 180) coordinates_ok, case when navaid_type in ('NDB', 'NDB-DME') then frequency_khz between 190 and 1800 when navaid_type = 'TACAN' then frequency_khz between 108000 and 136000 else frequency_khz between 108000 and 118000 end band_ok from (select distinct id, navaid_type, frequency_khz, latitude_deg, longitude_deg from ourairports_navaids)")
def range_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Coordinate and frequency ranges by kind."""
    n = read(spark, d, "ourairports_navaids").select("id", "navaid_type", "frequency_khz", "latitude_deg", "longitude_deg").distinct()
    ok = F.col("latitude_deg").between(-90, 90) & F.col("longitude_deg").between(-180, 180)
    return n.select("id", "navaid_type", "frequency_khz", ok.alias("coordinates_ok"), text.in_band(text.navaid_kind(F.col("navaid_type")), F.col("frequency_khz")).alias("band_ok"))


_HARD = "regexp_matches(upper(surface), 'ASP|CON|BIT|PEM|PAVED|TARMAC')"


@query(f"""with l as (select airport_ref, arg_max({{l: length_ft, w: width_ft, h: coalesce({_HARD}, false), i: id}}, {{l: length_ft, i: id}}) r from ourairports_runways where airport_ref is not null and length_ft is not null group by 1)
select airport_ref, r.l length_ft, r.i runway_id, concat_ws('; ', case when r.l < 6000 then 'runway too short' end, case when r.w < 100 then 'runway too narrow' end, case when not r.h then 'surface not hard' end) reasons from l""")
def airport_suitability(spark: SparkSession, d: str) -> DataFrame:
    """The longest runway of each airport against an aircraft's needs, with the reasons why not."""
    r = read(spark, d, "ourairports_runways").filter("airport_ref is not null and length_ft is not null")
    hard = F.coalesce(F.upper("surface").rlike("ASP|CON|BIT|PEM|PAVED|TARMAC"), F.lit(False))
    best = r.groupBy("airport_ref").agg(F.max_by(F.struct("length_ft", "width_ft", hard.alias("hard"), F.col("id").alias("runway_id")), F.struct("length_ft", "id")).alias("r"))
    why = F.array_compact(F.array(F.when(F.col("r.length_ft") < 6000, "runway too short"), F.when(F.col("r.width_ft") < 100, "runway too narrow"), F.when(~F.col("r.hard"), "surface not hard")))
    return best.select("airport_ref", "r.length_ft", "r.runway_id", F.array_join(why, "; ").alias("reasons"))


@query("""select distinct id, le_ident, regexp_full_match(le_ident, '(RW)*(0[1-9]|[12][0-9]|3[0-6])[LRCAB]?') valid,
case when regexp_matches(le_ident, '^(0[1-9]|[12][0-9]|3[0-6])') then lpad(((((regexp_extract(le_ident, '^(..)', 1)::int + 18) - 1) % 36) + 1)::varchar, 2, '0') || case regexp_extract(le_ident, '([LRC])$', 1) when 'L' then 'R' when 'R' then 'L' when 'C' then 'C' else '' end end back from ourairports_runways""")
def runway_designators(spark: SparkSession, d: str) -> DataFrame:
    """Validity and reciprocal of designators."""
    c = F.col("le_ident")
    return read(spark, d, "ourairports_runways").select("id", "le_ident", text.is_runway(c).alias("valid"), text.reciprocal_designator(c).alias("back")).distinct()


@query("""select event_id, event_type, ts <= timestamp '2024-01-15' and ts + interval 6 hour >= timestamp '2024-01-15' active, ts > timestamp '2024-01-15' and ts <= timestamp '2024-01-15' + interval 1 day upcoming from events""")
def temporal_activity(spark: SparkSession, d: str) -> DataFrame:
    """Active in a closed period and upcoming within a day."""
    t, now = F.col("ts"), F.lit("2024-01-15").cast("timestamp_ntz")
    return read(spark, d, "events").select(
        "event_id", "event_type", ((t <= now) & (t + F.expr("interval 6 hours") >= now)).alias("active"), ((t > now) & (t <= now + F.expr("interval 1 day"))).alias("upcoming")
    )


@query("""select s.snapshot_id, case when p.license_tier is null then 'unknown provider' when p.license_tier <> 'public' then 'not public' else 'ok' end verdict
from raw_source_snapshots s left join provider_registry p on lower(trim(s.provider_id)) = lower(trim(p.provider_id))""")
def policy_gate(spark: SparkSession, d: str) -> DataFrame:
    """Public distribution; an unknown provider fails."""
    p = read(spark, d, "provider_registry").select(F.lower(F.trim("provider_id")).alias("p"), "license_tier")
    s = read(spark, d, "raw_source_snapshots").join(small_side(p), F.lower(F.trim("provider_id")) == F.col("p"), "left")
    return s.select("snapshot_id", F.when(F.col("license_tier").isNull(), "unknown provider").when(F.col("license_tier") != "public", "not public").otherwise("ok").alias("verdict"))


@query("""with a as (select distinct id from ourairports_airports), r as (select distinct id, airport_ref from ourairports_runways)
select a.id airport_id, count(r.id) runways, coalesce(string_agg(r.id::varchar, ',' order by r.id), '') runway_ids from a left join r on r.airport_ref = a.id group by 1""")
def airport_runways_nested(spark: SparkSession, d: str) -> DataFrame:
    """Airports with their runways nested in one pass."""
    a = read(spark, d, "ourairports_airports").select(F.col("id").alias("airport_id")).distinct()
    r = read(spark, d, "ourairports_runways").filter("airport_ref is not null").groupBy(F.col("airport_ref").alias("airport_id")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    return a.join(r, "airport_id", "left").select("airport_id", F.size(ids).cast("long").alias("runways"), F.array_join(ids.cast("array<string>"), ",").alias("runway_ids"))


@query("""with a as (select distinct id, iso_country from ourairports_airports), r as (select distinct id, airport_ref from ourairports_runways)
select coalesce(iso_country, '??') country, count(distinct a.id) airports, count(r.id) runways from a left join r on r.airport_ref = a.id group by 1""")
def coverage_by_country(spark: SparkSession, d: str) -> DataFrame:
    """Airports and runways by country; runways are counted before the join, so nothing fans out."""
    a = read(spark, d, "ourairports_airports").select("id", "iso_country").distinct()
    r = read(spark, d, "ourairports_runways").select(F.col("id").alias("rid"), "airport_ref").distinct().groupBy("airport_ref").agg(F.count("rid").alias("n"))
    j = a.join(r, a.id == r.airport_ref, "left")
    return j.groupBy(F.coalesce("iso_country", F.lit("??")).alias("country")).agg(F.count_distinct("id").alias("airports"), F.coalesce(F.sum("n"), F.lit(0)).alias("runways"))


@query("""with f as (select distinct upper(trim(start_ident)) i, start_region r from airway_segments where trim(start_ident) <> ''),
n as (select upper(trim(ident)) i, iso_country r, min(id) filter (not starts_with(navaid_type, 'NDB')) vhf, min(id) filter (starts_with(navaid_type, 'NDB')) ndb from ourairports_navaids group by 1, 2)
select f.i ident, f.r region, coalesce(n.vhf, n.ndb) navaid_id, case when n.vhf is not null then 'vhf' when n.ndb is not null then 'ndb' end found_as from f left join n on n.i = f.i and n.r = f.r""")
def fix_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Ends of segments looked up as VHF navaid first, then as NDB, by ident and region."""
    f = read(spark, d, "airway_segments").select(F.upper(F.trim("start_ident")).alias("ident"), F.col("start_region").alias("region")).filter("ident <> ''").distinct()
    ndb = F.col("navaid_type").startswith("NDB")
    n = read(spark, d, "ourairports_navaids").groupBy(F.upper(F.trim("ident")).alias("ident"), F.col("iso_country").alias("region")).agg(F.min(F.when(~ndb, F.col("id"))).alias("vhf"), F.min(F.when(ndb, F.col("id"))).alias("ndb"))
    return f.join(n, ["ident", "region"], "left").select("ident", "region", F.coalesce("vhf", "ndb").alias("navaid_id"), F.when(F.col("vhf").isNotNull(), "vhf").when(F.col("ndb").isNotNull(), "ndb").alias("found_as"))


def _identity(ident: str, country: str) -> str:
    return f"case when upper(trim({ident})) = '' then null when regexp_full_match(upper(trim({ident})), '[A-Z]{{4}}') then 'icao:' || upper(trim({ident})) else 'local:' || upper(coalesce({country}, '')) || ':' || upper(trim({ident})) end"


_BUCKET = f"""with a as (select {_identity('ident', 'iso_country')} k, count(distinct id) n, arg_min({{id: id, lat: latitude_deg, lon: longitude_deg}}, {{i: id, f: latitude_deg, g: longitude_deg}}) r from ourairports_airports group by 1),
b as (select {_identity('ident', 'iso_country')} k, count(distinct record_id) n, arg_min({{id: record_id, lat: lat, lon: lon}}, {{i: record_id}}) r from aixm_airports group by 1),
j as (select a.k, a.n na, b.n nb, a.r ra, b.r rb, {_hav('a.r.lat', 'a.r.lon', 'b.r.lat', 'b.r.lon')} nm from a join b on a.k = b.k where a.k is not null)
select k "key", case when na = 1 and nb = 1 then ra.id end id_a, case when na = 1 and nb = 1 then rb.id end id_b, case when na = 1 and nb = 1 then round(nm, 6) end distance_nm,
case when na > 1 or nb > 1 then 'ambiguous' when nm is null then 'unplaced' when nm <= 3 then 'exact' when nm <= 30 then 'probable' else 'conflict' end outcome from j"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = read(spark, d, "ourairports_airports").select("id", text.airport_identity(F.col("ident"), F.col("iso_country")).alias("key"), F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
    a = a.groupBy("id", "key").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "key", "p.lat", "p.lon")
    b = read(spark, d, "aixm_airports").select(F.col("record_id").alias("id"), text.airport_identity(F.col("ident"), F.col("iso_country")).alias("key"), "lat", "lon").distinct()
    return a, b


@query(_BUCKET)
def reconcile_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of two providers in identity buckets, with distance tiers."""
    return reconcile.bucket_pairs(*_sides(spark, d))


@query(f"select outcome, count(*) n from ({_BUCKET}) group by 1")
def reconcile_stats(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of reconciliation."""
    return reconcile.bucket_pairs(*_sides(spark, d)).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""with f as (select lower(provider_name) p, source_snapshot_id, row_number() over (partition by lower(provider_name) order by retrieved_at desc, source_snapshot_id desc) nth from fetched_datasets where lower(coverage) <> 'partial'),
r as (select f.p, lower(trim(record_id)) id, arg_min({{t: navaid_type, i: ident, g: iso_country, lat: latitude_deg, lon: longitude_deg}}, row_id) v from dataset_rows join f using (source_snapshot_id) where nth = 1 group by 1, 2),
n as (select p, id, case when v.t = 'NDB' then 'ndb' else 'vor' end || ':' || upper(trim(v.i)) k, coalesce(upper(trim(v.g)), '') g, v.lat lat, v.lon lon from r where v.lat is not null and v.lon is not null and not (v.lat = 0 and v.lon = 0)),
c as (select a.p pa, a.id ia, b.p pb, b.id ib, a.g ga, b.g gb, round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) d from n a join n b on a.k = b.k and a.p < b.p where not exists (select 1 from n s where s.p = a.p and s.id = a.id and s.k = b.k and s.g = b.g)),
e as (select p, id, count(*) n from (select pa p, ia id from c where d <= 30 union all select pb, ib from c where d <= 30) group by 1, 2)
select pa provider_a, ia id_a, pb provider_b, ib id_b, d distance_nm, coalesce(x.n, 0) partners_a, coalesce(y.n, 0) partners_b,
case when d <= 30 and greatest(coalesce(x.n, 0), coalesce(y.n, 0)) > 1 then 'ambiguous' when ga <> '' and gb <> '' then 'distinct' when d <= 3 then 'exact' when d <= 30 then 'probable' else 'distinct' end outcome
from c left join e x on x.p = pa and x.id = ia left join e y on y.p = pb and y.id = ib""")
def navaid_provider_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Navaids of the last full deliveries of all providers on kind and whole ident, without strict pairs."""
    f = read(spark, d, "fetched_datasets").filter("lower(coverage) <> 'partial'").groupBy(F.lower("provider_name").alias("provider"))
    f = f.agg(F.max(F.struct("retrieved_at", "source_snapshot_id")).alias("s")).select("provider", "s.source_snapshot_id")
    rows = read(spark, d, "dataset_rows").join(F.broadcast(f), "source_snapshot_id").groupBy("provider", F.lower(F.trim("record_id")).alias("id"))
    n = rows.agg(F.min_by(F.struct("navaid_type", "ident", "iso_country", "latitude_deg", "longitude_deg"), "row_id").alias("v")).select("provider", "id", "v.*")
    n = n.filter("latitude_deg is not null and longitude_deg is not null and not (latitude_deg = 0 and longitude_deg = 0)")
    k = F.concat(text.navaid_class(F.col("navaid_type")), F.lit(":"), F.upper(F.trim("ident")))
    return reconcile.fallback_pairs(n.select("provider", "id", k.alias("key"), F.col("iso_country").alias("region"), F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon")))


@query(f"""with a as (select distinct id, ident, iso_country c, latitude_deg lat, longitude_deg lon from ourairports_airports), b as (select distinct record_id id, ident, iso_country c, lat, lon from aixm_airports where lat is not null and lon is not null)
select distinct a.id id_a, b.id id_b, a.ident ident_a, b.ident ident_b, round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) distance_nm from a join b on floor(a.lat / 0.1) = floor(b.lat / 0.1) and floor(a.lon / 0.1) = floor(b.lon / 0.1) and a.c = b.c
where a.ident <> b.ident and round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) <= 0.3""")
def ident_change_cells(spark: SparkSession, d: str) -> DataFrame:
    """Another ident at the same place, by 0.1 degree cells."""
    a = read(spark, d, "ourairports_airports").select("id", "ident", F.col("iso_country").alias("country"), F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon")).distinct()
    b = read(spark, d, "aixm_airports").filter("lat is not null and lon is not null").select(F.col("record_id").alias("id"), "ident", F.col("iso_country").alias("country"), "lat", "lon").distinct()
    return reconcile.ident_changes(a, b).distinct()


@query("""with e as (select id, case when le_latitude_deg < he_latitude_deg or (le_latitude_deg = he_latitude_deg and le_longitude_deg <= he_longitude_deg)
  then concat_ws(',', floor(le_latitude_deg * 100000 + 0.5)::bigint, floor(le_longitude_deg * 100000 + 0.5)::bigint, floor(he_latitude_deg * 100000 + 0.5)::bigint, floor(he_longitude_deg * 100000 + 0.5)::bigint) else concat_ws(',', floor(he_latitude_deg * 100000 + 0.5)::bigint, floor(he_longitude_deg * 100000 + 0.5)::bigint, floor(le_latitude_deg * 100000 + 0.5)::bigint, floor(le_longitude_deg * 100000 + 0.5)::bigint) end g from ourairports_runways)
select g geometry, count(distinct id) runways, min(id) first_id from e group by 1""")
def runway_identity(spark: SparkSession, d: str) -> DataFrame:
    """Runways by their ends, whatever their designator."""
    r = read(spark, d, "ourairports_runways")
    g = reconcile.runway_geometry(F.col("le_latitude_deg"), F.col("le_longitude_deg"), F.col("he_latitude_deg"), F.col("he_longitude_deg"))
    return r.groupBy(g.alias("geometry")).agg(F.count_distinct("id").alias("runways"), F.min("id").alias("first_id"))


@query("""with v as (select n_nationkey::varchar entity, 'name' field, upper(n_name) "value", 2 rank, 'nation' source from nation
 union all select c_nationkey::varchar, 'balance', round(c_acctbal, 2)::decimal(18, 2)::varchar, 2, 'customer' from customer union all select s_nationkey::varchar, 'balance', round(s_acctbal, 2)::decimal(18, 2)::varchar, 1, 'supplier' from supplier)
select entity, field, arg_min("value", {r: rank, s: source, v: "value"}) "value", arg_min(source, {r: rank, s: source, v: "value"}) source, count(distinct "value") - 1 overruled from v group by 1, 2""")
def authority_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Fields of an entity by the rank of their source, and how many values that overrules."""
    dec = lambda c: F.round(c, 2).cast("decimal(18,2)").cast("string")
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("entity"), F.lit("name").alias("field"), F.upper("n_name").alias("value"), F.lit(2).alias("rank"), F.lit("nation").alias("source"))
    c = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("entity"), F.lit("balance").alias("field"), dec(F.col("c_acctbal")).alias("value"), F.lit(2).alias("rank"), F.lit("customer").alias("source"))
    s = read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("entity"), F.lit("balance").alias("field"), dec(F.col("s_acctbal")).alias("value"), F.lit(1).alias("rank"), F.lit("supplier").alias("source"))
    return reconcile.authority(n.unionByName(c).unionByName(s))


@query("""with s as (select lower(trim(provider_name)) p, min({r: retrieved_at, s: source_snapshot_id}).s a, max({r: retrieved_at, s: source_snapshot_id}).s b from fetched_datasets where lower(coverage) <> 'partial' group by 1),
x as (select p, lower(trim(record_id)) k, arg_min({f: frequency_khz, e: elevation_ft}, row_id) v from dataset_rows join s on source_snapshot_id = s.a group by 1, 2),
y as (select p, lower(trim(record_id)) k, arg_min({f: frequency_khz, e: elevation_ft}, row_id) v from dataset_rows join s on source_snapshot_id = s.b group by 1, 2)
select coalesce(x.p, y.p) provider, coalesce(x.k, y.k) record_id, case when y.k is null then 'only_a' when x.k is null then 'only_b' when x.v.f is distinct from y.v.f or x.v.e is distinct from y.v.e then 'differs' else 'common' end "class",
case when x.k is null or y.k is null then '' else concat_ws(',', case when x.v.f is distinct from y.v.f then 'frequency_khz' end, case when x.v.e is distinct from y.v.e then 'elevation_ft' end) end fields from x full join y on x.p = y.p and x.k = y.k""")
def package_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two packages of each provider (its first and its last delivery that is not partial) field by field."""
    f = read(spark, d, "fetched_datasets").filter("lower(coverage) <> 'partial'").groupBy(F.lower(F.trim("provider_name")).alias("provider"))
    ends = f.agg(F.min(F.struct("retrieved_at", "source_snapshot_id")).alias("a"), F.max(F.struct("retrieved_at", "source_snapshot_id")).alias("b"))
    rows = read(spark, d, "dataset_rows").select("source_snapshot_id", F.lower(F.trim("record_id")).alias("record_id"), "row_id", "frequency_khz", "elevation_ft")

    def pack(side: str) -> DataFrame:
        sid = ends.select("provider", F.col(f"{side}.source_snapshot_id"))
        one = rows.join(small_side(sid), "source_snapshot_id")
        return one.groupBy("provider", "record_id").agg(F.min_by(F.struct("frequency_khz", "elevation_ft"), "row_id").alias("v")).select("provider", "record_id", "v.*")

    return reconcile.package_diff(pack("a"), pack("b"), ["provider", "record_id"], ["frequency_khz", "elevation_ft"])


@query("""with u as (select airport_icao k, title, 1 p from (select distinct on (airport_icao) airport_icao, title from chart_documents order by airport_icao, id, title)
 union all select ident, name, 0 from (select distinct on (ident) ident, name from ourairports_airports order by ident, valid_from, name))
select k "key", arg_max(title, p) title from u group by 1""")
def merge_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Datasets merged by key, the last one wins."""
    a = read(spark, d, "ourairports_airports").groupBy(F.col("ident").alias("key")).agg(F.min_by("name", F.struct("valid_from", "name")).alias("title"))
    c = read(spark, d, "chart_documents").groupBy(F.col("airport_icao").alias("key")).agg(F.min_by("title", F.struct("id", "title")).alias("title"))
    return reconcile.merge_datasets([a, c], "key")


@query("""select a.assoc_id, a.chart_id, case when count(c.id) over (partition by a.assoc_id) = 0 then 'unmatched'
 when max(case when (a.procedure_kind = 'D' and c.chart_type = 'sid') or (a.procedure_kind = 'E' and c.chart_type = 'star') or (a.procedure_kind = 'F' and c.chart_type = 'approach') then case when a.runway is not null and c.runway = a.runway then 2 else 1 end else 0 end) over (partition by a.assoc_id) = 2 then 'exact'
 when max(case when (a.procedure_kind = 'D' and c.chart_type = 'sid') or (a.procedure_kind = 'E' and c.chart_type = 'star') or (a.procedure_kind = 'F' and c.chart_type = 'approach') then 1 else 0 end) over (partition by a.assoc_id) = 1 then 'likely' else 'mismatch' end match
from (select distinct assoc_id, procedure_kind, runway, upper(trim(chart_id)) chart_id from chart_associations) a left join (select distinct upper(trim(id)) id, chart_type, runway from chart_documents) c on c.id = a.chart_id
qualify row_number() over (partition by a.assoc_id) = 1""")
def chart_association(spark: SparkSession, d: str) -> DataFrame:
    """Procedures against their charts by type and runway."""
    a = read(spark, d, "chart_associations").select("assoc_id", "procedure_kind", "runway", F.upper(F.trim("chart_id")).alias("chart_id")).distinct()
    c = read(spark, d, "chart_documents").select(F.upper(F.trim("id")).alias("cid"), "chart_type", F.col("runway").alias("chart_runway")).distinct()
    fits = ((F.col("procedure_kind") == "D") & (F.col("chart_type") == "sid")) | ((F.col("procedure_kind") == "E") & (F.col("chart_type") == "star")) | ((F.col("procedure_kind") == "F") & (F.col("chart_type") == "approach"))
    score = F.when(F.col("cid").isNull(), -1).when(~fits, 0).when(F.col("runway") == F.col("chart_runway"), 2).otherwise(1)
    best = a.join(c, F.col("chart_id") == F.col("cid"), "left").groupBy("assoc_id", "chart_id").agg(F.max(score).alias("s"))
    return best.select("assoc_id", "chart_id", F.when(F.col("s") == -1, "unmatched").when(F.col("s") == 2, "exact").when(F.col("s") == 1, "likely").otherwise("mismatch").alias("match"))


#: Lines of an order in a unique order, as line numbers may repeat.
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

# --- windows and aggregates -------------------------------------------------------------------------------------------


@query("""select l_orderkey route, l_linenumber seq, lag(l_suppkey) over w start_fix, l_suppkey end_fix, lag(l_quantity) over w altitude from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) qualify row_number() over w > 1""")
def airway_chain(spark: SparkSession, d: str) -> DataFrame:
    """A record and the one before it make a segment; the altitude comes from the one before."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    prev = F.lag(F.struct("l_suppkey", "l_quantity")).over(w)
    rows = read(spark, d, "lineitem").withColumn("p", prev).filter("p is not null")
    return rows.select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq"), F.col("p.l_suppkey").alias("start_fix"), F.col("l_suppkey").alias("end_fix"), F.col("p.l_quantity").alias("altitude"))


@query("""select route_ident, count(*) legs, arg_min({v: start_ident}, {s: sequence_number, i: segment_id}).v first_fix, arg_max({v: end_ident}, {s: sequence_number, i: segment_id}).v last_fix
from (select distinct on (segment_id) * from airway_segments order by segment_id, start_ident, end_ident) group by 1""")
def airway_summary(spark: SparkSession, d: str) -> DataFrame:
    """A4: legs and the first and last fix of each route."""
    one = read(spark, d, "airway_segments").groupBy("segment_id").agg(F.min(F.struct("start_ident", "end_ident", "route_ident", "sequence_number")).alias("r")).select("segment_id", "r.*")
    o = F.struct("sequence_number", "segment_id")
    return one.groupBy("route_ident").agg(
        F.count("*").alias("legs"), F.min_by(F.struct("start_ident"), o)["start_ident"].alias("first_fix"), F.max_by(F.struct("end_ident"), o)["end_ident"].alias("last_fix")
    )


@query("""select upper(trim(start_ident)) a, upper(trim(end_ident)) b, direction, level_code, minimum_altitude_ft lo, maximum_altitude_ft hi, string_agg(distinct route_ident, '-' order by route_ident) names
from airway_segments where minimum_altitude_ft is not null and maximum_altitude_ft is not null and trim(start_ident) <> '' and trim(end_ident) <> '' group by all""")
def segment_merge(spark: SparkSession, d: str) -> DataFrame:
    """SNK3: airways that share a segment and its band merge, their names joined."""
    s = read(spark, d, "airway_segments").filter("minimum_altitude_ft is not null and maximum_altitude_ft is not null and trim(start_ident) <> '' and trim(end_ident) <> ''")
    keys = [F.upper(F.trim("start_ident")).alias("a"), F.upper(F.trim("end_ident")).alias("b"), "direction", "level_code", F.col("minimum_altitude_ft").alias("lo"), F.col("maximum_altitude_ft").alias("hi")]
    return s.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("route_ident")), "-").alias("names"))


@query("""with h as (select *, sha256(coalesce(text, '')) k from documents) select k content, min(doc_id) first_doc, count(*) - 1 repeats, count(distinct source) sources from h group by 1 having count(*) > 1""")
def fix_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies by content hash; the first wins, the others are counted."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return read(spark, d, "documents").groupBy(h.alias("content")).agg(F.min("doc_id").alias("first_doc"), (F.count("*") - 1).alias("repeats"), F.count_distinct("source").alias("sources")).filter("repeats > 0")


@query('select user_id, date_trunc(\'minute\', ts) "minute", count(*) n from events group by 1, 2 having count(*) > 1')
def having_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """A2: several events of a user in a minute."""
    return read(spark, d, "events").groupBy("user_id", F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n")).filter("n > 1")


# --- geometry, graph, weather, tracking -------------------------------------------------------------------------------

@query(f"""with r as (select distinct id, le_latitude_deg a, le_longitude_deg b, he_latitude_deg c, he_longitude_deg d, le_heading_degt p from ourairports_runways)
select id, round(coalesce(p, {_BEARING.format(a='a', b='b', c='c', d='d')}), 4) heading, round({_hav('a', 'b', 'c', 'd', '6371.0088')}, 5) km from r""")
def runway_geometry(spark: SparkSession, d: str) -> DataFrame:
    """True heading and length of runways from their ends."""
    c = [F.col(x) for x in ("le_latitude_deg", "le_longitude_deg", "he_latitude_deg", "he_longitude_deg")]
    r = read(spark, d, "ourairports_runways").select("id", *c, "le_heading_degt", "le_ident").distinct()
    return r.select("id", F.round(geo.runway_heading(F.col("le_heading_degt"), *c, F.col("le_ident")), 4).alias("heading"), F.round(geo.haversine_km(*c), 5).alias("km")).distinct()


@query("""with r as (select distinct id, le_heading_degt h from ourairports_runways where le_heading_degt is not null)
select id, round(15 * cos(radians(240 - h)), 6) headwind, round(15 * sin(radians(240 - h)), 6) crosswind from r""")
def wind_components(spark: SparkSession, d: str) -> DataFrame:
    """Wind 240 degrees, 15 kt against each runway."""
    r = read(spark, d, "ourairports_runways").filter("le_heading_degt is not null").select("id", "le_heading_degt").distinct()
    w = geo.wind_components(F.col("le_heading_degt"), F.lit(240.0), F.lit(15.0))
    return r.select("id", F.round(w["headwind"], 6).alias("headwind"), F.round(w["crosswind"], 6).alias("crosswind"))


@query("""select distinct id, case when iso_country = 'CA' or (starts_with(ident, 'C') and length(ident) = 4) then 'CY' when iso_country = 'MX' or (starts_with(ident, 'M') and length(ident) = 4) then 'MM'
 when left(ident, 2) in ('PA', 'PF', 'PO', 'PP') then 'PA' when left(ident, 2) = 'PH' then 'PH' when left(ident, 2) in ('TJ', 'MD') then 'PR' when latitude_deg >= 50 and longitude_deg <= -130 then 'PA'
 when latitude_deg <= 25 and longitude_deg <= -150 then 'PH' when latitude_deg <= 20 and longitude_deg >= -70 then 'PR' when longitude_deg <= -104 then case when latitude_deg >= 42 then 'K1' else 'K2' end
 when longitude_deg <= -89 then case when latitude_deg >= 37 then 'K3' else 'K4' end when latitude_deg >= 40 and longitude_deg <= -80.5 then 'K5' when latitude_deg >= 37 then 'K6' else 'K7' end region from ourairports_airports""")
def airport_region(spark: SparkSession, d: str) -> DataFrame:
    """G14, SNK5: region codes."""
    return read(spark, d, "ourairports_airports").select("id", geo.region_of(F.col("latitude_deg"), F.col("longitude_deg"), F.col("ident"), F.col("iso_country")).alias("region")).distinct()


@query(None)
def geodesic_distance(spark: SparkSession, d: str) -> DataFrame:
    """G1: distance and bearing on the ellipsoid from a point to every airport."""
    a = read(spark, d, "ourairports_airports").select("id", "latitude_deg", "longitude_deg").distinct()
    g = geo.geodesic(F.lit(48.0), F.lit(11.0), F.col("latitude_deg"), F.col("longitude_deg"))
    return a.select("id", g.alias("g")).select("id", F.round("g.nm", 4).alias("nm"), F.round("g.bearing", 4).alias("bearing"))


@query("""with d as (select distinct id, latitude_deg lat, longitude_deg lon, elevation_ft e from ourairports_airports)
select id, round(greatest(0, 300 - (greatest(0, 35000 - (coalesce(e, 0) + 1500)) / 1000 * 3 + 5)), 6) tod_nm, case when id % 500 < 200 then case when id % 360 < 180 then 15000 else 16000 end when id % 500 < 400 then case when id % 360 < 180 then 25000 else 26000 end else case when id % 360 < 180 then 35000 else 36000 end end cruise_ft from d""")
def descent_and_cruise(spark: SparkSession, d: str) -> DataFrame:
    """Top of descent and cruise level."""
    a = read(spark, d, "ourairports_airports").select("id", "latitude_deg", "longitude_deg", "elevation_ft").distinct()
    tod = geo.top_of_descent_nm(F.lit(35_000.0), F.coalesce("elevation_ft", F.lit(0.0)), F.lit(300.0))
    return a.select("id", F.round(tod, 6).alias("tod_nm"), geo.cruise_level(F.col("id") % 500, F.col("id") % 360, F.lit(41_000)).alias("cruise_ft"))


_EDGE = """with s as (select distinct upper(trim(start_ident)) || '/' || start_region a, upper(trim(end_ident)) || '/' || end_region b, direction dir, route_ident from airway_segments where trim(start_ident) <> '' and trim(end_ident) <> ''),
e as (select a src, b dst, route_ident from s where dir <> 'B' union all select b, a, route_ident from s where dir <> 'F')"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    node = lambda i, r: F.concat_ws("/", F.upper(F.trim(i)), r)
    s = read(spark, d, "airway_segments").filter("trim(start_ident) <> '' and trim(end_ident) <> ''")
    legs = s.select(node("start_ident", "start_region").alias("start"), node("end_ident", "end_region").alias("end"), "direction", "route_ident").distinct()
    return graph.edges(legs)


@query(_EDGE + " select src, dst, route_ident from e")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges of the airway graph."""
    return _edges(spark, d).select("src", "dst", "route_ident")


@query(_EDGE + """, l as (select distinct src, dst from (select src, dst from e union all select dst, src from e)), n as (select src node from l union select dst from l),
r as (with recursive w(node, root) as (select node, node from n union select l.dst, w.root from w join l on l.src = w.node) select node, min(root) component from w group by 1)
select component, count(*) nodes from r group by 1""")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Weakly connected components of the airway graph with their sizes."""
    c = graph.components(_edges(spark, d))
    return c.groupBy("component").agg(F.count("*").alias("nodes"))


@query(None)
def route_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Shortest routes between the ends of every route ident over the airway graph, by haversine cost."""
    n = read(spark, d, "ourairports_navaids").filter("latitude_deg is not null and longitude_deg is not null").groupBy(F.concat_ws("/", F.upper(F.trim("ident")), "iso_country").alias("node")).agg(F.min(F.struct("id", "latitude_deg", "longitude_deg")).alias("p"))
    e = _edges(spark, d)
    a, b = n.select(F.col("node").alias("src"), F.col("p").alias("pa")), n.select(F.col("node").alias("dst"), F.col("p").alias("pb"))
    cost = geo.haversine_nm(F.col("pa.latitude_deg"), F.col("pa.longitude_deg"), F.col("pb.latitude_deg"), F.col("pb.longitude_deg"))
    placed = e.join(a, "src").join(b, "dst").select("src", "dst", "route_ident", F.round(cost, 6).alias("cost"))
    ends = placed.groupBy("route_ident").agg(F.min("src").alias("origin"), F.max("dst").alias("destination")).filter("origin <> destination")
    return graph.shortest(placed, ends).select("origin", "destination", F.round("cost", 4).alias("cost"), F.array_join("path", " ").alias("path"))


@query(_EDGE + """, t as (select src from e group by 1 order by count(*) desc, src limit 1),
w as (with recursive r(node, h) as (select src, 0 from t union select e.dst, r.h + 1 from r join e on e.src = r.node where r.h < 3) select node, min(h) hops from r group by 1) select node, hops from w""")
def graph_reach(spark: SparkSession, d: str) -> DataFrame:
    """What can be reached in three hops from the most used node."""
    e = _edges(spark, d)
    top = e.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1).collect()
    return graph.bfs(e, [r["src"] for r in top], 3)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        F.col("user_id").alias("session_id"), "ts", "event_id", (F.col("event_id") % 5 < 2).alias("on_ground"), F.coalesce("value", F.lit(0.0)).alias("speed"),
        (F.col("event_id") % 400 * 100).cast("double").alias("altitude"), (F.col("event_id") % 41 * 100 - 2000).cast("double").alias("vs"), (F.col("event_id") % 300).cast("double").alias("to_go"),
        ((F.col("event_id") * 7919 % 17_000) / 100.0 - 85).alias("lat"), ((F.col("event_id") * 104_729 % 35_900) / 100.0 - 179.5).alias("lon"),
    )


_SEEN = """with recursive e as (select user_id session_id, event_id, ts, event_id % 5 < 2 on_ground, coalesce(value, 0) speed, event_id % 400 * 100 altitude, event_id % 41 * 100 - 2000 vs, event_id % 300 to_go from events),
x as (select *, altitude over_departure, altitude over_destination, altitude agl, 35000 - altitude under_cruise from e),
s as (select session_id, event_id, row_number() over (partition by session_id order by ts, event_id) n,
  case {fresh} end fresh, case {flown} end flown from x),
r as (select session_id, 0::bigint n, 0::bigint event_id, 'preflight' phase, 0 ticks, false airborne, false changed from (select distinct session_id from s)
  union all select session_id, n, event_id, case when moved then raw else phase end, case when moved or raw = phase then 0 else ticks + 1 end, airborne or (moved and raw in ({air})), moved from (
    select r.session_id, s.n, s.event_id, r.phase, r.ticks, r.airborne, case when r.airborne then s.flown else s.fresh end raw,
      raw <> r.phase and r.ticks + 1 >= case {ticks} else 2 end moved from r join s on s.session_id = r.session_id and s.n = r.n + 1))
select session_id, event_id, phase, changed from r where n > 0"""
_WHEN = lambda flown: " ".join(f"when on_ground = {g} and ({rule}) then '{p}'" for p, g, f, rule in tracking.PHASES if f in (flown, None))


@query(_SEEN.format(fresh=_WHEN(False), flown=_WHEN(True), air=", ".join(f"'{p}'" for p in sorted(tracking.AIRBORNE)), ticks=" ".join(f"when raw = '{p}' then {n}" for p, n in tracking.TICKS.items())))
def telemetry_phase(spark: SparkSession, d: str) -> DataFrame:
    """ST1 to ST3: the phase of every sample of every session."""
    return tracking.replay(_samples(spark, d))


@query(f"""with e as (select user_id session_id, event_id, ts, {_pt('event_id')[0]} lat, {_pt('event_id')[1]} lon from events),
h as (select *, coalesce({_hav('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')}, 0) hop from e window w as (partition by session_id order by ts, event_id))
select session_id, event_id, round(sum(case when hop < 50 then hop else 0 end) over (partition by session_id order by ts, event_id rows unbounded preceding), 4) flown_nm from h""")
def telemetry_progress(spark: SparkSession, d: str) -> DataFrame:
    """ST1, W9: distance flown without teleports."""
    return tracking.progress(_samples(spark, d)).select("session_id", "event_id", F.round("flown_nm", 4).alias("flown_nm"))


@query("""with e as (select event_id, date_diff('second', ts, timestamp '2024-01-30 12:00:00') s from events) select event_id, case when floor(s / 60) <= 30 then 'FRESH' when floor(s / 60) <= 60 then 'AGING' when floor(s / 60) <= 120 then 'STALE' else 'EXPIRED' end weather,
case when s <= 35 then 'LIVE' when s <= 90 then 'DELAYED' when s <= 300 then 'STALE' else 'OFFLINE' end network from e""")
def freshness_tiers(spark: SparkSession, d: str) -> DataFrame:
    """F19, ST8: freshness of weather and network data at an instant."""
    s = F.expr("timestampdiff(SECOND, date_trunc('second', ts), timestamp'2024-01-30 12:00:00')")
    e = read(spark, d, "events").withColumn("s", s)
    return e.select("event_id", text.weather_freshness(F.floor(F.col("s") / 60)).alias("weather"), text.network_freshness(F.col("s")).alias("network"))


@query("select event_id, event_type from events where event_id > 500 order by event_id limit 100")
def event_paging(spark: SparkSession, d: str) -> DataFrame:
    """S5, ST5: a page of events after an id."""
    return read(spark, d, "events").filter("event_id > 500").select("event_id", "event_type").orderBy("event_id").limit(100)


@query("select distinct id, 'apt:' || left(sha256('icao:' || upper(trim(ident))), 16) canonical from ourairports_airports where regexp_full_match(upper(trim(ident)), '[A-Z]{4}')")
def sha_canonical_id(spark: SparkSession, d: str) -> DataFrame:
    """canonical ids from identity keys."""
    a = read(spark, d, "ourairports_airports").withColumn("k", text.airport_identity(F.col("ident"), F.lit(""))).filter("k like 'icao:%'")
    return a.select("id", text.canonical_id("apt", F.col("k")).alias("canonical")).distinct()


_V = """with issues as (
 select distinct 1 rule, 'error' severity, 'airports' table_name, id::varchar id, 'references missing source snapshot' message from ourairports_airports where source_snapshot_id not in (select snapshot_id from raw_source_snapshots)
 union all select distinct 2, 'error', 'runways', id::varchar, 'references missing airport' from ourairports_runways where airport_ref is null or airport_ref not in (select id from ourairports_airports)
 union all select distinct 3, 'error', 'navaids', id::varchar, 'coordinates out of range' from ourairports_navaids where latitude_deg < -90 or latitude_deg > 90 or longitude_deg < -180 or longitude_deg > 180
 union all select distinct 4, 'error', 'airports', id::varchar, 'valid_until not strictly after valid_from' from ourairports_airports where valid_until <= valid_from
 union all select distinct 4, 'error', 'updates', update_id::varchar, 'valid_until not strictly after valid_from' from airport_updates where valid_until <= valid_from
 union all select 5, 'error', 'airports', id::varchar, 'multiple open temporal revisions' from ourairports_airports where valid_until is null group by id having count(distinct valid_from) > 1
 union all select distinct 6, 'error', 'navaids', id::varchar, 'frequency outside its band' from ourairports_navaids where not (case when navaid_type in ('NDB', 'NDB-DME') then frequency_khz between 190 and 1800 when navaid_type = 'TACAN' then frequency_khz between 108000 and 136000 else frequency_khz between 108000 and 118000 end)
 union all select 10, 'error', 'airway_segments', route_ident || '/' || source_snapshot_id, 'sequence ' || sequence_number || ' duplicated' from (select distinct segment_id, route_ident, source_snapshot_id, sequence_number from airway_segments) group by route_ident, source_snapshot_id, sequence_number having count(*) > 1
 union all select distinct 12, 'warning', 'airway_legs', segment_id::varchar, 'endpoint has no waypoint or navaid' from airway_segments where (start_ident is not null and start_ident not in (select ident from ourairports_navaids)) or (end_ident is not null and end_ident not in (select ident from ourairports_navaids))
 union all select 19, 'error', 'publications', publication_id, 'conflicting content' from fetched_datasets where publication_id is not null group by publication_id having count(distinct content_sha256) > 1 and min(case when lower(revision_kind) = 'correction' then 0 else 1 end) = 1)"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: read(spark, d, n)
    a, n, r, s = t("ourairports_airports"), t("ourairports_navaids"), t("ourairports_runways"), t("airway_segments")
    legs = s.select(F.col("segment_id").alias("id"), "start_ident", "end_ident")
    distinct_legs = s.select("segment_id", "route_ident", "source_snapshot_id", "sequence_number").distinct()
    return quality.report([
        quality.orphan_snapshots(a, t("raw_source_snapshots"), "airports"),
        quality.missing_parent(r, a, "airport_ref", "runways"),
        quality.bad_coordinates(n, "navaids"),
        quality.inverted(a, "airports"),
        quality.inverted(t("airport_updates").withColumnRenamed("update_id", "id"), "updates"),
        quality.several_open(a, "airports"),
        quality.navaid_bands(n),
        quality.duplicate_sequence(distinct_legs, ["route_ident", "source_snapshot_id"], "sequence_number", "airway_segments"),
        quality.unresolved_ends(legs, n),
        quality.conflicting_publications(t("fetched_datasets")),
    ])


@query(_V + " select * from issues")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """The store's rules, one shape."""
    return _issues(spark, d)


@query(_V + " select rule, severity, table_name, message, count(*) n from issues group by all")
def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by rule."""
    return _issues(spark, d).groupBy("rule", "severity", "table_name", "message").agg(F.count("*").alias("n"))


@query(_V + " select * from issues qualify row_number() over (partition by rule, table_name, message order by id) <= 20")
def validation_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty of each rule."""
    return quality.first_of_each(_issues(spark, d))


@query("""with r as (select distinct id, le_latitude_deg a, le_longitude_deg b, he_latitude_deg c, he_longitude_deg d, le_heading_degt p from ourairports_runways where le_heading_degt is not null),
x as (select id, abs(((p - """ + _BEARING.format(a="a", b="b", c="c", d="d") + """ + 540) % 360) - 180) off from r)
select count(*) runways, count_if(off > 5 and off <= 10) over_5, count_if(off > 10 and off <= 30) over_10, count_if(off > 30 and off <= 60) over_30, count_if(off > 60) over_60 from x""")
def runway_drift(spark: SparkSession, d: str) -> DataFrame:
    """A10, V5: published headings against the ends, in exclusive buckets."""
    c = [F.col(x) for x in ("le_latitude_deg", "le_longitude_deg", "he_latitude_deg", "he_longitude_deg")]
    r = read(spark, d, "ourairports_runways").filter("le_heading_degt is not null").select("id", *c, "le_heading_degt").distinct()
    off = F.abs(F.pmod(F.col("le_heading_degt") - geo.bearing(*c) + 540, F.lit(360.0)) - 180)
    o = r.withColumn("off", off)
    b = lambda lo, hi: F.count_if((F.col("off") > lo) & (F.col("off") <= hi))
    return o.agg(F.count("*").alias("runways"), b(5, 10).alias("over_5"), b(10, 30).alias("over_10"), b(30, 60).alias("over_30"), b(60, 1000).alias("over_60"))


@query("""select direction, count(distinct segment_id) segments, count(distinct route_ident) routes, count(distinct case when start_ident = end_ident and start_region = end_region then segment_id end) self_loops from airway_segments group by 1""")
def ats_graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """Segments, routes and self loops by direction."""
    loop = F.when((F.col("start_ident") == F.col("end_ident")) & (F.col("start_region") == F.col("end_region")), F.col("segment_id"))
    return read(spark, d, "airway_segments").groupBy("direction").agg(F.count_distinct("segment_id").alias("segments"), F.count_distinct("route_ident").alias("routes"), F.count_distinct(loop).alias("self_loops"))


@query("select count(distinct id) charts, count(distinct airport_icao) airports, count(distinct provider_id) providers from chart_documents")
def chart_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the chart catalog."""
    return read(spark, d, "chart_documents").agg(F.count_distinct("id").alias("charts"), F.count_distinct("airport_icao").alias("airports"), F.count_distinct("provider_id").alias("providers"))


@query("select distinct airport_icao, id, chart_type, title, procedure_name from chart_documents")
def chart_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The chart catalog in order of airport, type and title."""
    return read(spark, d, "chart_documents").select("airport_icao", "id", "chart_type", "title", "procedure_name").distinct().orderBy("airport_icao", "chart_type", "title", "id")


@query("select sha256(string_agg(n, '|' order by n)) fingerprint from (select 'airports=' || count(distinct id) n from ourairports_airports union all select 'navaids=' || count(distinct id) from ourairports_navaids union all select 'runways=' || count(distinct id) from ourairports_runways)")
def world_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A16, SNK15: a fingerprint of the world's counts."""
    s = temporal.summary({n: read(spark, d, t) for n, t in _TABLES}, AT)
    line = F.concat_ws("=", "table_name", F.col("entities").cast("string"))
    return s.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("fingerprint"))


@query("""with a as (select distinct id, lower(trim(name)) alias, iso_country country from ourairports_airports), h as (select alias, count(distinct id) holders from a group by 1 having count(distinct id) > 1)
select distinct a.alias, a.country, h.holders from a join h on a.alias = h.alias""")
def aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names with several holders."""
    a = read(spark, d, "ourairports_airports").select("id", F.lower(F.trim("name")).alias("alias"), F.col("iso_country").alias("country")).distinct()
    h = a.groupBy("alias").agg(F.count_distinct("id").alias("holders")).filter("holders > 1")
    return a.select("alias", "country").distinct().join(h, "alias")


@query("""with u as (select distinct airport_id, list_sort(list(distinct airport_type) filter (airport_type is not null)) t from airport_updates group by 1),
h as (select airport_id, list_sort(list(distinct airport_type) filter (airport_type is not null and valid_from < timestamp '2025-06-01')) t from airport_updates group by 1)
select u.airport_id, array_to_string(list_sort([x for x in u.t if not list_contains(coalesce(h.t, []), x)]), ',') new_types from u join h using (airport_id) where u.t is not null""")
def new_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes there now and not before."""
    u = read(spark, d, "airport_updates")
    old = F.collect_set(F.when(F.col("valid_from") < F.lit("2025-06-01").cast("timestamp_ntz"), F.col("airport_type")))
    g = u.groupBy("airport_id").agg(F.collect_set("airport_type").alias("all"), old.alias("old")).filter("size(`all`) > 0")
    return g.select("airport_id", F.array_join(F.array_sort(F.array_except("all", "old")), ",").alias("new_types"))
