"""Queries of text tables, XML, reconciliation and exports, with their SQL. Source texts are written from test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.operators import metadata_rules, quality, reconcile
from airloom.plans.functions import _A, _LEGS, _airports, _degrees_sql, _fixed, procedure_legs
from airloom.plans.reference import _hav
from airloom.session import cut
from airloom.sinks import packages
from airloom.sinks import text_layers as sink
from airloom.sources import documents
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


_T = F.lit


@query(_LEGS + """, h as (select pr, row_number() over (order by pr) * 100000 base from (select distinct pr from l)),
r as (select l.*, base from l join h using (pr))
select base + i line_no, pr procedure_ident, i % 1000 sequence_number, term path_terminator, nullif(fx, '') fix_ident, i % 2 = 0 fly_over, case when i % 3 > 0 then (i % 360)::double end magnetic, case when i % 3 < 2 then ((i + 7) % 360)::double end true_course,
case when i % 4 = 0 then 'BETWEEN' when i % 4 = 1 then 'AT_OR_ABOVE' when i % 4 = 2 then 'AT' end altitude_kind from r""")
def procedure_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC12, F10: coding rows under the header line that precedes them in their file."""
    from pyspark.sql import Window

    i = F.col("segment_id")
    legs = procedure_legs(spark, d)
    base = legs.select("procedure_ident").distinct().withColumn("base", F.row_number().over(Window.orderBy("procedure_ident")).cast("long") * 100_000)  # one row a procedure
    course = F.when(i % 3 == 0, F.concat(_T("("), ((i + 7) % 360).cast("string"), _T(".0)"))).when(i % 3 == 1, F.concat((i % 360).cast("string"), _T(" ("), ((i + 7) % 360).cast("string"), _T(".0)"))).otherwise((i % 360).cast("string"))
    alt = F.when(i % 4 == 0, "1000-2000").when(i % 4 == 1, "+FL060").when(i % 4 == 2, "3500").otherwise("by ATC")
    j = legs.join(base, "procedure_ident")
    rows = j.select((F.col("base") + i).alias("line_no"), F.concat_ws("|", (i % 1000).cast("string"), "path_terminator", F.concat(_T(" "), "fix_ident"), F.when(i % 2 == 0, "y").otherwise("N"), course, _T(""), _T("5 NM"), alt, _T("250")).alias("value"))
    heads = base.select(F.col("base").alias("line_no"), F.concat(_T("PROCEDURE: "), "procedure_ident", _T(" | RWY: 09 | APT: ROUT")).alias("value"))
    lines = cut(rows.unionByName(heads).withColumn("file", _T("one")))
    p = documents.procedure_table(lines)
    return p.select("line_no", "procedure_ident", "sequence_number", "path_terminator", "fix_ident", "fly_over", F.col("course.magnetic").alias("magnetic"), F.col("course.true").alias("true_course"), F.col("altitude.kind").alias("altitude_kind"))


@query(_LEGS + """ select i line_no, pr route_ident, sq sequence_number, case i % 4 when 0 then 'F' when 1 then 'B' else 'N' end direction, case when coalesce(a1, 0) // 100 >= 180 then 'H' else 'L' end "level", case when i % 5 > 0 then coalesce(a1, 0) // 100 * 100 else i % 90 * 100 end minimum_altitude_ft
from l where lat is not null and fx <> '' and not contains(fx, ',')""")
def ats_route_table(spark: SparkSession, d: str) -> DataFrame:
    """SRC14: route segments of comma text; comments, the header and short rows fall away."""
    i = F.col("segment_id")
    legs = procedure_legs(spark, d).filter("lat is not null and fix_ident <> '' and not contains(fix_ident, ',')")
    fl = F.floor(F.coalesce("altitude_1_ft", F.lit(0)) / 100).cast("int").cast("string")
    way = F.when(i % 4 == 0, "forward").when(i % 4 == 1, "ODD").otherwise("both")
    rows = legs.select(i.alias("line_no"), F.concat_ws(",", "procedure_ident", F.col("sequence_number").cast("string"), "fix_ident", F.col("lat").cast("string"), F.col("lon").cast("string"), _T("END"), _T("1.0"), _T("2.0"), way, fl, _T("660"), F.when(i % 5 > 0, "").otherwise((i % 90 * 100).cast("string"))).alias("value"))
    noise = spark.createDataFrame([(-1, "# comment"), (-2, "// comment"), (-3, "ROUTE,SEQ,START_FIX,START_LAT,START_LON,END_FIX,END_LAT,END_LON,DIR"), (-4, "A1,1,B,2"), (-5, "")], "line_no long, value string")
    s = documents.ats_segments(rows.unionByName(noise))
    return s.select("line_no", "route_ident", "sequence_number", "direction", "level", "minimum_altitude_ft")


@query(f"with {_A} select left(ident, 4) ident, id % 96 + 1 channel, 100000 + (id % 96 + 1) * 100 frequency_khz, {_degrees_sql('lat', 100)} lat, {_degrees_sql('lon', 100)} lon, (id % 400)::double range_km from a where not regexp_matches(name, '[,;|]')")
def rsbn_table(spark: SparkSession, d: str) -> DataFrame:
    """SRC15: stations whose frequency follows from their channel."""
    form = lambda c, n, s, w: F.regexp_replace(_fixed(F.col(c), n, s, w, 2), r"^([NSEW])(\d+)(\d{2})$", "$2.$3$1")
    i = F.col("id")
    a = _airports(spark, d).filter("not name rlike '[,;|]'")
    lines = a.select(i.alias("line_no"), F.concat_ws(";", F.substring("ident", 1, 4), "name", (i % 96 + 1).cast("string"), form("latitude_deg", "N", "S", 2), form("longitude_deg", "E", "W", 3), _T(""), (i % 400).cast("string")).alias("value"))
    s = documents.rsbn_stations(cut(lines).unionByName(spark.createDataFrame([(-1, "ident;name;channel;lat;lon")], "line_no long, value string")))
    return s.select("ident", "channel", "frequency_khz", F.round("latitude_deg", 9).alias("lat"), F.round("longitude_deg", 9).alias("lon"), "range_km")


@query(f"""with {_A}, b as (select * from a where not regexp_matches(coalesce(name, ''), '[<>&]'))
select case when id % 2 = 0 then 'Ahp' else 'AirportHeliport' end feature, ident, nullif(trim(name), '') "name", case when id % 11 > 0 then {_degrees_sql('lat', 100)} end lat, case when id % 11 > 0 then {_degrees_sql('lon', 100)} end lon,
case when e is null then null when id % 2 = 0 then round(round(e) * 3.280839895, 4) else round(e) end elevation_ft, case when id % 11 = 0 then 'no position' end reason from b""")
def aixm_features(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, SRC9, SRC10, F3: aerodromes of AIXM 4.5 and 5 documents; a missing position gives a reason."""
    i = F.col("id")
    la, lo = (F.regexp_replace(_fixed(F.col(c), n, s, w, 2), r"^([NSEW])(\d+)(\d{2})$", "$2.$3$1") for c, n, s, w in (("latitude_deg", "N", "S", 2), ("longitude_deg", "E", "W", 3)))
    a = _airports(spark, d).filter("not coalesce(name, '') rlike '[<>&]'")
    tag = lambda n, c: F.concat(_T(f"<{n}>"), F.coalesce(c, _T("")), _T(f"</{n}>"))
    e = F.round("elevation_ft").cast("int").cast("string")
    there = i % 11 > 0
    old = F.concat(_T('<AIXM-Snapshot version="4.5"><Ahp><AhpUid>'), tag("codeId", F.col("ident")), _T("</AhpUid>"), tag("txtName", F.col("name")), F.when(there, F.concat(tag("geoLat", la), tag("geoLong", lo))).otherwise(""), tag("valElev", e), _T("<uomDistVer>M</uomDistVer></Ahp></AIXM-Snapshot>"))
    new = F.concat(
        _T('<aixm:AIXMBasicMessage xmlns:aixm="http://www.aixm.aero/schema/5.1" xmlns:gml="http://www.opengis.net/gml/3.2"><aixm:AirportHeliport>'), tag("aixm:designator", F.col("ident")), tag("aixm:name", F.col("name")),
        F.when(there, tag("gml:pos", F.concat_ws(" ", la, lo))).otherwise(""), tag("aixm:elevation", e), _T("</aixm:AirportHeliport></aixm:AIXMBasicMessage>"),
    )
    docs = a.select(i.cast("string").alias("file"), F.when(i % 2 == 0, old).otherwise(new).alias("value"))
    f = documents.aixm(docs)
    return f.select("feature", "ident", "name", F.round("latitude_deg", 9).alias("lat"), F.round("longitude_deg", 9).alias("lon"), F.round("elevation_ft", 4).alias("elevation_ft"), "reason")


# --- reconciliation ---------------------------------------------------------------------------------------------------


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Navaids of the newest full delivery of each provider: provider, id, key, region, frequency, position."""
    f = read(spark, d, "fetched_datasets").filter(F.regexp_replace(F.lower("coverage"), "[^a-z]", "").isin("full", "fullsnapshot"))
    newest = f.groupBy(F.lower(F.trim("provider_name")).alias("provider")).agg(F.max_by("source_snapshot_id", F.struct("retrieved_at", "source_snapshot_id")).alias("source_snapshot_id"))
    r = read(spark, d, "dataset_rows").join(F.broadcast(newest), "source_snapshot_id")
    kind = F.when(F.upper(F.trim("navaid_type")).startswith("NDB"), "ndb").otherwise("vor")
    one = r.groupBy("provider", F.lower(F.trim("record_id")).alias("id")).agg(F.min_by(F.struct(F.upper(F.trim("ident")).alias("ident"), kind.alias("kind"), F.upper(F.trim("iso_country")).alias("region"), "frequency_khz", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon")), "row_id").alias("r"))
    return one.select("provider", "id", "r.*").filter("ident <> ''").withColumn("key", F.concat_ws(":", "kind", "ident", "region"))


_N = """f as (select lower(trim(provider_name)) provider, arg_max(source_snapshot_id, {r: retrieved_at, s: source_snapshot_id}) sid from fetched_datasets where regexp_replace(lower(coverage), '[^a-z]', '', 'g') in ('full', 'fullsnapshot') group by 1),
n as (select * from (select provider, lower(trim(record_id)) id, upper(trim(ident)) ident, case when starts_with(upper(trim(navaid_type)), 'NDB') then 'ndb' else 'vor' end kind, upper(trim(iso_country)) region, frequency_khz fq, latitude_deg lat, longitude_deg lon,
  row_number() over (partition by provider, lower(trim(record_id)) order by row_id) nth from dataset_rows join f on source_snapshot_id = sid) where nth = 1 and ident <> ''),
k as (select *, concat_ws(':', kind, ident, region) "key" from n),
s as (select provider, "key", count(*) n, arg_min({id: id, fq: fq, lat: lat, lon: lon}, id) r from k group by 1, 2),
p as (select a."key", a.provider pa, b.provider pb, a.n = 1 and b.n = 1 alone, a.r ra, b.r rb from s a join s b on a."key" = b."key" and a.provider < b.provider)"""


@query(f"""with {_N}, q as (select *, {_hav('ra.lat', 'ra.lon', 'rb.lat', 'rb.lon')} nm from p)
select pa provider_a, pb provider_b, "key", case when not alone then 'ambiguous' when nm <= 3 then 'exact' when nm <= 30 then 'probable' when nm is null then 'unplaced' else 'conflict' end outcome, alone and nm <= 30 and ra.fq <> rb.fq frequency_conflict from q""")
def navaid_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Navaids of every two providers on kind, ident and region, with a conflict where their frequencies differ."""
    out = reconcile.provider_pairs(_entities(spark, d), ["frequency_khz"])
    return out.select("provider_a", "provider_b", "key", "outcome", (F.array_contains("conflicts", "frequency_khz")).alias("frequency_conflict"))


@query(f"""with {_N}, q as (select *, {_hav('ra.lat', 'ra.lon', 'rb.lat', 'rb.lon')} nm from p)
select pa provider_a, pb provider_b, "key", case when not alone then 'ambiguous' when nm <= 3 then 'exact' when nm <= 30 then 'probable' when nm is null then 'unplaced' else 'distinct' end outcome from q""")
def waypoint_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """The same for points, where far apart is distinct and no conflict."""
    return reconcile.provider_pairs(_entities(spark, d), [], "distinct").select("provider_a", "provider_b", "key", "outcome")


@query(f"""with {_N}, q as (select *, {_hav('ra.lat', 'ra.lon', 'rb.lat', 'rb.lon')} nm from p),
m as (select pa provider, ra.id id, "key" from q where alone and nm <= 3 union select pb, rb.id, "key" from q where alone and nm <= 3)
select distinct 'nav:' || left(sha256("key"), 16) canonical_id, provider, id entity_id from m""")
def reconciled_memberships(spark: SparkSession, d: str) -> DataFrame:
    """Entities that exact pairs bring under one canonical id; running it again adds nothing."""
    e = _entities(spark, d)
    once = cut(reconcile.memberships(e, "nav"))
    return reconcile.join_memberships(once, reconcile.memberships(e, "nav"))


# --- rules of the metadata tables --------------------------------------------------------------------------------------

_KINDS = ", ".join(f"'{x}'" for x in metadata_rules.REVISION_KINDS)
_COVER = ", ".join(f"'{x}'" for x in metadata_rules.COVERAGES)


@query(f"""with v as (select source_snapshot_id id, revision_kind k, coverage c, content_sha256 h, publication_id pub, valid_from f, airac_cycle cy from fetched_datasets),
cy as (select airac_cycle id, min(effective_from) eff, max(effective_until) u from raw_source_snapshots where airac_cycle is not null group by 1),
i as (select distinct 16 rule, 'dataset_versions' table_name, id, 'unknown revision_kind ' || coalesce(k, 'null') message from v where k is null or k not in ({_KINDS})
 union all select distinct 16, 'dataset_versions', id, 'unknown coverage ' || coalesce(c, 'null') from v where c is null or c not in ({_COVER})
 union all select distinct 16, 'dataset_versions', id, 'content_sha256 must be 64 hex digits' from v where not coalesce(regexp_full_match(h, '[0-9a-f]{{64}}'), false)
 union all select distinct 20, 'dataset_versions', pub, 'references unknown cycle' from v where pub is not null and cy is not null and cy not in (select id from cy)
 union all select distinct 20, 'dataset_versions', pub, 'baseline does not start with its cycle' from v join cy on v.cy = cy.id where pub is not null and k = 'Baseline' and f <> eff
 union all select distinct 20, 'dataset_versions', pub, 'correction precedes its cycle' from v join cy on v.cy = cy.id where pub is not null and k = 'Correction' and f < eff
 union all select distinct 14, 'cycles', id, 'effective_until not strictly after effective_from' from cy where u <= eff
 union all select distinct 31, 'ils_associations', airport_ident || '/' || le_ident, 'localizer bearing out of range' from ourairports_runways where airport_ident is not null and not (le_heading_degt between 0 and 360)
 union all select distinct 3, 'airports', id::varchar, 'coordinates out of range' from ourairports_airports where latitude_deg < -90 or latitude_deg > 90 or longitude_deg < -180 or longitude_deg > 180)
select rule, table_name, message, count(*) n from i group by all""")
def validation_metadata(spark: SparkSession, d: str) -> DataFrame:
    """V1: rules 3, 14, 16, 20 and the course of 31, on deliveries, cycles and localizers."""
    v = read(spark, d, "fetched_datasets").withColumnRenamed("source_snapshot_id", "id")
    cycles = read(spark, d, "raw_source_snapshots").filter("airac_cycle is not null").groupBy(F.col("airac_cycle").alias("id")).agg(F.min("effective_from").alias("effective_from"), F.max("effective_until").alias("effective_until"))
    r = read(spark, d, "ourairports_runways").filter("airport_ident is not null")
    course = quality._issue(r.filter(~F.col("le_heading_degt").between(0, 360)), 31, "error", "ils_associations", "localizer bearing out of range", F.concat_ws("/", "airport_ident", "le_ident"))
    all_ = quality.report([
        metadata_rules.dataset_versions(v), metadata_rules.publication_dates(v, cycles), quality.cycle_windows(cycles.withColumnRenamed("id", "cycle")), quality.bad_coordinates(read(spark, d, "ourairports_airports"), "airports"), course,
    ])
    return all_.groupBy("rule", "table_name", "message").agg(F.count("*").alias("n"))


@query(_LEGS + """, i as (select 'unknown altitude descriptor' message, i from l where ds <> '' and ds not in ('+', '-', 'B') union all select 'altitude band requires both altitudes', i from l where ds = 'B' and (a1 is null or a2 is null)
 union all select 'altitude 2 set without altitude 1', i from l where a1 is null and a2 is not null) select message, count(*) n from i group by 1""")
def validation_altitudes(spark: SparkSession, d: str) -> DataFrame:
    """V1: rule 8 on the altitude descriptors of procedure legs."""
    legs = procedure_legs(spark, d).withColumn("id", F.col("segment_id"))
    return quality.altitude_descriptors(legs).groupBy("message").agg(F.count("*").alias("n"))


@query(f"""with {_N}, q as (select *, {_hav('ra.lat', 'ra.lon', 'rb.lat', 'rb.lon')} nm from p),
m as (select distinct 'nav:' || left(sha256("key"), 16) cid, id from (select ra.id id, "key" from q where alone and nm <= 30 union select rb.id, "key" from q where alone and nm <= 30)),
i as (select 24 rule, 'member without namespace' message, id from m where not contains(id, ':') union all select 26, 'one source with several canonicals', id from (select id from m group by 1 having count(*) > 1))
select rule, message, count(distinct id) n from i group by 1, 2""")
def validation_memberships(spark: SparkSession, d: str) -> DataFrame:
    """V1: rules 24 to 26, 28 and 29 on the memberships that reconciliation finds."""
    e = _entities(spark, d)
    p = cut(reconcile.provider_pairs(e, []).filter("outcome in ('exact', 'probable')"))
    ends = F.array(F.col("id_a"), F.col("id_b"))
    from airloom.functions.text import canonical_id

    t = lambda v: F.lit(v).cast("timestamp_ntz")
    m = p.select(canonical_id("nav", F.col("key")).alias("canonical_id"), F.lit("navaid").alias("kind"), F.explode(ends).alias("entity_id")).distinct().withColumns({"valid_from": t("2025-01-01"), "valid_until": t(None)})
    sources = e.select("id", "region", "lat", "lon").distinct().withColumns({"valid_from": t("2025-01-01"), "valid_until": t(None)})
    found = metadata_rules.memberships(m, m.select("canonical_id", "kind").distinct(), sources)
    return found.groupBy("rule", "message").agg(F.count_distinct("id").alias("n"))


# --- exports ----------------------------------------------------------------------------------------------------------


@query("""with l as (select distinct on (id) id, ident, navaid_type t, frequency_khz f, latitude_deg lat, longitude_deg lon from ourairports_navaids where latitude_deg is not null and longitude_deg is not null order by id, valid_from, latitude_deg, longitude_deg)
select concat_ws('|', ident, t, printf('%.6f', lat), printf('%.6f', lon), printf('%.2f', case when t = 'NDB' then f / 100.0 else f / 1000.0 end)) as "value" from l""")
def export_navaid_text(spark: SparkSession, d: str) -> DataFrame:
    """SNK11: navaid lines with the frequency in the unit of their kind."""
    n = read(spark, d, "ourairports_navaids").filter("latitude_deg is not null and longitude_deg is not null")
    n = n.groupBy("id").agg(F.min_by(F.struct("ident", "navaid_type", "frequency_khz", "latitude_deg", "longitude_deg"), F.struct("valid_from", "latitude_deg", "longitude_deg")).alias("r")).select("id", "r.*")
    line = sink.rendered("%s|%s|%.6f|%.6f|%.2f")
    return n.select(line(F.col("ident"), F.col("navaid_type"), F.col("latitude_deg"), F.col("longitude_deg"), sink.pmdg_frequency(F.col("navaid_type"), F.col("frequency_khz"))).alias("value"))


@query(_LEGS + """, t as (select *, case kind when 'D' then 'Departure' when 'E' then 'Arrival' else 'Approach' end tag from l where term in (""" + ", ".join(f"'{x}'" for x in packages.LEG_TYPES) + """)),
x as (select tag, pr, string_agg('<Leg type="' || term || '"' || case when fx <> '' then ' fixIdent="' || fx || '"' else '' end || case when a1 is not null then ' altitude1="' || a1 || '"' else '' end || case when a2 is not null then ' altitude2="' || a2 || '"' else '' end || '/>', '' order by tr, sq,
  '<Leg type="' || term || '"' || case when fx <> '' then ' fixIdent="' || fx || '"' else '' end || case when a1 is not null then ' altitude1="' || a1 || '"' else '' end || case when a2 is not null then ' altitude2="' || a2 || '"' else '' end || '/>') b from t group by 1, 2)
select sha256('<Airport ident="ROUT">' || string_agg('<' || tag || ' name="' || pr || '">' || b || '</' || tag || '>', '' order by tag, pr) || '</Airport>') digest from x having count(*) > 0""")
def export_procedure_xml(spark: SparkSession, d: str) -> DataFrame:
    """SNK10: the XML of an airport's procedures, whole, by its digest."""
    return packages.procedure_xml(procedure_legs(spark, d))[0].select(F.sha2("value", 256).alias("digest"))

