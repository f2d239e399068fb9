"""Queries of the scalar functions over the test tables, with SQL that works the expected values out of the tables.

Where a function decodes a form that no test table holds, the query writes the form from a table's numbers, decodes it
with the library and the SQL says what must come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions import geo, text
from airloom.operators import correlate, procedures
from airloom.plans.reference import _BEARING, _hav
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


def _airports(spark: SparkSession, d: str) -> DataFrame:
    """One row per airport: its first revision by time, then name and position."""
    a = read(spark, d, "ourairports_airports")
    cols = ["ident", "name", "airport_type", "latitude_deg", "longitude_deg", "elevation_ft", "iso_country", "municipality", "valid_from"]
    return a.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("valid_from", "name", "latitude_deg", "longitude_deg")).alias("r")).select("id", "r.*")


_A = "a as (select distinct on (id) id, ident, name, airport_type, latitude_deg lat, longitude_deg lon, elevation_ft e, iso_country country, municipality town, valid_from from ourairports_airports order by id, valid_from, name, latitude_deg, longitude_deg)"


def _fixed(value: Column, positive: str, negative: str, degrees: int, fraction: int) -> Column:
    """NDDMMSS with ``fraction`` digits after the seconds."""
    per = 10**fraction
    n = F.round(F.abs(value) * 3600 * per).cast("long")
    part = lambda c, w: F.lpad(c.cast("long").cast("string"), w, "0")
    sign = F.when(value < 0, negative).otherwise(positive)
    return F.concat(sign, part(F.floor(n / (3600 * per)), degrees), part(F.floor(n / (60 * per)) % 60, 2), part(F.floor(n / per) % 60, 2), part(n % per, fraction))


def _degrees_sql(c: str, per: int) -> str:
    return f"round((case when {c} < 0 then -1 else 1 end) * round(abs({c}) * 3600 * {per}) / (3600.0 * {per}), 9)"


@query(f"with {_A} select id, {_degrees_sql('lat', 100)} lat, {_degrees_sql('lon', 100)} lon from a")
def coordinate_fixed_width(spark: SparkSession, d: str) -> DataFrame:
    """NDDMMSSHH and WDDDMMSSHH."""
    a = _airports(spark, d)
    lat, lon = _fixed(F.col("latitude_deg"), "N", "S", 2, 2), _fixed(F.col("longitude_deg"), "E", "W", 3, 2)
    return a.select("id", F.round(text.dms(lat), 9).alias("lat"), F.round(text.dms(lon), 9).alias("lon"))


@query(f"with {_A} select id, {_degrees_sql('lat', 10000)} lat, {_degrees_sql('lon', 10000)} lon from a")
def coordinate_high_resolution(spark: SparkSession, d: str) -> DataFrame:
    """the same with four digits of fraction."""
    a = _airports(spark, d)
    lat, lon = _fixed(F.col("latitude_deg"), "N", "S", 2, 4), _fixed(F.col("longitude_deg"), "E", "W", 3, 4)
    return a.select("id", F.round(text.dms_high(lat), 9).alias("lat"), F.round(text.dms_high(lon), 9).alias("lon"))


@query(f"""with {_A} select id, case when id % 3 = 0 then {_degrees_sql('lat', 100)} else round(lat, 4) end lat,
case when e is null then null when id % 4 = 0 then round(round(e) * 3.280839895, 4) when id % 4 = 1 then round(e) when id % 4 = 2 then round(e) * 100 end feet from a""")
def coordinate_with_suffix(spark: SparkSession, d: str) -> DataFrame:
    """490035.00N, 49.0097N and plain decimals; heights in metres, feet and flight levels, null in any other unit."""
    a, lat = _airports(spark, d), F.col("latitude_deg")
    sexagesimal = F.regexp_replace(_fixed(lat, "N", "S", 2, 2), r"^([NS])(\d{6})(\d{2})$", "$2.$3$1")
    decimal = F.concat(F.format_string("%.4f", F.abs(F.round(lat, 4))), F.when(lat < 0, "s").otherwise("n"))
    form = F.when(F.col("id") % 3 == 0, sexagesimal).when(F.col("id") % 3 == 1, decimal).otherwise(F.concat(F.lit(" "), F.format_string("%.4f", F.round(lat, 4))))
    unit = F.element_at(F.array(F.lit("m"), F.lit("FT"), F.lit("FL"), F.lit("fathoms")), (F.col("id") % 4 + 1).cast("int"))
    return a.select("id", F.round(text.dms_suffix(form), 9).alias("lat"), F.round(text.feet(F.round("elevation_ft"), unit), 4).alias("feet"))


@query("""select distinct id, case when magnetic_variation_deg is null then null when magnetic_variation_deg >= 0 then round(magnetic_variation_deg * 10) / 10 else round(magnetic_variation_deg * 100) / 100 end variation from ourairports_navaids""")
def magnetic_variation_field(spark: SparkSession, d: str) -> DataFrame:
    """E0123 in tenths, W01234 in hundredths."""
    v = F.col("magnetic_variation_deg")
    form = F.when(v >= 0, F.concat(F.lit("E"), F.lpad(F.round(v * 10).cast("long").cast("string"), 4, "0"))).when(v < 0, F.concat(F.lit("W"), F.lpad(F.round(-v * 100).cast("long").cast("string"), 5, "0")))
    return read(spark, d, "ourairports_navaids").select("id", text.magnetic_variation(form).alias("variation")).distinct()


@query(f"with {_A} select id, ascii(substr(ident, 1, 1)) + 256 * ascii(substr(ident, 2, 1)) + 65536 * ascii(substr(ident, 3, 1)) number from a where regexp_full_match(left(ident, 3), '[A-Z0-9-]{{3}}')")
def waypoint_type_number(spark: SparkSession, d: str) -> DataFrame:
    """three characters as a little-endian number."""
    return _airports(spark, d).filter(F.col("ident").rlike("^[A-Z0-9-]{3}")).select("id", text.waypoint_type(F.substring("ident", 1, 3)).alias("number"))


@query("select distinct id, case upper(power_class) when 'HIGH' then 130 when 'MEDIUM' then 40 when 'LOW' then 25 end volume_nm, round(frequency_khz / 1000.0, 3) mhz, frequency_khz khz_again from ourairports_navaids")
def navaid_volume_and_frequency(spark: SparkSession, d: str) -> DataFrame:
    """service volume by power; kHz to MHz and back."""
    mhz = text.mhz(F.col("frequency_khz"))
    return read(spark, d, "ourairports_navaids").select("id", text.service_volume(F.col("power_class")).alias("volume_nm"), mhz.alias("mhz"), text.khz(mhz).alias("khz_again")).distinct()


@query("""select distinct segment_id, case when lo is null or hi is null then null else ['BETWEEN', 'AT_OR_ABOVE', 'AT_OR_BELOW', 'BETWEEN', 'AT'][segment_id % 5 + 1] end kind,
case when lo is null or hi is null then null when segment_id % 5 in (0, 3) then least(lo, hi) when segment_id % 5 in (1, 4) then lo end low_ft,
case when lo is null or hi is null then null when segment_id % 5 in (0, 3) then greatest(lo, hi) when segment_id % 5 = 2 then hi when segment_id % 5 = 4 then lo end high_ft
from (select segment_id, minimum_altitude_ft // 100 * 100 lo, maximum_altitude_ft // 100 * 100 hi from airway_segments)""")
def altitude_grammar(spark: SparkSession, d: str) -> DataFrame:
    """a-b, +a, -a, FLx-FLy and a."""
    s = read(spark, d, "airway_segments")
    lo, hi = (F.floor(F.col(c) / 100).cast("int") * 100 for c in ("minimum_altitude_ft", "maximum_altitude_ft"))
    fl = lambda c: F.concat(F.lit("FL"), F.lpad((c / 100).cast("int").cast("string"), 3, "0"))
    t = lambda c: c.cast("string")
    forms = [F.concat(t(lo), F.lit(" - "), t(hi)), F.concat(F.lit("+"), t(lo)), F.concat(F.lit("-"), t(hi)), F.concat(fl(lo), F.lit("-"), fl(hi)), t(lo)]
    form = F.when(lo.isNotNull() & hi.isNotNull(), F.element_at(F.array(*forms), (F.col("segment_id") % 5 + 1).cast("int")))
    return s.select("segment_id", text.altitude_constraint(form).alias("c")).select("segment_id", "c.kind", F.col("c.lo").alias("low_ft"), F.col("c.hi").alias("high_ft")).distinct()


@query("""select distinct id, case when id % 3 < 2 then round(h) end magnetic, case when id % 3 > 0 then round(h, 1) end true_course,
round(case when id % 4 = 0 then len / 100.0 / 1.852 when id % 4 = 1 then len / 100.0 end, 6) nm, case when id % 4 = 2 then len / 100.0 end as minutes
from (select id, le_heading_degt h, length_ft len from ourairports_runways where le_heading_degt is not null and length_ft is not null)""")
def course_and_distance_grammar(spark: SparkSession, d: str) -> DataFrame:
    """"63 (074.5)" and "d km", "d NM", "n MIN"; anything else is null."""
    r = read(spark, d, "ourairports_runways").filter("le_heading_degt is not null and length_ft is not null")
    h, kind, way = F.col("le_heading_degt"), F.col("id") % 3, F.col("id") % 4
    mag, true = F.round(h).cast("int").cast("string"), F.format_string("(%s)", F.format_string("%05.1f", F.round(h, 1)))
    course = F.when(kind == 0, mag).when(kind == 1, F.concat_ws(" ", mag, true)).otherwise(true)
    unit = F.when(way == 0, " km").when(way == 1, " NM").when(way == 2, " min").otherwise(" parsec")
    c, m = text.dual_course(course), text.distance_or_time(F.concat(F.format_string("%.2f", F.col("length_ft") / 100), unit))
    return r.select("id", c["magnetic"].alias("magnetic"), c["true"].alias("true_course"), F.round(m["nm"], 6).alias("nm"), m["minutes"].alias("minutes")).distinct()


_KEY = """case when ident is null or trim(ident) = '' then null when regexp_full_match(upper(trim(ident)), '[A-Z]{4}') then 'icao:' || upper(trim(ident)) else 'local:' || upper(coalesce(country, '')) || ':' || upper(trim(ident)) end"""


@query(f"""with {_A}, k as (select id, {_KEY} k from a), n as (select distinct id, case when upper(navaid_type) = 'NDB' then 'ndb' else 'vor' end || ':' || upper(trim(ident)) || ':' || upper(trim(iso_country)) k from ourairports_navaids)
select 'airport' kind, id, k identity_key, 'apt:' || left(sha256(k), 16) canonical from k union all select 'navaid', id, k, 'nav:' || left(sha256(k), 16) from n""")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    """identity keys of airports and navaids and the canonical ids from them."""
    a = _airports(spark, d).select(F.lit("airport").alias("kind"), "id", text.airport_identity(F.col("ident"), F.col("iso_country")).alias("identity_key"), F.lit("apt").alias("p"))
    n = read(spark, d, "ourairports_navaids").select(F.lit("navaid").alias("kind"), "id", text.navaid_identity(F.col("navaid_type"), F.col("ident"), F.col("iso_country")).alias("identity_key"), F.lit("nav").alias("p")).distinct()
    both = a.unionByName(n)
    return both.select("kind", "id", "identity_key", F.when(F.col("p") == "apt", text.canonical_id("apt", F.col("identity_key"))).otherwise(text.canonical_id("nav", F.col("identity_key"))).alias("canonical"))


@query("select distinct segment_id, sha256(least(upper(trim(start_ident)), upper(trim(end_ident))) || '|' || greatest(upper(trim(start_ident)), upper(trim(end_ident))) || '|' || route_ident) \"key\" from airway_segments where trim(start_ident) <> '' and trim(end_ident) <> ''")
def conflict_keys(spark: SparkSession, d: str) -> DataFrame:
    """one key for a pair whichever side comes first."""
    s = read(spark, d, "airway_segments").filter("trim(start_ident) <> '' and trim(end_ident) <> ''")
    return s.select("segment_id", text.conflict_key(F.upper(F.trim("start_ident")), F.upper(F.trim("end_ident")), F.col("route_ident")).alias("key")).distinct()


@query(f"with {_A} select id, round(year(valid_from) + (dayofyear(valid_from) - 1) / dayofyear(make_date(year(valid_from), 12, 31))::double, 9) decimal_year from a")
def decimal_years(spark: SparkSession, d: str) -> DataFrame:
    """instants as fractions of their year."""
    return _airports(spark, d).select("id", F.round(text.decimal_year(F.col("valid_from")), 9).alias("decimal_year"))


@query("""with e as (select event_id, case when event_id % 11 > 0 then (event_id * 37) % 5000 end c, case when event_id % 13 > 0 then event_id % 9 end v from events)
select event_id, case when coalesce(c, 10000) < 500 or coalesce(v, 10) < 1 then 'LIFR' when coalesce(c, 10000) < 1000 or coalesce(v, 10) < 3 then 'IFR' when coalesce(c, 10000) <= 3000 or coalesce(v, 10) <= 5 then 'MVFR' else 'VFR' end category from e""")
def flight_categories(spark: SparkSession, d: str) -> DataFrame:
    """category from ceiling and visibility, either of which may be missing."""
    e, i = read(spark, d, "events"), F.col("event_id")
    ceiling, vis = F.when(i % 11 > 0, (i * 37) % 5000), F.when(i % 13 > 0, (i % 9).cast("double"))
    return e.select("event_id", text.flight_category(ceiling, vis).alias("category"))


_SUFFIX = ["_OBS", "_FSS", "_CTR", "_DEP", "_APP", "_TWR", "_GND", "_DEL", "_ATIS", "_X", ""]


@query(f"""with {_A}, c as (select id, case when id % 3 = 0 then left(upper(regexp_replace(ident, '[^A-Za-z]', '', 'g')), 3) else upper(regexp_replace(ident, '[^A-Za-z]', '', 'g')) end || (array{_SUFFIX})[id % 11 + 1] callsign from a)
select id, callsign, coalesce((array['OBS','FSS','CTR','DEP','APP','TWR','GND','DEL','ATIS'])[id % 11 + 1], 'OTHER') facility,
case when regexp_full_match(split_part(callsign, '_', 1), '[A-Z]{{4}}') then split_part(callsign, '_', 1) when regexp_full_match(split_part(callsign, '_', 1), '[A-Z]{{3}}') then 'K' || split_part(callsign, '_', 1) end airport from c""")
def callsigns(spark: SparkSession, d: str) -> DataFrame:
    """facility by suffix, airport by the letters before it."""
    letters = F.upper(F.regexp_replace("ident", "[^A-Za-z]", ""))
    head = F.when(F.col("id") % 3 == 0, F.substring(letters, 1, 3)).otherwise(letters)
    call = F.concat(head, F.element_at(F.array(*[F.lit(s) for s in _SUFFIX]), (F.col("id") % 11 + 1).cast("int")))
    a = _airports(spark, d).select("id", call.alias("callsign"))
    return a.select("id", "callsign", text.facility(F.col("callsign")).alias("facility"), text.callsign_airport(F.col("callsign")).alias("airport"))


@query("""select distinct segment_id, case segment_id % 4 when 0 then lo // 100 * 100 when 1 then lo // 100 * 100 when 2 then case when lo // 100 < 1000 then lo // 100 * 100 end else case when lo < 1000 then lo * 100 else lo end end feet
from (select segment_id, minimum_altitude_ft lo from airway_segments where minimum_altitude_ft is not null)""")
def filed_altitudes(spark: SparkSession, d: str) -> DataFrame:
    """FL350, F350, 350 and 35000."""
    s, lo = read(spark, d, "airway_segments").filter("minimum_altitude_ft is not null"), F.col("minimum_altitude_ft")
    hundreds = F.floor(lo / 100).cast("int").cast("string")
    forms = F.array(F.concat(F.lit("FL"), hundreds), F.concat(F.lit("f"), hundreds), F.concat(F.lit(" "), hundreds), lo.cast("string"))
    return s.select("segment_id", text.altitude_ft(F.element_at(forms, (F.col("segment_id") % 4 + 1).cast("int"))).alias("feet")).distinct()


@query(f"""with {_A} select id, replace(replace(replace(replace(replace(name || ' <' || ident || '> & "x''"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') html,
left(regexp_replace(upper(ident || ' ' || airport_type), '[^A-Z0-9_-]', '', 'g'), 12) callsign, left(regexp_replace(upper(ident), '[^A-Z0-9]', '', 'g'), 4) icao, round(((lon * 3) % 360 + 360) % 360, 6) heading from a""")
def sanitized_text(spark: SparkSession, d: str) -> DataFrame:
    """escaped and cleaned text, headings within 360."""
    html = text.escape_html(F.concat("name", F.lit(" <"), "ident", F.lit("> & \"x'\"")))
    return _airports(spark, d).select(
        "id", html.alias("html"), text.clean_callsign(F.concat("ident", F.lit(" "), "airport_type")).alias("callsign"), text.clean_icao(F.col("ident")).alias("icao"), F.round(text.heading360(F.col("longitude_deg") * 3), 6).alias("heading"),
    )


_HAZARDS = [("convective sigmet", "CONVECTIVE"), ("SEV TURB", "TURBULENCE"), ("icing", "ICING"), ("volcanic ash", "VOLCANIC_ASH"), ("IFR", "IFR"), ("MTN wave", "MOUNTAIN_WAVE"), ("dust", "OTHER"), ("Thunder", "CONVECTIVE"), ("mtw", "MOUNTAIN_WAVE")]


@query(f"select event_id, (array{[b for _, b in _HAZARDS]})[event_id % 9 + 1] hazard from events")
def sigmet_hazards(spark: SparkSession, d: str) -> DataFrame:
    """hazards from free spelling."""
    said = F.element_at(F.array(*[F.lit(a) for a, _ in _HAZARDS]), (F.col("event_id") % 9 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", text.sigmet_hazard(said).alias("hazard"))


@query("""select distinct id, case when source_url is null then null else '<path>/' || split_part(source_url_, '/', -1) end redacted from (select id, source_url, regexp_replace(source_url, '^[a-z]+://', '') source_url_ from chart_documents)""")
def redacted_paths(spark: SparkSession, d: str) -> DataFrame:
    """paths without their folders in diagnostics."""
    path = F.concat(F.lit("/var/lib/"), F.regexp_replace("source_url", "^[a-z]+://", ""))
    return read(spark, d, "chart_documents").select("id", text.redact_path(path).alias("redacted")).distinct()


@query(f"""with {_A} select id, case when contains(lower(airport_type), 'large') then 1 when contains(lower(airport_type), 'medium') then 2 when contains(lower(airport_type), 'small') then 3 when contains(lower(airport_type), 'heli') then 4 when contains(lower(airport_type), 'sea') then 5 else 6 end tier from a""")
def airport_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers from the type."""
    return _airports(spark, d).select("id", text.airport_tier(F.col("airport_type")).alias("tier"))


@query("select event_id, coalesce(value, 0) >= 40 or event_id % 900 > 500 airborne from events")
def airborne_test(spark: SparkSession, d: str) -> DataFrame:
    """In the air by speed or height."""
    return read(spark, d, "events").select("event_id", correlate.airborne(F.coalesce("value", F.lit(0.0)), F.col("event_id") % 900).alias("airborne"))


# --- geometry ---------------------------------------------------------------------------------------------------------

_LAT2 = "degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(b)))"
_LON2 = "degrees(radians(lon) + atan2(sin(b) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * (sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(b))))"


@query(f"""with {_A}, p as (select id, lat, lon, (id % 500 + 1) / 3440.065 d, radians(id % 360) b from a)
select id, round({_LAT2}, 6) lat, round((({_LON2} + 540) % 360 + 360) % 360 - 180, 6) lon from p where abs(lat) < 85""")
def direct_point(spark: SparkSession, d: str) -> DataFrame:
    """The point at a distance and bearing."""
    a = _airports(spark, d).filter("abs(latitude_deg) < 85")
    p = geo.direct_point(F.col("latitude_deg"), F.col("longitude_deg"), (F.col("id") % 360).cast("double"), (F.col("id") % 500 + 1).cast("double"))
    lon = F.pmod(p["lon"] + 540, F.lit(360.0)) - 180
    return a.select("id", F.round(p["lat"], 6).alias("lat"), F.round(lon, 6).alias("lon"))


_XTK = f"""asin(least(1, greatest(-1, sin({_hav('48.0', '11.0', 'lat', 'lon')} / 3440.065) * sin(radians({_BEARING.format(a='48.0', b='11.0', c='lat', d='lon')}) - radians({_BEARING.format(a='48.0', b='11.0', c='53.0', d='-6.0')}))))) * (6371000.0 / 1852)"""


@query(f"with {_A} select id, round({_XTK}, 4) xtk_nm from a where lat between 40 and 60 and lon between -30 and 40")
def cross_track(spark: SparkSession, d: str) -> DataFrame:
    """Signed distance from a great circle."""
    a = _airports(spark, d).filter("latitude_deg between 40 and 60 and longitude_deg between -30 and 40")
    x = geo.track_offsets(F.col("latitude_deg"), F.col("longitude_deg"), F.lit(48.0), F.lit(11.0), F.lit(53.0), F.lit(-6.0))
    return a.select("id", F.round(x["cross_nm"], 4).alias("xtk_nm"))


# --- procedures -------------------------------------------------------------------------------------------------------
# No test table holds procedure legs: those of a route, in sequence, take the place of the legs of one procedure.

_T = procedures.TERMINATORS
_CODES = [t[0] for t in _T]
_DESCRIPTORS = ["+", "-", "B", "", "@"]


def procedure_legs(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "ourairports_navaids").filter("latitude_deg is not null and longitude_deg is not null")
    n = n.groupBy(F.upper(F.trim("ident")).alias("fix"), F.col("iso_country").alias("region")).agg(F.min_by(F.struct(F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon")), F.struct("id", "latitude_deg", "longitude_deg")).alias("p"))
    s = read(spark, d, "airway_segments").groupBy("segment_id").agg(F.min(F.struct("route_ident", "sequence_number", F.coalesce(F.upper(F.trim("start_ident")), F.lit("")).alias("fix_ident"), "start_region", "minimum_altitude_ft", "maximum_altitude_ft", "valid_from")).alias("r")).select("segment_id", "r.*")
    i = F.col("segment_id")
    at = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    legs = s.select(
        "segment_id", F.lit("ROUT").alias("airport_ident"), at(["D", "E", "F"], F.length("route_ident") % 3).alias("procedure_kind"), F.col("route_ident").alias("procedure_ident"),
        at(["", "T1", "T2"], i % 3).alias("transition_ident"), "sequence_number", "fix_ident", "start_region", at(_CODES, i % len(_CODES)).alias("path_terminator"), at(_DESCRIPTORS, i % 5).alias("altitude_descriptor"),
        F.col("minimum_altitude_ft").alias("altitude_1_ft"), F.when(i % 4 > 0, F.col("maximum_altitude_ft")).alias("altitude_2_ft"), F.when(i % 7 > 0, "NAV").alias("recommended_navaid"), F.when(i % 2 > 0, 3.5).alias("arc_radius_nm"),
        (i % 360).cast("double").alias("course_a_deg"), (i % 180).cast("double").alias("course_b_deg"), (i % 50).cast("double").alias("distance_a_nm"), (i % 20).cast("double").alias("distance_b_nm"), "valid_from",
    )
    return legs.join(n, (F.col("fix_ident") == F.col("fix")) & (F.col("start_region") == F.col("region")), "left").select(*legs.columns, "p.lat", "p.lon")


_LEGS = f"""with n as (select distinct on (fix, region) upper(trim(ident)) fix, iso_country region, latitude_deg lat, longitude_deg lon from ourairports_navaids where latitude_deg is not null and longitude_deg is not null order by fix, region, id, latitude_deg, longitude_deg),
s as (select distinct on (segment_id) segment_id i, route_ident pr, sequence_number sq, coalesce(upper(trim(start_ident)), '') fx, start_region rg, minimum_altitude_ft a1, maximum_altitude_ft mx, valid_from from airway_segments
  order by segment_id, route_ident, sequence_number, coalesce(upper(trim(start_ident)), ''), start_region, minimum_altitude_ft nulls first, maximum_altitude_ft nulls first, valid_from),
l as (select s.*, (array['D', 'E', 'F'])[length(pr) % 3 + 1] kind, (array['', 'T1', 'T2'])[i % 3 + 1] tr, (array{_CODES})[i % {len(_CODES)} + 1] term, (array{_DESCRIPTORS})[i % 5 + 1] ds, case when i % 4 > 0 then mx end a2, lat, lon
  from s left join n on n.fix = s.fx and n.region = s.rg)"""
_IN = lambda k: "(" + ", ".join(f"'{t[0]}'" for t in _T if t[k]) + ")"


@query(_LEGS + f""" select i segment_id, term path_terminator, case when a1 is null then null when ds = '+' then 'AT_OR_ABOVE' when ds = '-' then 'AT_OR_BELOW' when ds = 'B' and a2 is not null then 'BETWEEN' when ds = '' then 'AT' else 'OTHER' end constraint_kind,
case when term = 'AF' then i % 180 else i % 360 end::double course_deg, case when term in ('AF', 'RF') then i % 20 else i % 50 end::double distance_nm,
array_to_string(list_filter([case when term in {_IN(1)} and fx = '' then 'missing-fix' end, case when term in {_IN(2)} and i % 7 = 0 then 'missing-navaid' end, case when term = 'RF' and i % 2 = 0 then 'missing-radius' end,
  case when ds = 'B' and (a1 is null or a2 is null) then 'band-incomplete' end, case when a1 is null and a2 is not null then 'second-altitude-alone' end], lambda x: x is not null), ',') issues from l""")
def procedure_leg_interpretation(spark: SparkSession, d: str) -> DataFrame:
    """Terminators, the columns they use, altitude constraints and what is missing."""
    p = procedures.interpret(procedure_legs(spark, d))
    return p.select("segment_id", "path_terminator", F.col("constraint.kind").alias("constraint_kind"), "course_deg", "distance_nm", F.array_join("issues", ",").alias("issues"))


@query(_LEGS + """, p as (select kind, pr, tr, count(*) legs, min(valid_from) lo, max(valid_from) hi from l group by all)
select kind procedure_kind, pr procedure_ident, coalesce(sum(legs) filter (tr = ''), -1)::int main_legs, coalesce(string_agg(tr, ',' order by tr) filter (tr <> ''), '') transitions, min(lo) <> max(hi) mixed_validity from p group by all""")
def procedure_assembly(spark: SparkSession, d: str) -> DataFrame:
    """F16, A5: main legs and transitions of each procedure."""
    p = procedures.assemble(procedure_legs(spark, d))
    return p.select("procedure_kind", "procedure_ident", F.coalesce(F.size("main"), F.lit(-1)).alias("main_legs"), F.array_join(F.transform("transitions", lambda t: t["transition_ident"]), ",").alias("transitions"), "mixed_validity")


_CHAIN = _LEGS + f""", c as (select *, lag(sq) over w psq, last_value(case when lat is not null and lon is not null then {{la: lat, lo: lon}} end ignore nulls) over b pat, last_value(a1 ignore nulls) over b pa1
  from l window w as (partition by kind, pr, tr order by sq), b as (partition by kind, pr, tr order by sq rows between unbounded preceding and 1 preceding)),
e as (select kind procedure_kind, pr procedure_ident, tr transition_ident, sq sequence_number, unnest(list_filter([case when psq = sq then {{s: 'error', c: 'sequence-duplicate'}} end, case when sq - psq > 100 then {{s: 'warning', c: 'sequence-gap'}} end,
  case when {_hav('pat.la', 'pat.lo', 'lat', 'lon')} > 250 then {{s: 'error', c: 'leg-too-long'}} end, case when kind = 'D' and pa1 - a1 > 500 then {{s: 'warning', c: 'descends-on-departure'}} end,
  case when kind = 'E' and a1 - pa1 > 500 then {{s: 'warning', c: 'climbs-on-arrival'}} end, case when lat is null and fx <> '' then {{s: 'warning', c: 'fix-unresolved'}} end], lambda x: x is not null)) x from c)"""


@query(_CHAIN + " select procedure_kind, procedure_ident, transition_ident, x.s severity, x.c code, count(*) n from e group by all")
def procedure_validation(spark: SparkSession, d: str) -> DataFrame:
    """Order, gaps, distances and profile of consecutive legs."""
    v = procedures.validate(_one_leg_per_sequence(spark, d))
    return v.groupBy("procedure_kind", "procedure_ident", "transition_ident", "severity", "code").agg(F.count("*").alias("n"))


@query(_CHAIN + ", bad as (select distinct procedure_kind, procedure_ident from e where x.s = 'error') select distinct kind procedure_kind, pr procedure_ident, b.procedure_ident is null is_flyable from l left join bad b on b.procedure_kind = l.kind and b.procedure_ident = l.pr")
def procedure_flyable(spark: SparkSession, d: str) -> DataFrame:
    """V3: procedures without an error."""
    return procedures.flyable(_one_leg_per_sequence(spark, d)).select("procedure_kind", "procedure_ident", "is_flyable")


def _one_leg_per_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Legs whose place in their transition is their own, so that the order of a window over them is one."""
    legs = procedure_legs(spark, d)
    keys = [*procedures.KEY, "transition_ident", "sequence_number"]
    cols = [c for c in legs.columns if c not in keys]
    return legs.groupBy(*keys).agg(F.min_by(F.struct(*cols), "segment_id").alias("r")).select(*keys, "r.*")


# the same in SQL
_CHAIN_ONE = _CHAIN.replace("from s left join n on n.fix = s.fx and n.region = s.rg)", "from s left join n on n.fix = s.fx and n.region = s.rg qualify row_number() over (partition by (array['D', 'E', 'F'])[length(pr) % 3 + 1], pr, (array['', 'T1', 'T2'])[i % 3 + 1], sq order by i) = 1)")
for _name in ("procedure_validation", "procedure_flyable"):
    SQL[_name] = SQL[_name].replace(_CHAIN, _CHAIN_ONE)
