"""Scalar functions of the domain: coordinates, designators, frequencies, classes, callsigns, weather, charts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dms(col: Column) -> Column:
    """Fixed-width NDDMMSSHH or WDDDMMSSHH as decimal degrees; null if it has another form."""
    m = lambda g: F.regexp_extract(col, r"^([NSEW])(\d{2,3})(\d{2})(\d{2})(\d{2})$", g)
    v = m(2).cast("double") + m(3).cast("double") / 60 + (m(4).cast("double") + m(5).cast("double") / 100) / 3600
    return F.when(m(1) != "", F.when(m(1).isin("S", "W"), -v).otherwise(v))


def dms_high(col: Column) -> Column:
    """The same with four digits of fraction (NDDMMSSHHHH, WDDDMMSSHHHH)."""
    m = lambda g: F.regexp_extract(col, r"^([NSEW])(\d{2,3})(\d{2})(\d{2})(\d{4})$", g)
    v = m(2).cast("double") + m(3).cast("double") / 60 + (m(4).cast("double") + m(5).cast("double") / 10_000) / 3600
    return F.when(m(1) != "", F.when(m(1).isin("S", "W"), -v).otherwise(v))


def dms_suffix(col: Column) -> Column:
    """490035.00N or 0023247.5E, also plain decimals, as degrees."""
    c = F.upper(F.trim(col))
    m = lambda g: F.regexp_extract(c, r"^(\d{2,3})(\d{2})(\d{2}(?:\.\d+)?)([NSEW])$", g)
    d = lambda g: F.regexp_extract(c, r"^(\d+(?:\.\d+)?)([NSEW])$", g)
    sexa = m(1).cast("double") + m(2).cast("double") / 60 + m(3).cast("double") / 3600
    sign = lambda h: F.when(h.isin("S", "W"), -1.0).otherwise(1.0)
    return (
        F.when(m(4) != "", sexa * sign(m(4)))
        .when(d(2) != "", d(1).cast("double") * sign(d(2)))
        .when(c.rlike(r"^[+-]?\d+(\.\d+)?$"), c.try_cast("double"))
    )


def feet(value: Column, unit: Column) -> Column:
    """A height in feet from metres, feet or flight levels; any other unit gives null."""
    u = F.upper(F.coalesce(unit, F.lit("FT")))
    return F.when(u == "M", value * 3.280839895).when(u == "FT", value).when(u == "FL", value * 100)


def magnetic_variation(col: Column) -> Column:
    """E0123 is 12.3 east (tenths, four digits), W01234 is -12.34 (hundredths, five digits)."""
    m = lambda g: F.regexp_extract(col, r"^([EW])(\d{4,5})$", g)
    v = m(2).cast("double") / F.when(F.length(m(2)) == 4, 10).otherwise(100)
    return F.when(m(1) == "E", v).when(m(1) == "W", -v)


def waypoint_type(col: Column) -> Column:
    """Three characters as a little-endian number."""
    c = F.rpad(col, 3, " ")
    return (F.ascii(F.substring(c, 1, 1)) + F.ascii(F.substring(c, 2, 1)) * 256 + F.ascii(F.substring(c, 3, 1)) * 65536).cast("long")


def runway_number(designator: Column) -> Column:
    n = F.regexp_extract(F.upper(designator), r"^(?:RW)*(0[1-9]|[12]\d|3[0-6])", 1)
    return F.when(n != "", n.cast("int"))


def is_runway(designator: Column) -> Column:
    return F.coalesce(designator.rlike(r"^(RW)*(0[1-9]|[12]\d|3[0-6])[LRCAB]?$"), F.lit(False))


def swap_side(side: Column) -> Column:
    return F.when(side == "L", "R").when(side == "R", "L").otherwise(side)


def reciprocal_designator(designator: Column) -> Column:
    """10L is 28R, 18 is 36, 36 is 18."""
    n = runway_number(designator)
    back = F.pmod(n + 18, F.lit(36))
    back = F.when(back == 0, 36).otherwise(back)
    side = F.regexp_extract(F.upper(designator), r"([LRC])$", 1)
    return F.when(n.isNotNull(), F.concat(F.lpad(back.cast("string"), 2, "0"), swap_side(side)))


def procedure_fits_runway(procedure_runway: Column, runway: Column) -> Column:
    """A procedure for RW09B or 09 serves 09L and 09R; one with a side only that side; ALL serves every runway."""
    a, b = (F.regexp_replace(F.upper(c), "^RW", "") for c in (procedure_runway, runway))
    side_a = F.regexp_extract(a, r"^\d{2}([LRCB]?)$", 1)
    same = F.substring(a, 1, 2) == F.substring(b, 1, 2)
    return F.coalesce((a == "ALL") | (a == "") | (same & (side_a.isin("", "B") | (a == b))), F.lit(False))


def navaid_kind(col: Column) -> Column:
    """The nine kinds from free spelling; null if it is none."""
    k = F.regexp_replace(F.upper(F.trim(col)), r"[^A-Z]", "")
    return (
        F.when(k == "NDB", "NDB").when(k.isin("VOR", "DVOR"), "VOR").when(k.isin("VORDME", "DVORDME"), "VOR-DME").when(k == "VORTAC", "VORTAC")
        .when(k.isin("DME", "NDBDME"), F.when(k == "DME", "DME").otherwise("NDB")).when(k == "TACAN", "TACAN")
        .when(k.isin("ILSLOC", "LOC", "ILSLOCALIZER"), "ILS-LOC").when(k.isin("ILSGS", "GS", "ILSGLIDEPATH"), "ILS-GS").when(k == "RSBN", "RSBN")
    )


#: kind -> least and greatest kHz that the store accepts
BANDS = {
    "NDB": (190, 1_800), "VOR": (108_000, 118_000), "VOR-DME": (108_000, 118_000), "VORTAC": (108_000, 118_000), "ILS-LOC": (108_000, 112_000),
    "ILS-GS": (108_000, 112_000), "DME": (108_000, 118_000), "TACAN": (108_000, 136_000), "RSBN": (100_000, 200_000),
}


def in_band(kind: Column, khz: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for k, (lo, hi) in BANDS.items():
        out = F.when(kind == k, khz.between(lo, hi)).otherwise(out)
    return out


def service_volume(power: Column) -> Column:
    p = F.upper(power)
    return F.when(p == "HIGH", 130).when(p == "MEDIUM", 40).when(p == "LOW", 25)


def airport_tier(kind: Column) -> Column:
    k = F.lower(kind)
    return (
        F.when(k.contains("large"), 1).when(k.contains("medium"), 2).when(k.contains("small"), 3).when(k.contains("heli"), 4)
        .when(k.contains("sea"), 5).otherwise(6)
    )


def mhz(khz: Column) -> Column:
    return F.round(khz / 1000, 3)


def khz(mhz_: Column) -> Column:
    return F.round(mhz_ * 1000).cast("int")


def navaid_identity(kind: Column, ident: Column, region: Column) -> Column:
    """Class, ident and region; null where the ident is missing."""
    i = F.nullif(F.upper(F.trim(ident)), F.lit(""))
    return F.concat(navaid_class(kind), F.lit(":"), i, F.lit(":"), F.coalesce(F.upper(F.trim(region)), F.lit("")))


def canonical_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(key, 256), 1, 16))


def conflict_key(a: Column, b: Column, *rest: Column) -> Column:
    """One key for a pair whichever side comes first."""
    return F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b), *rest), 256)


def airport_identity(ident: Column, country: Column) -> Column:
    i = F.upper(F.trim(ident))
    return F.when(i == "", None).when(i.rlike("^[A-Z]{4}$"), F.concat(F.lit("icao:"), i)).otherwise(
        F.concat(F.lit("local:"), F.upper(F.coalesce(country, F.lit(""))), F.lit(":"), i)
    )


def navaid_class(kind: Column) -> Column:
    return F.when(F.upper(kind) == "NDB", "ndb").otherwise("vor")


def decimal_year(ts: Column) -> Column:
    y = F.year(ts)
    return y + (F.dayofyear(ts) - 1) / F.dayofyear(F.make_date(y, F.lit(12), F.lit(31)))


def cycle_index(ts: Column) -> Column:
    """28-day periods since 2020-01-30, negative before."""
    return F.floor(F.datediff(ts, F.lit("2020-01-30").cast("date")) / 28).cast("long")


def cycle_label(index: Column) -> Column:
    """YYNN with thirteen cycles to each year."""
    year = 2020 + F.floor(index / 13)
    return F.concat(F.lpad(F.pmod(year, F.lit(100)).cast("int").cast("string"), 2, "0"), F.lpad((F.pmod(index, F.lit(13)) + 1).cast("int").cast("string"), 2, "0"))


def cycle_start(index: Column) -> Column:
    return F.date_add(F.lit("2020-01-30").cast("date"), (index * 28).cast("int"))


def cycle_from_label(label: Column) -> Column:
    """Index of YYNN or YYYYNN, also with AIRAC before or a slash between; null for anything else."""
    c = F.regexp_replace(F.upper(F.trim(label)), r"^AIRAC|[\s/]", "")
    c = F.when(F.length(c) == 6, F.substring(c, 3, 4)).otherwise(c)
    y, n = F.substring(c, 1, 2).try_cast("int"), F.substring(c, 3, 2).try_cast("int")
    full = F.when(y >= 70, 1900 + y).otherwise(2000 + y)
    return F.when(c.rlike(r"^\d{4}$") & n.between(1, 14), ((full - 2020) * 13 + n - 1).cast("long"))


def flight_category(ceiling_ft: Column, visibility_sm: Column) -> Column:
    c, v = F.coalesce(ceiling_ft, F.lit(10_000)), F.coalesce(visibility_sm, F.lit(10.0))
    return F.when((c < 500) | (v < 1), "LIFR").when((c < 1000) | (v < 3), "IFR").when((c <= 3000) | (v <= 5), "MVFR").otherwise("VFR")


def weather_freshness(age_minutes: Column) -> Column:
    return F.when(age_minutes <= 30, "FRESH").when(age_minutes <= 60, "AGING").when(age_minutes <= 120, "STALE").otherwise("EXPIRED")


def network_freshness(age_seconds: Column) -> Column:
    return F.when(age_seconds <= 35, "LIVE").when(age_seconds <= 90, "DELAYED").when(age_seconds <= 300, "STALE").otherwise("OFFLINE")


def facility(callsign: Column) -> Column:
    c = F.upper(callsign)
    out = F.lit("OTHER")
    for suffix, name in (("_OBS", "OBS"), ("_FSS", "FSS"), ("_CTR", "CTR"), ("_DEP", "DEP"), ("_APP", "APP"), ("_TWR", "TWR"), ("_GND", "GND"), ("_DEL", "DEL"), ("_ATIS", "ATIS")):
        out = F.when(c.endswith(suffix), name).otherwise(out)
    return out


def callsign_airport(callsign: Column) -> Column:
    """The airport before the first underscore: four letters as they are, three letters with K before."""
    head = F.upper(F.split(callsign, "_")[0])
    return F.when(head.rlike("^[A-Z]{4}$"), head).when(head.rlike("^[A-Z]{3}$"), F.concat(F.lit("K"), head))


def altitude_ft(col: Column) -> Column:
    """FL350, F350, 350 (under a thousand: hundreds) or 35000 as feet."""
    c = F.upper(F.trim(col))
    n = F.regexp_extract(c, r"^(?:FL|F)?(\d+)$", 1).try_cast("int")
    return F.when(c.rlike(r"^(FL|F)\d+$"), n * 100).when(n < 1000, n * 100).otherwise(n)


def escape_html(col: Column) -> Column:
    out = col
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_callsign(col: Column) -> Column:
    return F.substring(F.regexp_replace(F.upper(col), r"[^A-Z0-9_-]", ""), 1, 12)


def clean_icao(col: Column) -> Column:
    return F.substring(F.regexp_replace(F.upper(col), r"[^A-Z0-9]", ""), 1, 4)


def heading360(col: Column) -> Column:
    return F.pmod(col, F.lit(360.0))


def sigmet_hazard(col: Column) -> Column:
    c = F.upper(col)
    return (
        F.when(c.rlike("CONV|TS|THUNDER"), "CONVECTIVE").when(c.rlike("TURB"), "TURBULENCE").when(c.rlike("ICE|ICING|ICG"), "ICING")
        .when(c.rlike("ASH|VA"), "VOLCANIC_ASH").when(c.rlike("IFR"), "IFR").when(c.rlike("MTW|MOUNTAIN|MTN"), "MOUNTAIN_WAVE").otherwise("OTHER")
    )


def chart_type(col: Column) -> Column:
    c = F.upper(F.trim(col))
    return (
        F.when(c.isin("IAP", "IAC", "APPROACH"), "approach").when(c.isin("DP", "SID", "ODP"), "sid").when(c.isin("STAR", "STR"), "star")
        .when(c.isin("APD", "ADC", "AIRPORT", "AERODROME"), "airport").when(c.isin("MIN", "MINIMUMS"), "minimums").when(c.isin("PDC", "APDC", "PARKING"), "parking").otherwise("other")
    )


def runway_in_title(title: Column) -> Column:
    r = F.regexp_extract(F.upper(title), r"\bRWY\s*(\d{2}[LRC]?)\b", 1)
    return F.nullif(r, F.lit(""))


def altitude_constraint(col: Column) -> Column:
    """struct(kind, lo, hi) of +a, -a, a-b, FLx-FLy or a; kind is AT_OR_ABOVE, AT_OR_BELOW, BETWEEN, AT or null."""
    c = F.upper(F.regexp_replace(col, r"\s", ""))
    one = lambda s: F.when(s.startswith("FL"), F.regexp_replace(s, "^FL", "").try_cast("int") * 100).otherwise(s.try_cast("int"))
    a, b = F.regexp_extract(c, r"^((?:FL)?\d+)-((?:FL)?\d+)$", 1), F.regexp_extract(c, r"^((?:FL)?\d+)-((?:FL)?\d+)$", 2)
    rest = F.regexp_replace(c, r"^[+-]", "")
    kind = F.when(a != "", "BETWEEN").when(c.rlike(r"^\+(FL)?\d+$"), "AT_OR_ABOVE").when(c.rlike(r"^-(FL)?\d+$"), "AT_OR_BELOW").when(c.rlike(r"^(FL)?\d+$"), "AT")
    lo = F.when(kind == "BETWEEN", F.least(one(a), one(b))).when(kind.isin("AT_OR_ABOVE", "AT"), one(rest))
    hi = F.when(kind == "BETWEEN", F.greatest(one(a), one(b))).when(kind.isin("AT_OR_BELOW", "AT"), one(rest))
    return F.struct(kind.alias("kind"), lo.alias("lo"), hi.alias("hi"))


def dual_course(col: Column) -> Column:
    """struct(magnetic, true) of "63 (074.5)"."""
    m = lambda g: F.regexp_extract(col, r"^\s*(\d+(?:\.\d+)?)?\s*(?:\((\d+(?:\.\d+)?)\))?\s*$", g).try_cast("double")
    return F.struct(m(1).alias("magnetic"), m(2).alias("true"))


def distance_or_time(col: Column) -> Column:
    """struct(nm, minutes) of "d km", "d NM" or "n MIN"."""
    m = lambda g: F.regexp_extract(F.upper(col), r"^\s*(\d+(?:\.\d+)?)\s*(KM|NM|MIN)\s*$", g)
    v = m(1).try_cast("double")
    return F.struct(F.when(m(2) == "KM", v / 1.852).when(m(2) == "NM", v).alias("nm"), F.when(m(2) == "MIN", v).alias("minutes"))


def redact_path(col: Column) -> Column:
    """File system paths without their folders, for diagnostics."""
    return F.regexp_replace(F.regexp_replace(col, r"(?:[A-Za-z]:)?(?:[\\/][^\\/\s:]+)+[\\/]([^\\/\s:]+)", "<path>/$1"), r"/home/[^/\s]+", "<home>")
