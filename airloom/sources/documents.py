"""Text tables, XML and JSON documents, and the registry of sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.functions.text import altitude_constraint, distance_or_time, dms_suffix, dual_course, feet, flight_category, sigmet_hazard


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines of text files, numbered within each file from 1."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("__l"))
    return files.select("file", F.posexplode("__l").alias("line_no", "value")).withColumn("line_no", F.col("line_no") + 1)


def ats_segments(lines: DataFrame) -> DataFrame:
    """Route segments of comma text: comments and the header fall away, rows of under eight columns are no segments."""
    c = F.split("value", ",")
    col = lambda i: F.nullif(F.trim(F.get(c, F.lit(i))), F.lit(""))
    rows = lines.filter(~F.trim("value").rlike(r"^(#|//|$)") & (F.size(c) >= 8) & col(1).rlike(r"^\d+$"))
    way = F.upper(col(8))
    level, mea = col(9).try_cast("int"), col(11).try_cast("int")
    return rows.select(
        "line_no", col(0).alias("route_ident"), col(1).cast("int").alias("sequence_number"), col(2).alias("start_fix"), col(3).try_cast("double").alias("start_lat"), col(4).try_cast("double").alias("start_lon"),
        col(5).alias("end_fix"), col(6).try_cast("double").alias("end_lat"), col(7).try_cast("double").alias("end_lon"),
        F.when(way.isin("F", "FORWARD", "EVEN"), "F").when(way.isin("B", "BACKWARD", "ODD"), "B").otherwise("N").alias("direction"),
        F.when(level >= 180, "H").otherwise("L").alias("level"), F.coalesce(mea, level * 100).alias("minimum_altitude_ft"), (col(10).try_cast("int") * 100).alias("maximum_altitude_ft"),
    )


def procedure_table(lines: DataFrame) -> DataFrame:
    """Coding rows under the header line that precedes them in their file."""
    h = F.when(F.col("value").startswith("PROCEDURE:"), F.col("value"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("header", F.last(h, ignorenulls=True).over(w)).filter(F.col("value").contains("|") & ~F.col("value").startswith("PROCEDURE:"))
    p = F.split("value", r"\|")
    col = lambda i: F.nullif(F.trim(F.get(p, F.lit(i))), F.lit(""))
    head = lambda k: F.nullif(F.trim(F.regexp_extract("header", k + r":\s*([^|]*)", 1)), F.lit(""))
    return rows.filter(col(0).rlike(r"^\d+$")).select(
        "file", "line_no", head("PROCEDURE").alias("procedure_ident"), head("RWY").alias("runway"), head("APT").alias("airport"), col(0).cast("int").alias("sequence_number"), col(1).alias("path_terminator"),
        col(2).alias("fix_ident"), (F.upper(col(3)) == "Y").alias("fly_over"), dual_course(col(4)).alias("course"), col(5).alias("turn"), distance_or_time(col(6)).alias("leg"), altitude_constraint(col(7)).alias("altitude"), col(8).try_cast("int").alias("speed_kts"),
    )


def rsbn_stations(lines: DataFrame) -> DataFrame:
    """Stations of a comma table; the frequency follows from the channel."""
    c = F.split("value", r"[,;|]")
    col = lambda i: F.nullif(F.trim(F.get(c, F.lit(i))), F.lit(""))
    rows = lines.filter((F.size(c) >= 5) & col(2).rlike(r"^\d+$"))
    return rows.select(
        col(0).alias("ident"), col(1).alias("name"), col(2).cast("int").alias("channel"), (100_000 + col(2).cast("int") * 100).alias("frequency_khz"), dms_suffix(col(3)).alias("latitude_deg"), dms_suffix(col(4)).alias("longitude_deg"),
        col(5).try_cast("double").alias("elevation_ft"), col(6).try_cast("double").alias("range_km"), col(7).alias("associated_airport"), F.lit("RSBN").alias("navaid_type"),
    )


def index_entries(pages: DataFrame, html: str = "value") -> DataFrame:
    """Links of an index page with a class from their text."""
    links = F.regexp_extract_all(F.col(html), F.lit(r'<a[^>]*href="([^"]+)"[^>]*>([^<]*)</a>'), F.lit(0))
    e = pages.select(F.posexplode(links).alias("pos", "link"))
    href, name = F.regexp_extract("link", r'href="([^"]+)"', 1), F.trim(F.regexp_extract("link", r">([^<]*)<", 1))
    kind = F.when(F.upper(name).rlike(r"\bSID\b"), "sid").when(F.upper(name).rlike(r"\bSTAR\b"), "star").when(F.upper(name).rlike(r"\b(IAC|APPROACH|RNP|ILS)\b"), "approach").otherwise("other")
    return e.select("pos", href.alias("href"), name.alias("title"), kind.alias("kind"))


def cycle_listing(pages: DataFrame, text: str = "value") -> DataFrame:
    """Cycle codes named in a listing, newest first."""
    codes = F.regexp_extract_all(F.col(text), F.lit(r"(?i)cycle[ _-]?(\d{4})\b"), F.lit(1))
    return pages.select(F.explode(codes).alias("cycle")).distinct().orderBy(F.desc("cycle"))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _find(e: ElementTree.Element, name: str) -> str | None:
    for x in e.iter():
        if _tag(x) == name and x.text and x.text.strip():
            return x.text.strip()
    return None


#: AIXM class -> (fields, element of each)
AIXM5 = {
    "AirportHeliport": {"ident": "designator", "name": "name", "position": "pos", "elevation": "elevation"}, "Navaid": {"ident": "designator", "name": "name", "position": "pos", "elevation": "elevation"},
    "DesignatedPoint": {"ident": "designator", "name": "name", "position": "pos", "elevation": "elevation"}, "Runway": {"ident": "designator", "name": "nominalLength", "position": "pos", "elevation": "widthStrip"},
}
AIXM45 = {"Ahp": "codeId", "Vor": "codeId", "Ndb": "codeId", "Dme": "codeId", "Tcn": "codeId", "Dpn": "codeId", "Rwy": "txtDesig"}


def aixm_version(head: str) -> str:
    """4.5 or 5 from the beginning of a document."""
    if "AIXM-Snapshot" in head:
        return "4.5"
    if "AIXMBasicMessage" in head or "/aixm/5" in head:
        return "5"
    raise ValueError("no AIXM document")


def aixm(docs: DataFrame) -> DataFrame:
    """Features (file, feature, ident, name, lat, lon, elevation_ft, reason) of AIXM 4.5 and 5 documents (file, value).

    Tags are matched without their name space. Values that are not there stay null and give a reason; none is made up.
    A document that does not parse yields one row with the error.
    """
    columns = ["file", "feature", "ident", "name", "lat_text", "lon_text", "elevation", "unit", "reason"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, doc in zip(b["file"], b["value"]):
                try:
                    root = ElementTree.fromstring(doc)
                    old = aixm_version(doc[:4000]) == "4.5"
                except (ElementTree.ParseError, ValueError) as e:
                    out.append((file, "document", None, None, None, None, None, None, f"unreadable: {e}"))
                    continue
                for e in root.iter():
                    t = _tag(e)
                    if old and t in AIXM45:
                        out.append((file, t, _find(e, AIXM45[t]), _find(e, "txtName"), _find(e, "geoLat"), _find(e, "geoLong"), _find(e, "valElev"), _find(e, "uomDistVer"), None))
                    elif not old and t in AIXM5:
                        f = AIXM5[t]
                        pos = (_find(e, f["position"]) or "").split()
                        out.append((file, t, _find(e, f["ident"]), _find(e, f["name"]), pos[0] if len(pos) > 1 else None, pos[1] if len(pos) > 1 else None, _find(e, f["elevation"]), "FT", None))
            yield pd.DataFrame(out, columns=columns)

    raw = docs.select("file", "value").mapInPandas(run, ", ".join(f"{c} string" for c in columns))
    lat, lon = dms_suffix(F.col("lat_text")), dms_suffix(F.col("lon_text"))
    needs = ~F.col("feature").isin("Rwy", "Runway", "document")
    reason = F.coalesce("reason", F.when(F.col("ident").isNull(), "no ident"), F.when(needs & (lat.isNull() | lon.isNull()), "no position"))
    return raw.select("file", "feature", "ident", "name", lat.alias("latitude_deg"), lon.alias("longitude_deg"), feet(F.col("elevation").try_cast("double"), F.col("unit")).alias("elevation_ft"), reason.alias("reason"))


def charts(docs: DataFrame, cycle: str) -> DataFrame:
    """Charts of a metafile (file, value): one row per record with airport, code, name and file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc in b["value"]:
                for a in ElementTree.fromstring(doc).iter("airport_name"):
                    for r in a.iter("record"):
                        g = lambda n: (r.findtext(n) or "").strip() or None
                        out.append((a.get("icao_ident") or a.get("apt_ident"), g("chart_code"), g("chart_name"), g("pdf_name"), g("useraction")))
            yield pd.DataFrame(out, columns=["airport_icao", "chart_code", "title", "file", "change_flag"])

    return docs.select("value").mapInPandas(run, "airport_icao string, chart_code string, title string, file string, change_flag string").withColumn("airac_cycle", F.lit(cycle))


METAR = "array<struct<icaoId:string,obsTime:bigint,temp:double,dewp:double,wdir:string,wspd:int,wgst:int,visib:string,altim:double,fltcat:string,rawOb:string,clouds:array<struct<cover:string,base:int>>,wxString:string>>"
TAF = "array<struct<icaoId:string,rawTAF:string,issueTime:string,validTimeFrom:bigint,validTimeTo:bigint,fcsts:array<struct<timeFrom:bigint,timeTo:bigint,change:string,wdir:string,wspd:int,wgst:int,visib:string,clouds:array<struct<cover:string,base:int>>,wxString:string>>>>"
SIGMET = "struct<features:array<struct<properties:struct<isigmetId:string,hazard:string,validTimeFrom:bigint,validTimeTo:bigint>,geometry:struct<coordinates:array<array<array<double>>>>>>>"
PIREP = "array<struct<lat:double,lon:double,obsTime:bigint,acType:string,fltLvl:string,tbType:string,tbInt:string,icgType:string,icgInt:string,temp:double,rawOb:string>>"


def _array(col: Column) -> Column:
    """A document that is a single object read as an array of one."""
    return F.when(F.trim(col).startswith("{"), F.concat(F.lit("["), col, F.lit("]"))).otherwise(col)


def visibility(col: Column) -> Column:
    """Statute miles; 10+ and the like are 10."""
    return F.when(col.contains("+"), F.lit(10.0)).otherwise(col.try_cast("double"))


def ceiling(clouds: Column) -> Column:
    """The lowest broken or overcast base."""
    return F.array_min(F.transform(F.filter(clouds, lambda c: c["cover"].isin("BKN", "OVC", "OVX")), lambda c: c["base"]))


def metars(docs: DataFrame, value: str = "value") -> DataFrame:
    m = docs.select(F.explode(F.from_json(_array(F.col(value)), METAR)).alias("m")).select("m.*")
    vis = visibility(F.col("visib"))
    return m.select(
        F.col("icaoId").alias("station"), F.timestamp_seconds("obsTime").alias("observed_at"), "temp", "dewp", F.col("wdir").try_cast("int").alias("wind_dir"), F.col("wspd").alias("wind_kt"), F.col("wgst").alias("gust_kt"),
        vis.alias("visibility_sm"), ceiling(F.col("clouds")).alias("ceiling_ft"), (F.col("altim") * 0.0295299830714).alias("altimeter_inhg"), F.coalesce("fltcat", flight_category(ceiling(F.col("clouds")), vis)).alias("category"), F.col("rawOb").alias("raw"),
    )


def tafs(docs: DataFrame, value: str = "value") -> DataFrame:
    """Forecasts with their periods nested; validity is a day where it is not given."""
    t = docs.select(F.explode(F.from_json(_array(F.col(value)), TAF)).alias("t")).select("t.*")
    start = F.timestamp_seconds("validTimeFrom")
    periods = F.transform("fcsts", lambda p: F.struct(F.timestamp_seconds(p["timeFrom"]).alias("from"), F.timestamp_seconds(p["timeTo"]).alias("to"), p["change"].alias("change"), p["wspd"].alias("wind_kt"), visibility(p["visib"]).alias("visibility_sm"), ceiling(p["clouds"]).alias("ceiling_ft")))
    return t.select(F.col("icaoId").alias("station"), start.alias("valid_from"), F.coalesce(F.timestamp_seconds("validTimeTo"), start + F.expr("interval 24 hours")).alias("valid_to"), periods.alias("periods"), F.col("rawTAF").alias("raw"))


def sigmets(docs: DataFrame, value: str = "value") -> DataFrame:
    """Areas as array<struct<lon, lat>>; validity is four hours where it is not given."""
    f = docs.select(F.explode(F.from_json(F.col(value), SIGMET)["features"]).alias("f"))
    start = F.timestamp_seconds("f.properties.validTimeFrom")
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return f.select(F.col("f.properties.isigmetId").alias("id"), sigmet_hazard(F.col("f.properties.hazard")).alias("hazard"), start.alias("valid_from"), F.coalesce(F.timestamp_seconds("f.properties.validTimeTo"), start + F.expr("interval 4 hours")).alias("valid_to"), ring.alias("area"))


def pireps(docs: DataFrame, value: str = "value") -> DataFrame:
    p = docs.select(F.explode(F.from_json(_array(F.col(value)), PIREP)).alias("p")).select("p.*")
    return p.select(F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"), F.timestamp_seconds("obsTime").alias("observed_at"), F.col("acType").alias("aircraft"), (F.col("fltLvl").try_cast("int") * 100).alias("altitude_ft"), F.coalesce("tbInt", "tbType").alias("turbulence"), F.coalesce("icgInt", "icgType").alias("icing"), "temp", F.col("rawOb").alias("raw"))


NETWORK = "struct<general:struct<update_timestamp:string,connected_clients:int>,pilots:array<struct<cid:bigint,callsign:string,latitude:double,longitude:double,altitude:int,groundspeed:int,heading:int,flight_plan:struct<departure:string,arrival:string,altitude:string,route:string>>>,controllers:array<struct<cid:bigint,callsign:string,frequency:string,facility:int>>,atis:array<struct<cid:bigint,callsign:string,frequency:string,atis_code:string>>,servers:array<struct<ident:string,hostname_or_ip:string>>,prefiles:array<struct<cid:bigint,callsign:string,flight_plan:struct<departure:string,arrival:string>>>>"


def network(docs: DataFrame, value: str = "value") -> dict[str, DataFrame]:
    """The five arrays of one network document, each with the snapshot's id and time."""
    n = docs.select(F.sha2(F.col(value), 256).alias("snapshot_id"), F.from_json(F.col(value), NETWORK).alias("n"))
    at = F.to_timestamp("n.general.update_timestamp").alias("generated_at")
    return {k: n.select("snapshot_id", at, F.explode(f"n.{k}").alias("e")).select("snapshot_id", "generated_at", "e.*") for k in ("pilots", "controllers", "atis", "servers", "prefiles")}


EVENTS = "struct<data:array<struct<id:bigint,type:string,name:string,start_time:string,end_time:string,airports:array<struct<icao:string>>>>>"


def network_events(docs: DataFrame, value: str = "value") -> DataFrame:
    e = docs.select(F.explode(F.from_json(F.col(value), EVENTS)["data"]).alias("e")).select("e.*")
    return e.select("id", "type", "name", F.to_timestamp("start_time").alias("start_time"), F.to_timestamp("end_time").alias("end_time"), F.transform("airports", lambda a: F.upper(a["icao"])).alias("airports"))


def content_digest(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of landed files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def nav_text(lines: DataFrame) -> DataFrame:
    """Rows of simulator text tables split at blanks; header and the closing 99 fall away."""
    p = F.split(F.trim("value"), r"\s+")
    return lines.filter((F.size(p) >= 5) & ~F.trim("value").isin("99", "I", "A")).select("line_no", p.alias("fields"))


@dataclass
class Source:
    """A provider of datasets: its name, the namespace of its ids, what it owns, and how its raw data become tables."""

    name: str
    namespace: str
    tables: tuple[str, ...]
    parse: Callable[[SparkSession, str], dict[str, DataFrame]]
    tier: str = "public"


@dataclass
class Registry:
    sources: dict[str, Source] = field(default_factory=dict)

    def add(self, s: Source) -> None:
        if any(o.namespace == s.namespace and o.name != s.name for o in self.sources.values()):
            raise ValueError(f"namespace {s.namespace} has an owner")
        self.sources[s.name] = s

    def by_namespace(self, entity_id: str) -> Source | None:
        ns = entity_id.split(":", 1)[0]
        return next((s for s in self.sources.values() if s.namespace == ns), None)

    def load(self, spark: SparkSession, name: str, path: str) -> dict[str, DataFrame]:
        out = self.sources[name].parse(spark, path)
        foreign = set(out) - set(self.sources[name].tables)
        if foreign:
            raise ValueError(f"{name} does not own {sorted(foreign)}")
        return out


def vault_active(packages: DataFrame) -> DataFrame:
    """The active package of each provider: the newest registered one that is not withdrawn."""
    w = Window.partitionBy("provider").orderBy(F.desc("registered_at"), F.desc("package_id"))
    return packages.filter("not withdrawn").withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def leaks(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Rows whose provider is not public or not known, which a public bundle must not hold."""
    public = policy.filter("license_tier = 'public'").select("provider")
    return rows.join(public, "provider", "left_anti")
