"""CSV scans of airports, runways and navaids, with every rejected row and its reason kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions.text import in_band, navaid_kind, service_volume

AIRPORT_COLUMNS = "id string, ident string, type string, name string, latitude_deg string, longitude_deg string, elevation_ft string, continent string, iso_country string, iso_region string, municipality string, scheduled_service string, gps_code string, iata_code string, local_code string, home_link string, wikipedia_link string, keywords string"
RUNWAY_COLUMNS = "id string, airport_ref string, airport_ident string, length_ft string, width_ft string, surface string, lighted string, closed string, le_ident string, le_latitude_deg string, le_longitude_deg string, le_elevation_ft string, le_heading_degT string, le_displaced_threshold_ft string, he_ident string, he_latitude_deg string, he_longitude_deg string, he_elevation_ft string, he_heading_degT string, he_displaced_threshold_ft string"
NAVAID_COLUMNS = "id string, filename string, ident string, name string, type string, frequency_khz string, latitude_deg string, longitude_deg string, elevation_ft string, iso_country string, dme_frequency_khz string, dme_channel string, dme_latitude_deg string, dme_longitude_deg string, dme_elevation_ft string, slaved_variation_deg string, magnetic_variation_deg string, usageType string, power string, associated_airport string"


def scan(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV file with its header as text columns; short rows give nulls, quoted line breaks are kept."""
    return spark.read.csv(path, schema=columns, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def number(c: str) -> Column:
    return F.trim(F.col(c)).try_cast("double")


def whole(c: str) -> Column:
    return F.when(F.trim(F.col(c)).rlike(r"^[0-9]+$"), F.trim(F.col(c)).try_cast("int"))


def valid_at(df: DataFrame, valid_from: str, snapshot: str) -> DataFrame:
    return df.withColumn("valid_from", F.lit(valid_from).cast("timestamp")).withColumn("valid_until", F.lit(None).cast("timestamp")).withColumn("source_snapshot_id", F.lit(snapshot))


def place_fault(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNull() | ~lat.between(-90, 90), "bad latitude").when(lon.isNull() | ~lon.between(-180, 180), "bad longitude")


def airports(raw: DataFrame) -> DataFrame:
    """Typed airports with disposition accepted or rejected and a reason."""
    lat, lon = number("latitude_deg"), number("longitude_deg")
    reason = F.when(F.coalesce(F.trim("ident"), F.lit("")) == "", "empty ident").otherwise(place_fault(lat, lon))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return raw.select(
        F.concat(F.lit("ourairports:"), F.trim("id")).alias("id"), text("ident").alias("ident"), text("name").alias("name"), text("type").alias("airport_type"),
        lat.alias("latitude_deg"), lon.alias("longitude_deg"), number("elevation_ft").alias("elevation_ft"), text("iso_country").alias("iso_country"), text("municipality").alias("municipality"),
        F.when(reason.isNull(), "accepted").otherwise("rejected").alias("disposition"), reason.alias("reason"),
    )


def runways(raw: DataFrame) -> DataFrame:
    """Typed runways: accepted, quarantined (usable in part) or rejected."""
    le, he = F.trim("le_ident"), F.trim("he_ident")
    pos = [number(c) for c in ("le_latitude_deg", "le_longitude_deg", "he_latitude_deg", "he_longitude_deg")]
    length, closed = whole("length_ft"), F.coalesce(F.trim("closed") == "1", F.lit(False))
    rejected = F.when(F.coalesce(F.trim("airport_ident"), F.lit("")) == "", "empty airport").when(F.coalesce(le, F.lit("")) == "", "empty designator")
    held = F.when(closed, "closed").when(length.isNull() | (length <= 0), "no length").when(pos[0].isNull() | pos[1].isNull() | pos[2].isNull() | pos[3].isNull(), "ends without position")
    heading = number("le_heading_degT")
    return raw.select(
        F.concat(F.lit("ourairports:"), F.trim("id")).alias("id"), F.concat(F.lit("ourairports:"), F.trim("airport_ref")).alias("airport_id"), F.trim("airport_ident").alias("airport_ident"),
        F.concat_ws("/", F.nullif(le, F.lit("")), F.nullif(he, F.lit(""))).alias("official_designator"), F.when((heading > 0) & (heading <= 360), heading).alias("true_heading_deg"),
        length.alias("length_ft"), whole("width_ft").alias("width_ft"), F.nullif(F.trim("surface"), F.lit("")).alias("surface"), le.alias("le_ident"), he.alias("he_ident"),
        *[p.alias(n) for p, n in zip(pos, ("le_lat", "le_lon", "he_lat", "he_lon"))],
        F.when(rejected.isNotNull(), "rejected").when(held.isNotNull(), "quarantined").otherwise("accepted").alias("disposition"), F.coalesce(rejected, held).alias("reason"),
    )


def navaids(raw: DataFrame) -> DataFrame:
    """Typed navaids; a station with DME becomes two rows, the DME at its own position or else that of the station."""
    lat, lon, khz = number("latitude_deg"), number("longitude_deg"), whole("frequency_khz")
    kind = navaid_kind(F.col("type"))
    reason = (
        F.when(F.coalesce(F.trim("ident"), F.lit("")) == "", "empty ident").when(kind.isNull(), "unknown type").when(khz.isNull(), "bad frequency")
        .when(~F.coalesce(in_band(kind, khz), F.lit(False)), "frequency outside its band").otherwise(place_fault(lat, lon))
    )
    t = F.upper(F.trim("type"))
    paired = t.isin("VOR-DME", "VORTAC", "NDB-DME")
    base = raw.withColumn("kind", kind).withColumn("khz", khz).withColumn("lat", lat).withColumn("lon", lon).withColumn("reason", reason).withColumn("paired", F.coalesce(paired, F.lit(False)))
    oid = F.concat(F.lit("ourairports:"), F.trim("id"))
    main = F.struct(oid.alias("id"), F.col("kind").alias("navaid_type"), F.col("khz").alias("frequency_khz"), F.col("lat").alias("latitude_deg"), F.col("lon").alias("longitude_deg"), (F.col("paired") & (t != "NDB-DME")).alias("dme_paired"))
    dme = F.struct(
        F.concat(oid, F.lit(":dme")).alias("id"), F.lit("DME").alias("navaid_type"), F.coalesce(whole("dme_frequency_khz"), F.col("khz")).alias("frequency_khz"),
        F.coalesce(number("dme_latitude_deg"), F.col("lat")).alias("latitude_deg"), F.coalesce(number("dme_longitude_deg"), F.col("lon")).alias("longitude_deg"), F.lit(True).alias("dme_paired"),
    )
    rows = base.withColumn("e", F.explode(F.when(F.col("paired") & F.col("reason").isNull(), F.array(main, dme)).otherwise(F.array(main))))
    return rows.select(
        "e.*", F.trim("ident").alias("ident"), F.trim("name").alias("name"), service_volume(F.col("power")).alias("service_volume_nm"), F.nullif(F.trim("associated_airport"), F.lit("")).alias("associated_airport"),
        F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("disposition"), "reason",
    )


def ingest_report(rows: DataFrame) -> DataFrame:
    """Seen, accepted, quarantined and rejected rows, with reasons."""
    return rows.groupBy("disposition", "reason").agg(F.count("*").alias("rows"))
