"""The four exports of a world, each written whole to a folder: text layer, SQLite tables, XML of procedures, delimited text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.plans.formats import _layer
from airloom.plans.functions import _airports, procedure_legs
from airloom.sinks import packages
from airloom.sinks import text_layers as sink
from airloom.tables import read


def _navaids(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "ourairports_navaids").filter("latitude_deg is not null and longitude_deg is not null")
    cols = ["ident", "name", "navaid_type", "frequency_khz", "latitude_deg", "longitude_deg", "elevation_ft", "iso_country"]
    return n.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("valid_from", "latitude_deg", "longitude_deg")).alias("r")).select("id", "r.*")


def _runways(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "ourairports_runways")
    cols = [c for c in r.columns if c not in ("id", "source_snapshot_id")]
    return r.groupBy("id").agg(F.min(F.struct(*cols)).alias("r")).select("id", "r.*")


def text_layer(spark: SparkSession, d: str, out: str) -> dict[str, int]:
    """SNK1, SNK3, SNK5, SNK8: fixes, airways and airport metadata in one swap."""
    a = _airports(spark, d).filter("ident is not null")
    w = a.withColumn("region", F.lit("K1")).withColumn("waypoint_type", F.lit(87)).withColumn("is_enroute", F.lit(True))
    longest = _runways(spark, d).groupBy(F.col("airport_ident").alias("airport_ref")).agg(F.max("length_ft").alias("longest"))
    meta = sink.delimited(a.join(longest, a["ident"] == longest["airport_ref"], "left"), ["ident", "iso_country", F.rint("elevation_ft").cast("int"), "longest"], " ", ["ident"])
    return sink.write_layer(spark, out, {"fixes": sink.fixes(w)[0], "airways": _layer(spark, d)[0], "airports": meta}, "1100 Version")


def sqlite(spark: SparkSession, d: str, out: str) -> dict[str, int]:
    """SNK9: airports, runways, navaids and airways with surrogate ids in one SQLite file, which lies where the driver runs."""
    os.makedirs(out, exist_ok=True)
    plain = lambda df: df.select(*[F.col(c).cast("string").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])
    s = read(spark, d, "airway_segments").select("segment_id", "route_ident", "sequence_number", "start_ident", "end_ident", "minimum_altitude_ft", "maximum_altitude_ft").distinct()
    tables = {"airport": (_airports(spark, d), ["ident", "id"]), "runway": (_runways(spark, d), ["airport_ident", "le_ident", "id"]), "navaid": (_navaids(spark, d), ["ident", "id"]), "airway": (s, ["route_ident", "sequence_number", "segment_id"])}
    return packages.sqlite(f"{out}/world.sqlite", {n: plain(sink.surrogate_ids(t, order, f"{n}_id")) for n, (t, order) in tables.items()})


def xml(spark: SparkSession, d: str, out: str) -> int:
    """SNK10: one XML text for each airport with procedures."""
    packages.procedure_xml(procedure_legs(spark, d))[0].write.mode("overwrite").parquet(out)
    return 1


def delimited(spark: SparkSession, d: str, out: str) -> int:
    """SNK11 to SNK13: airports, navaids, fixes and routes as delimited text."""
    six = lambda c: F.format_string("%.6f", F.col(c))
    a, n = _airports(spark, d), _navaids(spark, d)
    r = _runways(spark, d).filter("airport_ident is not null")
    parts = {
        "apt": sink.delimited(r, ["airport_ident", "le_ident", six("le_latitude_deg"), six("le_longitude_deg"), "length_ft", "le_heading_degt"], "|"), "aid": sink.delimited(n, ["ident", "navaid_type", six("latitude_deg"), six("longitude_deg"), "frequency_khz"], "|"),
        "fix": sink.delimited(a, ["ident", six("latitude_deg"), six("longitude_deg")], "|"), "rte": sink.delimited(read(spark, d, "airway_segments"), ["route_ident", "sequence_number", "start_ident", "end_ident"], "|"),
    }
    for name, lines in parts.items():
        lines.write.mode("overwrite").text(f"{out}/{name}")
    return len(parts)


EXPORTS = {"export_text_layer": text_layer, "export_sqlite": sqlite, "export_xml": xml, "export_delimited_text": delimited}
