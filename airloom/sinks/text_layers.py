"""Text layers for simulators and flight management systems. What cannot be written is skipped with a reason."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rendered(template: str):
    """A vectorised UDF that fills a %-template; numbers are rounded from their binary value."""

    @F.pandas_udf(T.StringType())
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([template % t for t in zip(*cols)], dtype=object)

    return run


def is_region(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Z][A-Z0-9 ]$"), F.lit(False))


def split(rows: DataFrame, reason: Column, kind: str, ident: str = "ident") -> tuple[DataFrame, DataFrame]:
    """(rows that can be written, skipped ones as kind, ident, reason)."""
    marked = rows.withColumn("__why", reason)
    return marked.filter("__why is null").drop("__why"), marked.filter("__why is not null").select(F.lit(kind).alias("kind"), F.col(ident).alias("ident"), F.col("__why").alias("reason"))


def fixes(waypoints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, skipped, exported endpoints): enroute fixes in order of ident and name."""
    why = F.when(~is_region(F.col("region")), "missing or invalid region").when(F.col("waypoint_type").isNull(), "missing waypoint type").when(~F.coalesce("is_enroute", F.lit(False)), "terminal fix")
    ok, skipped = split(waypoints, why, "fix")
    line = rendered("%12.9f %13.9f %5s ENRT %s %d %s")(F.col("latitude_deg"), F.col("longitude_deg"), F.col("ident"), F.col("region"), F.col("waypoint_type"), F.col("name"))
    return ok.orderBy("ident", "name").select(line.alias("value")), skipped, ok.select("ident", "region", F.lit(11).alias("type")).distinct()


CODES = {"NDB": 2, "VOR": 3, "VOR-DME": 3, "VORTAC": 3, "TACAN": 3, "ILS-LOC": 4, "ILS-GS": 6, "DME": 13}


def navaids(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, skipped, exported endpoints) in order of row code, ident and name. A localizer without a glide path is 5, a
    paired DME 12; frequencies are kHz for NDB and hundredths of MHz else."""
    code = F.lit(None).cast("int")
    for k, v in CODES.items():
        code = F.when(F.col("navaid_type") == k, v).otherwise(code)
    gs = rows.filter("navaid_type = 'ILS-GS'").select(F.col("ident").alias("__g")).distinct()
    j = rows.join(gs, F.col("ident") == F.col("__g"), "left")
    code = F.when((F.col("navaid_type") == "ILS-LOC") & F.col("__g").isNull(), 5).when((F.col("navaid_type") == "DME") & F.coalesce("dme_paired", F.lit(False)), 12).otherwise(code)
    j = j.withColumn("code", code).drop("__g")
    ils = F.col("code").isin(4, 5, 6)
    why = (
        F.when(F.col("code").isNull(), "kind has no row").when(F.col("latitude_deg").isNull() | F.col("longitude_deg").isNull(), "no position").when(~is_region(F.col("region")), "missing or invalid region")
        .when(ils & F.col("associated_airport").isNull(), "no airport").when(F.col("code").isin(4, 5) & F.col("bearing_deg").isNull(), "no localizer course").when((F.col("code") == 6) & F.col("glideslope_angle_deg").isNull(), "no glide path angle")
    )
    ok, skipped = split(j, why, "navaid")
    freq = F.when(F.col("code") == 2, F.col("frequency_khz")).otherwise((F.col("frequency_khz") / 10).cast("int"))
    turn = F.when(F.col("code") == 6, F.coalesce("glideslope_angle_deg", F.lit(0.0)) * 100_000 + F.coalesce("bearing_deg", F.lit(0.0))).otherwise(F.coalesce("bearing_deg", "slaved_variation_deg", F.lit(0.0)))
    line = rendered("%2d %12.8f %13.8f %7d %7d %5d %11.3f %4s %4s %s %s")(
        F.col("code"), F.col("latitude_deg"), F.col("longitude_deg"), F.coalesce("elevation_ft", F.lit(0)).cast("int"), freq, F.coalesce("service_volume_nm", F.lit(0)), turn, F.col("ident"),
        F.when(ils, F.col("associated_airport")).otherwise("ENRT"), F.col("region"), F.col("name"),
    )
    ends = ok.filter("code in (2, 3)").select("ident", "region", F.col("code").alias("type")).distinct()
    return ok.orderBy("code", "ident", "name").select(line.alias("value")), skipped, ends


def airways(legs: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, skipped): segments between exported ends; routes with the same ends, direction, level and band share a line."""
    ends = ends.groupBy("ident", "region").agg(F.max("type").alias("type"))
    a, b = (ends.select(F.col("ident").alias(f"{s}_fix"), F.col("region").alias(f"{s}_icao_code"), F.col("type").alias(f"{s}_type")) for s in ("start", "end"))
    j = legs.withColumn("start_fix", F.trim("start_fix")).withColumn("end_fix", F.trim("end_fix")).join(a, ["start_fix", "start_icao_code"], "left").join(b, ["end_fix", "end_icao_code"], "left")
    why = (
        F.when(F.col("minimum_altitude_ft").isNull() | F.col("maximum_altitude_ft").isNull(), "missing altitudes").when(~is_region(F.col("start_icao_code")), "invalid start region").when(~is_region(F.col("end_icao_code")), "invalid end region")
        .when(F.col("start_type").isNull(), "start not in the exported layer").when(F.col("end_type").isNull(), "end not in the exported layer")
    )
    ok, skipped = split(j, why, "airway", "route_ident")
    keys = ["start_fix", "start_icao_code", "start_type", "end_fix", "end_icao_code", "end_type", "direction", "lvl", "minimum_altitude_ft", "maximum_altitude_ft"]
    g = ok.withColumn("lvl", F.when(F.coalesce("level", F.lit("L")) == "H", 2).otherwise(1)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "route_ident"))).alias("r"))
    names = F.array_join(F.array_distinct(F.transform("r", lambda x: x["route_ident"])), "-")
    fl = lambda c: (F.col(c) / 100).cast("int")
    line = rendered("%5s %s %2d %5s %s %2d %s %d %3d %3d %s")(F.col("start_fix"), F.col("start_icao_code"), F.col("start_type"), F.col("end_fix"), F.col("end_icao_code"), F.col("end_type"), F.col("direction"), F.col("lvl"), fl("minimum_altitude_ft"), fl("maximum_altitude_ft"), names)
    return g.orderBy(*keys[:2], *keys[3:5], "direction", "lvl", "minimum_altitude_ft").select(line.alias("value")), skipped


def holds(legs: DataFrame) -> DataFrame:
    """Holding patterns, one per fix, airport, course (tenths) and turn; the first one stands."""
    h = legs.filter(F.col("path_terminator").isin("HA", "HF", "HM") & F.col("course_a_deg").isNotNull())
    w = Window.partitionBy("fix_ident", "fix_icao_code", "airport_ident", F.round(F.col("course_a_deg") * 10), "turn_direction").orderBy("line_no")
    one = h.withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    line = rendered("%5s %s %4s %.1f %.1f %.1f %s")(F.col("fix_ident"), F.col("fix_icao_code"), F.col("airport_ident"), F.col("course_a_deg"), F.lit(0.0), F.coalesce("distance_a_nm", F.lit(0.0)), F.coalesce("turn_direction", F.lit("R")))
    return one.orderBy("fix_ident", "airport_ident", "line_no").select(line.alias("value"))


def airport_metadata(airports: DataFrame, runways: DataFrame) -> DataFrame:
    from airloom.functions.geo import region_of

    longest = runways.groupBy("airport_ident").agg(F.max("length_ft").alias("longest"))
    j = airports.join(longest, airports.ident == longest.airport_ident, "left")
    line = rendered("%4s %s %11.7f %12.7f %6d %5d")(F.col("ident"), region_of(F.col("latitude_deg"), F.col("longitude_deg"), F.col("ident"), F.coalesce("iso_country", F.lit(""))), F.col("latitude_deg"), F.col("longitude_deg"), F.coalesce("elevation_ft", F.lit(0)).cast("int"), F.coalesce("longest", F.lit(0)))
    return j.orderBy("ident").select(line.alias("value"))


def msa(rows: DataFrame) -> DataFrame:
    sectors = F.array_join(F.transform("sectors", lambda s: F.concat_ws(" ", s["bearing_to"].cast("string"), (s["altitude_ft"] / 100).cast("int").cast("string"), s["radius_nm"].cast("string"))), " ")
    return rows.filter(F.size("sectors") > 0).orderBy("airport_ident", "center_fix").select(F.concat_ws(" ", "center_fix", "airport_ident", sectors).alias("value"))


def mora(rows: DataFrame) -> DataFrame:
    values = F.array_join(F.transform("values", lambda v: F.lpad(v.cast("string"), 3, "0")), " ")
    return rows.orderBy("lat_deg", "lon_deg").select(F.concat_ws(" ", F.col("lat_deg").cast("string"), F.col("lon_deg").cast("string"), values).alias("value"))


def delimited(rows: DataFrame, columns: list[Column | str], by: str = "|", order: list[str] | None = None) -> DataFrame:
    """Lines of delimited text, nulls as empty fields."""
    cells = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return (rows.orderBy(*order) if order else rows).select(F.concat_ws(by, *cells).alias("value"))


def pmdg_frequency(kind: Column, khz: Column) -> Column:
    return F.when(kind == "NDB", khz / 100).otherwise(khz / 1000)


def surrogate_ids(rows: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Ids from 1 in a natural order, dense over all partitions: counts of sorted partitions give each its offset, so no
    task sees the whole table."""
    from airloom.session import cut

    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect()  # one row a partition
    offsets, at = {}, 0
    for r in sizes:
        offsets[r["__p"]] = at
        at += r["n"]
    pairs = [F.lit(x) for k, v in offsets.items() for x in (k, v)]
    base = F.element_at(F.create_map(*pairs), F.col("__p")) if pairs else F.lit(0)
    return ranged.withColumn(name, (base + F.col("__i") + 1).cast("long")).drop("__p", "__i")


def flight_plan(fixes_: list[tuple[str, float, float]], cycle: str, form: str) -> str:
    """One plan as FMS (numbered rows), FPL (XML) or a plain line list."""
    if form == "fms":
        rows = [f"{1 if i in (0, len(fixes_) - 1) else 11} {n} {'ADEP' if i == 0 else 'ADES' if i == len(fixes_) - 1 else 'DRCT'} 0.000000 {a:.6f} {b:.6f}" for i, (n, a, b) in enumerate(fixes_)]
        return "\n".join(["I", "1100 Version", f"CYCLE {cycle}", f"ADEP {fixes_[0][0]}", f"ADES {fixes_[-1][0]}", f"NUMENR {len(fixes_)}", *rows]) + "\n"
    if form == "fpl":
        from xml.sax.saxutils import escape

        pts = "".join(f"<route-point><waypoint-identifier>{escape(n)}</waypoint-identifier></route-point>" for n, _, _ in fixes_)
        return f'<?xml version="1.0" encoding="utf-8"?><flight-plan><route>{pts}</route></flight-plan>'
    return "\n".join(n for n, _, _ in fixes_) + "\n"


def write_layer(spark: SparkSession, root: str, files: dict[str, DataFrame], header: str) -> dict[str, int]:
    """All files of a layer into a staging folder with a manifest, then one swap; an empty file refuses the whole layer.

    Lines are worked out once. Each file is one text file, as its readers want it, so its lines pass through one task as
    a stream. The layer before is set aside until the new one stands, and comes back if that fails.
    """
    import json

    from airloom.session import cut

    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    stage, aside = f"{root}.staging", f"{root}.previous"
    fs.delete(path(stage), True)
    counts = {}
    for name, lines in files.items():
        lines = cut(lines)
        n = lines.count()
        if not n:
            fs.delete(path(stage), True)
            raise ValueError(f"{name} has no rows")
        first = spark.createDataFrame([(0, header)], "o int, value string")
        body = lines.withColumn("o", F.lit(1)).select("o", "value")
        last = spark.createDataFrame([(2, "99")], "o int, value string")
        first.unionByName(body).unionByName(last).coalesce(1).select("value").write.text(f"{stage}/{name}")
        counts[name] = n
    spark.createDataFrame([(json.dumps({"header": header, "rows": counts}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{stage}/manifest")
    fs.delete(path(aside), True)
    there = fs.exists(path(root))
    if there and not fs.rename(path(root), path(aside)):
        raise OSError("the layer before could not be set aside")
    if not fs.rename(path(stage), path(root)):
        if there:
            fs.rename(path(aside), path(root))
        raise OSError("the layer could not be published")
    fs.delete(path(aside), True)
    return counts


def table_digest(df: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows, added up in two halves of 64 bits."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    h = F.sha2(text, 256)
    half = lambda a: F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(half(1)), F.lit(0)).alias("a"), F.coalesce(F.sum(half(16)), F.lit(0)).alias("b")).first()
    import hashlib

    return hashlib.sha256(f"{r['n']}:{r['a']}:{r['b']}".encode()).hexdigest()


def bundle(tables: dict[str, DataFrame], policy: DataFrame, public: bool) -> dict:
    """A manifest of tables with digests; a public bundle refuses rows of providers that are not public."""
    from airloom.sources.documents import leaks

    if public:
        bad = [n for n, t in tables.items() if "provider" in t.columns and leaks(t, policy).limit(1).count()]
        if bad:
            raise ValueError(f"not for distribution: {', '.join(sorted(bad))}")
    return {n: {"rows": t.count(), "digest": table_digest(t)} for n, t in sorted(tables.items())}


def verify(manifest: dict, tables: dict[str, DataFrame]) -> list[str]:
    """Tables whose digest is not that of the manifest."""
    return [n for n, m in manifest.items() if n not in tables or table_digest(tables[n]) != m["digest"]]


def decide_update(installed: str | None, offered: str, pinned: bool) -> str:
    return "hold" if pinned else "install" if installed is None else "update" if offered > installed else "current" if offered == installed else "refuse-downgrade"


