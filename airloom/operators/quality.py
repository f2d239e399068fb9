"""Validation rules, one DataFrame each, in one shape: rule, severity, table_name, id, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.text import in_band, navaid_kind


def _issue(df: DataFrame, rule: int, severity: str, table: str, message: Column | str, key: Column | str = "id") -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    m = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(table).alias("table_name"), k.cast("string").alias("id"), m.alias("message")).distinct()


def orphan_snapshots(df: DataFrame, snapshots: DataFrame, table: str) -> DataFrame:
    s = snapshots.select(F.col("snapshot_id").alias("__s")).distinct()
    return _issue(df.join(s, F.col("source_snapshot_id") == F.col("__s"), "left_anti"), 1, "error", table, "references missing source snapshot")


def missing_parent(df: DataFrame, parents: DataFrame, ref: str, table: str, rule: int = 2, parent_key: str = "id", message: str = "references missing airport", severity: str = "error") -> DataFrame:
    p = parents.select(F.col(parent_key).alias("__p")).distinct()
    empty = F.col(ref).isNull() | (F.col(ref).cast("string") == "")
    return _issue(df.filter(empty).unionByName(df.filter(~empty).join(p, F.col(ref) == F.col("__p"), "left_anti")), rule, severity, table, message)


def bad_coordinates(df: DataFrame, table: str) -> DataFrame:
    return _issue(df.filter("latitude_deg < -90 or latitude_deg > 90 or longitude_deg < -180 or longitude_deg > 180"), 3, "error", table, "coordinates out of range")


def inverted(df: DataFrame, table: str) -> DataFrame:
    return _issue(df.filter("valid_until is not null and valid_until <= valid_from"), 4, "error", table, "valid_until not strictly after valid_from")


def several_open(df: DataFrame, table: str) -> DataFrame:
    d = df.filter("valid_until is null").groupBy("id").agg(F.count_distinct("valid_from").alias("n")).filter("n > 1")
    return _issue(d, 5, "error", table, "multiple open temporal revisions")


def navaid_bands(df: DataFrame) -> DataFrame:
    k = navaid_kind(F.col("navaid_type"))
    unknown = _issue(df.filter(k.isNull()), 6, "error", "navaids", "unknown navaid type")
    off = _issue(df.filter(~in_band(k, F.col("frequency_khz"))), 6, "error", "navaids", "frequency outside its band")
    return unknown.unionByName(off)


def altitude_descriptors(legs: DataFrame) -> DataFrame:
    d = F.coalesce("altitude_descriptor", F.lit(""))
    return reduce(DataFrame.unionByName, [
        _issue(legs.filter((d != "") & ~d.rlike(r"^[+\-B AC-Z]$")), 8, "error", "procedure_legs", "unknown altitude descriptor"),
        _issue(legs.filter(d.rlike(r"^[ AC-Z]$")), 8, "warning", "procedure_legs", "altitude descriptor not yet interpreted"),
        _issue(legs.filter((d == "B") & (F.col("altitude_1_ft").isNull() | F.col("altitude_2_ft").isNull())), 8, "error", "procedure_legs", "altitude band requires both altitudes"),
        _issue(legs.filter(F.col("altitude_1_ft").isNull() & F.col("altitude_2_ft").isNotNull()), 8, "error", "procedure_legs", "altitude 2 set without altitude 1"),
    ])


def duplicate_sequence(df: DataFrame, keys: list[str], sequence: str, table: str, rule: int = 10) -> DataFrame:
    d = df.groupBy(*keys, sequence).agg(F.count("*").alias("n")).filter("n > 1")
    return _issue(d, rule, "error", table, F.concat(F.lit("sequence "), F.col(sequence).cast("string"), F.lit(" duplicated")), F.concat_ws("/", *keys))


def unresolved_ends(legs: DataFrame, idents: DataFrame, rule: int = 12) -> DataFrame:
    """Legs of which one end names no known ident."""
    known = idents.select(F.col("ident").alias("__i")).distinct()
    ends = legs.select("id", F.explode(F.array("start_ident", "end_ident")).alias("end"))
    return _issue(ends.filter("end is not null").join(known, F.col("end") == F.col("__i"), "left_anti"), rule, "warning", "airway_legs", "endpoint has no waypoint or navaid")


def conflicting_publications(df: DataFrame) -> DataFrame:
    """One publication with several contents none of which is a correction."""
    d = df.filter("publication_id is not null").groupBy("publication_id").agg(
        F.count_distinct("content_sha256").alias("n"), F.min(F.when(F.lower("revision_kind") == "correction", 0).otherwise(1)).alias("plain")
    )
    return _issue(d.filter("n > 1 and plain = 1"), 19, "error", "publications", "conflicting content", "publication_id")


def cycle_windows(df: DataFrame, table: str = "cycles") -> DataFrame:
    return _issue(df.filter("effective_until is not null and effective_until <= effective_from"), 14, "error", table, "effective_until not strictly after effective_from", "cycle")


def report(issues: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def first_of_each(issues: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` ids of each rule, table and message, as a listing shows them."""
    from pyspark.sql import Window

    w = Window.partitionBy("rule", "table_name", "message").orderBy("id")
    return issues.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= limit).drop("nth")
