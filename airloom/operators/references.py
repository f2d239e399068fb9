"""References to records that do not exist at the time of the referring row.

References and parent intervals of all tables go into one stream, co-partitioned by (target, key) and sorted by time.
A running maximum of the parents' ends, parents before references, tells in one linear pass whether a reference is
covered: it is exactly if some parent that has started ends later. Whether any parent exists, and on which side of the
reference it lies, separates missing, deleted and late.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.operators.skew import HOT_ROWS, hot_keys, parts
from airloom.tables import far_future, far_past, key_text

REFERENCE = ["table_name", "field_name", "row_key", "target", "key", "at"]


def references(df: DataFrame, table: str, field: str, row_key: str, target: str, key: Column, at: str = "valid_from") -> DataFrame:
    """The references of one field; rows whose key or time is null are none."""
    return df.select(
        F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), F.col(row_key).cast("long").alias("row_key"),
        F.lit(target).alias("target"), key.alias("key"), F.col(at).alias("at"),
    ).filter("key is not null and at is not null")


def parents(df: DataFrame, target: str, key: Column, start: str, end: str) -> DataFrame:
    """Validity intervals of a target table, one row per key and start; a missing bound is unbounded."""
    return (
        df.select(
            F.lit(target).alias("target"), key.alias("key"),
            F.coalesce(F.col(start), far_past(df, start)).alias("at"), F.coalesce(F.col(end), far_future(df, end)).alias("ends"),
        )
        .filter("key is not null and ends > at")
        .groupBy("target", "key", "at").agg(F.max("ends").alias("ends"))
    )


def orphans(refs: DataFrame, held: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The references without a valid parent: table_name, field_name, row_key, at, reason (missing, deleted, late, gap).

    References of a hot key (any number of keys) are salted over as many parts as its size asks for, its parents are
    copied to each part (parents are one row per key and start). One row per case, however often the referring row was delivered.
    """
    keys = ["target", "key"]
    hot = hot_keys(refs, keys, hot_rows)
    marked, split = parts(refs.select(*REFERENCE), keys, hot, hot_rows)
    r = marked.select(*REFERENCE, F.pmod(F.xxhash64("row_key", "at"), split).cast("int").alias("part"), F.lit(None).cast(held.schema["ends"].dataType).alias("ends"))
    marked, split = parts(held, keys, hot, hot_rows)
    p = marked.select(
        *[F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in REFERENCE[:3]], "target", "key", "at",
        F.explode(F.sequence(F.lit(0), split - 1)).alias("part"), "ends",
    )
    w = Window.partitionBy("target", "key", "part").orderBy("at", F.col("ends").isNull())
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("target", "key", "part")
    merged = r.unionByName(p).select(
        *REFERENCE, "ends",
        F.max("ends").over(seen).alias("reach"),
        F.max(F.when(F.col("ends").isNotNull(), F.col("at"))).over(group).alias("last_start"),
    )
    found = merged.filter("ends is null and (reach is null or reach <= at)")
    reason = (
        F.when(F.col("last_start").isNull(), "missing")
        .when(F.col("reach").isNull(), "late")
        .when(F.col("last_start") > F.col("at"), "gap")
        .otherwise("deleted")
    )
    return found.select("table_name", "field_name", "row_key", "at", reason.alias("reason")).distinct()


def navigation_references(charts: DataFrame, runways: DataFrame, segments: DataFrame) -> DataFrame:
    def fix(ident: str, region: str) -> Column:
        return F.when(key_text(ident).isNotNull(), F.concat_ws("|", key_text(ident), F.coalesce(key_text(region), F.lit(""))))

    return reduce(DataFrame.unionByName, [
        references(charts, "chart_associations", "chart_id", "assoc_id", "chart", key_text("chart_id")),
        references(runways, "ourairports_runways", "airport_ref", "id", "airport", key_text("airport_ref")),
        references(segments, "airway_segments", "start_ident", "segment_id", "navaid", fix("start_ident", "start_region")),
        references(segments, "airway_segments", "end_ident", "segment_id", "navaid", fix("end_ident", "end_region")),
    ])


def navigation_parents(charts: DataFrame, airports: DataFrame, navaids: DataFrame) -> DataFrame:
    fix = F.when(key_text("ident").isNotNull(), F.concat_ws("|", key_text("ident"), F.coalesce(key_text("iso_country"), F.lit(""))))
    return reduce(DataFrame.unionByName, [
        parents(charts, "chart", key_text("id"), "effective_from", "effective_to"),
        parents(airports, "airport", key_text("id"), "valid_from", "valid_until"),
        parents(navaids, "navaid", fix, "valid_from", "valid_until"),
    ])
