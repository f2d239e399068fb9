"""What changed between consecutive full snapshots of a table.

The deliveries of all series are merged in one sweep: rows are range-partitioned and sorted by (series, key, delivery),
so the delivery before and after of a key are its neighbours in the stream, and every range is merged on its own. The
table is read once however many snapshots there are, and what crosses the network is the key, a 128-bit digest of the
exactly compared fields and the fields with a tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.tables import digest, number, plain, small_side


def full_deliveries(fetched: DataFrame) -> DataFrame:
    """The distinct full deliveries: source_snapshot_id, series, seq (from 1), deliveries (in the series).

    A series is provider_name and dataset_name as plain text. A delivery with the content of an earlier one of its
    series is that one again and left out. Missing digests never equal each other; rows without id are left out.
    """
    kind = F.regexp_replace(F.lower(F.coalesce("coverage", F.lit(""))), r"[^a-z]", "")
    one = (
        fetched.filter(F.col("source_snapshot_id").isNotNull() & kind.isin("full", "fullsnapshot"))
        .withColumn("at", F.coalesce("valid_from", "retrieved_at"))
        .groupBy("source_snapshot_id")
        .agg(F.min_by(F.struct("provider_name", "dataset_name", "content_sha256", "at", "retrieved_at"), F.struct("at", "retrieved_at")).alias("d"))
        .select("source_snapshot_id", "d.*")
    )
    series = F.concat_ws("\u0001", F.coalesce(plain("provider_name"), F.lit("")), F.coalesce(plain("dataset_name"), F.lit("")))
    sha = F.nullif(F.regexp_replace(F.lower(F.trim("content_sha256")), r"^sha-?256\s*[:=]\s*", ""), F.lit(""))
    ordered = one.withColumn("series", series).withColumn("content", F.coalesce(sha, F.concat(F.lit("?"), "source_snapshot_id")))
    by = ["at", "retrieved_at", "source_snapshot_id"]
    first = ordered.withColumn("nth", F.row_number().over(Window.partitionBy("series", "content").orderBy(*by))).filter("nth = 1")
    w = Window.partitionBy("series")
    return first.select(
        "source_snapshot_id",
        "series",
        F.row_number().over(w.orderBy(*by)).alias("seq"),
        F.count("*").over(w).cast("int").alias("deliveries"),
    )


def snapshot_changes(
    rows: DataFrame,
    deliveries: DataFrame,
    key: Column,
    exact: list[Column],
    tolerant: dict[str, float],
    row_id: str = "row_id",
    names: list[str] | None = None,
) -> DataFrame:
    """Typed changes (series, source_snapshot_id, record_id, change_kind) between consecutive deliveries.

    ``exact`` columns are compared as they are (null equals null only), ``tolerant`` ones differ from the given amount
    on or where only one is missing. A key delivered twice in one delivery counts once, with its lowest row_id. Rows of
    other snapshots and rows without key are left out. The first delivery of a series has no changes; a delivery without
    any row removes all. Columns of ``rows`` that are not named play no part, so extra ones may be called anything.

    With ``names`` for the exact columns the result also has ``fields``: what differs of a changed record. Each column
    then crosses the network as a hash of its own in place of the common digest.
    """
    d1, d2 = digest(*exact) if names is None else (F.array(*[F.xxhash64(F.coalesce(c.cast("string"), F.lit("\u0000"))) for c in exact]), F.lit(0))
    tol = list(tolerant)
    slim = rows.select(
        F.trim(F.col("source_snapshot_id")).alias("__snap"),
        key.alias("record_id"),
        F.struct(d1.alias("d1"), d2.alias("d2"), *[number(F.col(c)).alias(c) for c in tol]).alias("v"),
        F.col(row_id).alias("rid"),
    ).filter("record_id is not null and record_id <> ''")
    order = deliveries.select(F.trim("source_snapshot_id").alias("__snap"), "series", "seq", "deliveries")
    known = slim.join(small_side(order), "__snap").drop("__snap")
    # one row per key and delivery, combined before the shuffle: copies of a hot key never meet in one task
    single = known.groupBy("series", "record_id", "seq", "deliveries").agg(F.min_by("v", "rid").alias("v"))
    ranged = single.repartitionByRange("series", "record_id")
    w = Window.partitionBy("series", "record_id").orderBy("seq")
    merged = ranged.select(
        "series", "record_id", "seq", "deliveries", "v",
        F.lag(F.struct("seq", "v")).over(w).alias("p"),
        F.lead("seq").over(w).alias("n"),
    )
    differs = (F.col("v.d1") != F.col("p.v.d1")) | (F.col("v.d2") != F.col("p.v.d2"))
    which = [F.when(F.get("v.d1", F.lit(i)) != F.get("p.v.d1", F.lit(i)), F.lit(n)) for i, n in enumerate(names or [])]
    for c, by in tolerant.items():
        a, b = F.col(f"v.{c}"), F.col(f"p.v.{c}")
        moved = (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) >= by - by * 1e-5, F.lit(False))
        differs = differs | moved
        which.append(F.when(moved, F.lit(c)))
    follows = F.col("p.seq").isNotNull() & (F.col("p.seq") == F.col("seq") - 1)
    here = F.when(follows & differs, "changed").when(~follows & (F.col("seq") > 1), "added")
    gone = F.when((F.col("seq") < F.col("deliveries")) & (F.coalesce("n", F.lit(2**31 - 1)) > F.col("seq") + 1), "removed")
    none = F.array().cast("array<string>")
    fields = [F.when(here == "changed", F.array_compact(F.array(*which))).otherwise(none).alias("fields")] if names else []
    events = merged.select(
        "series", "record_id",
        F.explode(F.array(
            F.struct(F.col("seq").alias("seq"), here.alias("change_kind"), *fields), F.struct((F.col("seq") + 1).alias("seq"), gone.alias("change_kind"), *([none.alias("fields")] if names else []))
        )).alias("e"),
    ).select("series", "record_id", "e.*").filter("change_kind is not null")
    named = deliveries.select("series", "seq", "source_snapshot_id")
    return events.join(small_side(named), ["series", "seq"]).select("series", "source_snapshot_id", "record_id", "change_kind", *(["fields"] if names else []))


def navaid_changes(rows: DataFrame, fetched: DataFrame, fields: bool = False) -> DataFrame:
    """snapshot_changes over the fetched navaid datasets, with the names of the changed fields if asked for."""
    texts = ["ident", "name", "navaid_type", "iso_country", "associated_airport"]
    return snapshot_changes(
        rows,
        full_deliveries(fetched),
        F.lower(F.regexp_replace("record_id", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")),
        [*[plain(c) for c in texts], F.col("frequency_khz"), number(F.col("elevation_ft"))],
        {"latitude_deg": 1e-5, "longitude_deg": 1e-5},
        names=[*texts, "frequency_khz", "elevation_ft"] if fields else None,
    )
