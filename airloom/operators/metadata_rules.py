"""Validation rules of the metadata tables, in the shape of operators.quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.geo import haversine_nm
from airloom.operators.quality import _issue, report

#: What the enumerated columns may hold.
ENTITY_TABLES = ["airports", "runways", "navaids", "waypoints", "airway_legs", "procedure_legs"]
REVISION_KINDS = ["Baseline", "Correction"]
COVERAGES = ["FullSnapshot", "Partial"]
EVENT_KINDS = ["Discovered", "Downloaded", "Preloaded", "Activated", "Superseded", "Expired", "Rollback"]
SPAN_NM = 500.0


def outside(df: DataFrame, rule: int, table: str, column: str, known: list[str], key: Column | str = "id", severity: str = "error") -> DataFrame:
    bad = F.col(column).isNull() | ~F.col(column).isin(known)
    return _issue(df.filter(bad), rule, severity, table, F.concat(F.lit(f"unknown {column} "), F.coalesce(column, F.lit("null"))), key)


def absent(df: DataFrame, rule: int, table: str, on: list[Column], keys: DataFrame, message: str, key: Column | str = "id", severity: str = "error") -> DataFrame:
    """Rows of ``df`` whose ``on`` is in no row of ``keys`` (its columns in the same order)."""
    names = [f"__a{i}" for i in range(len(on))]
    left = df.select("*", *[c.alias(n) for c, n in zip(on, names)])
    right = keys.toDF(*[f"__b{i}" for i in range(len(on))]).distinct()
    cond = [F.col(n) == F.col(f"__b{i}") for i, n in enumerate(names)]
    return _issue(left.join(right, cond, "left_anti"), rule, severity, table, message, key)


def cycle_events(df: DataFrame) -> DataFrame:
    """Rule 15: event kinds; a rollback names the cycle it restores."""
    return outside(df, 15, "cycle_events", "kind", EVENT_KINDS).unionByName(
        _issue(df.filter("kind = 'Rollback' and restored_cycle_id is null"), 15, "error", "cycle_events", "rollback must name the restored cycle")
    )


def dataset_versions(df: DataFrame) -> DataFrame:
    """Rule 16: revision kind, coverage and digest of deliveries."""
    sha = _issue(df.filter(~F.coalesce(F.col("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))), 16, "error", "dataset_versions", "content_sha256 must be 64 hex digits")
    return report([outside(df, 16, "dataset_versions", "revision_kind", REVISION_KINDS), outside(df, 16, "dataset_versions", "coverage", COVERAGES), sha])


def aliases(df: DataFrame) -> DataFrame:
    """Rule 17: aliases name known tables."""
    return outside(df, 17, "entity_aliases", "entity_table", ENTITY_TABLES, "entity_id")


def tombstones(df: DataFrame, providers: DataFrame, entities: DataFrame) -> DataFrame:
    """Rule 18: table, provider and namespace of tombstones (entity_table, entity_id, provider); entities: (entity_table, id) of all times."""
    j = df.join(providers.select("provider", F.col("namespace").alias("__ns")), "provider", "left")
    out = _issue(j.filter("__ns is null"), 18, "error", "tombstones", "unknown provider", "entity_id")
    foreign = _issue(j.filter(~F.col("entity_id").startswith(F.concat("__ns", F.lit(":")))), 18, "error", "tombstones", "entity outside the provider's namespace", "entity_id")
    never = absent(df.filter(F.col("entity_table").isin(ENTITY_TABLES)), 18, "tombstones", [F.col("entity_table"), F.col("entity_id")], entities.select("entity_table", "id"), "tombstone for entity with no historical row", "entity_id", "warning")
    return report([outside(df, 18, "tombstones", "entity_table", ENTITY_TABLES, "entity_id"), out, foreign, never])


def publication_dates(df: DataFrame, cycles: DataFrame) -> DataFrame:
    """Rule 20: a baseline starts with its cycle, a correction not before it, and the cycle is known."""
    c = cycles.select(F.col("id").alias("__c"), F.col("effective_from").alias("__eff"))
    j = df.filter("publication_id is not null and airac_cycle is not null").join(c, F.col("airac_cycle") == F.col("__c"), "left")
    return report([
        _issue(j.filter("__c is null"), 20, "error", "dataset_versions", "references unknown cycle", "publication_id"),
        _issue(j.filter("revision_kind = 'Baseline' and valid_from <> __eff"), 20, "error", "dataset_versions", "baseline does not start with its cycle", "publication_id"),
        _issue(j.filter("revision_kind = 'Correction' and valid_from < __eff"), 20, "error", "dataset_versions", "correction precedes its cycle", "publication_id"),
    ])


def applications(df: DataFrame, versions: DataFrame) -> DataFrame:
    """Rules 21 to 23: differential publications close nothing, kinds are known, every publication was applied."""
    audit = absent(versions.filter("publication_id is not null"), 23, "dataset_versions", [F.col("publication_id"), F.col("valid_from")], df.select("publication_id", "valid_from"), "publication without a completed application", "publication_id")
    return report([
        _issue(df.filter("coverage = 'Partial' and rows_closed > 0"), 21, "error", "publication_applications", "differential publication closed rows", "publication_id"),
        outside(df, 22, "publication_applications", "kind", REVISION_KINDS, "publication_id"), outside(df, 22, "publication_applications", "coverage", COVERAGES, "publication_id"), audit,
    ])


def memberships(df: DataFrame, identities: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules 24 to 26, 28 and 29 of memberships (canonical_id, kind, entity_id, valid_from, valid_until).

    identities: canonical_id, kind. sources: id, valid_from, valid_until, region, lat, lon of all revisions.
    """
    ids = identities.select(F.col("canonical_id").alias("__c"), F.col("kind").alias("__k"))
    j = df.join(ids, F.col("canonical_id") == F.col("__c"), "left")
    spread = df.join(sources.select(F.col("id").alias("entity_id"), "region", "lat", "lon").distinct(), "entity_id").groupBy("canonical_id").agg(
        F.count_distinct("region").alias("regions"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d")
    )
    wide = haversine_nm(F.col("a"), F.col("c"), F.col("b"), F.col("d")) > SPAN_NM
    several = df.groupBy("entity_id").agg(F.count_distinct("canonical_id").alias("n")).filter("n > 1")
    src = sources.select(F.col("id").alias("__i"), F.col("valid_from").alias("__f"), F.col("valid_until").alias("__u")).distinct()
    same = (F.col("entity_id") == F.col("__i")) & (F.col("valid_from") == F.col("__f")) & F.col("valid_until").eqNullSafe(F.col("__u"))
    known = absent(df, 24, "memberships", [F.col("entity_id")], sources.select("id"), "dangling member", "entity_id")
    off = df.join(src, same, "left_anti").join(src.select(F.col("__i").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return report([
        _issue(df.filter(~F.col("entity_id").contains(":")), 24, "error", "memberships", "member without namespace", "entity_id"), _issue(df.filter("valid_until <= valid_from"), 24, "error", "memberships", "interval does not run forward", "entity_id"), known,
        _issue(j.filter("__c is null or kind <> __k"), 25, "error", "memberships", "canonical identity missing or of another kind", "canonical_id"), _issue(several, 26, "error", "memberships", "one source with several canonicals", "entity_id"),
        _issue(spread.filter((F.col("regions") > 1) | wide), 28, "warning", "memberships", "canonical spans regions or 500 NM", "canonical_id"), _issue(off, 29, "error", "memberships", "interval is not that of the source", "entity_id"),
    ])


def conflicts(df: DataFrame) -> DataFrame:
    """Rules 27 and 30: severity and status of conflicts, and their key."""
    return report([
        outside(df, 27, "conflicts", "severity", ["info", "warning", "error"]), outside(df, 27, "conflicts", "status", ["open", "resolved", "ignored"]),
        _issue(df.filter("conflict_key is null or conflict_key = ''"), 30, "error", "conflicts", "missing conflict key"),
    ])


def ils(df: DataFrame, navaids: DataFrame, runways: DataFrame) -> DataFrame:
    """Rule 31: bearing, glide path, localizer and runway end of associations."""
    key = F.concat_ws("/", "airport_ident", "approach_ident")
    ends = runways.select("airport_ident", F.explode(F.array("le_ident", "he_ident")).alias("end"))
    return report([
        _issue(df.filter(~F.col("bearing_mag_deg").between(0, 360)), 31, "error", "ils_associations", "localizer bearing out of range", key), _issue(df.filter(~F.col("glideslope_deg").between(1, 10)), 31, "error", "ils_associations", "glide path angle out of range", key),
        absent(df, 31, "ils_associations", [F.col("localizer_ident"), F.col("airport_ident")], navaids.select("ident", "associated_airport"), "localizer has no navaid row", key),
        absent(df, 31, "ils_associations", [F.col("airport_ident"), F.col("runway")], ends, "runway end not found", key, "warning"),
    ])
