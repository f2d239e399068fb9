"""Reconciling providers on identity keys: candidate pairs in a bucket, distance tiers, conflicts and continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.geo import haversine_nm
from airloom.functions.text import canonical_id

#: Fixed values in NM: coordinates confirm identity, identity is probable, an ident change is the same place.
EXACT_NM, PROBABLE_NM, IDENT_CHANGE_NM = 3.0, 30.0, 0.3


def tier(nm: Column, far: str) -> Column:
    return F.when(nm <= EXACT_NM, "exact").when(nm <= PROBABLE_NM, "probable").otherwise(far)


def bucket_pairs(left: DataFrame, right: DataFrame, far: str = "conflict") -> DataFrame:
    """Pairs of two providers that share ``key`` (both: id, key, lat, lon), with distance and outcome.

    A key that has more than one entity on a side is ambiguous: one row for it without pairing its members, so a bucket
    of any size yields one row. Ambiguous never merges.
    """
    side = lambda d, s: d.filter("key is not null").groupBy("key").agg(
        F.count_distinct("id").alias(f"n_{s}"), F.min_by(F.struct("id", "lat", "lon"), "id").alias(s)
    )
    j = side(left, "a").join(side(right, "b"), "key")
    nm = haversine_nm(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    alone = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    return j.select(
        "key", F.when(alone, F.col("a.id")).alias("id_a"), F.when(alone, F.col("b.id")).alias("id_b"),
        F.when(alone, F.round(nm, 6)).alias("distance_nm"), F.when(alone, F.coalesce(tier(nm, far), F.lit("unplaced"))).otherwise("ambiguous").alias("outcome"),
    )


def fallback_pairs(navaids: DataFrame) -> DataFrame:
    """Candidates across providers on ``key`` (kind and ident) that no strict pair (same region too) has decided.

    ``navaids`` has provider, id, key, region, lat, lon, one row an entity. Every two providers are compared, whole keys
    with each other; a missing region is a region of its own. Partners are the candidates within PROBABLE_NM, over all
    other providers; more than one on either side makes a near pair ambiguous. Different regions never merge.
    """
    n = navaids.withColumn("region", F.coalesce(F.upper(F.trim("region")), F.lit("")))

    def paired(rows: DataFrame) -> DataFrame:
        a, b = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "key"]) for s in "ab")
        p = a.join(b, "key").filter("provider_a < provider_b and region_a <> region_b")
        return p.withColumn("distance_nm", F.round(haversine_nm(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 6))

    # partners are counted first and go along with the entities, so that pairs are never shuffled
    near = paired(n).filter(F.col("distance_nm") <= PROBABLE_NM)
    ends = near.select(F.explode(F.array(*[F.struct(F.col(f"provider_{s}").alias("provider"), F.col(f"id_{s}").alias("id")) for s in "ab"])).alias("e")).select("e.*")
    partners = ends.groupBy("provider", "id").agg(F.count("*").alias("partners"))
    p = paired(n.join(partners, ["provider", "id"], "left").fillna(0, ["partners"]))
    several = (F.col("distance_nm") <= PROBABLE_NM) & (F.greatest("partners_a", "partners_b") > 1)
    apart = (F.col("region_a") != "") & (F.col("region_b") != "")
    outcome = F.when(several, "ambiguous").when(apart, "distinct").otherwise(tier(F.col("distance_nm"), "distinct"))
    return p.select("provider_a", "id_a", "provider_b", "id_b", "distance_nm", "partners_a", "partners_b", outcome.alias("outcome"))


def ident_changes(a: DataFrame, b: DataFrame, cell: float = 0.1, limit_nm: float = IDENT_CHANGE_NM) -> DataFrame:
    """Entities of the same country and cell within ``limit_nm`` under another ident: the place changed its ident.

    Only the own cell is searched, as continuity across a cell border is not claimed.
    """
    place = lambda d, s: d.select(
        F.floor(F.col("lat") / cell).alias("cy"), F.floor(F.col("lon") / cell).alias("cx"), "country",
        F.col("id").alias(f"id_{s}"), F.col("ident").alias(f"ident_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"),
    )
    j = place(a, "a").join(place(b, "b"), ["cy", "cx", "country"]).filter("ident_a <> ident_b")
    nm = haversine_nm(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return j.withColumn("distance_nm", F.round(nm, 6)).filter(F.col("distance_nm") <= limit_nm).select("id_a", "id_b", "ident_a", "ident_b", "distance_nm")


def runway_geometry(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Key of the ends of a runway in 1/100,000 degree, the southern (then western) one first."""
    first = (lat1 < lat2) | ((lat1 == lat2) & (lon1 <= lon2))
    at = lambda c: F.floor(c * 100_000 + 0.5).cast("string")
    ends = [at(c) for c in (lat1, lon1, lat2, lon2)]
    return F.when(first, F.concat_ws(",", *ends)).otherwise(F.concat_ws(",", *ends[2:], *ends[:2]))


def authority(values: DataFrame) -> DataFrame:
    """(entity, field, value, rank, source) in; the value of the best rank out, with how many others it overrules."""
    best = values.filter("value is not null").groupBy("entity", "field").agg(
        F.min_by(F.struct("value", "source"), F.struct("rank", "source", "value")).alias("b"), F.count_distinct("value").alias("n")
    )
    return best.select("entity", "field", "b.value", "b.source", (F.col("n") - 1).alias("overruled"))


def package_diff(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Class of each key of two packages: common, only_a, only_b or differs, with the names of the differing fields."""
    x = a.select(*key, F.struct(*fields).alias("__a"))
    y = b.select(*key, F.struct(*fields).alias("__b"))
    delta = F.array_compact(F.array(*[F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.lit(f)) for f in fields]))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    kind = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").when(F.size(delta) > 0, "differs").otherwise("common")
    return x.join(y, key, "full_outer").select(*key, kind.alias("class"), F.when(both, F.array_join(delta, ",")).otherwise("").alias("fields"))


def merge_datasets(parts: list[DataFrame], key: str) -> DataFrame:
    """Datasets in order of priority; the last one that has a key wins, whole row."""
    out = None
    for i, p in enumerate(parts):
        q = p.withColumn("__prio", F.lit(i))
        out = q if out is None else out.unionByName(q, allowMissingColumns=True)
    cols = [c for c in out.columns if c != "__prio"]
    return out.groupBy(key).agg(F.max_by(F.struct(*cols), "__prio").alias("r")).select("r.*")


def provider_pairs(entities: DataFrame, fields: list[str], far: str = "conflict") -> DataFrame:
    """Every two providers' entities of one ``key`` (provider, id, key, lat, lon, ``fields``) with distance and outcome.

    A key that has more than one entity on a side is ambiguous and gives one row for the two providers, whatever its
    size. ``conflicts`` names the fields in which a near pair differs (a missing value differs from none).
    """
    cols = ["id", "lat", "lon", *fields]
    side = entities.filter("key is not null").groupBy("provider", "key").agg(F.count_distinct("id").alias("n"), F.min_by(F.struct(*cols), "id").alias("r"))
    a, b = (side.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("provider", "n", "r")]) for s in "ab")
    j = a.join(b, "key").filter("provider_a < provider_b")
    alone = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    nm = haversine_nm(F.col("r_a.lat"), F.col("r_a.lon"), F.col("r_b.lat"), F.col("r_b.lon"))
    near = alone & F.coalesce(nm <= PROBABLE_NM, F.lit(False))
    differ = F.array_compact(F.array(*[F.when(F.col(f"r_a.{f}") != F.col(f"r_b.{f}"), F.lit(f)) for f in fields])) if fields else F.array().cast("array<string>")
    return j.select(
        "provider_a", "provider_b", "key", F.when(alone, F.col("r_a.id")).alias("id_a"), F.when(alone, F.col("r_b.id")).alias("id_b"), F.when(alone, F.round(nm, 6)).alias("distance_nm"),
        F.when(alone, F.coalesce(tier(nm, far), F.lit("unplaced"))).otherwise("ambiguous").alias("outcome"), F.when(near, differ).otherwise(F.array().cast("array<string>")).alias("conflicts"),
    )


def memberships(entities: DataFrame, prefix: str) -> DataFrame:
    """(canonical_id, provider, entity_id): entities that an exact pair brings under the canonical id of their key."""
    exact = provider_pairs(entities, []).filter("outcome = 'exact'")
    ends = F.array(*[F.struct(F.col(f"provider_{s}").alias("provider"), F.col(f"id_{s}").alias("entity_id")) for s in "ab"])
    return exact.select(canonical_id(prefix, F.col("key")).alias("canonical_id"), F.explode(ends).alias("e")).select("canonical_id", "e.*").distinct()


def join_memberships(current: DataFrame, found: DataFrame) -> DataFrame:
    """``current`` with what ``found`` adds; what is there already is left as it is, so a second run changes nothing."""
    return current.unionByName(found.join(current, current.columns, "left_anti"))
