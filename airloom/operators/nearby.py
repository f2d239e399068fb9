"""Points near other points or in regions: latitude strips with overlap, a longitude sweep in each, one owner per pair.

A strip is as high as the distance, so partners lie in the same or the next strip; a strip is cut into longitude blocks
whose width follows from the latitude. A point goes to its own block and, as a guest, to those whose sweep can reach it.
Blocks are range-partitioned and sorted by longitude; the sweep is vectorised over Arrow batches and keeps only the
points of the current block within reach. The pair belongs to the block of the lower strip and the western point. The
points that a block owns are dealt out over as many shares as it is dense; a share looks only at pairs whose western
point it was dealt, so the shares of a block divide its candidates between them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.operators.skew import hot_keys, join_hot, parts
from airloom.session import cut
from airloom.tables import small_side

EARTH_KM = 6371.0088
#: Points of one block from which its sweep is shared by several tasks, one for each so many points.
BLOCK_ROWS = 50_000
#: Pairs verified at once in a sweep, for memory.
CHUNK = 1_000_000


def usable(lat: Column, lon: Column) -> Column:
    """Coordinates that are there, within bounds and not both zero."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def _blocks(points: DataFrame, km: float) -> DataFrame:
    step = math.degrees(km / EARTH_KM) * 1.0001
    half = math.sin(km / EARTH_KM / 2) * 1.0001
    strip = F.floor((F.col("lat") + 90) / step).cast("long")
    rows = points.withColumn("__t", F.explode(F.array(F.struct(strip.alias("s"), F.lit(True).alias("native")), F.struct((strip - 1).alias("s"), F.lit(False).alias("native")))))
    rows = rows.select("id", "moves", "lat", "lon", F.col("__t.s").alias("strip"), F.col("__t.native").alias("native"))
    top = F.least(F.lit(90.0), F.greatest(F.abs(F.col("strip") * step - 90), F.abs((F.col("strip") + 2) * step - 90)))
    ratio = F.lit(half) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
    reach = F.when(ratio < math.sin(math.radians(2.5)), F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 2 + 1e-6).otherwise(F.lit(360.0))
    rows = rows.withColumn("reach", reach)
    width = F.when(F.col("reach") >= 360, 360.0).otherwise(F.least(F.lit(360.0), F.col("reach") * 64))
    # equal blocks, none narrower than reach: over the antimeridian too the partner is in the next one
    rows = rows.withColumn("last", F.floor(F.lit(360.0) / width).cast("long") - 1).withColumn("width", F.lit(360.0) / (F.col("last") + 1))
    block = F.least(F.floor((F.col("lon") + 180) / F.col("width")).cast("long"), F.col("last"))
    into = F.col("lon") + 180 - F.col("block") * F.col("width")
    rows = rows.withColumn("block", block).withColumn("__near", (into < F.col("reach")) & (F.col("reach") < 360))
    copy = lambda b, x, own: F.struct(b.alias("block"), x.alias("x"), own.alias("own"))
    copies = F.array(
        copy(F.col("block"), F.col("lon"), F.lit(True)),
        F.when(F.col("__near") & (F.col("block") > 0), copy(F.col("block") - 1, F.col("lon"), F.lit(False))),
        F.when(F.col("__near") & (F.col("block") == 0), copy(F.col("last"), F.col("lon") + 360, F.lit(False))),
    )
    return rows.select("id", "moves", "lat", "strip", "native", "reach", F.explode(F.array_compact(copies)).alias("c")).select(
        "id", "moves", "lat", "strip", "native", "reach", F.col("c.block").alias("block"), F.col("c.x").alias("x"), F.col("c.own").alias("own")
    )


def _sweep(km: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            if not len(cols["id"]):
                continue
            old = 0
            if kept is not None:
                old = len(kept["id"])
                cols = {n: np.concatenate([kept[n], cols[n]]) for n in cols}
            strip, block, share, x = cols["strip"], cols["block"], cols["share"], cols["x"]
            change = np.empty(len(x), dtype=bool)
            change[0] = True
            change[1:] = (strip[1:] != strip[:-1]) | (block[1:] != block[:-1]) | (share[1:] != share[:-1])
            line = np.cumsum(change) * 2000.0  # blocks one after another on a single axis
            pos = line + x
            own = np.nonzero(cols["own"])[0]
            # for each point the owned ones before it and within reach; the kept ones have met each other already
            first = np.searchsorted(pos[own], line + np.maximum(x - cols["reach"], -500.0), side="left")
            count = np.maximum(np.searchsorted(own, np.arange(len(x)), side="left") - first, 0)
            count[:old] = 0
            ends = np.cumsum(count)
            at = old
            while at < len(x):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
                n = count[at:stop]
                right = np.repeat(np.arange(at, stop), n)
                left = own[np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n)]
                yield from _verified(cols, left, right, km)
                at = stop
            tail = cols["own"] & (pos >= line[-1] + x[-1] - cols["reach"][-1] - 1e-3)
            tail[-1] = True  # so that the next batch knows the block it goes on in
            kept = {n: c[tail] for n, c in cols.items()}

    return run


def _verified(c: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, km: float) -> Iterator[pa.RecordBatch]:
    ids = c["id"]
    take = (c["native"][left] | c["native"][right]) & (ids[left] != ids[right])
    left, right = left[take], right[take]
    la, lb = np.radians(c["lat"][left]), np.radians(c["lat"][right])
    dx = np.radians(c["x"][left] - c["x"][right])
    h = np.sin((la - lb) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(dx / 2) ** 2
    d = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    near = d <= km
    if near.any():
        a, b = ids[left[near]], ids[right[near]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d[near]), pa.array(c["moves"][left[near]] | c["moves"][right[near]])], names=["id_a", "id_b", "km", "moves"]
        )


def near_pairs(points: DataFrame, km: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (id_a < id_b, km) of different ids at most ``km`` apart on the sphere, once each, at their least distance.

    ``points`` has id (long), lat, lon; unusable coordinates and null ids take no part, repeated rows count once, an id
    with several positions is near wherever one of them is. Nothing is capped: a block of n points is swept in
    n / block_rows shares, each with all its points and 1 / shares of its candidates. Only pairs of ids that have several
    positions are grouped; all others come out once by their owner.
    """
    clean = points.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    clean = cut(clean.filter(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon"))).distinct())
    moving = hot_keys(clean, ["id"], 2)
    clean = clean.withColumn("moves", F.lit(False)) if moving is None else join_hot(clean, ["id"], moving).withColumn("moves", F.col("__n").isNotNull()).drop("__n")
    rows = _blocks(clean, km)
    marked, shares = parts(rows, ["strip", "block"], hot_keys(rows, ["strip", "block"], block_rows), block_rows)
    mine = F.pmod(F.xxhash64("id", "x"), F.col("__shares")) == F.col("share")
    rows = marked.withColumn("__shares", shares).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)))
    rows = rows.select("strip", "block", "share", "x", (F.col("own") & mine).alias("own"), (~F.col("own")).alias("guest"), "native", "moves", "reach", "lat", "id")
    # guests of a block lie east of its own points, also where both stand on the antimeridian
    swept = rows.repartitionByRange("strip", "block", "share").sortWithinPartitions("strip", "block", "share", "x", "guest", "id")
    pairs = swept.mapInArrow(_sweep(km), "id_a long, id_b long, km double, moves boolean")
    if moving is None:
        return pairs.select("id_a", "id_b", "km")
    pairs = cut(pairs)
    several = pairs.filter("moves").groupBy("id_a", "id_b").agg(F.min("km").alias("km"))
    return pairs.filter("not moves").select("id_a", "id_b", "km").unionByName(several)


def containing(points: DataFrame, regions: DataFrame, step: float = 0.5) -> DataFrame:
    """(id, region_id) of every region that holds a point, its border included on its southern and western side.

    ``points`` has id, lat, lon, ``regions`` region_id and ring, an array of (lat, lon) corners in order; a ring is closed
    by itself and may not cross the antimeridian (a region that does is given as two rings). Unusable coordinates and
    rings of fewer than three corners take no part; repeated rows count once. Latitude is cut into strips of ``step``
    degrees. A ring goes to each strip it touches with only the edges that lie there, so a strip's rows are bounded by the
    edges in it; a point belongs to one strip, which owns its answer: an odd number of edges to its west.
    """
    clean = points.select(F.col("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).filter(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon"))).distinct()
    clean = clean.withColumn("strip", F.floor(F.col("lat") / step).cast("int"))
    rings = regions.select("region_id", "ring").filter("region_id is not null and size(ring) >= 3")
    corner = F.transform("ring", lambda c, i: F.struct(
        c["lat"].alias("a"), c["lon"].alias("x"), F.get("ring", F.pmod(i + 1, F.size("ring")))["lat"].alias("b"), F.get("ring", F.pmod(i + 1, F.size("ring")))["lon"].alias("y"),
    ))
    edges = rings.select("region_id", F.xxhash64("ring").alias("part"), F.explode(corner).alias("e")).filter("e.a <> e.b").distinct()
    low, high = F.least("e.a", "e.b"), F.greatest("e.a", "e.b")
    edges = edges.withColumn("strip", F.explode(F.sequence(F.floor(low / step).cast("int"), F.floor(high / step).cast("int"))))
    edges = edges.groupBy("strip", "region_id", "part").agg(F.collect_set("e").alias("edges"), F.min(F.least("e.x", "e.y")).alias("west"))
    met = clean.join(small_side(edges), "strip").filter(F.col("west") <= F.col("lon"))

    def crosses(e: Column) -> Column:
        over = (e["a"] <= F.col("lat")) != (e["b"] <= F.col("lat"))
        return over & (e["x"] + (F.col("lat") - e["a"]) / (e["b"] - e["a"]) * (e["y"] - e["x"]) <= F.col("lon"))

    inside = met.filter(F.size(F.filter("edges", crosses)) % 2 == 1)
    return inside.select("id", "region_id").distinct()
