"""The airway graph: nodes, directed edges, reachability and shortest paths."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.session import cut

def edges(legs: DataFrame) -> DataFrame:
    """Directed edges of legs (start, end, direction): F forward only, B backward only, anything else both ways."""
    fwd = F.struct(F.col("start").alias("src"), F.col("end").alias("dst"))
    back = F.struct(F.col("end").alias("src"), F.col("start").alias("dst"))
    ways = F.when(F.col("direction") == "F", F.array(fwd)).when(F.col("direction") == "B", F.array(back)).otherwise(F.array(fwd, back))
    return legs.filter("start is not null and end is not null").withColumn("__w", F.explode(ways)).select("__w.src", "__w.dst", *[c for c in legs.columns if c not in ("start", "end", "direction")])


def unresolved(legs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of legs without a node, with how many legs ask for them."""
    ends = legs.select(F.explode(F.array("start", "end")).alias("node")).filter("node is not null")
    return ends.join(nodes.select("node").distinct(), "node", "left_anti").groupBy("node").agg(F.count("*").alias("legs"))


def nodes_by_precedence(waypoints: DataFrame, navaids: DataFrame) -> DataFrame:
    """(node, lat, lon, kind): of fixes with one key the last holds, of navaids the first; fixes and navaids have keys of their own."""
    fix = waypoints.groupBy("node").agg(F.max_by(F.struct("lat", "lon"), "ord").alias("p")).select("node", "p.lat", "p.lon", F.lit("fix").alias("kind"))
    aid = navaids.groupBy("node").agg(F.min_by(F.struct("lat", "lon", "kind"), "ord").alias("p")).select("node", "p.lat", "p.lon", "p.kind")
    return fix.unionByName(aid)


def eligible(need_rnav: bool = True, altitude: int | None = None, exclude_routes: list[str] | None = None) -> Column:
    """Whether an edge may be flown: RNAV only where equipped, altitude within the band, route not excluded."""
    ok = F.lit(True)
    if not need_rnav:
        ok = ok & (F.coalesce(F.col("route_type"), F.lit("O")) != "R")
    if altitude is not None:
        ok = ok & (F.coalesce(F.col("minimum_altitude_ft"), F.lit(0)) <= altitude) & (F.coalesce(F.col("maximum_altitude_ft"), F.lit(99_999)) >= altitude)
    if exclude_routes:
        ok = ok & ~F.col("route_ident").isin(exclude_routes)
    return ok


def components(e: DataFrame) -> DataFrame:
    """(node, component): weakly connected, named by the least node. Least labels spread with pointer jumping, so the
    rounds grow with the logarithm of the longest chain; each round is cut into the shared checkpoint folder."""
    links = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    links = cut(links)
    labels = cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")))
    moved = 1
    while moved:  # labels only fall, so this ends
        seen = links.join(labels, links.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(seen, labels.node == seen.src, "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        up = step.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        step = cut(step.join(up, step.label == up["__n"], "left").select("node", F.least("label", F.coalesce("__l", "label")).alias("label"), "was"))
        moved = step.filter("label <> was").limit(1).count()
        labels = step.select("node", "label")
    return labels.withColumnRenamed("label", "component")


def bfs(e: DataFrame, origins: list, hops: int) -> DataFrame:
    """(node, hops): what can be reached from the origins along directed edges in at most ``hops``."""
    spark = e.sparkSession
    kind = e.schema["src"].dataType.simpleString()
    seen = cut(spark.createDataFrame([(o, 0) for o in origins], f"node {kind}, hops int"))
    front = seen
    links = e.select("src", "dst").distinct()
    for h in range(1, hops + 1):
        nxt = front.join(links, front.node == links.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = cut(nxt.withColumn("hops", F.lit(h)))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    return seen


def relaxed(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """``shortest`` without a limit on the graph: labels (origin, node) spread along the edges until none improves.

    A round joins only the labels that the round before improved; each is cut into the shared checkpoint folder. Of equal
    costs the path that comes first in order of its nodes holds.
    """
    links = cut(e.filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    start = pairs.select("origin").distinct()
    labels = front = cut(start.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.array(F.col("origin").cast("string")).alias("path")))
    while not front.isEmpty():
        step = front.alias("f").join(links.alias("l"), F.col("f.node") == F.col("l.src")).select(
            "f.origin", F.col("l.dst").alias("node"), (F.col("f.cost") + F.col("l.cost")).alias("cost"), F.concat("f.path", F.array(F.col("l.dst").cast("string"))).alias("path")
        )
        best = step.groupBy("origin", "node").agg(F.min(F.struct("cost", "path")).alias("n"))
        met = labels.groupBy("origin", "node").agg(F.min(F.struct("cost", "path")).alias("o"))
        both = cut(met.join(best, ["origin", "node"], "full_outer").select("origin", "node", F.least("o", "n").alias("v"), F.coalesce(F.col("o").isNull() | (F.col("n") < F.col("o")), F.lit(False)).alias("better")))
        labels = both.select("origin", "node", "v.cost", "v.path")
        front = both.filter("better").select("origin", "node", "v.cost", "v.path")
    return labels.join(pairs.select("origin", F.col("destination").alias("node")).distinct(), ["origin", "node"]).select("origin", F.col("node").alias("destination"), "cost", "path")


def shortest(e: DataFrame, pairs: DataFrame, max_edges: int = 2_000_000) -> DataFrame:
    """(origin, destination, cost, path) for origin-destination pairs over edges (src, dst, cost >= 0).

    A graph of up to ``max_edges`` edges (counted; a world's airways are far fewer) goes to every worker, the pairs are
    spread by origin and one search from an origin serves all its destinations. A larger one stays where it is and is
    searched from all origins at once, see ``relaxed``. No route: no row.
    """
    if e.limit(max_edges + 1).count() > max_edges:
        return relaxed(e, pairs)
    graph = e.groupBy("src", "dst").agg(F.min("cost").alias("cost")).toPandas()
    out: dict = {}
    for s, d, c in graph.itertuples(index=False):
        out.setdefault(s, []).append((float(c), d))
    for v in out.values():
        v.sort()
    kind = e.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        rows, found = pd.concat(got, ignore_index=True), []
        for o, part in rows.groupby("origin"):
            want, best, prev, done = set(part["destination"]), {o: 0.0}, {}, set()
            heap = [(0.0, o)]
            while heap and want:
                c, n = heapq.heappop(heap)
                if n in done:
                    continue
                done.add(n)
                want.discard(n)
                for w, m in out.get(n, ()):
                    if c + w < best.get(m, float("inf")):
                        best[m], prev[m] = c + w, n
                        heapq.heappush(heap, (c + w, m))
            for d in sorted(set(part["destination"]) & done):
                path = [d]
                while path[-1] != o:
                    path.append(prev[path[-1]])
                found.append((o, d, best[d], [str(x) for x in path[::-1]]))
        if found:  # an empty column of lists has no Arrow form
            yield pd.DataFrame(found, columns=["origin", "destination", "cost", "path"])

    spread = pairs.select("origin", "destination").distinct().repartition(e.sparkSession.sparkContext.defaultParallelism, "origin")
    return spread.mapInPandas(run, f"origin {kind}, destination {kind}, cost double, path array<string>")


