"""The query surface: one object over a folder of tables, every verb a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions.geo import haversine_nm
from airloom.operators import graph, quality, temporal
from airloom.tables import read


class World:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _at(self, table: str, at: str | None) -> DataFrame:
        t = read(self.spark, self.root, table)
        return temporal.as_of(t, at) if at and "valid_until" in t.columns else t

    def airports(self, at: str | None = None) -> DataFrame:
        return self._at("ourairports_airports", at)

    def navaids(self, at: str | None = None) -> DataFrame:
        return self._at("ourairports_navaids", at)

    def runways(self, airport_id: int | None = None) -> DataFrame:
        r = self._at("ourairports_runways", None)
        return r if airport_id is None else r.filter(F.col("airport_ref") == airport_id)

    def airport(self, ident: str, at: str) -> DataFrame:
        return temporal.lookup(read(self.spark, self.root, "ourairports_airports"), ident, at)

    def navaid(self, ident: str, at: str) -> DataFrame:
        return temporal.lookup(read(self.spark, self.root, "ourairports_navaids"), ident, at)

    def search(self, text: str, at: str, limit: int = 25) -> DataFrame:
        q = text.upper()
        return self.airports(at).filter(F.upper("ident").startswith(q) | F.upper("name").contains(q)).orderBy("ident", "id").limit(limit)

    def nearby(self, lat: float, lon: float, radius_nm: float, at: str, limit: int = 50) -> DataFrame:
        def part(df: DataFrame, kind: str) -> DataFrame:
            near = df.filter(F.col("latitude_deg").between(lat - radius_nm / 60 - 1, lat + radius_nm / 60 + 1))
            return near.select(F.lit(kind).alias("kind"), "id", "ident", haversine_nm(F.lit(lat), F.lit(lon), F.col("latitude_deg"), F.col("longitude_deg")).alias("distance_nm"))

        both = part(self.airports(at), "airport").unionByName(part(self.navaids(at), "navaid")).distinct()
        return both.filter(F.col("distance_nm") <= radius_nm).orderBy("distance_nm", "kind", "id").limit(limit)

    def airway(self, ident: str) -> DataFrame:
        return read(self.spark, self.root, "airway_segments").filter(F.col("route_ident") == ident).orderBy("sequence_number", "segment_id")

    def airway_graph(self) -> DataFrame:
        node = lambda i, r: F.concat_ws("/", F.upper(F.trim(i)), r)
        s = read(self.spark, self.root, "airway_segments").filter("trim(start_ident) <> '' and trim(end_ident) <> ''")
        return graph.edges(s.select(node("start_ident", "start_region").alias("start"), node("end_ident", "end_region").alias("end"), "direction", "route_ident").distinct())

    def charts(self, airport: str) -> DataFrame:
        return read(self.spark, self.root, "chart_documents").filter(F.col("airport_icao") == airport).orderBy("chart_type", "title", "id")

    def snapshots(self) -> DataFrame:
        return read(self.spark, self.root, "raw_source_snapshots").orderBy(F.desc("retrieved_at"), "snapshot_id")

    def summary(self, at: str) -> DataFrame:
        return temporal.summary({n: read(self.spark, self.root, t) for n, t in (("airports", "ourairports_airports"), ("runways", "ourairports_runways"), ("navaids", "ourairports_navaids"))}, at)

    def issues(self) -> DataFrame:
        a = self.airports()
        return quality.report([quality.inverted(a, "airports"), quality.several_open(a, "airports"), quality.navaid_bands(self.navaids()), quality.bad_coordinates(self.navaids(), "navaids"), quality.missing_parent(self.runways(), a, "airport_ref", "runways")])
