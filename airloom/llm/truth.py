"""Best representative of each duplicate group by iterative truth discovery.

Sources (providers) and values judge each other: a claim weighs as much as its source is reliable, a value is supported
by the weights of its claims, a source is as reliable as its claims have a share in the support of their field, until
nothing moves. The value with the highest support survives.

Voting by reliability alone cannot express a strict order of trust: three poor sources that agree outvote the best one.
Trust rank and retrieval time are therefore part of the weights: a claim that stands one level lower in its group's order
of (rank, time) weighs less by a base that exceeds all claims of the group together. The same iteration then runs on
these weights, so that reliability decides within a level and never against it.

Groups only matter for the iteration through the sets of (source, level) behind their values, so they are folded into
patterns first; the iteration runs over the pattern table and the records are read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.session import cut
from airloom.tables import number, plain, small_side

#: What stands in a text field for a missing name.
FILLERS = ["unknown", "unk", "none", "null", "nan", "n/a", "na", "n.a.", "nil", "tbd", "tba", "xxx", "not available", "not known", "no data"]
ELEVATION_FT = (-2_000.0, 30_000.0)
ROUNDS = 20
EPSILON = 1e-4
#: Sources up to which their reliabilities travel as one array; more of them are joined as a table in every round.
ARRAY_SOURCES = 1_000
#: Reliability keeps within these bounds, so that no level can be outweighed by lower ones.
LEAST, MOST = 0.01, 1.0
#: Levels that are told apart; the weight of a lower one is under 1e-40 of the best claim's and changes no double.
LEVELS = 20
UNKNOWN_RANK = 2**31 - 1


def group_ident(col: str) -> Column:
    """The letters and digits of an ident in upper case; null where there are none."""
    return F.nullif(F.upper(F.regexp_replace(col, r"[^\p{L}\p{N}]", "")), F.lit(""))


def place_name(col: str) -> Column:
    p = plain(col)
    return F.when(p.rlike(r"\p{L}") & ~p.isin(FILLERS), p)


def real_elevation(col: str) -> Column:
    n = number(F.col(col))
    return F.when(n.between(*ELEVATION_FT), n)


def airport_claims(records: DataFrame, snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    """(group_ident, field_name, value, source, rank, at, record_id); value is null where the record has no real one."""
    ranks = registry.select(plain("provider_id").alias("source"), F.col("trust_rank").alias("rank")).groupBy("source").agg(F.min("rank").alias("rank"))
    snaps = snapshots.select(F.trim("snapshot_id").alias("__s"), plain("provider_id").alias("source"), F.col("retrieved_at").alias("at"))
    snaps = snaps.groupBy("__s").agg(F.max_by("source", "at").alias("source"), F.max("at").alias("at"))
    origin = snaps.join(small_side(ranks), "source", "left")
    rows = records.withColumn("__s", F.trim("source_snapshot_id")).select(
        "__s", group_ident("ident").alias("group_ident"), "record_id", real_elevation("elevation_ft").cast("string").alias("elevation_ft"), place_name("municipality").alias("municipality")
    ).filter("group_ident is not null and record_id is not null")
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("elevation_ft", "municipality")])
    rows = rows.join(small_side(origin), "__s", "left").withColumn("__f", F.explode(fields))
    return rows.select(
        "group_ident", "__f.field_name", "__f.value", F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("rank", F.lit(UNKNOWN_RANK)).alias("rank"), "at", "record_id",
    )


@dataclass
class Truth:
    """values: one row per group, field and value with its support; reliability: (source, reliability) after ``rounds``."""

    values: DataFrame
    reliability: DataFrame
    rounds: int


def discover(claims: DataFrame, precedence: bool, rounds: int = ROUNDS, array_sources: int = ARRAY_SOURCES) -> Truth:
    """Alternate source reliability and value support until the largest change is under EPSILON.

    With ``precedence`` claims weigh by their level of (trust rank, retrieval time) in their group and field, without it
    all alike. Only groups of two or more record_id take part; null values and fields without any real value have no row.
    A source counts once for a value, at its best level, however many records it repeats it in. Empty claims give empty
    values. Null sources and unknown snapshots are one nameless source of the lowest rank; a missing time is the earliest.
    """
    # combined on the map side: a hot group shrinks to its distinct (value, source, rank, time) before it is shuffled
    named = claims.withColumn("source", F.coalesce("source", F.lit("")))
    slim = cut(named.groupBy("group_ident", "field_name", "value", "source", "rank", "at").agg(
        F.min("record_id").alias("lo"), F.max("record_id").alias("hi")
    ))
    several = slim.groupBy("group_ident").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("group_ident")
    real = slim.filter("value is not null").join(several, "group_ident", "left_semi")
    group = ["group_ident", "field_name"]
    if precedence:
        # one row per group and distinct (rank, time), of which there are no more than snapshots
        order = Window.partitionBy(*group).orderBy("rank", F.col("at").desc_nulls_last())
        levels = real.select(*group, "rank", "at").distinct().withColumn("level", F.least(F.row_number().over(order) - 1, F.lit(LEVELS)))
        on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*group, "rank")] + [F.col("l.at").eqNullSafe(F.col("r.at"))]
        real = real.alias("l").join(levels.alias("r"), on).select("l.*", "r.level")
    else:
        real = real.withColumn("level", F.lit(0))
    # (rank, time, id) of the best claim, in an order where the least is the best
    best = F.min(F.struct("rank", F.coalesce(-F.unix_micros(F.col("at").cast("timestamp")), F.lit(2**62)).alias("before"), F.col("lo").alias("record_id")))
    by_source = real.groupBy(*group, "value", "source").agg(F.min("level").alias("level"), best.alias("best"))
    sources = cut(by_source.groupBy("source").agg(F.count("*").alias("n")))
    by_array = sources.limit(array_sources + 1).count() <= array_sources
    names = [r[0] for r in sources.select("source").orderBy("source").collect()] if by_array else []
    claim = F.struct("source", "level")
    values = cut(by_source.groupBy(*group, "value").agg(
        F.array_sort(F.collect_set(claim)).alias("claims"),
        F.min("best").alias("best"),
    ))
    kinds = values.groupBy(*group, "claims").agg(F.count("*").alias("n"))
    shapes = kinds.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("claims", "n"))).alias("shape"))
    shapes = shapes.groupBy("shape").agg(F.count("*").alias("times"))
    shapes = cut(shapes.withColumn("base", _base(F.aggregate("shape", F.lit(0).cast("long"), lambda a, v: a + v["n"] * F.size(v["claims"])))))
    judge = _ByArray(shapes, names) if by_array else _ByJoin(shapes, sources)
    done = 0
    for done in range(1, rounds + 1):
        if judge.step() < EPSILON:
            break
    size = values.groupBy(*group).agg(F.sum(F.size("claims")).cast("long").alias("__claims"))
    based = values.join(size, group).withColumn("base", _base(F.col("__claims"))).drop("__claims")
    return Truth(judge.supported(based), judge.table(claims.sparkSession), done)


def _base(claims: Column) -> Column:
    """More than all claims of a group and field together can weigh one level lower."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(claims * (MOST / LEAST) * 2)))


def _renewed(share: float | None, weight: int | None) -> float:
    # one imagined claim of even odds keeps a source with few claims near the middle
    return round(min(MOST, max(LEAST, ((share or 0.0) + 0.5) / ((weight or 0) + 1))), 9)


class _ByArray:
    """Reliabilities of few sources as an array literal: one aggregate over the patterns in a round, no join."""

    def __init__(self, shapes: DataFrame, names: list[str]):
        self.shapes, self.names, self.trust = shapes, names, [0.8] * len(names)
        index = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))]) if names else None
        self.place = (lambda s: F.element_at(index, s)) if names else (lambda s: F.lit(None).cast("int"))

    def support(self, claims: Column, base: Column) -> Column:
        t = F.lit([float(x) for x in self.trust]) if self.trust else F.array().cast("array<double>")
        return F.aggregate(claims, F.lit(0.0), lambda a, c: a + F.get(t, self.place(c["source"])) * F.pow(base, -c["level"]))

    def step(self) -> float:
        total = F.aggregate("shape", F.lit(0.0), lambda a, v: a + self.support(v["claims"], F.col("base")) * v["n"])
        weighed = self.shapes.select("times", "base", total.alias("total"), F.explode("shape").alias("v"))
        each = weighed.select(
            F.explode("v.claims.source").alias("source"), (F.col("times") * F.col("v.n")).alias("w"), (self.support(F.col("v.claims"), F.col("base")) / F.col("total")).alias("p")
        )
        rows = each.groupBy("source").agg(F.sum(F.col("p") * F.col("w")).alias("a"), F.sum("w").alias("w")).collect()
        got = {r["source"]: _renewed(r["a"], r["w"]) for r in rows}
        new = [got[s] for s in self.names]
        moved = max((abs(a - b) for a, b in zip(new, self.trust)), default=0.0)
        self.trust = new
        return moved

    def supported(self, values: DataFrame) -> DataFrame:
        return values.withColumn("support", self.support(F.col("claims"), F.col("base")))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.names, self.trust)), "source string, reliability double")


class _ByJoin:
    """Reliabilities of any number of sources as a table, joined to the claims of the patterns."""

    def __init__(self, shapes: DataFrame, sources: DataFrame):
        flat = shapes.withColumn("i", F.monotonically_increasing_id()).select("i", "times", "base", F.posexplode("shape").alias("k", "v"))
        self.flat = cut(flat.select("i", "k", "times", "base", F.col("v.n").alias("n"), F.explode("v.claims").alias("c")).select("i", "k", "times", "base", "n", "c.*"))
        self.trust = cut(sources.select("source", F.lit(0.8).alias("reliability")))

    def step(self) -> float:
        joined = self.flat.join(self.trust, "source")
        v = joined.groupBy("i", "k", "times", "n").agg(F.sum(F.col("reliability") * F.pow("base", -F.col("level"))).alias("s"))
        total = v.groupBy("i").agg(F.sum(F.col("s") * F.col("n")).alias("total"))
        p = v.join(total, "i").select("i", "k", (F.col("s") / F.col("total")).alias("p"), (F.col("times") * F.col("n")).alias("w"))
        sums = self.flat.select("i", "k", "source").join(p, ["i", "k"]).groupBy("source").agg(F.sum(F.col("p") * F.col("w")).alias("a"), F.sum("w").alias("w"))
        fresh = F.round(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), (F.col("a") + 0.5) / (F.col("w") + 1))), 9)
        new = cut(self.trust.withColumnRenamed("reliability", "old").join(sums, "source").select("source", fresh.alias("reliability"), F.abs(fresh - F.col("old")).alias("moved")))
        moved = new.agg(F.max("moved")).first()[0]
        self.trust = new.drop("moved")
        return moved or 0.0

    def supported(self, values: DataFrame) -> DataFrame:
        keys = ["group_ident", "field_name", "value"]
        flat = values.select(*keys, "base", F.explode("claims").alias("c")).select(*keys, "base", "c.*").join(self.trust, "source")
        s = flat.groupBy(*keys).agg(F.sum(F.col("reliability") * F.pow("base", -F.col("level"))).alias("support"))
        return values.join(s, keys)

    def table(self, spark: SparkSession) -> DataFrame:
        return self.trust


def survivors(truth: Truth) -> DataFrame:
    """One row per group and field: the value of the highest support, its record_id and support.

    The record is the value's best by rank, then time, then the lowest id. Values of equal support: the later
    time, the lower rank, the lower record_id.
    """
    b, s = F.col("best"), F.round("support", 12)
    order = F.struct(s, (-b["before"]).alias("at"), (-b["rank"]).alias("r"), (-b["record_id"]).alias("i"))
    return (
        truth.values.groupBy("group_ident", "field_name")
        .agg(F.max_by(F.struct("value", b["record_id"].alias("record_id"), F.round("support", 9).alias("support")), order).alias("v"))
        .select("group_ident", "field_name", "v.*")
    )
