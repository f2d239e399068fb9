"""Versioned tables: as-of reads, revision upserts, closing, tombstones, corrections, cycles and rollback.

All verbs take and return DataFrames. A revision is valid from valid_from (included) to valid_until (excluded, null is
open). History that has taken effect is never rewritten; only its end can be set.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instant(df: DataFrame, at: str, column: str = "valid_from") -> Column:
    """``at`` in the time type of ``column``; microseconds are the finest step, finer text is refused."""
    if "." in at and len(at.split(".")[1].rstrip("Z")) > 6:
        raise ValueError("times are in microseconds")
    return F.lit(at).cast(df.schema[column].dataType)


def just_before(col: Column) -> Column:
    return col - F.expr("interval 1 microsecond")


def as_of(df: DataFrame, at: str, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    t = instant(df, at, start)
    return df.filter((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


def lookup(df: DataFrame, ident: str, at: str, column: str = "ident") -> DataFrame:
    """The revision of one ident at an instant; of several the latest."""
    return as_of(df.filter(F.col(column) == ident), at).orderBy(F.desc("valid_from")).limit(1)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def compact(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Revisions without those whose payload equals that of the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__p", F.lag(F.struct(*payload)).over(w))
    return marked.filter(F.col("__p").isNull() | ~F.col("__p").eqNullSafe(F.struct(*payload))).drop("__p")


def classify(current: DataFrame, incoming: DataFrame, payload: list[str], key: str = "id") -> DataFrame:
    """Incoming rows with their latest revision and the outcome created, updated, unchanged or stale.

    stale: another payload that does not start after the latest revision; it is refused by upsert.
    """
    last = current.groupBy(key).agg(F.max_by(F.struct("valid_from", *payload), "valid_from").alias("__last"))
    j = incoming.join(last, key, "left")
    same = F.struct(*[F.col(c).alias(c) for c in payload]).eqNullSafe(F.struct(*[F.col(f"__last.{c}").alias(c) for c in payload]))
    outcome = (
        F.when(F.col("__last").isNull(), "created").when(same, "unchanged")
        .when(F.col("valid_from") <= F.col("__last.valid_from"), "stale").otherwise("updated")
    )
    return j.withColumn("outcome", outcome)


def upsert(current: DataFrame, incoming: DataFrame, payload: list[str], key: str = "id") -> DataFrame:
    """The table after an upsert: untouched, closed and new revisions. An unchanged payload makes no revision."""
    c = classify(current, incoming, payload, key)
    if c.filter("outcome = 'stale'").limit(1).count():
        raise ValueError("a changed payload must start after the latest revision")
    changed = c.filter("outcome = 'updated'").select(key, F.col("valid_from").alias("__end"))
    w = Window.partitionBy(key)
    newest = F.col("valid_from") == F.max("valid_from").over(w)
    kept = current.join(changed, key, "left").withColumn("__newest", newest)
    end = F.when(F.col("__newest") & F.col("__end").isNotNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("__end"))), F.col("__end")).otherwise(F.col("valid_until"))
    kept = kept.withColumn("valid_until", end).select(*current.columns)
    fresh = c.filter("outcome in ('created', 'updated')").select(*[F.col(x) if x in incoming.columns else F.lit(None).cast(current.schema[x].dataType).alias(x) for x in current.columns])
    return kept.unionByName(fresh)


def observe(log: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """The observation log with one line per entity, revision and snapshot, however often it is seen."""
    new = rows.select(F.lit(table).alias("entity_table"), F.col("id").alias("entity_id"), "valid_from", "source_snapshot_id")
    return log.unionByName(new).dropDuplicates(["entity_table", "entity_id", "valid_from", "source_snapshot_id"])


def replace_future(current: DataFrame, corrections: DataFrame, now: str, key: str = "id") -> DataFrame:
    """Without the revisions that a correction of the same key and start replaces, which must lie after ``now``."""
    hit = corrections.filter(F.col("valid_from") > instant(corrections, now)).select(key, "valid_from").distinct()
    return current.join(hit, [key, "valid_from"], "left_anti")


def close_absent(current: DataFrame, seen: DataFrame, namespace: str, at: str, key: str = "id") -> DataFrame:
    """Open rows of the namespace that started before ``at`` and are not in ``seen`` end at ``at``. Doing it twice changes nothing."""
    t = instant(current, at)
    mine = F.col("valid_until").isNull() & F.col(key).startswith(namespace + ":") & (F.col("valid_from") < t)
    there = seen.select(F.col(key).alias("__seen")).distinct()
    j = current.join(there, F.col(key) == F.col("__seen"), "left")
    return j.withColumn("valid_until", F.when(mine & F.col("__seen").isNull(), t).otherwise(F.col("valid_until"))).drop("__seen")


def may_close(report: DataFrame) -> bool:
    """Whether a scan report (errors, unsupported) lets absence count as removal: nothing may have hidden a row."""
    r = report.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("e"), F.coalesce(F.sum("unsupported"), F.lit(0)).alias("u")).first()
    return r["e"] == 0 and r["u"] == 0


def apply_tombstones(current: DataFrame, tombstones: DataFrame, namespace: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(table, outcomes): each tombstone (id, effective_from) is closed, already_closed, unknown or foreign."""
    state = current.groupBy(key).agg(F.max_by(F.struct("valid_from", "valid_until"), "valid_from").alias("__last"))
    j = tombstones.join(state, key, "left")
    outcome = (
        F.when(~F.col(key).startswith(namespace + ":"), "foreign").when(F.col("__last").isNull(), "unknown")
        .when(F.col("__last.valid_until").isNotNull(), "already_closed").otherwise("closed")
    )
    outcomes = j.withColumn("outcome", outcome).drop("__last")
    ends = outcomes.filter("outcome = 'closed'").groupBy(key).agg(F.min("effective_from").alias("__end"))
    table = current.join(ends, key, "left").withColumn("valid_until", F.coalesce("valid_until", "__end")).drop("__end")
    return table, outcomes


def withdraw_future(current: DataFrame, withdrawn: DataFrame, now: str, key: str = "id") -> DataFrame:
    """Without withdrawn future revisions (id, valid_from); the revision they closed is open again."""
    if withdrawn.filter(F.col("valid_from") <= instant(withdrawn, now)).limit(1).count():
        raise ValueError("history that has taken effect is not withdrawn")
    gone = withdrawn.select(key, "valid_from").distinct()
    left = current.join(gone, [key, "valid_from"], "left_anti")
    reopened = gone.select(F.col(key).alias("__k"), F.col("valid_from").alias("__from"))
    j = left.join(reopened, (F.col(key) == F.col("__k")) & (F.col("valid_until") == F.col("__from")), "left")
    return j.withColumn("valid_until", F.when(F.col("__k").isNull(), F.col("valid_until"))).drop("__k", "__from")


def publication_guard(publications: DataFrame) -> DataFrame:
    """For each publication_id in order of arrival: recorded, duplicate, correction, owner_conflict or content_conflict."""
    w = Window.partitionBy("publication_id").orderBy("retrieved_at", "source_snapshot_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    owner = F.first("owner").over(w)
    seen = F.coalesce(F.array_contains(F.collect_set("content").over(before), F.col("content")), F.lit(False))
    first = F.row_number().over(w) == 1
    return publications.withColumn(
        "decision",
        F.when(first, "recorded").when(F.col("owner") != owner, "owner_conflict").when(seen, "duplicate")
        .when(F.lower("kind") == "correction", "correction").otherwise("content_conflict"),
    )


@dataclass
class Publication:
    """What one publication brings for a table."""

    upserts: DataFrame
    tombstones: DataFrame | None
    namespace: str
    full: bool
    effective_from: str
    masked: bool = False


def apply_publication(current: DataFrame, pub: Publication, payload: list[str], now: str) -> tuple[DataFrame, dict[str, int]]:
    """Corrections, upserts, tombstones and, for a full snapshot of an unmasked table, closing of what is absent."""
    table = replace_future(current, pub.upserts, now)
    counts = {r["outcome"]: r["count"] for r in classify(table, pub.upserts, payload).groupBy("outcome").count().collect()}
    table = upsert(table, pub.upserts, payload)
    if pub.tombstones is not None:
        table, outcomes = apply_tombstones(table, pub.tombstones, pub.namespace)
        counts |= {f"tombstone_{r['outcome']}": r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    if pub.full and not pub.masked:
        table = close_absent(table, pub.upserts, pub.namespace, pub.effective_from)
    return table, counts


#: From which status a cycle may go to which.
TRANSITIONS = [
    ("Discovered", "Downloaded"), ("Downloaded", "Preloaded"), ("Preloaded", "Active"), ("Active", "Superseded"), ("Active", "Expired"),
    ("Preloaded", "Expired"), ("Superseded", "Expired"), ("Active", "RolledBack"), ("RolledBack", "Active"),
]


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events (cycle, from_status, to_status) that no rule allows."""
    legal = events.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string")
    return events.join(F.broadcast(legal), ["from_status", "to_status"], "left_anti")


def observe_cycles(cycles: DataFrame, now: str) -> DataFrame:
    """Status of preloaded cycles (id, effective_from, effective_until) at an instant: the newest reached one is Active
    unless its window has passed, those before it Superseded or, where their window never was observed, Expired."""
    t = instant(cycles, now, "effective_from")
    reached = F.col("effective_from") <= t
    w = Window.orderBy(F.col("reached").desc(), F.col("effective_from").desc(), F.col("id").desc())
    ranked = cycles.withColumn("reached", reached).withColumn("nth", F.row_number().over(w))
    gone = F.col("effective_until").isNotNull() & (F.col("effective_until") < t)
    status = F.when(~F.col("reached"), "Preloaded").when(F.col("nth") == 1, F.when(gone, "Expired").otherwise("Active")).otherwise("Superseded")
    return ranked.withColumn("status", status).drop("nth", "reached")


def rollback_diff(table: DataFrame, effective: str, payload: list[str], key: str = "id") -> DataFrame:
    """What a cycle changed: id and class added, removed or changed between just before and at its start."""
    t = instant(table, effective)
    b = just_before(t)
    pick = lambda at: table.filter((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))).groupBy(key).agg(
        F.max_by(F.struct(*payload), "valid_from").alias("v")
    )
    pre, cur = pick(b).withColumnRenamed("v", "pre"), pick(t).withColumnRenamed("v", "cur")
    kind = F.when(F.col("pre").isNull(), "added").when(F.col("cur").isNull(), "removed").when(~F.col("pre").eqNullSafe(F.col("cur")), "changed")
    return pre.join(cur, key, "full_outer").select(key, kind.alias("change")).filter("change is not null")


def rollback(table: DataFrame, effective: str, payload: list[str], namespace: str, key: str = "id") -> DataFrame:
    """The table with the provider's state of just before ``effective`` published again at ``effective``.

    Added rows close, changed ones go back to their payload before, removed ones are published again; what another
    provider owns stays as it is.
    """
    t = instant(table, effective)
    mine = F.col(key).startswith(namespace + ":")
    diff = rollback_diff(table.filter(mine), effective, payload, key)
    before = as_of_column(table, just_before(t)).select(*table.columns)
    again = before.join(diff.filter("change in ('changed', 'removed')").select(key), key, "left_semi")
    again = again.withColumn("valid_from", t).withColumn("valid_until", F.lit(None).cast(table.schema["valid_until"].dataType))
    touched = diff.filter("change in ('added', 'changed')").select(F.col(key).alias("__k"))
    j = table.join(touched, F.col(key) == F.col("__k"), "left")
    at_t = F.col("__k").isNotNull() & (F.col("valid_from") == t)
    rest = j.filter(~at_t).drop("__k")
    return rest.unionByName(again)


def as_of_column(table: DataFrame, at: Column) -> DataFrame:
    return table.filter((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def summary(tables: dict[str, DataFrame], at: str) -> DataFrame:
    """(table_name, revisions, entities, current) for each table, all revisions beside those valid at an instant."""
    parts = []
    for name, t in tables.items():
        live = (F.col("valid_from") <= instant(t, at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > instant(t, at))) if "valid_until" in t.columns else F.col("valid_from") <= instant(t, at)
        parts.append(t.agg(F.count("*").alias("revisions"), F.count_distinct("id").alias("entities"), F.count_distinct(F.when(live, F.col("id"))).alias("current")).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


def open_duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    """Entities with more than one open revision."""
    return df.filter("valid_until is null").groupBy(key).agg(F.count_distinct("valid_from").alias("open")).filter("open > 1")
