"""History of changing attributes: a hub, insert-only satellites by change rate, and lead-based validity views.

``build_vault`` makes a vault of updates; ``load`` adds later updates to stored satellites by appending rows, whatever
order they come in, and works only on the entities that they touch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.operators.skew import HOT_ROWS, with_neighbours
from airloom.session import cut
from airloom.tables import digest, number, plain, second, small_side


@dataclass
class Vault:
    """One row per holding state with the flags that say which satellite gets a row; nothing is ever updated."""

    states: DataFrame
    split: dict[str, list[str]]
    hot_rows: int = HOT_ROWS

    def hub(self) -> DataFrame:
        return self.states.groupBy("airport_id").agg(F.min("valid_from").alias("first_seen"))

    def satellite(self, name: str) -> DataFrame:
        """The appended rows of one satellite: only where its hash-diff changed or the entity came back after a gap."""
        return self.states.filter(f"new_{name}").select(
            "airport_id", F.col("valid_from").alias("load_from"), F.col(f"diff_{name}").alias("hash_diff"), *self.split[name]
        )

    def changes(self) -> DataFrame:
        """Satellite starts and closing marks in one stream: airport_id, at, starts."""
        start = F.lit(False)
        for name in self.split:
            start = start | F.col(f"new_{name}")
        marks = F.array(
            F.when(start, F.struct(F.col("valid_from").alias("at"), F.lit(True).alias("starts"))),
            F.when(F.col("closes_at").isNotNull(), F.struct(F.col("closes_at").alias("at"), F.lit(False).alias("starts"))),
        )
        return self.states.select("airport_id", F.explode(F.array_compact(marks)).alias("m")).select("airport_id", "m.*")

    def versions(self) -> DataFrame:
        """The view: every version with its period; the end is the next start or closing mark."""
        led = with_neighbours(self.changes(), ["airport_id"], "at", ["at"], ["at"], self.hot_rows)
        return led.filter("starts").select("airport_id", F.col("at").alias("valid_from"), F.col("next.at").alias("valid_until"))


def _holding(updates: DataFrame, snapshots: DataFrame) -> DataFrame:
    got = snapshots.select(F.trim("snapshot_id").alias("__s"), F.col("retrieved_at").alias("__got"))
    got = got.groupBy("__s").agg(F.max("__got").alias("__got"))
    rows = updates.filter(
        "airport_id is not null and valid_from is not null and (valid_until is null or valid_until > valid_from)"
    ).withColumn("__s", F.trim("source_snapshot_id"))
    rows = rows.join(small_side(got), "__s", "left")
    state = F.struct(
        "valid_until",
        F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"),
        plain("name").alias("name"),
        plain("airport_type").alias("airport_type"),
        number(F.col("elevation_ft")).alias("elevation_ft"),
        plain("municipality").alias("municipality"),
    )
    return (
        rows.groupBy("airport_id", "valid_from")
        .agg(F.max_by(state, F.struct("__got", "update_id")).alias("s"))
        .select("airport_id", "valid_from", "s.*")
    )


def split_by_rate(linked: DataFrame, attributes: list[str]) -> dict[str, list[str]]:
    """Attributes that change more often than the mean of all go to the fast satellite, the others to the slow one."""
    both = F.col("prev.withdrawn").isNotNull() & ~F.col("prev.withdrawn") & ~F.col("withdrawn")
    counts = linked.agg(*[F.count(F.when(both & ~F.col(a).eqNullSafe(F.col(f"prev.{a}")), 1)).alias(a) for a in attributes]).first()
    mean = sum(counts) / len(attributes)
    fast = [a for a in attributes if counts[a] > mean]
    slow = [a for a in attributes if a not in fast]
    return {k: v for k, v in (("fast", fast), ("slow", slow)) if v}


def build_vault(updates: DataFrame, snapshots: DataFrame, hot_rows: int = HOT_ROWS, split: dict[str, list[str]] | None = None) -> Vault:
    """States in any order become a vault.

    Void rows (valid_until not after valid_from) and rows without airport_id or valid_from are left out. Of rows with one
    airport_id and valid_from that of the snapshot retrieved last holds (unknown snapshots first; then the highest
    update_id). Text is compared as plain text, NaN and empty text are missing values, null equals null. A withdrawn row
    closes; a null in withdrawn means false. Extra columns are ignored. The attributes are split by how often they change in
    ``updates``, unless ``split`` says where they already stand.
    """
    attributes = ["name", "airport_type", "elevation_ft", "municipality"]
    linked = cut(with_neighbours(
        _holding(updates, snapshots), ["airport_id"], "valid_from",
        ["valid_until", "withdrawn", *attributes], ["valid_from", "withdrawn"], hot_rows,
    ))
    split = split or split_by_rate(linked, attributes)
    live = ~F.col("withdrawn")
    joins = F.col("prev").isNotNull() & ~F.col("prev.withdrawn") & (
        F.col("prev.valid_until").isNull() | (F.col("prev.valid_until") >= F.col("valid_from"))
    )
    out = linked
    for name, cols in split.items():
        new, old = _diff(cols, ""), _diff(cols, "prev.")
        out = out.withColumn(f"diff_{name}", new).withColumn(f"new_{name}", live & ~(F.coalesce(joins, F.lit(False)) & (new == old)))
    until, follows = F.col("valid_until"), F.col("next.valid_from")
    closes = (
        F.when(~live, F.lit(None))
        .when(until.isNotNull() & (follows.isNull() | (until < follows)), until)
        .when(F.col("next.withdrawn"), follows)
    )
    return Vault(out.withColumn("closes_at", closes), split, hot_rows)


def _diff(cols: list[str], prefix: str) -> Column:
    a, b = digest(*[F.col(prefix + c) for c in cols])
    return F.concat_ws(":", F.hex(a), F.hex(b))


def airport_history(updates: DataFrame, snapshots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(airport_id, valid_from, valid_until) of every version as text, ``open`` where there is no end."""
    v = build_vault(updates, snapshots, hot_rows).versions()
    return v.select("airport_id", second("valid_from").alias("valid_from"), F.coalesce(second("valid_until"), F.lit("open")).alias("valid_until"))


MARKS = "marks"


def rows_of(vault: Vault) -> dict[str, DataFrame]:
    """What the satellites hold, and the closing marks as one more: airport_id, load_from, hash_diff and attributes."""
    marks = vault.states.filter("closes_at is not null").select("airport_id", F.col("closes_at").alias("load_from"), F.lit("closed").alias("hash_diff")).distinct()
    return {**{name: vault.satellite(name) for name in vault.split}, MARKS: marks}


def holding(satellite: DataFrame) -> DataFrame:
    """The rows of a stored satellite that hold: of those with one start the last loaded, unless it voids the start."""
    cols = [c for c in satellite.columns if c not in ("airport_id", "load_from")]
    g = satellite.groupBy("airport_id", "load_from").agg(F.max_by(F.struct(*cols), "load").alias("r"))
    return g.select("airport_id", "load_from", "r.*").filter("not void").select(satellite.columns)


def load(stored: dict[str, DataFrame] | None, log: DataFrame | None, updates: DataFrame, snapshots: DataFrame, number: int, split: dict[str, list[str]] | None = None, hot_rows: int = HOT_ROWS) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """(rows to append to each satellite, split) for load ``number`` of ``updates``.

    ``log`` has the updates loaded so far, ``stored`` the satellites, ``split`` the attributes of each; all three are
    missing for the first load only, which decides the split, and an attribute never moves after that. Only entities
    with new updates are worked out again. A start that was there with another hash, or was not, is appended; one that a
    late update took away is appended as void. Nothing stored is changed, so loading the same updates again appends nothing.
    """
    mine = updates
    if log is not None:
        touched = updates.select(F.col("airport_id").alias("__t")).distinct()
        mine = log.unionByName(updates).join(touched, F.col("airport_id") == F.col("__t"), "left_semi")
    vault = build_vault(mine, snapshots, hot_rows, split)
    out = {}
    for name, want in rows_of(vault).items():
        fresh = want.withColumns({"load": F.lit(number), "void": F.lit(False)})
        if stored is not None:
            have = holding(stored[name]).join(touched, F.col("airport_id") == F.col("__t"), "left_semi")
            key = ["airport_id", "load_from"]
            gone = have.join(want.select(*key), key, "left_anti").withColumns({"load": F.lit(number), "void": F.lit(True)})
            fresh = fresh.join(have.select(*key, "hash_diff"), [*key, "hash_diff"], "left_anti").unionByName(gone.select(fresh.columns))
        out[name] = fresh
    return out, vault.split


def stored_versions(satellites: dict[str, DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(airport_id, valid_from, valid_until) from stored satellites: every start with the next start or closing mark."""
    starts = None
    for name, rows in satellites.items():
        one = holding(rows).select("airport_id", F.col("load_from").alias("at"), F.lit(name != MARKS).alias("starts"))
        starts = one if starts is None else starts.unionByName(one)
    changes = starts.groupBy("airport_id", "at").agg(F.max("starts").alias("starts"))
    led = with_neighbours(changes, ["airport_id"], "at", ["at"], ["at"], hot_rows)
    return led.filter("starts").select("airport_id", F.col("at").alias("valid_from"), F.col("next.at").alias("valid_until"))
