"""Keys that hold very many rows, and neighbours in a sorted group of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.session import cut
from airloom.tables import small_side

#: A key is hot if it has at least HOT_ROWS rows, so there are at most rows / HOT_ROWS of them.
HOT_ROWS = 200_000
#: Quantiles taken of a hot key's order; it is cut at as many of them as its size asks for.
QUANTILES = 4_096


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame | None:
    """(keys, __n) of every key of at least ``rows`` rows, cut; None if there are none. Counted before the shuffle."""
    hot = cut(df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= rows))
    return None if hot.isEmpty() else hot


def join_hot(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``df`` with the columns of ``hot``, null for usual keys. Null keys equal each other."""
    side = hot.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], *[c for c in hot.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(keys)]
    return df.join(small_side(side), on, "left").drop(*[f"__h{i}" for i in range(len(keys))])


def parts(df: DataFrame, keys: list[str], hot: DataFrame | None, rows: int = HOT_ROWS) -> tuple[DataFrame, Column]:
    """``df`` and a column that says into how many parts its key is to be split: one for usual keys."""
    if hot is None:
        return df, F.lit(1)
    return join_hot(df, keys, hot), F.coalesce(F.ceil(F.col("__n") / rows).cast("int"), F.lit(1))


def with_neighbours(
    df: DataFrame, keys: list[str], order: str, prev: list[str], nxt: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``prev`` and ``next``: structs of the named columns of the row before and after in ``keys`` by ``order``.

    (keys, order) must be unique. Usual keys take one window. A hot key, of which there may be any number, is cut into
    ranges of ``order`` of about ``hot_rows`` rows (bounds from an approximate quantile of that key; at most QUANTILES of
    them), each range takes its own window and only its first and last row carry over. No task sees more than a range.
    """
    prev_s, next_s = F.struct(*prev), F.struct(*nxt)
    w = Window.partitionBy(*keys).orderBy(order)

    def usual(d: DataFrame) -> DataFrame:
        return d.withColumn("prev", F.lag(prev_s).over(w)).withColumn("next", F.lead(next_s).over(w))

    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return usual(df)
    marked = join_hot(df, keys, hot)
    big = marked.filter("__n is not null")
    fine = F.percentile_approx(order, F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)]), F.lit(10 * QUANTILES))
    step = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES) * hot_rows / F.max("__n")).cast("int"))
    bounds = cut(big.groupBy(*keys).agg(fine.alias("__all"), step.alias("__step")).select(
        *keys, F.filter("__all", lambda _, i: (i + 1) % F.col("__step") == 0).alias("__bounds")
    ))
    ranged = join_hot(big, keys, bounds)
    ranged = ranged.withColumn("__range", F.size(F.filter("__bounds", lambda b: b <= F.col(order)))).drop("__bounds", "__n")
    edges = ranged.groupBy(*keys, "__range").agg(
        F.min_by(next_s, order).alias("__first"), F.max_by(prev_s, order).alias("__last")
    )
    over = Window.partitionBy(*keys).orderBy("__range")
    edges = cut(edges.select(
        *keys, "__range", F.lag("__last").over(over).alias("__before"), F.lead("__first").over(over).alias("__after")
    ))
    wr = Window.partitionBy(*keys, "__range").orderBy(order)
    inner = ranged.withColumn("prev", F.lag(prev_s).over(wr)).withColumn("next", F.lead(next_s).over(wr))
    done = join_hot(inner, [*keys, "__range"], edges)
    done = done.withColumn("prev", F.coalesce("prev", "__before")).withColumn("next", F.coalesce("next", "__after"))
    done = done.select(*df.columns, "prev", "next")
    return usual(marked.filter("__n is null").drop("__n")).select(*df.columns, "prev", "next").unionByName(done)
