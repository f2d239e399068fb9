"""Access to the test tables and small helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side is taken as small; above either the plain join (shuffle) is used.
SMALL_ROWS = 200_000
SMALL_BYTES = 64 << 20

def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than that, else as it is, unshuffled.

    What is shuffled is therefore less than one scan partition (spark.sql.files.maxPartitionBytes) for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


SPACE = r"[\s\p{Z}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _width(field: T.StructField) -> Column:
    """About how many bytes a column takes in a row."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(F.col(field.name)))) + 8
    return F.lit(8)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to have at most ``max_rows`` rows and ``max_bytes``, else ``df`` itself.

    Measuring runs the side once more (never past ``max_rows`` rows), so a side that is dear to work out is cut first.
    """
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        width = width + _width(f)
    n, size = df.limit(max_rows + 1).select(width.alias("w")).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def plain(col: Column | str) -> Column:
    """Text without letter case and amount of white space; empty text is null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), SPACE, " ")), F.lit(""))


def key_text(col: Column | str) -> Column:
    """Trimmed upper-case text; empty text is null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.upper(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def second(col: Column | str) -> Column:
    """A time as ``yyyy-MM-dd HH:mm:ss``, whatever the session's time zone does to other formats."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c.cast("string"), 1, 19)


def far_future(like: DataFrame, column: str) -> Column:
    return F.lit("9999-12-31 00:00:00").cast(like.schema[column].dataType)


def far_past(like: DataFrame, column: str) -> Column:
    return F.lit("0001-01-01 00:00:00").cast(like.schema[column].dataType)


def digest(*cols: Column) -> tuple[Column, Column]:
    """128 bits over ``cols``, nulls told from every text."""
    filled = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]
    return F.xxhash64(*filled), F.xxhash64(F.lit("airloom"), *filled)


def number(c: Column) -> Column:
    """A double with NaN as null."""
    d = c.cast(T.DoubleType())
    return F.when(~F.isnan(d), d)
