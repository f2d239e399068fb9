"""Rows that fail to parse: RFC 4180 records taken apart into cells, checked by a rule table, split from the clean rows.

Parsing stays in the JVM and linear in the text: a record is split at its double quotes, so every second piece lies
inside quotes; what may stand at the ends of the outer pieces decides whether the record is well formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.session import cut

COLUMNS = 20
#: dataset, cell (from 0), kind, form, least, most, may be empty. kind '' holds for all kinds of the dataset not named.
RULES = [
    ("runways", 3, "", r"^[0-9]+$", 1.0, 30_000.0, False),
    ("runways", 12, "", r"^[0-9]+(\.[0-9]+)?$", 0.0, 360.0, True),
    ("navaids", 5, "ndb", r"^[0-9]+$", 190.0, 1_800.0, False),
    ("navaids", 5, "ndb-dme", r"^[0-9]+$", 190.0, 1_800.0, False),
    ("navaids", 5, "", r"^[0-9]+$", 108_000.0, 118_000.0, False),
]
#: dataset -> cell that holds the kind
KIND_CELL = {"navaids": 4}
BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules, a fixed handful, as a table that is joined to the cells."""
    return spark.createDataFrame(RULES, "rule_dataset string, rule_cell int, rule_kind string, form string, least double, most double, empty_ok boolean")


def parse(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """Add well_formed and cells. A line end at the end does not count; a null line is an empty one.

    Cells come out as they are in the text. The separator used inside, U+0001, is escaped with U+0002 in the few texts
    that hold either.
    """
    text = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"(\r\n|\n|\r)\z", "")
    rare = text.contains("\u0001") | text.contains("\u0002")
    text = F.when(rare, F.replace(F.replace(text, F.lit("\u0002"), F.lit("\u0002b")), F.lit("\u0001"), F.lit("\u0002a"))).otherwise(text)
    # a comma on either side, so that every piece outside quotes must begin and end with one; '' between two quoted
    # pieces is an escaped quote. The lambdas use nothing but their piece: what they named else would be worked out anew
    # for each piece.
    pieces = F.split(F.concat(F.lit(","), text, F.lit(",")), '"', -1)
    split = lines.withColumn("__p", pieces)

    def bad(p: Column, i: Column) -> Column:
        return (i % 2 == 0) & (p != "") & ~(p.startswith(",") & p.endswith(","))

    ok = (F.size("__p") % 2 == 1) & ~F.exists(F.transform("__p", bad), lambda b: b)
    joined = F.array_join(
        F.transform("__p", lambda p, i: F.when(i % 2 == 1, p).when(p == "", F.lit('"')).otherwise(F.translate(p, ",", "\u0001"))), ""
    )
    split = split.withColumn("well_formed", ok).withColumn("__j", F.when(ok, joined)).drop("__p")
    cells = F.split("__j", "\u0001", -1)
    plain = F.slice(cells, 2, F.size(cells) - 2)
    restored = F.transform(plain, lambda c: F.replace(F.replace(c, F.lit("\u0002a"), F.lit("\u0001")), F.lit("\u0002b"), F.lit("\u0002")))
    return split.withColumn("cells", F.when(F.col("__j").contains("\u0002"), restored).otherwise(plain)).drop("__j")


def failures(lines: DataFrame, rules: DataFrame, line_id: str = "line_id", dataset: str = "dataset_name") -> DataFrame:
    """(line_id, reason, details): one row per bad line; details names the cells that broke a rule.

    Order of reasons: quoting, column_count, value. Datasets without rules can only fail by form.
    """
    return _failures(parse(lines), rules, line_id, dataset)


def _failures(parsed: DataFrame, rules: DataFrame, line_id: str, dataset: str) -> DataFrame:
    name = F.lower(F.regexp_replace(F.coalesce(F.col(dataset), F.lit("")), BLANK, ""))
    parsed = parsed.select(F.col(line_id).alias("line_id"), name.alias("dataset"), "well_formed", "cells")
    kind = F.lit("")
    for d, i in KIND_CELL.items():
        kind = F.when(F.col("dataset") == d, F.lower(F.regexp_replace(F.get("cells", F.lit(i)), BLANK, ""))).otherwise(kind)
    # a line of bad form is one row with its reason, any other one row for each cell: one pass over the lines finds all
    form = F.when(~F.col("well_formed"), "quoting").when(F.size("cells") != COLUMNS, "column_count")
    one = F.array(F.struct(F.lit(-1).alias("cell"), form.alias("form"), F.lit(None).cast("string").alias("value")))
    each = F.transform("cells", lambda c, i: F.struct(i.alias("cell"), F.lit(None).cast("string").alias("form"), c.alias("value")))
    cells = parsed.select("line_id", "dataset", kind.alias("kind"), F.explode(F.when(form.isNotNull(), one).otherwise(each)).alias("c")).select(
        "line_id", "dataset", "kind", "c.cell", F.col("c.form").alias("broken"), "c.value"
    )
    named = rules.select("rule_dataset", "rule_cell", F.col("rule_kind").alias("k")).filter("k <> ''").groupBy("rule_dataset", "rule_cell").agg(F.collect_set("k").alias("kinds"))
    table = rules.join(named, ["rule_dataset", "rule_cell"], "left")
    checked = cells.join(
        F.broadcast(table),
        (F.col("dataset") == F.col("rule_dataset")) & (F.col("cell") == F.col("rule_cell"))
        & F.when(F.col("rule_kind") == "", F.coalesce(~F.array_contains("kinds", F.col("kind")), F.lit(True))).otherwise(F.col("rule_kind") == F.col("kind")),
        "left",
    )
    value = F.regexp_replace("value", BLANK, "")
    fits = F.when(value == "", F.col("empty_ok")).otherwise(
        value.rlike("^[0-9]") & F.regexp_like(value, F.col("form")) & F.coalesce(F.expr(f"try_cast(regexp_replace(value, '{BLANK.replace(chr(92), chr(92) * 2)}', '') as double)").between(F.col("least"), F.col("most")), F.lit(False))
    )
    errors = checked.filter(F.col("broken").isNotNull() | (F.col("rule_cell").isNotNull() & ~fits))
    # a line_id that was delivered more than once keeps its first reason in the order of the checks
    rank = F.when(F.col("broken") == "quoting", 0).when(F.col("broken") == "column_count", 1).otherwise(2)
    found = errors.groupBy("line_id").agg(F.min(rank).alias("rank"), F.array_sort(F.collect_set(F.when(F.col("cell") >= 0, F.col("cell")))).alias("cells"))
    reason = F.element_at(F.array(F.lit("quoting"), F.lit("column_count"), F.lit("value")), F.col("rank") + 1)
    return found.select("line_id", reason.alias("reason"), F.when(F.col("rank") == 2, F.col("cells")).otherwise(F.array().cast("array<int>")).alias("details"))


def split_lines(lines: DataFrame, line_id: str = "line_id", dataset: str = "dataset_name") -> tuple[DataFrame, DataFrame]:
    """(clean rows with their cells, bad lines with their reason); every line is in exactly one of them.

    The lines are parsed once for both: what parsing gave is cut.
    """
    parsed = cut(parse(lines))
    bad = _failures(parsed, rule_table(lines.sparkSession), line_id, dataset)
    clean = parsed.join(bad.select(F.col("line_id").alias("__bad")), F.col(line_id) == F.col("__bad"), "left_anti")
    return clean.drop("well_formed"), bad
