"""Instrument procedures: terminators, leg interpretation, assembly and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.functions.geo import haversine_nm

#: Path terminator, needs a fix, needs a navaid, follows a heading, is a hold, known to the store rules.
TERMINATORS = [
    ("AF", True, True, False, False, False), ("CA", False, False, False, False, True), ("CD", False, True, False, False, True), ("CF", True, True, False, False, True),
    ("CI", False, False, False, False, True), ("CR", False, True, False, False, True), ("DF", True, False, False, False, True), ("FA", True, False, False, False, True),
    ("FC", True, False, False, False, True), ("FD", True, True, False, False, True), ("FM", True, False, False, False, True), ("HA", True, False, False, True, True),
    ("HF", True, False, False, True, True), ("HM", True, False, False, True, True), ("IF", True, False, False, False, True), ("PI", True, True, False, False, False),
    ("RF", True, False, False, False, True), ("TF", True, False, False, False, True), ("VA", False, False, True, False, True), ("VD", False, True, True, False, True),
    ("VI", False, False, True, False, True), ("VM", False, False, True, False, True), ("VR", False, True, True, False, True), ("PT", True, False, False, False, False),
    ("FT", True, False, False, False, False),
]


def terminators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMINATORS, "path_terminator string, needs_fix boolean, needs_navaid boolean, heading boolean, hold boolean, store_known boolean")


def altitude(descriptor: Column, a1: Column, a2: Column) -> Column:
    """struct(kind, lo, hi) of an altitude description code and its two altitudes."""
    d = F.coalesce(F.trim(descriptor), F.lit(""))
    kind = F.when(a1.isNull(), None).when(d == "+", "AT_OR_ABOVE").when(d == "-", "AT_OR_BELOW").when((d == "B") & a2.isNotNull(), "BETWEEN").when(d == "", "AT").otherwise("OTHER")
    lo = F.when(kind == "BETWEEN", F.least(a1, a2)).when(kind.isin("AT_OR_ABOVE", "AT"), a1)
    hi = F.when(kind == "BETWEEN", F.greatest(a1, a2)).when(kind.isin("AT_OR_BELOW", "AT"), a1)
    return F.struct(kind.alias("kind"), lo.alias("lo"), hi.alias("hi"))


def interpret(legs: DataFrame) -> DataFrame:
    """Legs with their constraint, the course and distance their terminator uses, and what is wrong with them."""
    t = F.broadcast(terminators(legs.sparkSession))
    j = legs.join(t, "path_terminator", "left")
    course = F.when(F.col("path_terminator").isin("AF"), F.col("course_b_deg")).otherwise(F.col("course_a_deg"))
    dist = F.when(F.col("path_terminator").isin("AF", "RF"), F.col("distance_b_nm")).otherwise(F.col("distance_a_nm"))
    issues = F.array_compact(F.array(
        F.when(F.col("needs_fix").isNull(), "unknown-terminator"),
        F.when(F.col("needs_fix") & (F.coalesce(F.trim("fix_ident"), F.lit("")) == ""), "missing-fix"),
        F.when(F.col("needs_navaid") & (F.coalesce(F.trim("recommended_navaid"), F.lit("")) == ""), "missing-navaid"),
        F.when((F.col("path_terminator") == "RF") & F.col("arc_radius_nm").isNull(), "missing-radius"),
        F.when((F.col("altitude_descriptor") == "B") & (F.col("altitude_1_ft").isNull() | F.col("altitude_2_ft").isNull()), "band-incomplete"),
        F.when(F.col("altitude_1_ft").isNull() & F.col("altitude_2_ft").isNotNull(), "second-altitude-alone"),
    ))
    return j.withColumn("constraint", altitude(F.col("altitude_descriptor"), F.col("altitude_1_ft"), F.col("altitude_2_ft"))).withColumn("course_deg", course).withColumn("distance_nm", dist).withColumn("issues", issues)


KEY = ["airport_ident", "procedure_kind", "procedure_ident"]


def assemble(legs: DataFrame) -> DataFrame:
    """One row per procedure: main legs and transitions of legs in sequence; several starts of validity are an error."""
    leg = F.struct("sequence_number", "fix_ident", "path_terminator")
    part = legs.groupBy(*KEY, "transition_ident").agg(F.array_sort(F.collect_list(leg)).alias("legs"), F.min("valid_from").alias("lo"), F.max("valid_from").alias("hi"))
    main = F.trim(F.coalesce("transition_ident", F.lit(""))) == ""
    return part.groupBy(*KEY).agg(
        F.first(F.when(main, F.col("legs")), ignorenulls=True).alias("main"),
        F.array_sort(F.collect_list(F.when(~main, F.struct("transition_ident", "legs")))).alias("transitions"),
        (F.min("lo") != F.max("hi")).alias("mixed_validity"),
    )


def validate(legs: DataFrame) -> DataFrame:
    """Issues (procedure key, sequence_number, severity, code) of consecutive legs: order, gaps, distance, profile.

    ``legs`` has lat and lon of the fix (null if unresolved). The distance is from the last leg that had a position, the
    altitude against the last one that had a constraint.
    """
    w = Window.partitionBy(*KEY, "transition_ident").orderBy("sequence_number")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    j = (
        legs.withColumn("p_seq", F.lag("sequence_number").over(w))
        .withColumn("p_at", F.last(at, ignorenulls=True).over(before))
        .withColumn("p_alt", F.last("altitude_1_ft", ignorenulls=True).over(before))
    )
    far = haversine_nm(F.col("p_at.lat"), F.col("p_at.lon"), F.col("lat"), F.col("lon"))
    issue = lambda cond, sev, code: F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code")))
    found = F.array_compact(F.array(
        issue(F.col("p_seq") == F.col("sequence_number"), "error", "sequence-duplicate"),
        issue(F.col("sequence_number") - F.col("p_seq") > 100, "warning", "sequence-gap"),
        issue(far > 250, "error", "leg-too-long"),
        issue((F.col("procedure_kind") == "D") & (F.col("p_alt") - F.col("altitude_1_ft") > 500), "warning", "descends-on-departure"),
        issue((F.col("procedure_kind") == "E") & (F.col("altitude_1_ft") - F.col("p_alt") > 500), "warning", "climbs-on-arrival"),
        issue(F.col("lat").isNull() & (F.coalesce(F.trim("fix_ident"), F.lit("")) != ""), "warning", "fix-unresolved"),
    ))
    return j.select(*KEY, "transition_ident", "sequence_number", F.explode(found).alias("i")).select(*KEY, "transition_ident", "sequence_number", "i.*")


def flyable(legs: DataFrame) -> DataFrame:
    """Procedures with whether no error was found."""
    errors = validate(legs).filter("severity = 'error'").select(*KEY).distinct().withColumn("__e", F.lit(True))
    return legs.select(*KEY).distinct().join(errors, KEY, "left").select(*KEY, F.col("__e").isNull().alias("is_flyable"))


def discontinuities(legs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Legs (start, end, connector) that do not begin where the one before them ended; a missing end on either side and
    connectors give no finding."""
    w = Window.partitionBy(*keys).orderBy(*order)
    j = legs.withColumn("previous_end", F.lag("end").over(w))
    return j.filter((F.col("start") != F.col("previous_end")) & ~F.coalesce("connector", F.lit(False)))
