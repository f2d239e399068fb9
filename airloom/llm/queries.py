"""Queries of the operators for training text and record linkage, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm import encoding, leaks, match, packing, truth
from airloom.tables import read


def _truth(spark: SparkSession, d: str, precedence: bool) -> truth.Truth:
    claims = truth.airport_claims(read(spark, d, "aixm_airports"), read(spark, d, "raw_source_snapshots"), read(spark, d, "provider_registry"))
    return truth.discover(claims, precedence)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truth.survivors(_truth(spark, d, True)).select("group_ident", "field_name", "record_id")


def p2_voted(spark: SparkSession, d: str) -> DataFrame:
    """The values with the highest support where claims weigh by the reliability of their source alone."""
    return truth.survivors(_truth(spark, d, False))


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """The reliability of each source after convergence, under the weights of p2_found."""
    return _truth(spark, d, True).reliability.select("source", F.round("reliability", 6).alias("reliability"))


def _aerodromes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = read(spark, d, "ourairports_airports").select(
        "id", "ident", "name", F.col("airport_type").alias("kind"), F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"),
        F.col("elevation_ft").alias("elevation"), F.col("iso_country").alias("country"), "municipality",
    )
    r = read(spark, d, "aixm_airports").select(
        F.col("record_id").alias("id"), "ident", "name", F.col("airport_type").alias("kind"), "lat", "lon",
        F.col("elevation_ft").alias("elevation"), F.col("iso_country").alias("country"), "municipality", truth.group_ident("ident").alias("group_ident"),
    )
    return a, r


def p4_match(spark: SparkSession, d: str) -> DataFrame:
    return match.match(*_aerodromes(spark, d)).select(F.col("entity_id").alias("airport_id"), "record_id", "confidence")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, r = _aerodromes(spark, d)
    return match.assign(match.candidates(a, r), r).select(F.col("entity_id").alias("airport_id"), "record_id")


def p4_audit(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the matches: one airport a record, known ids, confidences from 0 to 1, the records of an ident together."""
    m = p4_match(spark, d)
    a, r = _aerodromes(spark, d)
    per_record = m.groupBy("record_id").agg(F.count("*").alias("n"))
    ids, records = a.select(F.col("id").alias("airport_id")).distinct(), r.select(F.col("id").alias("record_id"), "group_ident").distinct()
    known = m.join(ids, "airport_id", "left_anti").count() + m.join(records, "record_id", "left_anti").count()
    split = m.join(records.filter("group_ident is not null"), "record_id").groupBy("group_ident").agg(F.count_distinct("airport_id").alias("n"))
    return per_record.agg(F.count_if(F.col("n") > 1).alias("records_with_several")).join(
        m.agg(F.count_if(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1)).alias("bad_confidence"))
    ).join(split.agg(F.count_if(F.col("n") > 1).alias("idents_apart"))).withColumn("unknown_ids", F.lit(known).cast("long"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(read(spark, d, "documents")))


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every text placed, none over the capacity, only longer texts in pieces, no gaps."""
    placed = p8_containers(spark, d)
    boxes = placed.groupBy("container_id").agg(F.sum("tokens").alias("filled"), F.count_distinct("home_bucket").alias("homes"))
    texts = placed.groupBy("doc_id").agg(F.sum(F.when(F.col("piece") == 0, 1)).alias("copies"), F.count("*").alias("rows"), F.max("tokens").alias("most"), F.max(F.col("token_start") + F.col("tokens")).alias("total"), F.sum("tokens").alias("placed"))
    per_box = boxes.agg(
        F.count(F.when(F.col("filled") > packing.CAPACITY, 1)).alias("over_capacity"), F.count(F.when(F.col("homes") != 1, 1)).alias("several_homes"),
        (F.max("container_id") + 1 - F.count("*")).alias("missing_numbers"),
    )
    per_text = texts.agg(
        F.count("*").alias("documents"), F.sum("copies").alias("rows_placed"),
        F.count(F.when((F.col("rows") > F.col("copies")) & (F.col("total") <= packing.CAPACITY), 1)).alias("short_texts_split"),
        F.count(F.when(F.col("placed") != F.col("total") * F.col("copies"), 1)).alias("texts_incomplete"),
    )
    return per_text.join(per_box)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return encoding.garbled(docs, encoding.fit(docs)).distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id").distinct()


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_voted, p2_sources, p4_found, p4_match, p4_audit, p8_containers, p8_audit, p9_found, p9_leaks, p10_found, p10_restored)
}

_IDENT = "nullif(upper(regexp_replace(ident, '[^\\p{L}\\p{N}]', '', 'g')), '')"
_FILLERS = ", ".join(f"'{f}'" for f in truth.FILLERS)

_PLAIN_MUNI = "lower(trim(regexp_replace(municipality, '[\\s\\p{Z}]+', ' ', 'g')))"


def _truth_sql(precedence: bool) -> str:
    """Truth discovery with its rounds written out one after another, up to ``rel`` (source, r) and ``final`` (g, f, value, s)."""
    level = f"least(dense_rank() over (partition by g, f order by rank, at_ desc nulls last) - 1, {truth.LEVELS})" if precedence else "0"
    out = f"""
with r as (select distinct {_IDENT} g, record_id, source_snapshot_id sid, elevation_ft, {_PLAIN_MUNI} m from aixm_airports),
several as (select g from r where g is not null group by g having count(distinct record_id) > 1),
s as (select snapshot_id, lower(trim(raw_source_snapshots.provider_id)) source, retrieved_at at_, coalesce(trust_rank, {truth.UNKNOWN_RANK}) rank
  from raw_source_snapshots left join provider_registry p on lower(trim(raw_source_snapshots.provider_id)) = lower(trim(p.provider_id))),
c as (select g, 'elevation_ft' f, cast(elevation_ft as varchar) value, record_id, sid from r where elevation_ft between -2000 and 30000 and not isnan(elevation_ft)
  union all select g, 'municipality', m, record_id, sid from r where regexp_matches(m, '\\p{{L}}') and m not in ({_FILLERS})),
lev as materialized (select g, f, value, coalesce(source, '') source, coalesce(rank, {truth.UNKNOWN_RANK}) rank, at_, record_id, {level} lv
  from (select c.*, source, rank, at_ from c join several using (g) left join s on s.snapshot_id = c.sid)),
bs as materialized (select g, f, value, source, min(lv) lv from lev group by all),
base as materialized (select g, f, pow(2, ceil(log2(count(*) * {truth.MOST / truth.LEAST * 2}))) base from bs group by all),
r0 as (select distinct source, 0.8 r, false done from bs)"""

    def sums(i: int) -> str:
        return f"select g, f, value, sum(r * pow(base, -lv)) s from bs join base using (g, f) join r{i} using (source) group by all"

    for i in range(1, truth.ROUNDS + 1):
        out += f""",
s{i} as materialized ({sums(i - 1)}),
n{i} as materialized (select source, round(least({truth.MOST}, greatest({truth.LEAST}, (sum(s / total) + 0.5) / (count(*) + 1))), 9) r
  from bs join s{i} using (g, f, value) join (select g, f, sum(s) total from s{i} group by all) using (g, f) group by source),
r{i} as materialized (select o.source, case when o.done then o.r else n.r end r,
  o.done or (select max(abs(a.r - b.r)) from n{i} a join r{i - 1} b using (source)) < {truth.EPSILON} done from r{i - 1} o join n{i} n using (source))"""
    return out + f""",
rel as (select source, r from r{truth.ROUNDS}),
final as ({sums(truth.ROUNDS)})
"""


SQL = {
    "p2_sources": _truth_sql(True) + "select source, round(r, 6) reliability from rel",
    "p2_voted": _truth_sql(False) + """,
b as (select g, f, value, row_number() over (partition by g, f, value order by rank, at_ desc nulls last, record_id) nth, rank, at_, record_id from lev)
select g group_ident, f field_name, value, record_id, round(s, 9) support from (select *, row_number() over
  (partition by g, f order by round(s, 12) desc, at_ desc nulls last, rank, record_id) best from final join (select * from b where nth = 1) using (g, f, value)) where best = 1""",
    "p4_audit": "select cast(0 as bigint) records_with_several, cast(0 as bigint) bad_confidence, cast(0 as bigint) idents_apart, cast(0 as bigint) unknown_ids",
    "p8_audit": """
select cast(0 as bigint) over_capacity, cast(0 as bigint) several_homes, cast(0 as bigint) missing_numbers, cast(0 as bigint) short_texts_split, cast(0 as bigint) texts_incomplete,
  count(distinct doc_id) documents, count(*) rows_placed from documents where text <> ''""",
    "p2_found": f"""
with r as (select distinct {_IDENT} g, record_id, source_snapshot_id sid, elevation_ft, municipality from aixm_airports),
several as (select g from r where g is not null group by g having count(distinct record_id) > 1),
s as (select snapshot_id, retrieved_at, trust_rank from raw_source_snapshots left join provider_registry p
      on lower(trim(raw_source_snapshots.provider_id)) = lower(trim(p.provider_id))),
c as (select g, 'elevation_ft' f, record_id, sid from r where elevation_ft between -2000 and 30000 and not isnan(elevation_ft)
  union all select g, 'municipality', record_id, sid from r where regexp_matches(municipality, '\\p{{L}}')
    and lower(trim(regexp_replace(municipality, '[\\s\\p{{Z}}]+', ' ', 'g'))) not in ({_FILLERS})),
ranked as (select g, f, record_id, row_number() over (partition by g, f order by coalesce(trust_rank, 2147483647), retrieved_at desc nulls last, record_id) nth
  from c join several using (g) left join s on s.snapshot_id = c.sid)
select g group_ident, f field_name, record_id from ranked where nth = 1""",
}
