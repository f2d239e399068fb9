"""Behaviour of versioned tables, publications, reconciliation and the graph."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airloom.operators import graph, quality, reconcile, temporal
from airloom.operators.commit import Store

T0 = datetime(2025, 1, 1)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


REV = "id string, name string, elevation_ft double, valid_from timestamp, valid_until timestamp, source_snapshot_id string"
PAY = ["name", "elevation_ft"]


def rev(spark, *rows):
    return spark.createDataFrame([(i, n, e, day(f), day(u), s) for i, n, e, f, u, s in rows], REV)


def tuples(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_as_of_is_half_open(spark):
    t = rev(spark, ("a", "x", 1.0, 0, 10, "s"), ("a", "y", 1.0, 10, None, "s"), ("b", "z", 1.0, 20, None, "s"))
    assert tuples(temporal.as_of(t, "2025-01-11 00:00:00"), "id", "name") == {("a", "y")}
    assert tuples(temporal.as_of(t, "2025-01-10 23:59:59.999999"), "id", "name") == {("a", "x")}
    with pytest.raises(ValueError):
        temporal.as_of(t, "2025-01-10 23:59:59.9999999")


def test_upsert(spark):
    cur = rev(spark, ("a", "x", 1.0, 0, None, "s1"), ("b", "x", None, 0, None, "s1"))
    inc = rev(spark, ("a", "y", 1.0, 10, None, "s2"), ("b", "x", None, 10, None, "s2"), ("c", "n", 2.0, 10, None, "s2"))
    out = temporal.upsert(cur, inc, PAY)
    assert tuples(out, "id", "name", "valid_from", "valid_until") == {("a", "x", day(0), day(10)), ("a", "y", day(10), None), ("b", "x", day(0), None), ("c", "n", day(10), None)}
    assert tuples(temporal.upsert(out, inc, PAY), *REV.replace(" string", "").replace(" double", "").replace(" timestamp", "").split(", ")) == tuples(out, *REV.replace(" string", "").replace(" double", "").replace(" timestamp", "").split(", "))
    with pytest.raises(ValueError):
        temporal.upsert(out, rev(spark, ("a", "z", 1.0, 10, None, "s3")), PAY)


def test_observations_close_absent_and_masking(spark):
    cur = rev(spark, ("n:a", "x", 1.0, 0, None, "s1"), ("n:b", "x", 1.0, 0, None, "s1"), ("m:c", "x", 1.0, 0, None, "s1"), ("n:d", "x", 1.0, 5, None, "s1"))
    log = temporal.observe(temporal.observe(spark.createDataFrame([], "entity_table string, entity_id string, valid_from timestamp, source_snapshot_id string"), cur, "t"), cur, "t")
    assert log.count() == 4
    once = temporal.close_absent(cur, cur.filter("id = 'n:a'"), "n", "2025-01-06 00:00:00")
    assert tuples(once, "id", "valid_until") == {("n:a", None), ("n:b", day(5)), ("m:c", None), ("n:d", None)}
    assert tuples(temporal.close_absent(once, cur.filter("id = 'n:a'"), "n", "2025-01-06 00:00:00"), "id", "valid_until") == tuples(once, "id", "valid_until")
    assert not temporal.may_close(spark.createDataFrame([(1, 0)], "errors int, unsupported int")) and temporal.may_close(spark.createDataFrame([], "errors int, unsupported int"))


def test_tombstones_and_withdrawal(spark):
    cur = rev(spark, ("n:a", "x", 1.0, 0, None, "s"), ("n:b", "x", 1.0, 0, 5, "s"))
    stones = spark.createDataFrame([("n:a", day(9)), ("n:b", day(9)), ("n:z", day(9)), ("q:a", day(9))], "id string, effective_from timestamp")
    table, out = temporal.apply_tombstones(cur, stones, "n")
    assert tuples(out, "id", "outcome") == {("n:a", "closed"), ("n:b", "already_closed"), ("n:z", "unknown"), ("q:a", "foreign")}
    assert tuples(table, "id", "valid_until") == {("n:a", day(9)), ("n:b", day(5))}
    fut = rev(spark, ("a", "x", 1.0, 0, 50, "s"), ("a", "y", 1.0, 50, None, "s"))
    back = temporal.withdraw_future(fut, spark.createDataFrame([("a", day(50))], "id string, valid_from timestamp"), "2025-01-20 00:00:00")
    assert tuples(back, "name", "valid_until") == {("x", None)}
    with pytest.raises(ValueError):
        temporal.withdraw_future(fut, spark.createDataFrame([("a", day(0))], "id string, valid_from timestamp"), "2025-01-20 00:00:00")


def test_publication_guard(spark):
    p = spark.createDataFrame(
        [("p1", "1", "A", "x", "Baseline", day(1)), ("p1", "2", "A", "x", "Baseline", day(2)), ("p1", "3", "A", "y", "Correction", day(3)), ("p1", "4", "A", "z", "Baseline", day(4)), ("p1", "5", "B", "x", "Correction", day(5))],
        "publication_id string, source_snapshot_id string, owner string, content string, kind string, retrieved_at timestamp",
    )
    assert tuples(temporal.publication_guard(p), "source_snapshot_id", "decision") == {("1", "recorded"), ("2", "duplicate"), ("3", "correction"), ("4", "content_conflict"), ("5", "owner_conflict")}


def test_publication_apply_and_differential(spark):
    cur = rev(spark, ("n:a", "x", 1.0, 0, None, "s1"), ("n:b", "x", 1.0, 0, None, "s1"), ("n:a", "f", 1.0, 40, None, "s1"))
    cur = cur.withColumn("valid_until", F.when((F.col("id") == "n:a") & (F.col("name") == "x"), F.lit(day(40))).otherwise(F.col("valid_until")))
    inc = rev(spark, ("n:a", "corrected", 1.0, 40, None, "s2"))
    for full in (True, False):
        out, counts = temporal.apply_publication(cur, temporal.Publication(inc, None, "n", full, "2025-02-10 00:00:00"), PAY, "2025-01-20 00:00:00")
        assert ("n:a", "corrected", day(40), None) in tuples(out, "id", "name", "valid_from", "valid_until") and counts["updated"] == 1
        assert ("n:b", day(40) if full else None) in tuples(out, "id", "valid_until")


def test_rollback(spark):
    t = rev(
        spark, ("n:same", "x", 1.0, 0, None, "s1"), ("n:chg", "old", 1.0, 0, 10, "s1"), ("n:chg", "new", 1.0, 10, None, "s2"), ("n:gone", "x", 1.0, 0, 10, "s1"), ("n:add", "x", 1.0, 10, None, "s2"), ("m:chg", "old", 1.0, 0, 10, "s1"), ("m:chg", "new", 1.0, 10, None, "s2")
    )
    at = "2025-01-11 00:00:00"
    assert tuples(temporal.rollback_diff(t, at, PAY), "id", "change") == {("n:chg", "changed"), ("n:gone", "removed"), ("n:add", "added"), ("m:chg", "changed")}
    now = temporal.as_of(temporal.rollback(t, at, PAY, "n"), at)
    assert tuples(now, "id", "name") == {("n:same", "x"), ("n:chg", "old"), ("n:gone", "x"), ("m:chg", "new")}


def test_cycles(spark):
    c = spark.createDataFrame([("2501", day(0), day(28)), ("2502", day(28), day(56)), ("2503", day(56), day(84))], "id string, effective_from timestamp, effective_until timestamp")
    assert tuples(temporal.observe_cycles(c, "2025-01-29 00:00:00"), "id", "status") == {("2501", "Superseded"), ("2502", "Active"), ("2503", "Preloaded")}
    assert tuples(temporal.observe_cycles(c, "2026-01-29 00:00:00"), "id", "status") == {("2501", "Superseded"), ("2502", "Superseded"), ("2503", "Expired")}
    e = spark.createDataFrame([("2501", "Preloaded", "Active"), ("2501", "Expired", "Active")], "cycle string, from_status string, to_status string")
    assert temporal.illegal_transitions(e).count() == 1


def test_commit_is_atomic(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/w")
    s.publish({"t": spark.range(3)})

    def fail():
        raise RuntimeError("before the swap")

    with pytest.raises(RuntimeError):
        s.publish({"t": spark.range(9)}, fail)
    assert s.version() == 1 and s.table("t").count() == 3
    s.publish({"t": spark.range(5)})
    assert s.table("t").count() == 5
    s.rollback(1)
    assert s.table("t").count() == 3
    s.backup(f"file://{tmp_path}/b")
    assert spark.read.parquet(f"file://{tmp_path}/b/t").count() == 3


def test_bucket_pairs(spark):
    a = spark.createDataFrame([("1", "k1", 10.0, 10.0), ("2", "k2", 10.0, 10.0), ("3", "k3", 0.0, 0.0), ("4", "k4", 0.0, 0.0), ("5", "k4", 0.0, 0.0), ("6", None, 0.0, 0.0)], "id string, key string, lat double, lon double")
    b = spark.createDataFrame([("x", "k1", 10.01, 10.0), ("y", "k2", 10.3, 10.0), ("z", "k3", 5.0, 0.0), ("w", "k4", 0.0, 0.0), ("v", None, 0.0, 0.0)], "id string, key string, lat double, lon double")
    assert tuples(reconcile.bucket_pairs(a, b), "key", "outcome") == {("k1", "exact"), ("k2", "probable"), ("k3", "conflict"), ("k4", "ambiguous")}


def test_authority_and_diff(spark):
    v = spark.createDataFrame([("e", "f", "bad", 5, "s5"), ("e", "f", "good", 1, "s1"), ("e", "f", None, 0, "s0")], "entity string, field string, value string, rank int, source string")
    assert tuples(reconcile.authority(v), "value", "source", "overruled") == {("good", "s1", 1)}
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "k int, p string, q int")
    b = spark.createDataFrame([(2, "y", 2), (3, "z", 1)], "k int, p string, q int")
    assert tuples(reconcile.package_diff(a, b, ["k"], ["p", "q"]), "k", "class", "fields") == {(1, "only_a", ""), (2, "differs", "q"), (3, "only_b", "")}


def test_graph(spark):
    legs = spark.createDataFrame([("A", "B", "F", 1.0), ("B", "C", "N", 1.0), ("A", "C", "N", 5.0), ("D", "C", "B", 1.0), ("X", "Y", "N", 1.0), ("P", None, "N", 1.0)], "start string, end string, direction string, cost double")
    e = graph.edges(legs)
    assert tuples(e, "src", "dst") == {("A", "B"), ("B", "C"), ("C", "B"), ("A", "C"), ("C", "A"), ("C", "D"), ("X", "Y"), ("Y", "X")}
    pairs = spark.createDataFrame([("A", "D"), ("B", "A"), ("D", "A"), ("A", "X")], "origin string, destination string")
    got = {(r["origin"], r["destination"]): (r["cost"], list(r["path"])) for r in graph.shortest(e, pairs).collect()}
    assert got == {("A", "D"): (3.0, ["A", "B", "C", "D"]), ("B", "A"): (6.0, ["B", "C", "A"])}
    assert tuples(graph.components(e), "node", "component") == {(n, "A") for n in "ABCD"} | {("X", "X"), ("Y", "X")}
    assert tuples(graph.bfs(e, ["A"], 1), "node", "hops") == {("A", 0), ("B", 1), ("C", 1)}
    assert tuples(graph.unresolved(legs.select("start", "end"), spark.createDataFrame([("A",), ("B",), ("C",)], "node string")), "node") == {("D",), ("X",), ("Y",), ("P",)}


def test_long_chain_is_one_component(spark):
    e = spark.range(300).select(F.format_string("n%04d", F.col("id")).alias("src"), F.format_string("n%04d", F.col("id") + 1).alias("dst"))
    assert tuples(graph.components(e), "component") == {("n0000",)}


def test_rules(spark):
    legs = spark.createDataFrame([("1", "B", 100, None), ("2", "?", 100, None), ("3", "J", 100, None), ("4", None, None, 100), ("5", "+", 100, None)], "id string, altitude_descriptor string, altitude_1_ft int, altitude_2_ft int")
    assert tuples(quality.altitude_descriptors(legs), "id", "severity") == {("1", "error"), ("2", "error"), ("3", "warning"), ("4", "error")}
    n = spark.createDataFrame([("1", "NDB", 300), ("2", "NDB", 5), ("3", "WHAT", 5), ("4", "vor/dme", 110_000)], "id string, navaid_type string, frequency_khz int")
    assert tuples(quality.navaid_bands(n), "id") == {("2",), ("3",)}


def test_shortest_in_one_graph_and_spread_agree(spark):
    """The search over a graph that stays where it is finds the costs of the one that every worker holds."""
    import random

    rnd = random.Random(4)
    e = spark.createDataFrame([(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}", float(rnd.randrange(1, 9))) for _ in range(70)], "src string, dst string, cost double")
    pairs = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(0, 25, 6) for j in range(25) if i != j] + [("n1", "none")], "origin string, destination string")
    a, b = ({(r["origin"], r["destination"]): (r["cost"], list(r["path"])) for r in graph.shortest(e, pairs, n).collect()} for n in (1000, 0))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] for k in a) and len(a) > 20
    best = {}
    for r in e.collect():
        best[(r["src"], r["dst"])] = min(r["cost"], best.get((r["src"], r["dst"]), 1e9))
    for (o, d), (cost, path) in b.items():
        assert path[0] == o and path[-1] == d and sum(best[x] for x in zip(path, path[1:])) == cost
