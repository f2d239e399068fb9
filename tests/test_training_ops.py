"""The general operators for training data on small fixtures: edge cases, hot keys, and brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airloom.operators import history, nearby, reconcile, references, rejects, skew, snapshot_diff

T0 = datetime(2025, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


FETCHED = "source_snapshot_id string, provider_name string, dataset_name string, content_sha256 string, retrieved_at timestamp_ntz, coverage string, valid_from timestamp_ntz"
ROWS = "row_id long, source_snapshot_id string, record_id string, ident string, name string, navaid_type string, frequency_khz int, latitude_deg double, longitude_deg double, elevation_ft double, iso_country string, associated_airport string"


def drow(i, snap, rec, name="A", lat=1.0, elev=None, apt=None):
    return (i, snap, rec, "X", name, "VOR", 110_000, lat, 2.0, elev, "XA", apt)


def test_snapshot_changes(spark):
    fetched = spark.createDataFrame(
        [
            ("s1", "P", "nav", "sha256:AA", day(1), "FullSnapshot", day(10)), ("s2", " p ", "NAV", "bb", day(2), "full_snapshot", day(20)),
            ("s2again", "p", "nav", "BB", day(3), "FULL", day(20)), ("part", "p", "nav", "cc", day(4), "partial", day(25)),
            ("s3", "p", "nav", "dd", day(5), "Full Snapshot", None), ("other", "q", "nav", "ee", day(1), "full", None), ("n1", "p", "nav", None, day(40), "full", None),
        ],
        FETCHED,
    )
    rows = spark.createDataFrame(
        [
            drow(1, "s1", "a"), drow(2, "s1", "b"), drow(3, "s1", "c", lat=1.0), drow(4, "s1", "d", apt=""), drow(5, "s1", " E "),
            drow(6, "s2", "A", name="a "), drow(7, "s2", "a", name="zzz"), drow(8, "s2", "c", lat=1.00001), drow(9, "s2", "d"), drow(10, "s2", "e", lat=1.000009), drow(11, "s2", "f"),
            drow(12, "s2again", "zzz"), drow(13, "part", "yyy"), drow(14, "n1", "a", elev=5.0), drow(15, "s1", None), drow(16, "gone", "a"),
        ],
        ROWS,
    ).withColumn("d1", F.lit("clash")).withColumn("seq", F.lit(9))
    got = {tuple(r) for r in snapshot_diff.navaid_changes(rows, fetched).select("source_snapshot_id", "record_id", "change_kind").collect()}
    # s3 comes before s1 as it counts from its retrieval, and has no rows: all of s1 is added
    assert got == {
        *[("s1", k, "added") for k in "abcde"], ("s2", "b", "removed"), ("s2", "c", "changed"), ("s2", "f", "added"),
        ("n1", "a", "changed"), *[("n1", k, "removed") for k in "cdef"],
    }


def test_snapshot_changes_name_the_fields(spark):
    fetched = spark.createDataFrame([(f"s{i}", "p", "n", str(i), day(i), "full", day(i)) for i in (1, 2)], FETCHED)
    rows = spark.createDataFrame([drow(1, "s1", "a"), drow(2, "s2", "a", name="B", lat=2.0, elev=5.0), drow(3, "s1", "b", apt=""), drow(4, "s2", "b"), drow(5, "s1", "c"), drow(6, "s2", "d")], ROWS)
    got = {(r["source_snapshot_id"], r["record_id"], r["change_kind"], ",".join(r["fields"])) for r in snapshot_diff.navaid_changes(rows, fetched, fields=True).collect()}
    assert got == {("s2", "a", "changed", "name,elevation_ft,latitude_deg"), ("s2", "c", "removed", ""), ("s2", "d", "added", "")}


def test_snapshot_changes_empty(spark):
    assert snapshot_diff.navaid_changes(spark.createDataFrame([], ROWS), spark.createDataFrame([], FETCHED)).count() == 0


def brute_changes(deliveries):
    out = set()
    for s in range(1, len(deliveries)):
        a, b = deliveries[s - 1], deliveries[s]
        out |= {(s, k, "added") for k in b.keys() - a.keys()} | {(s, k, "removed") for k in a.keys() - b.keys()}
        out |= {(s, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def test_snapshot_changes_brute_force(spark):
    rnd = random.Random(7)
    deliveries = [{f"k{i}": rnd.choice("AB") for i in range(60) if rnd.random() < 0.7} for _ in range(6)]
    fetched = spark.createDataFrame([(f"s{i}", "p", "n", str(i), day(i), "full", day(i)) for i in range(6)], FETCHED)
    rows = [drow(0, f"s{i}", k, name=v) for i, d in enumerate(deliveries) for k, v in d.items() for _ in range(3 if k == "k1" else 1)]
    rows = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], ROWS)
    got = {(int(r[0][1:]), r[1], r[2]) for r in snapshot_diff.navaid_changes(rows, fetched).select("source_snapshot_id", "record_id", "change_kind").collect()}
    assert got == brute_changes(deliveries)


UPD = "update_id long, airport_id string, name string, airport_type string, elevation_ft double, municipality string, valid_from timestamp_ntz, valid_until timestamp_ntz, withdrawn boolean, source_snapshot_id string"
SNAP = "snapshot_id string, retrieved_at timestamp_ntz"


def upd(i, a, f, u=None, name="N", elev=1.0, w=False, s="s1"):
    return (i, a, None if w else name, None, None if w else elev, None, day(f), None if u is None else day(u), w, s)


def fmt(n):
    return "open" if n is None else day(n).strftime("%Y-%m-%d %H:%M:%S")


def brute_history(rows, got_at):
    best = {}
    for r in rows:
        if r[7] is not None and r[7] <= r[6]:
            continue
        k = (r[1], r[6])
        o = (got_at.get(r[9], datetime.min), r[0])
        if k not in best or o > best[k][0]:
            best[k] = (o, r)
    out = set()
    for a in {k[0] for k in best}:
        seq = [best[k][1] for k in sorted(k for k in best if k[0] == a)]
        runs = []
        for i, r in enumerate(seq):
            end = min([x for x in (r[7], seq[i + 1][6] if i + 1 < len(seq) else None) if x is not None], default=None)
            if r[8]:
                continue
            pay = ((r[2] or "").lower().strip() or None, r[3], r[4], r[5])
            if runs and runs[-1][1] == r[6] and runs[-1][2] == pay:
                runs[-1][1] = end
            else:
                runs.append([r[6], end, pay])
        out |= {(a, f.strftime("%Y-%m-%d %H:%M:%S"), "open" if u is None else u.strftime("%Y-%m-%d %H:%M:%S")) for f, u, _ in runs}
    return out


def test_history_cases(spark):
    rows = [
        upd(1, "a", 1), upd(2, "a", 10, name=" n "), upd(3, "a", 20, name="M"), upd(4, "a", 30, w=True), upd(5, "a", 40, 45, name="M"), upd(6, "a", 50, name="M"),
        upd(7, "b", 5, 5), upd(8, "b", 5, 3), upd(9, "c", 1, elev=math.nan), upd(10, "c", 2, elev=None), upd(11, "d", 1, s="s1", name="late"), upd(12, "d", 1, s="s2", name="later"), upd(13, "d", 2, name="LATER"),
    ]
    snaps = spark.createDataFrame([("s1", day(100)), ("s2", day(200))], SNAP)
    got = {tuple(r) for r in history.airport_history(spark.createDataFrame(rows, UPD).withColumn("prev", F.lit(1)), snaps).collect()}
    assert got == {
        ("a", fmt(1), fmt(20)), ("a", fmt(20), fmt(30)), ("a", fmt(40), fmt(45)), ("a", fmt(50), "open"), ("c", fmt(1), "open"), ("d", fmt(1), "open"),
    }


def test_history_brute_force_with_hot_key(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        a = "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}"
        f = rnd.randrange(400)
        rows.append(upd(i, a, f, rnd.choice([None, None, None, f + rnd.randrange(-2, 30)]), rnd.choice(["N", "n ", "M"]), rnd.choice([1.0, 2.0, None]), rnd.random() < 0.1, rnd.choice(["s1", "s2", "s3"])))
    snaps = spark.createDataFrame([("s1", day(1)), ("s2", day(2))], SNAP)
    df = spark.createDataFrame(rows, UPD)
    want = brute_history(rows, {"s1": day(1), "s2": day(2)})
    for hot in (10**9, 100):
        assert {tuple(r) for r in history.airport_history(df, snaps, hot_rows=hot).collect()} == want


def test_vault_satellites(spark):
    rows = [upd(1, "a", 1), upd(2, "a", 2, elev=2.0), upd(3, "a", 3, elev=3.0), upd(4, "a", 4, elev=3.0)]
    v = history.build_vault(spark.createDataFrame(rows, UPD), spark.createDataFrame([("s1", day(1))], SNAP))
    assert v.split["fast"] == ["elevation_ft"] and v.satellite("fast").count() == 3 and v.satellite("slow").count() == 1 and v.hub().count() == 1


def test_history_loaded_in_parts(spark):
    """Loads in any order end in the history of all updates; what is stored never changes, and again appends nothing."""
    rnd = random.Random(12)
    rows = [upd(i, f"k{rnd.randrange(20)}", rnd.randrange(60), rnd.choice([None, None, rnd.randrange(80)]), rnd.choice(["N", "M"]), rnd.choice([1.0, 2.0]), rnd.random() < 0.1, rnd.choice(["s1", "s2"])) for i in range(300)]
    snaps = spark.createDataFrame([("s1", day(1)), ("s2", day(2))], SNAP)
    rnd.shuffle(rows)
    parts = [rows[:120], rows[120:125], rows[125:]]
    stored, split, log = None, None, None
    for n, part in enumerate(parts, 1):
        new = spark.createDataFrame(part, UPD)
        got, split = history.load(stored, log, new, snaps, n, split)
        got = {k: history.cut(v) for k, v in got.items()}
        if n == 2:
            touched = {r[1] for r in part}
            assert {r["airport_id"] for v in got.values() for r in v.collect()} <= touched
        stored = got if stored is None else {k: stored[k].unionByName(got[k]) for k in got}
        log = new if log is None else log.unionByName(new)
        have = {(r["airport_id"], fmt(None) if r["valid_from"] is None else r["valid_from"].strftime("%Y-%m-%d %H:%M:%S"), "open" if r["valid_until"] is None else r["valid_until"].strftime("%Y-%m-%d %H:%M:%S")) for r in history.stored_versions(stored).collect()}
        assert have == brute_history([r for p in parts[:n] for r in p], {"s1": day(1), "s2": day(2)})
    again, _ = history.load(stored, log, spark.createDataFrame(parts[1], UPD), snaps, 9, split)
    assert all(v.count() == 0 for v in again.values())


def test_history_empty(spark):
    assert history.airport_history(spark.createDataFrame([], UPD), spark.createDataFrame([], SNAP)).count() == 0


def test_neighbours_of_hot_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 9).cast("string"))).alias("k"), F.col("id").alias("o"))
    a = {tuple(map(str, r)) for r in skew.with_neighbours(df, ["k"], "o", ["o"], ["o"], 10**9).collect()}
    b = {tuple(map(str, r)) for r in skew.with_neighbours(df, ["k"], "o", ["o"], ["o"], 100).collect()}
    assert a == b and len(a) == 1000


def test_orphans(spark):
    refs = spark.createDataFrame(
        [("t", "f", 1, "x", "A", day(5)), ("t", "f", 2, "x", "A", day(10)), ("t", "f", 3, "x", "A", day(1)), ("t", "f", 4, "x", "Q", day(5)), ("t", "f", 5, "x", "A", day(12)), ("t", "f", 1, "x", "A", day(5)), ("t", "f", 6, "x", "B", day(30)), ("t", "f", 7, "x", "A", day(22))],
        "table_name string, field_name string, row_key long, target string, key string, at timestamp_ntz",
    )
    held = spark.createDataFrame([("x", "A", day(2), day(10)), ("x", "A", day(20), day(99)), ("x", "A", day(2), day(10)), ("x", "B", day(1), day(30))], "target string, key string, at timestamp_ntz, ends timestamp_ntz")
    want = {(2, "gap"), (3, "late"), (4, "missing"), (5, "gap"), (6, "deleted")}
    for hot in (10**9, 2):
        assert {(r["row_key"], r["reason"]) for r in references.orphans(refs, held, hot).collect()} == want


def test_reference_keys(spark):
    charts = spark.createDataFrame([(1, " cht-1 ", day(1)), (2, "", day(1)), (3, None, day(1)), (4, "CHT-2", None), (5, " CHT-1", day(1))], "assoc_id long, chart_id string, valid_from timestamp_ntz")
    from airloom.tables import key_text

    r = references.references(charts, "c", "chart_id", "assoc_id", "chart", key_text("chart_id")).collect()
    assert {(x["row_key"], x["key"]) for x in r} == {(1, "CHT-1"), (5, "CHT-1")}


GOOD = '1,2,ABCD,5000,75,GRS,1,0,09,1,2,,90.3,,27,1,2,,270.3,'
NAV = '1,F,ABC,"NAME, X",{},{},1,2,3,XA,,,,,,,,HI,LOW,'
LINES = [
    (GOOD, "runways", None), (GOOD + "\r\n", "runways", None), (GOOD.replace("GRS", '"Turf, ""soft"""'), "runways", None), (GOOD.replace("GRS", '"a\nb"'), "runways", None), (GOOD.replace("GRS", '""'), "runways", None),
    (GOOD.replace("GRS", 'G"RS'), "runways", "quoting"), (GOOD.replace("GRS", '"GRS'), "runways", "quoting"), (GOOD.replace("GRS", '"GRS" x'), "runways", "quoting"), (GOOD.replace("GRS", ' "GRS"'), "runways", "quoting"),
    (GOOD + ",", "runways", "column_count"), ("", "runways", "column_count"), (None, "navaids", "column_count"), ('"', "runways", "quoting"), ('""', "runways", "column_count"),
    (GOOD.replace("90.3", " 90.3 "), "runways", None), (GOOD.replace("90.3", ""), "runways", None), (GOOD.replace("90.3", "  "), "runways", None), (GOOD.replace("90.3", "360.1"), "runways", "value"), (GOOD.replace("90.3", "-1"), "runways", "value"),
    (GOOD.replace("90.3", "90."), "runways", "value"), (GOOD.replace("90.3", ".5"), "runways", "value"), (GOOD.replace("90.3", "N/A"), "runways", "value"), (GOOD.replace("5000", "0"), "runways", "value"), (GOOD.replace("5000", "30001"), "runways", "value"),
    (GOOD.replace("5000", ""), "runways", "value"), (GOOD.replace("5000", "5e3"), "runways", "value"), (GOOD.replace("5000", "9" * 500), "runways", "value"), (GOOD.replace("5000", '"5000"'), "runways", None),
    (NAV.format("NDB", 190), "navaids", None), (NAV.format(" ndb-dme ", 1800), "navaids", None), (NAV.format("NDB", 189), "navaids", "value"), (NAV.format("VOR", 117999), "navaids", None), (NAV.format("VOR", 500), "navaids", "value"), (NAV.format("", 110000), "navaids", None),
    (NAV.format("VOR", "115.95"), "navaids", "value"), ("x,y", "other", "column_count"), (GOOD, "other", None),
    ('"' + 'x""' * 50_000 + '"' + "," * 19, "other", None),
]


def test_rejects(spark):
    df = spark.createDataFrame([(i, d, t) for i, (t, d, _) in enumerate(LINES)], "line_id long, dataset_name string, raw_line string").withColumn("cell", F.lit(1)).withColumn("reason", F.lit("clash"))
    clean, bad = rejects.split_lines(df)
    got = {r["line_id"]: r["reason"] for r in bad.collect()}
    assert got == {i: r for i, (_, _, r) in enumerate(LINES) if r}
    cells = {r["line_id"]: list(r["cells"]) for r in clean.collect()}
    assert cells.keys() == {i for i, (_, _, r) in enumerate(LINES) if not r}
    assert cells[2][5] == 'Turf, "soft"' and cells[3][5] == "a\nb" and cells[4][5] == "" and len(cells[len(LINES) - 1][0]) == 100_000


def test_rejects_leave_cells_as_they_are(spark):
    odd = ["a\u0001b", "\u0002", "\u0002a\u0001\u0002b", "\ufffd", '"x\u0001,\u0002y"']
    df = spark.createDataFrame([(i, "other", ",".join([c, *"x" * 19])) for i, c in enumerate(odd)], "line_id long, dataset_name string, raw_line string")
    clean, bad = rejects.split_lines(df)
    assert bad.count() == 0 and {r["line_id"]: r["cells"][0] for r in clean.collect()} == {i: c.strip('"') for i, c in enumerate(odd)}


def test_rejects_parse_once(spark):
    df = spark.createDataFrame([(1, "runways", GOOD)], "line_id long, dataset_name string, raw_line string")
    plan = rejects.failures(df, rejects.rule_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("raw_line") > 0 and plan.count("Union") == 0


def test_rejects_empty(spark):
    clean, bad = rejects.split_lines(spark.createDataFrame([], "line_id long, dataset_name string, raw_line string"))
    assert clean.count() == 0 and bad.count() == 0


def brute_pairs(pts, km):
    out = set()
    for i, (a, la, oa) in enumerate(pts):
        for b, lb, ob in pts[i + 1 :]:
            if a == b:
                continue
            h = math.sin(math.radians(la - lb) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(oa - ob) / 2) ** 2
            if 2 * 6371.0088 * math.asin(min(1, math.sqrt(h))) <= km:
                out.add((min(a, b), max(a, b)))
    return out


def cloud(seed):
    rnd = random.Random(seed)
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(200)]
    for c, (la, lo) in enumerate([(0.0, 179.999), (0.0, -179.99), (89.99, 10.0), (-89.999, 0.0), (48.0, 11.0), (60.0, -180.0), (10.0, 180.0), (-0.001, 0.001)]):
        pts += [(1000 * (c + 1) + i, max(-90, min(90, la + rnd.gauss(0, 0.015))), (lo + rnd.gauss(0, 0.02) + 180) % 360 - 180) for i in range(60)]
    pts += [(90_001, 90.0, 5.0), (90_002, 90.0, -170.0), (90_003, 12.0, 180.0), (90_004, 12.0, -180.0), (90_005, 12.0, 180.0)]
    return [(i, float(a), float(o)) for i, a, o in pts]


@pytest.mark.parametrize("km", [2.0, 25.0])
def test_near_pairs_brute_force(spark, km):
    pts = cloud(int(km))
    df = spark.createDataFrame(pts + pts[:50], "id long, lat double, lon double")
    want = brute_pairs(pts, km)
    for rows in (10**9, 20):
        got = [tuple(r) for r in nearby.near_pairs(df, km, rows).select("id_a", "id_b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_pairs_over_the_antimeridian(spark):
    """At a latitude where blocks of a fixed width leave a last one narrower than reach, and at many others."""
    pts = [(1, -19.3513, 179.9913), (2, -19.3513, -179.998)]
    for i in range(400):
        lat = -80.0 + i * 0.4
        dx = math.degrees(1.0 / nearby.EARTH_KM) / math.cos(math.radians(lat))
        pts += [(10 + 2 * i, lat, 180 - dx * 0.85), (11 + 2 * i, lat, -180 + dx * 0.85)]
    got = {tuple(r) for r in nearby.near_pairs(spark.createDataFrame(pts, "id long, lat double, lon double"), 2).select("id_a", "id_b").collect()}
    assert got == {(1, 2)} | {(10 + 2 * i, 11 + 2 * i) for i in range(400)}


def test_fallback_pairs(spark):
    """Ids of one parity are compared, the whole ident is the key, strict pairs are out, partners count over providers."""
    rows = [
        ("a", "2", "vor:ABC", None, 10.0, 20.0), ("b", "4", "vor:ABC", "XA", 10.01, 20.0), ("b", "6", "vor:ABX", "XA", 10.01, 20.0), ("a", "8", "ndb:Q", "XA", 1.0, 1.0), ("b", "10", "ndb:Q", " xa", 1.0, 1.0),
        ("b", "12", "ndb:Q", None, 1.1, 1.0), ("c", "14", "ndb:Q", None, 1.2, 1.0), ("c", "16", "vor:ABC", "XZ", 50.0, 20.0),
    ]
    got = {(r["id_a"], r["id_b"]): (r["partners_a"], r["partners_b"], r["outcome"]) for r in reconcile.fallback_pairs(spark.createDataFrame(rows, "provider string, id string, key string, region string, lat double, lon double")).collect()}
    assert got == {
        ("2", "4"): (1, 1, "exact"), ("2", "16"): (1, 0, "distinct"), ("4", "16"): (1, 0, "distinct"),
        ("8", "12"): (2, 1, "ambiguous"), ("8", "14"): (2, 2, "ambiguous"), ("10", "14"): (1, 2, "ambiguous"),
    }


def test_near_pairs_share_a_dense_block(spark, monkeypatch):
    """The largest number of candidates that one task looks at falls with the number of shares, and no pair is lost."""
    rnd = random.Random(1)
    pts = [(i, 48.0 + rnd.random() * 0.02, 11.0 + rnd.random() * 0.02) for i in range(400)] + [(1000 + i, 48.01, 11.01) for i in range(60)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    want = brute_pairs(pts, 2)
    seen = {}
    for rows in (10**9, 60, 5):
        clean = df.withColumn("moves", F.lit(False))
        marked = nearby._blocks(clean, 2.0)
        marked, shares = skew.parts(marked, ["strip", "block"], skew.hot_keys(marked, ["strip", "block"], rows), rows)
        dealt = marked.filter("own").select("strip", "block", F.pmod(F.xxhash64("id", "x"), shares).alias("share"), "x", "id").toPandas()
        every = marked.select("strip", "block", "x", "id").toPandas()
        work = {}
        for s, b, k, x, i in dealt.itertuples(index=False):
            near = every[(every.strip == s) & (every.block == b)]
            work[(s, b, k)] = work.get((s, b, k), 0) + int((((near.x > x) | ((near.x == x) & (near.id > i))) & (near.x <= x + 0.03)).sum())
        seen[rows] = max(work.values())
        got = [tuple(r) for r in nearby.near_pairs(df, 2, rows).select("id_a", "id_b").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert seen[60] < seen[10**9] / 4 and seen[5] < seen[60] / 4


def test_near_pairs_of_one_id_with_very_many_positions(spark):
    pts = [(1, 10.0 + i * 0.001, 20.0) for i in range(500)] + [(2, 10.2, 20.001), (3, -5.0, 1.0)]
    got = nearby.near_pairs(spark.createDataFrame(pts * 2, "id long, lat double, lon double"), 2, 50).collect()
    assert [(r["id_a"], r["id_b"]) for r in got] == [(1, 2)] and got[0]["km"] < 0.2


def test_containing_brute_force(spark):
    rnd = random.Random(6)
    rings = {f"r{k}": [(la + rnd.uniform(2, 9) * math.sin(t), lo + rnd.uniform(2, 9) * math.cos(t)) for t in (i * math.pi / 6 for i in range(12))] for k, (la, lo) in enumerate([(0, 0), (3, 4), (50, -100), (-70, 160)])}
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(200)] + [(1000 + i, rnd.uniform(-12, 15), rnd.uniform(-12, 15)) for i in range(300)] + [(5000, None, 1.0), (5001, 99.0, 1.0), (None, 1.0, 1.0)]

    def inside(ring, lat, lon):
        odd = False
        for (a, x), (b, y) in zip(ring, ring[1:] + ring[:1]):
            if (a <= lat) != (b <= lat) and x + (lat - a) / (b - a) * (y - x) <= lon:
                odd = not odd
        return odd

    want = {(i, k) for i, la, lo in pts[:500] for k, r in rings.items() if inside(r, la, lo)}
    regions = spark.createDataFrame([(k, [(float(a), float(b)) for a, b in r]) for k, r in rings.items()] + [("line", [(0.0, 0.0), (1.0, 1.0)]), ("none", None)], "region_id string, ring array<struct<lat: double, lon: double>>")
    df = spark.createDataFrame(pts + pts[:40], "id long, lat double, lon double").withColumn("strip", F.lit(1))
    got = [tuple(r) for r in nearby.containing(df, regions.union(regions.limit(1))).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert nearby.containing(df, regions.limit(0)).count() == 0 and nearby.containing(df.limit(0), regions).count() == 0


def test_any_number_of_hot_keys(spark):
    """Sixty keys above the bound, none of them special: neighbours and orphans are as without any."""
    df = spark.range(6000).select(F.concat(F.lit("k"), F.col("id") % 60).alias("k"), F.col("id").alias("o"))
    a = {tuple(map(str, r)) for r in skew.with_neighbours(df, ["k"], "o", ["o"], ["o"], 10**9).collect()}
    b = {tuple(map(str, r)) for r in skew.with_neighbours(df, ["k"], "o", ["o"], ["o"], 20).collect()}
    assert a == b and len(a) == 6000
    hot = skew.hot_keys(df, ["k"], 20)
    assert hot.count() == 60
    marked, parts = skew.parts(df, ["k"], hot, 20)
    assert {r[0] for r in marked.select(parts).distinct().collect()} == {5}
    refs = spark.createDataFrame([("t", "f", i, "x", f"K{i % 60}", day(i % 40)) for i in range(1200)], "table_name string, field_name string, row_key long, target string, key string, at timestamp_ntz")
    held = spark.createDataFrame([("x", f"K{i}", day(10), day(30)) for i in range(0, 60, 2)], "target string, key string, at timestamp_ntz, ends timestamp_ntz")
    got = [{tuple(r) for r in references.orphans(refs, held, n).collect()} for n in (10**9, 3)]
    assert got[0] == got[1] and got[0]


def test_near_pairs_dirt(spark):
    bad = [(1, None, 1.0), (2, 1.0, None), (3, 0.0, 0.0), (4, 91.0, 0.0), (5, 1.0, 181.0), (6, math.nan, 1.0), (7, 0.0, 1.0), (7, 0.0, 1.001), (8, 0.0, 1.002), (None, 0.0, 1.0)]
    got = [tuple(r) for r in nearby.near_pairs(spark.createDataFrame(bad, "id long, lat double, lon double").withColumn("x", F.lit(1)), 2).select("id_a", "id_b").collect()]
    assert got == [(7, 8)]
    assert nearby.near_pairs(spark.createDataFrame([], "id long, lat double, lon double"), 2).count() == 0
