"""Metadata rules and package exports."""

import sqlite3
from datetime import datetime
from xml.etree import ElementTree

from airloom.operators import metadata_rules as m
from airloom.sinks import packages

D = lambda n: datetime(2025, 1, n)


def found(df):
    return {(r["rule"], r["id"], r["severity"]) for r in df.collect()}


def test_metadata_rules(spark):
    e = spark.createDataFrame([(1, "Rollback", "c", None), (2, "What", "c", None), (3, "Rollback", "c", "b")], "id long, kind string, cycle_id string, restored_cycle_id string")
    assert found(m.cycle_events(e)) == {(15, "1", "error"), (15, "2", "error")}
    v = spark.createDataFrame([(1, "Baseline", "Partial", "a" * 64), (2, "x", None, "a")], "id long, revision_kind string, coverage string, content_sha256 string")
    assert m.dataset_versions(v).count() == 3 and {r["id"] for r in m.dataset_versions(v).collect()} == {"2"}
    t = spark.createDataFrame([("airports", "n:1", "P"), ("airports", "q:1", "P"), ("huh", "n:1", "Z")], "entity_table string, entity_id string, provider string")
    got = found(m.tombstones(t, spark.createDataFrame([("P", "n")], "provider string, namespace string"), spark.createDataFrame([("airports", "n:1")], "entity_table string, id string")))
    assert got == {(18, "q:1", "error"), (18, "q:1", "warning"), (18, "n:1", "error")}
    p = spark.createDataFrame([("a", "c1", "Baseline", D(1)), ("b", "c1", "Baseline", D(2)), ("c", "c1", "Correction", D(1)), ("d", "zz", "Baseline", D(1))], "publication_id string, airac_cycle string, revision_kind string, valid_from timestamp")
    assert found(m.publication_dates(p, spark.createDataFrame([("c1", D(1))], "id string, effective_from timestamp"))) == {(20, "b", "error"), (20, "d", "error")}
    a = spark.createDataFrame([("a", "Baseline", "FullSnapshot", D(1), 5), ("b", "Baseline", "Partial", D(2), 5), ("c", "x", "FullSnapshot", D(9), 0)], "publication_id string, kind string, coverage string, valid_from timestamp, rows_closed int")
    assert found(m.applications(a, p)) == {(21, "b", "error"), (22, "c", "error"), (23, "c", "error"), (23, "d", "error")}
    mem = spark.createDataFrame([("C1", "airport", "n:1", D(1), None), ("C2", "airport", "n:1", D(1), None), ("C1", "airport", "q:9", D(5), D(4)), ("C1", "airport", "n:2", D(2), None)], "canonical_id string, kind string, entity_id string, valid_from timestamp, valid_until timestamp")
    src = spark.createDataFrame([("n:1", D(1), None, "K1", 0.0, 0.0), ("n:2", D(1), None, "K2", 20.0, 0.0)], "id string, valid_from timestamp, valid_until timestamp, region string, lat double, lon double")
    got = found(m.memberships(mem, spark.createDataFrame([("C1", "airport"), ("C2", "navaid")], "canonical_id string, kind string"), src))
    assert got == {(24, "q:9", "error"), (25, "C2", "error"), (26, "n:1", "error"), (28, "C1", "warning"), (29, "n:2", "error")}
    c = spark.createDataFrame([(1, "error", "open", "k"), (2, "bad", "open", "")], "id long, severity string, status string, conflict_key string")
    assert found(m.conflicts(c)) == {(27, "2", "error"), (30, "2", "error")}
    i = spark.createDataFrame([("A", "I1", "09", "L1", 90.0, 3.0), ("A", "I2", "10", "L2", 400.0, 0.5)], "airport_ident string, approach_ident string, runway string, localizer_ident string, bearing_mag_deg double, glideslope_deg double")
    got = found(m.ils(i, spark.createDataFrame([("L1", "A")], "ident string, associated_airport string"), spark.createDataFrame([("A", "09", "27")], "airport_ident string, le_ident string, he_ident string")))
    assert got == {(31, "A/I2", "error"), (31, "A/I2", "warning")}
    assert found(m.aliases(spark.createDataFrame([("airports", "x"), ("q", "y")], "entity_table string, entity_id string"))) == {(17, "y", "error")}


def test_packages(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", D(1)) for i in range(50)], "id long, name string, at timestamp")
    assert packages.sqlite(str(tmp_path / "w.sqlite"), {"t": df, "none": df.limit(0)}) == {"t": 50, "none": 0}
    assert sqlite3.connect(tmp_path / "w.sqlite").execute("select count(*), max(id) from t").fetchone() == (50, 49)
    legs = spark.createDataFrame([("A", "D", "P<1", "", 20, "B", "TF", None, None), ("A", "D", "P<1", "", 10, "A&", "IF", 3000, None), ("A", "F", "I09", "", 10, "X", "PT", None, None)], "airport_ident string, procedure_kind string, procedure_ident string, transition_ident string, sequence_number int, fix_ident string, path_terminator string, altitude_1_ft int, altitude_2_ft int")
    xml, skipped = packages.procedure_xml(legs)
    root = ElementTree.fromstring(xml.first()["value"])
    assert [(x.get("type"), x.get("fixIdent")) for x in root.iter("Leg")] == [("IF", "A&"), ("TF", "B")] and root[0].get("name") == "P<1" and skipped.count() == 1
    state = spark.createDataFrame([(1, "AAAA", 1.0, 2.0, 9000.0, 250.0, "cruise", 120.0, 0.01)], "session_id long, destination string, lat double, lon double, altitude double, speed double, phase string, to_go double, xtk_nm double")
    w = spark.createDataFrame([("AAAA", D(1), "IFR", 5), ("AAAA", D(2), "VFR", 9)], "station string, observed_at timestamp, category string, wind_kt int")
    s = packages.session_snapshot(state, w, spark.createDataFrame([("AAAA", "TWR", "AAAA_TWR")], "airport string, facility string, callsign string"))
    assert s.first()["weather"]["category"] == "VFR" and packages.compact(s).first()["briefing"] == "cruise, 120 NM to go, on track, destination VFR"
