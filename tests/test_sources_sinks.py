"""Sources from small files, sinks to text, geometry, tracking and streaming."""

import json
import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloom.functions import geo, magnetic, text
from airloom.operators import correlate, procedures, tracking
from airloom.plans import planner
from airloom.schemas import DDL, schema
from airloom.sinks import text_layers as sink
from airloom.sources import arinc, csv_tables, documents
from airloom.streaming import telemetry

L = F.lit


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_schemas(spark):
    assert all(schema(n).fields for n in DDL)


def test_geometry(spark):
    nm, km, brg = one(spark, geo.haversine_nm(L(0.0), L(0.0), L(0.0), L(1.0)), geo.haversine_km(L(0.0), L(0.0), L(1.0), L(0.0)), geo.bearing(L(0.0), L(0.0), L(0.0), L(-1.0)))
    assert nm == pytest.approx(60.0405, abs=1e-3) and km == pytest.approx(111.19508, abs=1e-3) and brg == pytest.approx(270)
    p = one(spark, geo.direct_point(L(10.0), L(20.0), L(45.0), L(100.0)))[0]
    back = one(spark, geo.haversine_nm(L(10.0), L(20.0), L(p["lat"]), L(p["lon"])))[0]
    assert back == pytest.approx(100, abs=1e-6)
    off = one(spark, geo.track_offsets(L(1.0), L(1.0), L(0.0), L(0.0), L(0.0), L(2.0)))[0]
    assert off["cross_nm"] == pytest.approx(-60.04, abs=0.05) and off["along_nm"] == pytest.approx(60.04, abs=0.05)
    ring = F.array(*[F.struct(L(x).alias("lon"), L(y).alias("lat")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    path = lambda *p: F.array(*[F.struct(L(x).alias("lon"), L(y).alias("lat")) for x, y in p])
    got = one(
        spark, geo.in_polygon(L(1.0), L(1.0), ring), geo.in_polygon(L(5.0), L(1.0), ring), geo.corridor_hits(path((-1.0, 2.0), (9.0, 2.0)), ring, 1.0), geo.corridor_hits(path((-5.0, -5.0), (-4.0, -5.0)), ring, 10.0),
        geo.corridor_hits(path((-0.1, -0.1), (-9.0, -9.0)), ring, 10.0), geo.in_polygon(L(1.0), L(1.0), F.slice(ring, 1, 2)),
    )
    assert list(got) == [True, False, True, False, True, False]
    arc = one(spark, geo.arc_points(L(0.0), L(0.0), L(10.0), L(350.0), L(20.0), L(True)), geo.arc_points(L(0.0), L(0.0), L(10.0), L(0.0), L(1.0), L(True)))
    assert len(arc[0]) == 7 and len(arc[1]) == 2
    t = [0.01, 0.0, 5.0, 0.0, -0.02, 50.0]
    g = one(spark, geo.affine(L(100.0), L(200.0), t))[0]
    px = one(spark, geo.affine_inverse(L(g["lon"]), L(g["lat"]), t))[0]
    assert px["x"] == pytest.approx(100) and px["y"] == pytest.approx(200)


def test_vincenty_known_pairs():
    # Flinders Peak to Buninyong, the usual check of the inverse formula, and simple arcs of WGS84
    d = lambda g, m, s: math.copysign(abs(g) + m / 60 + s / 3600, g)
    nm, _ = geo.vincenty([d(-37, 57, 3.72030)], [144 + 25 / 60 + 29.52440 / 3600], [d(-37, 39, 10.15610)], [143 + 55 / 60 + 35.38390 / 3600])
    assert nm[0] * 1852 == pytest.approx(54_972.271, abs=0.1)
    nm, brg = geo.vincenty([0, 0, 10, 0], [0, 0, 20, 0], [0, 1, 10, 0.3], [1, 0, 20, 179.7])
    assert nm[0] * 1852 == pytest.approx(111_319.4908, abs=1e-3) and nm[1] * 1852 == pytest.approx(110_574.3886, abs=1e-3) and nm[2] == 0 and np.isfinite(nm[3]) and brg[0] == pytest.approx(90)


def test_magnetic_low_degrees_and_range(tmp_path):
    r = magnetic.evaluate(magnetic.Model(magnetic.LOW), 2025.0, 0.0, [80.0, 0.0, 0.0], [0.0, 120.0, 500.0])
    assert np.isnan(r["f"][2]) and 20_000 < r["f"][1] < 70_000 and r["inclination"][0] > 70
    assert np.isnan(magnetic.evaluate(magnetic.Model(magnetic.LOW), 2031.0, 0.0, 0.0, 0.0)["f"]).all()
    # a dipole along the axis: no declination, and tan(inclination) = 2 tan(geocentric latitude)
    (tmp_path / "m.cof").write_text("2025.0 T 1\n1 0 -30000.0 0.0 0.0 0.0\n999999\n")
    d = magnetic.evaluate(magnetic.Model.read(str(tmp_path / "m.cof")), 2026.0, 0.0, 45.0, 10.0)
    assert abs(d["declination"][0]) < 1e-9 and d["inclination"][0] == pytest.approx(63.4, abs=0.5)


def test_text_functions(spark):
    got = one(
        spark, text.dms(L("N48213000")), text.dms(L("W123000000")), text.dms(L("X")), text.dms_suffix(L("490035.00N")), text.magnetic_variation(L("W0123")), text.magnetic_variation(L("E01234")), text.waypoint_type(L("W  ")),
        text.reciprocal_designator(L("10L")), text.reciprocal_designator(L("18")), text.reciprocal_designator(L("36C")), text.procedure_fits_runway(L("RW09B"), L("09R")), text.procedure_fits_runway(L("09L"), L("09R")),
        text.cycle_label(text.cycle_index(L("2020-01-30").cast("date"))), text.cycle_label(text.cycle_index(L("2020-01-29").cast("date"))), text.cycle_from_label(L("AIRAC 25/03")), text.flight_category(L(None).cast("int"), L(None).cast("double")), text.flight_category(L(400), L(9.0)),
        text.callsign_airport(L("LAX_APP")), text.callsign_airport(L("EDDM_TWR")), text.altitude_ft(L("FL350")), text.altitude_ft(L("9000")), text.escape_html(L("<a & 'b'>")), text.facility(L("EDDM_TWR")), text.runway_in_title(L("ILS RWY 27L CAT II")),
    )
    assert list(got) == [
        pytest.approx(48.358333, abs=1e-6), -123.0, None, pytest.approx(49.009722, abs=1e-6), -12.3, 12.34, 87 + 32 * 256 + 32 * 65536, "28R", "36", "18C", True, False, "2001", "1913", 67, "VFR", "LIFR", "KLAX", "EDDM", 35_000, 9000, "&lt;a &amp; &#39;b&#39;&gt;", "TWR", "27L",
    ]
    a = one(spark, *[text.altitude_constraint(L(x)) for x in ("+3000", "-FL100", "2000-FL080", "5000", "junk")])
    assert [(x["kind"], x["lo"], x["hi"]) for x in a] == [("AT_OR_ABOVE", 3000, None), ("AT_OR_BELOW", None, 10_000), ("BETWEEN", 2000, 8000), ("AT", 5000, 5000), (None, None, None)]
    c = one(spark, text.dual_course(L("63 (074.5)")), text.distance_or_time(L("18.52 km")), text.distance_or_time(L("2 MIN")))
    assert (c[0]["magnetic"], c[0]["true"], c[1]["nm"], c[2]["minutes"]) == (63.0, 74.5, pytest.approx(10.0), 2.0)


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,ident,type,name,latitude_deg,longitude_deg,elevation_ft\n1,AAAA,small_airport,\"A, b\",10,20,5\n2,,x,n,10,20,\n3,BB,x,n,95,20,\n4,CC,x,n,1,,\n")
    a = csv_tables.airports(csv_tables.scan(spark, str(tmp_path / "a.csv"), csv_tables.AIRPORT_COLUMNS))
    assert {(r["id"], r["reason"]) for r in a.collect()} == {("ourairports:1", None), ("ourairports:2", "empty ident"), ("ourairports:3", "bad latitude"), ("ourairports:4", "bad longitude")}
    head = "id,airport_ref,airport_ident,length_ft,width_ft,surface,lighted,closed,le_ident,le_latitude_deg,le_longitude_deg,le_elevation_ft,le_heading_degT,le_displaced_threshold_ft,he_ident,he_latitude_deg,he_longitude_deg,he_elevation_ft,he_heading_degT,he_displaced_threshold_ft\n"
    (tmp_path / "r.csv").write_text(head + "1,9,AAAA,5000,100,ASP,1,0,09,1,1,,90,,27,1,2,,,\n2,9,AAAA,,100,ASP,1,0,09,1,1,,90,,27,1,2,,,\n3,9,,5000,100,ASP,1,0,09,1,1,,90,,27,1,2,,,\n4,9,AAAA,5000,100,ASP,1,1,09,1,1,,90,,27,1,2,,,\n")
    r = csv_tables.runways(csv_tables.scan(spark, str(tmp_path / "r.csv"), csv_tables.RUNWAY_COLUMNS))
    assert {(x["id"][-1], x["disposition"]) for x in r.collect()} == {("1", "accepted"), ("2", "quarantined"), ("3", "rejected"), ("4", "quarantined")}
    head = "id,filename,ident,name,type,frequency_khz,latitude_deg,longitude_deg,elevation_ft,iso_country,dme_frequency_khz,dme_channel,dme_latitude_deg,dme_longitude_deg,dme_elevation_ft,slaved_variation_deg,magnetic_variation_deg,usageType,power,associated_airport\n"
    (tmp_path / "n.csv").write_text(head + "1,f,ABC,Abc,VOR-DME,112300,10,20,,XA,112300,,10.5,,,,,HI,HIGH,\n2,f,N,Nnn,NDB-DME,300,10,20,,XA,,,,,,,,HI,LOW,\n3,f,Q,Qqq,VOR,5,10,20,,XA,,,,,,,,HI,LOW,\n4,f,Q,Qqq,shifted,x,10,20,,XA,,,,,,,,HI,LOW,\n")
    n = csv_tables.navaids(csv_tables.scan(spark, str(tmp_path / "n.csv"), csv_tables.NAVAID_COLUMNS))
    assert {(x["id"].split(":", 1)[1], x["navaid_type"], x["dme_paired"], x["latitude_deg"], x["longitude_deg"], x["disposition"]) for x in n.collect()} == {
        ("1", "VOR-DME", True, 10.0, 20.0, "accepted"), ("1:dme", "DME", True, 10.5, 20.0, "accepted"), ("2", "NDB", False, 10.0, 20.0, "accepted"), ("2:dme", "DME", True, 10.0, 20.0, "accepted"), ("3", "VOR", False, 10.0, 20.0, "rejected"), ("4", None, False, 10.0, 20.0, "rejected"),
    }
    assert {(x["disposition"], x["reason"]): x["rows"] for x in csv_tables.ingest_report(n).collect()}[("accepted", None)] == 4


def line(*parts):
    out = [" "] * 132
    for at, s in parts:
        out[at - 1 : at - 1 + len(s)] = s
    return "".join(out)


def test_fixed_width(spark):
    er = lambda seq, fix, mea, maa: line((1, "SUSA"), (5, "ER"), (14, "J1"), (26, seq), (30, fix), (35, "K1"), (45, "O"), (46, "H"), (84, mea), (94, maa))
    pg = lambda rw, ln: line((1, "SUSA"), (5, "P"), (7, "KAAA"), (11, "K1"), (13, "G"), (14, rw), (23, ln), (33, "N10000000"), (42, "W020000000"))
    leg = lambda seq, term, fix, nav, ident="I09": line((1, "SUSA"), (5, "P"), (7, "KAAA"), (11, "K1"), (13, "F"), (14, ident), (27, seq), (30, fix), (48, term), (51, nav), (71, "0925"), (85, "FL100"), (83, "+"), (103, "-300"))
    lines = [
        "HDR short", line((1, "SUSA"), (5, "EA"), (14, "FIXAA"), (20, "K1"), (27, "W  "), (33, "N10300000"), (42, "W020300000")),
        line((1, "SUSA"), (5, "D "), (14, "ABC"), (20, "K2"), (23, "11230"), (28, "VTH"), (33, "N10000000"), (42, "W020000000"), (56, "N10003600"), (65, "W020000000")),
        line((1, "SUSA"), (5, "DB"), (14, "N"), (20, "K2"), (23, "0300"), (33, "N10000000"), (42, "W020000000")), er("0010", "AAA", "05000", "FL450"), er("0020", "BBB", "07000", "FL450"), er("0030", "CCC", "09000", "FL450"),
        pg("RW09", "05000"), pg("RW27", "05000"), pg("RW18", "04000"), pg("RW36", "04000"), pg("RW01", "03000"), leg("010", "IF", "START", ""), leg("020", "CF", "RW09", "IABC"), leg("030", "ZZ", "X", ""),
        line((1, "SUSA"), (5, "AS"), (14, "N40"), (17, "W080"), (31, "012034UNK")), line((1, "SUSA"), (5, "P"), (7, "KAAA"), (13, "S"), (14, "CTR"), (43, "   090045  "), (54, "   27003025")),
    ]
    rec = arinc.records(spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, value string")).cache()
    assert {r["record_class"]: r["records"] for r in arinc.scan_report(rec).collect()} == {"EA": 1, "D": 1, "DB": 1, "ER": 3, "PG": 5, "PF": 2, "AS": 1, "PS": 1, "unsupported": 1}
    w = arinc.waypoints(rec).first()
    assert (w["ident"], w["name"], w["latitude_deg"], w["longitude_deg"]) == ("FIXAA", "FIXAA", 10.5, -20.5)
    assert {(r["navaid_type"], r["frequency_khz"], round(r["latitude_deg"], 4)) for r in arinc.vhf_navaids(rec).collect()} == {("VORTAC", 112_300, 10.0), ("DME", 112_300, 10.01)}
    assert arinc.ndb_navaids(rec).first()["frequency_khz"] == 300
    assert [(r["start_fix"], r["end_fix"], r["minimum_altitude_ft"], r["maximum_altitude_ft"]) for r in arinc.airway_legs(rec).orderBy("line_no").collect()] == [("AAA", "BBB", 5000, 45_000), ("BBB", "CCC", 7000, 45_000)]
    pairs, alone = arinc.runways(rec)
    assert {r["official_designator"] for r in pairs.collect()} == {"09/27", "18/36"} and [r["designator"] for r in alone.collect()] == ["01"]
    ils = arinc.ils_associations(arinc.procedure_legs(rec)).collect()
    assert [(r["approach_ident"], r["runway"], r["localizer_ident"], r["bearing_mag_deg"], r["glideslope_deg"]) for r in ils] == [("I09", "09", "IABC", 92.5, 3.0)]
    m = arinc.mora(rec).first()
    assert (m["lat_deg"], m["lon_deg"], m["values"][:4]) == (40, -80, [12, 34, 0, 0])
    assert [(s["bearing_to"], s["altitude_ft"], s["radius_nm"]) for s in arinc.msa(rec).first()["sectors"]] == [(90, 4500, 25), (270, 3000, 25)]


def test_text_and_xml_sources(spark, tmp_path):
    (tmp_path / "ats.txt").write_text("# c\nROUTE,SEQ,S,SLAT,SLON,E,ELAT,ELON,DIR,MIN,MAX,MEA\nA1,10,AA,1,2,BB,3,4,F,180,450,\nA1,20,BB,3,4,CC,5,6,ODD,50,,6000\nshort,1\n")
    s = documents.ats_segments(documents.numbered_lines(spark, str(tmp_path / "ats.txt"))).orderBy("line_no").collect()
    assert [(r["direction"], r["level"], r["minimum_altitude_ft"], r["maximum_altitude_ft"]) for r in s] == [("F", "H", 18_000, 45_000), ("B", "L", 6000, None)]
    (tmp_path / "p.txt").write_text("PROCEDURE: AB1C | RWY: 09 | NAV: RNP | APT: Town\n1 | IF | AAA | N | 63 (074.5) | R | 5.5 km | +3000 | 250 |\nPROCEDURE: ZZ | RWY: 27 | APT: Town\n1 | TF | BBB | Y | | L | 2 MIN | FL050-FL070 | |\n")
    p = documents.procedure_table(documents.numbered_lines(spark, str(tmp_path / "p.txt"))).orderBy("line_no").collect()
    assert [(r["procedure_ident"], r["runway"], r["fix_ident"], r["fly_over"], r["altitude"]["kind"]) for r in p] == [("AB1C", "09", "AAA", False, "AT_OR_ABOVE"), ("ZZ", "27", "BBB", True, "BETWEEN")]
    r = documents.rsbn_stations(spark.createDataFrame([(1, "AB,Name,12,490035.00N,0103000E,100,250,XXXX"), (2, "x")], "line_no int, value string")).first()
    assert r["frequency_khz"] == 101_200 and r["longitude_deg"] == 10.5
    x45 = '<AIXM-Snapshot version="4.5"><Ahp><AhpUid><codeId>LFAA</codeId></AhpUid><txtName>Town</txtName><geoLat>490035.00N</geoLat><geoLong>0020000.00E</geoLong><valElev>100</valElev><uomDistVer>M</uomDistVer></Ahp><Vor><VorUid><codeId>ABC</codeId></VorUid></Vor></AIXM-Snapshot>'
    x5 = '<m:AIXMBasicMessage xmlns:m="http://www.aixm.aero/schema/5.1/message" xmlns:a="a" xmlns:g="g"><m:hasMember><a:AirportHeliport><a:designator>EDAA</a:designator><a:name>Stadt</a:name><g:pos>50.5 8.5</g:pos><a:elevation>300</a:elevation></a:AirportHeliport></m:hasMember></m:AIXMBasicMessage>'
    got = documents.aixm(spark.createDataFrame([("a", x45), ("b", x5), ("c", "<broken")], "file string, value string")).collect()
    assert {(r["file"], r["feature"], r["ident"], r["latitude_deg"] and round(r["latitude_deg"], 3), r["elevation_ft"] and round(r["elevation_ft"]), (r["reason"] or "")[:10]) for r in got} == {
        ("a", "Ahp", "LFAA", 49.010, 328, ""), ("a", "Vor", "ABC", None, None, "no positio"), ("b", "AirportHeliport", "EDAA", 50.5, 300, ""), ("c", "document", None, None, None, "unreadable"),
    }
    html = spark.createDataFrame([('<a href="x.pdf">SID RWY 09</a> <a class="k" href="y.pdf">ILS 27</a> cycle 2501, Cycle-2502',)], "value string")
    assert [(r["href"], r["kind"]) for r in documents.index_entries(html).collect()] == [("x.pdf", "sid"), ("y.pdf", "approach")] and [r[0] for r in documents.cycle_listing(html).collect()] == ["2502", "2501"]
    meta = '<tpp><airport_name icao_ident="KAAA"><record><chart_code>IAP</chart_code><chart_name>ILS</chart_name><pdf_name>1.PDF</pdf_name></record></airport_name></tpp>'
    assert documents.charts(spark.createDataFrame([(meta,)], "value string"), "2501").first()["chart_code"] == "IAP"


def test_json_sources(spark):
    doc = lambda o: spark.createDataFrame([(json.dumps(o),)], "value string")
    m = documents.metars(doc({"icaoId": "AAAA", "obsTime": 1_700_000_000, "visib": "10+", "altim": 1013.25, "clouds": [{"cover": "BKN", "base": 800}, {"cover": "FEW", "base": 100}]})).first()
    assert (m["visibility_sm"], m["ceiling_ft"], m["category"]) == (10.0, 800, "IFR") and m["altimeter_inhg"] == pytest.approx(29.92, abs=0.01)
    t = documents.tafs(doc([{"icaoId": "AAAA", "validTimeFrom": 1_700_000_000, "fcsts": [{"timeFrom": 1_700_000_000, "timeTo": 1_700_003_600, "wspd": 5}, {"timeFrom": 1_700_003_600, "timeTo": 1_700_007_200, "wspd": 9}]}]))
    assert (t.first()["valid_to"] - t.first()["valid_from"]) == timedelta(days=1)
    pick = lambda s: correlate.period_at(t, F.timestamp_seconds(L(s))).first()["period"]["wind_kt"]
    assert pick(1_700_003_600) == 9 and pick(1_800_000_000) == 5
    s = documents.sigmets(doc({"features": [{"properties": {"isigmetId": "S1", "hazard": "TURB", "validTimeFrom": 1_700_000_000}, "geometry": {"coordinates": [[[0, 0], [4, 0], [4, 4]]]}}]}))
    assert s.first()["hazard"] == "TURBULENCE" and correlate.route_sigmets(s, [(1.0, 3.0), (9.0, 9.0)], 5, F.timestamp_seconds(L(1_700_000_100))).count() == 1 and correlate.route_sigmets(s, [(1.0, 3.0)], 5, F.timestamp_seconds(L(1_800_000_000))).count() == 0
    assert documents.pireps(doc([{"obsTime": 1, "fltLvl": "350"}])).first()["lat"] == 0.0
    n = documents.network(doc({"general": {"update_timestamp": "2025-01-01T00:00:00Z"}, "pilots": [{"cid": 1, "callsign": "AB1", "latitude": 1.0}], "controllers": [{"cid": 2, "callsign": "EDDM_TWR"}], "atis": [], "servers": [], "prefiles": []}))
    assert n["pilots"].first()["callsign"] == "AB1" and n["atis"].count() == 0
    c = correlate.route_controllers(n["controllers"].select("callsign"), "EDDM", "EDDF", [("EDGG", "langen")])
    assert [r["rule"] for r in c.collect()] == ["departure"]
    e = documents.network_events(doc({"data": [{"id": 1, "type": "Event", "name": "n", "start_time": "2025-01-01T00:00:00Z", "airports": [{"icao": "eddm"}]}]})).first()
    assert e["airports"] == ["EDDM"]


def test_registry(spark):
    reg = documents.Registry()
    reg.add(documents.Source("a", "ns", ("t",), lambda s, p: {"t": s.range(1)}))
    assert reg.load(spark, "a", "")["t"].count() == 1 and reg.by_namespace("ns:1").name == "a" and reg.by_namespace("x:1") is None
    with pytest.raises(ValueError):
        reg.add(documents.Source("b", "ns", (), lambda s, p: {}))


def test_text_layers(spark, tmp_path):
    w = spark.createDataFrame([("BB", "B", 10.5, -20.25, "K1", 87, True), ("AA", "A", 1.0, 2.0, "K1", 87, True), ("CC", "C", 1.0, 2.0, "", 87, True), ("DD", "D", 1.0, 2.0, "K1", None, True), ("EE", "E", 1.0, 2.0, "K1", 87, False)], "ident string, name string, latitude_deg double, longitude_deg double, region string, waypoint_type long, is_enroute boolean")
    lines, skipped, ends = sink.fixes(w)
    assert [r[0] for r in lines.collect()] == [" 1.000000000   2.000000000    AA ENRT K1 87 A", "10.500000000 -20.250000000    BB ENRT K1 87 B"] and skipped.count() == 3
    legs = spark.createDataFrame(
        [(1, "J2", "AA", "K1", "BB", "K1", "N", "H", 5000, 45_000), (2, "J1", "AA", "K1", "BB", "K1", "N", "H", 5000, 45_000), (3, "J3", "AA", "K1", "BB", "K1", "N", "H", 6000, 45_000), (4, "J4", "AA", "K1", "EE", "K1", "N", "H", 6000, 45_000), (5, "J5", "AA", "K1", "BB", "K1", "N", None, None, 45_000)],
        "ord int, route_ident string, start_fix string, start_icao_code string, end_fix string, end_icao_code string, direction string, level string, minimum_altitude_ft int, maximum_altitude_ft int",
    )
    awy, bad = sink.airways(legs, ends)
    assert [r[0] for r in awy.collect()] == ["   AA K1 11    BB K1 11 N 2  50 450 J2-J1", "   AA K1 11    BB K1 11 N 2  60 450 J3"]
    assert {(r["ident"], r["reason"]) for r in bad.collect()} == {("J4", "end not in the exported layer"), ("J5", "missing altitudes")}
    counts = sink.write_layer(spark, f"file://{tmp_path}/layer", {"fix": lines, "awy": awy}, "I")
    assert counts == {"fix": 2, "awy": 2} and spark.read.text(f"file://{tmp_path}/layer/fix").count() == 4
    with pytest.raises(ValueError):
        sink.write_layer(spark, f"file://{tmp_path}/layer", {"fix": lines.limit(0)}, "I")
    ids = sink.surrogate_ids(spark.range(100).select((99 - F.col("id")).alias("k")), ["k"]).collect()
    assert sorted((r["k"], r["row_id"]) for r in ids) == [(i, i + 1) for i in range(100)]
    a, b = spark.range(50), spark.range(50).repartition(7)
    assert sink.table_digest(a) == sink.table_digest(b) != sink.table_digest(spark.range(49))
    m = sink.bundle({"t": a}, spark.createDataFrame([("p", "public")], "provider string, license_tier string"), True)
    assert sink.verify(m, {"t": b}) == [] and sink.verify(m, {"t": spark.range(3)}) == ["t"]
    with pytest.raises(ValueError):
        sink.bundle({"t": spark.createDataFrame([("q",)], "provider string")}, spark.createDataFrame([("p", "public")], "provider string, license_tier string"), True)
    assert sink.decide_update(None, "2", False) == "install" and sink.decide_update("3", "2", False) == "refuse-downgrade"
    assert "NUMENR 2" in sink.flight_plan([("A", 1.0, 2.0), ("B", 3.0, 4.0)], "2501", "fms")


NAV = "ident string, name string, navaid_type string, frequency_khz int, latitude_deg double, longitude_deg double, elevation_ft double, region string, associated_airport string, bearing_deg double, slaved_variation_deg double, glideslope_angle_deg double, service_volume_nm int, dme_paired boolean"


def test_navaid_rows(spark):
    n = spark.createDataFrame(
        [("V", "v", "VOR", 112_300, 1.0, 2.0, None, "K1", None, None, 3.0, None, 130, False), ("I1", "loc", "ILS-LOC", 110_300, 1.0, 2.0, None, "K1", "KAAA", 90.0, None, None, 18, False), ("I1", "gs", "ILS-GS", 110_300, 1.0, 2.0, None, "K1", "KAAA", 90.0, None, 3.0, 18, False),
         ("I2", "loc", "ILS-LOC", 110_300, 1.0, 2.0, None, "K1", "KAAA", 90.0, None, None, 18, False), ("I3", "loc", "ILS-LOC", 110_300, 1.0, 2.0, None, "K1", "KAAA", None, None, None, 18, False), ("D", "d", "DME", 112_300, 1.0, 2.0, None, "K1", None, None, None, None, 130, True), ("R", "r", "RSBN", 100_000, 1.0, 2.0, None, "K1", None, None, None, None, None, False)], NAV)
    lines, skipped, ends = sink.navaids(n)
    assert [r[0].split()[0] for r in lines.collect()] == ["3", "4", "5", "6", "12"] and {(r["ident"], r["reason"]) for r in skipped.collect()} == {("I3", "no localizer course"), ("R", "kind has no row")} and ends.count() == 1


def test_procedures(spark):
    legs = spark.createDataFrame(
        [("K", "D", "P1", "", 10, "A", "IF", None, None, None, 1.0, 1.0, 9000, datetime(2025, 1, 1)), ("K", "D", "P1", "", 20, "B", "TF", None, None, None, None, None, None, datetime(2025, 1, 1)), ("K", "D", "P1", "", 30, "C", "TF", None, None, None, 9.0, 1.0, 5000, datetime(2025, 1, 1)), ("K", "D", "P1", "TR", 10, "X", "RF", None, None, None, 1.0, 1.0, None, datetime(2025, 2, 1)), ("K", "D", "P2", "", 10, "A", "QQ", None, "B", None, 1.0, 1.0, 100, datetime(2025, 1, 1))],
        "airport_ident string, procedure_kind string, procedure_ident string, transition_ident string, sequence_number int, fix_ident string, path_terminator string, recommended_navaid string, altitude_descriptor string, arc_radius_nm double, lat double, lon double, altitude_1_ft int, valid_from timestamp",
    ).withColumn("altitude_2_ft", L(None).cast("int")).withColumn("course_a_deg", L(1.0)).withColumn("course_b_deg", L(1.0)).withColumn("distance_a_nm", L(1.0)).withColumn("distance_b_nm", L(1.0))
    issues = {(r["procedure_ident"], r["transition_ident"], r["sequence_number"], i) for r in procedures.interpret(legs).collect() for i in r["issues"]}
    assert issues == {("P1", "TR", 10, "missing-radius"), ("P2", "", 10, "unknown-terminator"), ("P2", "", 10, "band-incomplete")}
    found = {(r["sequence_number"], r["code"]) for r in procedures.validate(legs.filter("transition_ident = '' and procedure_ident = 'P1'")).collect()}
    assert found == {(20, "fix-unresolved"), (30, "leg-too-long"), (30, "descends-on-departure")}
    a = {r["procedure_ident"]: r for r in procedures.assemble(legs).collect()}
    assert [x["fix_ident"] for x in a["P1"]["main"]] == ["A", "B", "C"] and a["P1"]["mixed_validity"] and not a["P2"]["mixed_validity"] and len(a["P1"]["transitions"]) == 1
    assert {(r["procedure_ident"], r["is_flyable"]) for r in procedures.flyable(legs).collect()} == {("P1", False), ("P2", True)}


def flight():
    rows = [(True, 0, 0, 0, 300)] * 2 + [(True, 15, 0, 0, 300)] * 3 + [(True, 80, 0, 0, 300), (False, 160, 800, 1500, 299)] + [(False, 250, 9000 + i * 500, 2000, 280) for i in range(4)] + [(False, 450, 35_000, 0, 200)] * 4
    return rows + [(False, 430, 20_000 - i, -1800, 90) for i in range(4)] + [(False, 180, 2500, -600, 10)] * 3 + [(True, 110, 0, 0, 1), (True, 20, 0, 0, 0), (True, 20, 0, 0, 0), (True, 0, 0, 0, 0), (True, 0, 0, 0, 0)]


EV = "session_id long, ts timestamp, event_id long, on_ground boolean, speed double, altitude double, vs double, to_go double, lat double, lon double"


def samples(spark, session=1):
    return spark.createDataFrame([(session, datetime(2025, 1, 1) + timedelta(seconds=i), i, g, float(s), float(a), float(v), float(d), 10.0 + i / 100, 20.0) for i, (g, s, a, v, d) in enumerate(flight())], EV)


def test_phases(spark):
    rows = tracking.replay(samples(spark).unionByName(samples(spark, 2))).orderBy("session_id", "event_id").collect()
    seq = [r["phase"] for r in rows if r["session_id"] == 1]
    assert list(dict.fromkeys(seq)) == ["preflight", "taxi_out", "takeoff", "initial_climb", "climb", "cruise", "descent", "approach", "landing", "taxi_in", "parked"]
    assert seq == [r["phase"] for r in rows if r["session_id"] == 2]
    s = tracking.Phase()
    assert tracking.step(s, "taxi_out") == (tracking.Phase("preflight", 1, False), False) and tracking.step(tracking.Phase("preflight", 1, False), "climb")[0].ticks == 2
    assert tracking.advance(3, 9.9, 10, 5, "enroute") == 4 and tracking.advance(3, 1, 10, 5, "enroute") == 3


def test_streaming_equals_replay(spark, tmp_path):
    s = samples(spark).unionByName(samples(spark, 2))
    s.filter("event_id < 12").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    s.filter("event_id >= 12").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = telemetry.track(stream, stale_ms=3_600_000).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        # timers keep an idle stream running, so its end is when every sample is out
        for _ in range(90):
            if spark.table("tracked").count() >= 2 * len(flight()):
                break
            time.sleep(1)
    finally:
        q.stop()
    got = {(r["session_id"], r["event_id"]): r["phase"] for r in spark.table("tracked").collect()}
    want = {(r["session_id"], r["event_id"]): r["phase"] for r in tracking.replay(s).collect()}
    assert got.keys() == want.keys() and got == want
    assert telemetry.ring(s, 3).count() == 6


def test_planner(spark, tmp_path):
    airports = spark.createDataFrame([("AAAA", 0.0, 0.0), ("BBBB", 0.0, 6.0)], "ident string, lat double, lon double")
    runways = spark.createDataFrame([("AAAA", 5000, "09", "27", 90.0), ("BBBB", 9000, "18", "36", 180.0)], "airport_ident string, length_ft int, le_ident string, he_ident string, heading double")
    nodes = spark.createDataFrame([("P", 0.0, 0.5), ("Q", 0.0, 3.0), ("R", 0.0, 5.5)], "node string, lat double, lon double")
    edges = spark.createDataFrame([("P", "Q", "J1", 150.0), ("Q", "R", "J1", 150.0)], "src string, dst string, route_ident string, cost double")
    p = planner.plan(airports, runways, nodes, edges, planner.Request("AAAA", "BBBB", "A320", 270.0, 10.0))
    assert p.route() == "AAAA DCT P J1 R DCT BBBB" and p.runways["AAAA"] == "27" and p.distance_nm == pytest.approx(360, abs=1) and planner.revalidate(p) == []
    assert [x.to for x in planner.direct_to(p, "R", 10.0).legs] == ["R", "BBBB"]
    assert planner.plan(airports, runways, nodes, edges, planner.Request("AAAA", "ZZZZ")).issues == ["unknown airport ZZZZ"]
    st = planner.PlanStore(str(tmp_path))
    st.save("x", p)
    assert st.names() == ["x"] and st.load("x") == p
    assert planner.random_pairs(7, ["A", "B", "C"], 5) == planner.random_pairs(7, ["A", "B", "C"], 5)


def test_airport_traffic_near(spark):
    """Pairs beyond the antimeridian, at the poles and in any cell, against all pairs; nulls, NaN and infinity meet nobody."""
    rng = np.random.default_rng(7)
    spots = [(r, t) for c, s in (((0.0, 180.0), 0.2), ((85.0, 20.0), 0.6), ((89.95, 0.0), 180.0), ((-89.95, 0.0), 180.0), ((-60.0, -180.0), 0.3)) for r, t in zip(np.clip(c[0] + rng.uniform(-0.12, 0.12, 40), -90, 90), c[1] + rng.uniform(-s, s, 40))]
    at = [(float(la), float((lo + 180) % 360 - 180)) for la, lo in spots] + [(90.0, 10.0), (90.0, -170.0), (-90.0, 0.0), (10.0, 180.0), (10.0, -180.0)]
    ap = [(f"A{i // 2}", *p) for i, p in enumerate(at[::2])] + [(None, 0.0, 180.0), ("NUL", None, 1.0), ("NAN", float("nan"), float("nan")), ("INF", math.inf, math.inf)]
    pi = [(f"P{i}", "A0" if i % 3 else None, None if i % 2 else "A1", *p, 0, 0) for i, p in enumerate(at[1::2] + at[::4])] + [(None, "A0", "NUL", *at[0], 0, 0), ("PN", "A0", "NO", float("nan"), 0.0, 0, 0), ("PM", None, "NAN", 1.0, float("nan"), 0, 0), ("PL", "A2", "A2", None, None, 0, 0), ("PI", "A2", "INF", -math.inf, math.inf, 0, 0), ("PF", "A2", "A2", *at[0], 41, 0)]

    def nm(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * geo.NM_RADIUS * math.asin(math.sqrt(h))

    whole = lambda p: None not in p and all(map(math.isfinite, p))
    near = {(i, c) for i, *a in ap for c, _, _, la, lo, speed, _ in pi if whole(a) and whole((la, lo)) and c and speed < 40 and nm(a, (la, lo)) <= 5}
    want = {(i, sum(p[1] == i for p in pi), sum(p[2] == i for p in pi), sum(n[0] == i for n in near)) for i, *_ in ap if i}
    pilots = spark.createDataFrame(pi, "callsign string, departure string, arrival string, lat double, lon double, groundspeed int, altitude int")
    got = [tuple(r) for r in correlate.airport_traffic(pilots, spark.createDataFrame(ap, "ident string, lat double, lon double")).collect()]
    assert len(near) > 100 and len(got) == len(want) and set(got) == want


def test_airport_traffic_is_no_broadcast(spark, tmp_path):
    """What exploded cells hold is not known to the planner: sides that it takes for small are still not sent to the driver."""
    r = spark.range(400).select("id", (F.col("id") % 100 - 50.0).alias("lat"), (F.col("id") * 7 % 360 - 180.0).alias("lon"))
    r.select(F.concat(L("A"), F.col("id").cast("string")).alias("ident"), "lat", "lon").write.parquet(f"{tmp_path}/a")
    r.select(F.concat(L("P"), F.col("id").cast("string")).alias("callsign"), L("A1").alias("departure"), L("A2").alias("arrival"), "lat", "lon", L(0).alias("groundspeed"), L(0).alias("altitude")).write.parquet(f"{tmp_path}/p")
    t = correlate.airport_traffic(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/a"))
    assert t.count() == 400 and t.agg(F.sum("on_ground")).first()[0] >= 400
    t.collect()
    assert "Broadcast" not in t._jdf.queryExecution().executedPlan().toString()


def test_correlate(spark):
    pilots = spark.createDataFrame([("x", "AAAA", "BBBB", 0.0, 0.01, 0, 0), ("y", "AAAA", "CCCC", 0.0, 0.01, 200, 5000)], "callsign string, departure string, arrival string, lat double, lon double, groundspeed int, altitude int")
    ap = spark.createDataFrame([("AAAA", 0.0, 0.0), ("BBBB", 5.0, 5.0)], "ident string, lat double, lon double")
    assert {tuple(r) for r in correlate.airport_traffic(pilots, ap).collect()} == {("AAAA", 2, 0, 1), ("BBBB", 0, 1, 0)}
    assert correlate.traffic_on_route(pilots, [(0.0, -1.0), (0.0, 1.0)], 1).count() == 2
    s = spark.createDataFrame([(1, 6.0, False, 5.0, 0.0, 0.0, 100.0, 9000.0, 300.0, False)], "session_id int, xtk_nm double, stale boolean, tod_nm double, profile_ft double, vs double, to_go double, altitude double, speed double, source_required boolean")
    assert {r["code"] for r in correlate.advisories(s).collect()} == {"OFF_ROUTE", "TOD_NEAR", "SPEED_LIMIT"}
