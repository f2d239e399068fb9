"""Some queries beside their SQL on the smallest data, and the shape of the driver's contract. tools/oracle.py does all."""

import importlib
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ["asof_snapshot", "scd2_upsert", "publication_guard", "airac_cycle_of_date", "nearby_topk", "reconcile_pairs", "segment_merge", "telemetry_progress", "validation_counts", "p1_found", "p3_found", "p5_report", "p6_found", "p7_found"]


def canon(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def entry():
    sys.path.insert(0, ROOT)
    return importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, data, entry, con, name):
    df = entry.queries()[name](spark, data)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(cols, cur.fetchall())


def test_contract(spark, entry):
    qs = entry.queries()
    assert set(entry.oracle_sql()) <= set(qs) and {"p1_found", "p3_found", "p5_found", "p6_found", "p7_found"} <= set(qs)
    df = entry.entry(spark)
    assert df.columns == ["kind", "id", "ident", "distance_nm"]


def test_core_does_not_need_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "airloom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as s:
                    assert "airloom.llm" not in s.read()
