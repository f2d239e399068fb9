"""The four exports on the smallest data, and what a failed one leaves behind."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from airloom.operators.commit import Store
from airloom.plans import exports
from airloom.session import checkpoint_dir
from airloom.sinks import text_layers as sink


def test_exports(spark, data, tmp_path):
    got = {name: export(spark, data, f"{tmp_path}/{name}") for name, export in exports.EXPORTS.items()}
    assert got["export_text_layer"].keys() == {"fixes", "airways", "airports"} and all(got["export_text_layer"].values())
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/export_text_layer/fixes").collect()]
    assert lines[0] == "1100 Version" and lines[-1] == "99" and len(lines) == got["export_text_layer"]["fixes"] + 2
    assert "1100 Version" in spark.read.text(f"{tmp_path}/export_text_layer/manifest").first()[0]
    con = sqlite3.connect(f"{tmp_path}/export_sqlite/world.sqlite")
    for name, n in got["export_sqlite"].items():
        assert con.execute(f"select count(*), min({name}_id), max({name}_id) from {name}").fetchone() == (n, 1, n)
    assert spark.read.parquet(f"{tmp_path}/export_xml").count() == 1


def test_a_refused_layer_leaves_the_one_before(spark, tmp_path):
    root = f"{tmp_path}/layer"
    one = spark.createDataFrame([("a",)], "value string")
    sink.write_layer(spark, root, {"x": one}, "H")
    with pytest.raises(ValueError):
        sink.write_layer(spark, root, {"x": one, "y": one.limit(0)}, "H2")
    assert [r[0] for r in spark.read.text(f"{root}/x").collect()] == ["H", "a", "99"]
    sink.write_layer(spark, root, {"x": one.withColumn("value", F.lit("b"))}, "H2")
    assert [r[0] for r in spark.read.text(f"{root}/x").collect()] == ["H2", "b", "99"]


def test_there_is_a_version_at_every_moment(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    one = spark.range(1)
    assert store.version() == 0 and store.publish({"t": one}) == 1 and store.publish({"t": spark.range(2)}) == 2
    store.rollback(1)
    assert store.version() == 1 and store.table("t").count() == 1
    # a publication after a rollback is a version of its own
    assert store.publish({"t": spark.range(3)}) == 3 and store.table("t", 2).count() == 2 and store.table("t").count() == 3


def test_a_cluster_needs_a_shared_checkpoint_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
