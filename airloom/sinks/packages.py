"""Exports other than text layers: SQLite tables and XML sources of procedures; the session snapshot."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.text import escape_html

#: Leg types of the package format by path terminator.
LEG_TYPES = ["AF", "CA", "CD", "CF", "CI", "CR", "DF", "FA", "FC", "FD", "FM", "HA", "HF", "HM", "IF", "PI", "RF", "TF", "VA", "VD", "VI", "VM", "VR"]
BATCH = 5_000


def sqlite(path: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Tables into one SQLite file on the driver, streamed partition by partition and never held whole."""
    con, counts = sqlite3.connect(path), {}
    with con:
        for name, df in tables.items():
            cols = ", ".join(f'"{c}"' for c in df.columns)
            con.execute(f'drop table if exists "{name}"')
            con.execute(f'create table "{name}" ({cols})')
            n, buf, put = 0, [], f'insert into "{name}" values ({", ".join("?" * len(df.columns))})'
            for r in df.toLocalIterator():
                buf.append(tuple(v.isoformat() if hasattr(v, "isoformat") else v for v in r))
                n += 1
                if len(buf) >= BATCH:
                    con.executemany(put, buf)
                    buf.clear()
            con.executemany(put, buf)
            counts[name] = n
    con.close()
    return counts


def procedure_xml(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(airport_ident, value): XML of each airport's procedures; and the legs that have no type, with a reason."""
    ok = F.col("path_terminator").isin(LEG_TYPES)
    attr = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f' {n}="'), escape_html(c.cast("string")), F.lit('"'))).otherwise("")
    leg = F.concat(F.lit("<Leg"), attr("type", F.col("path_terminator")), attr("fixIdent", F.nullif(F.trim("fix_ident"), F.lit(""))), attr("altitude1", F.col("altitude_1_ft")), attr("altitude2", F.col("altitude_2_ft")), F.lit("/>"))
    tag = F.when(F.col("procedure_kind") == "D", "Departure").when(F.col("procedure_kind") == "E", "Arrival").otherwise("Approach")
    p = legs.filter(ok).groupBy("airport_ident", tag.alias("tag"), "procedure_ident").agg(F.array_sort(F.collect_list(F.struct("transition_ident", "sequence_number", leg.alias("x")))).alias("l"))
    xml = F.concat(F.lit("<"), F.col("tag"), attr("name", F.col("procedure_ident")), F.lit(">"), F.array_join(F.transform("l", lambda s: s["x"]), ""), F.lit("</"), F.col("tag"), F.lit(">"))
    a = p.select("airport_ident", F.struct("tag", "procedure_ident", xml.alias("x")).alias("s")).groupBy("airport_ident").agg(F.array_sort(F.collect_list("s")).alias("s"))
    value = F.concat(F.lit("<Airport"), attr("ident", F.col("airport_ident")), F.lit(">"), F.array_join(F.transform("s", lambda s: s["x"]), ""), F.lit("</Airport>"))
    return a.select("airport_ident", value.alias("value")), legs.filter(~ok).select("airport_ident", "procedure_ident", "sequence_number", F.lit("terminator has no leg type").alias("reason"))


def session_snapshot(state: DataFrame, weather: DataFrame, controllers: DataFrame) -> DataFrame:
    """One nested row per session: position and progress, weather at the destination, controllers of both airports."""
    w = weather.groupBy(F.col("station").alias("destination")).agg(F.max_by(F.struct("observed_at", "category", "wind_kt"), "observed_at").alias("weather"))
    c = controllers.groupBy("airport").agg(F.array_sort(F.collect_list(F.struct("facility", "callsign"))).alias("atc"))
    j = state.join(w, "destination", "left").join(c.withColumnRenamed("airport", "destination"), "destination", "left")
    track = F.when(F.abs("xtk_nm") < 0.05, "on track").when(F.col("xtk_nm") > 0, "right of track").otherwise("left of track")
    return j.select(
        "session_id", F.struct("lat", "lon", "altitude", "speed").alias("position"), F.struct("phase", "to_go", track.alias("track")).alias("progress"), "weather", F.coalesce("atc", F.array().cast(c.schema["atc"].dataType)).alias("atc"),
    )


def compact(snapshot: DataFrame) -> DataFrame:
    """The snapshot as one line of JSON, and as a sentence."""
    text = F.concat(F.col("progress.phase"), F.lit(", "), F.format_string("%.0f", F.col("progress.to_go")), F.lit(" NM to go, "), F.col("progress.track"), F.coalesce(F.concat(F.lit(", destination "), F.col("weather.category")), F.lit("")))
    return snapshot.select("session_id", F.to_json(F.struct(*[c for c in snapshot.columns if c != "session_id"])).alias("json"), text.alias("briefing"))
