"""Fixed-width records of 132 columns, decoded by class in one scan of the text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.text import dms, dms_high, magnetic_variation, reciprocal_designator, waypoint_type

WIDTH = 132
#: Terminators by which the decoder knows a procedure leg.
LEG_TERMINATORS = ["IF", "TF", "CF", "DF", "FA", "FC", "FD", "FM", "CA", "CI", "CR", "VA", "VD", "VI", "VM", "HA", "HF", "HM", "RF", "AF"]


def field(a: int, b: int) -> Column:
    """Columns a to b, counted from 1, both included, with their blanks."""
    return F.substring("value", a, b - a + 1)


def trimmed(a: int, b: int) -> Column:
    return F.nullif(F.trim(field(a, b)), F.lit(""))


def _num(a: int, b: int, div: int = 1) -> Column:
    n = trimmed(a, b).try_cast("double")
    return n / div if div != 1 else n


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def altitude(a: int, b: int) -> Column:
    """Feet; FLnnn counts in hundreds; nothing unless above zero."""
    c = trimmed(a, b)
    return _positive(F.when(c.startswith("FL"), F.substring(c, 3, 5).try_cast("int") * 100).otherwise(c.try_cast("int")))


def records(lines: DataFrame) -> DataFrame:
    """Lines (line_no, value) of full width with their class; unknown classes are kept as unsupported."""
    section, sub, kind = field(5, 5), field(6, 6), field(13, 13)
    leg = (section == "P") & kind.isin("D", "E", "F") & (sub == " ") & field(48, 49).isin(LEG_TERMINATORS)
    by = (
        F.when((section == "A") & (sub == "S"), "AS").when((section == "E") & (sub == "A"), "EA").when((section == "E") & (sub == "R"), "ER")
        .when((section == "D") & (sub == " "), "D").when((section == "D") & (sub == "B"), "DB").when((section == "P") & (sub == "N"), "PN")
    )
    for s in ("A", "G", "I", "C", "P", "S"):
        by = by.when((section == "P") & (sub == " ") & (kind == s), "P" + s)
    by = by.when(leg, F.concat(F.lit("P"), kind))
    return lines.filter(F.length("value") >= WIDTH).withColumn("record_class", F.coalesce(by, F.lit("unsupported")))


def scan_report(rec: DataFrame) -> DataFrame:
    return rec.groupBy("record_class").agg(F.count("*").alias("records"))


def _kept(df: DataFrame) -> DataFrame:
    return df.filter("reason is null").drop("reason")


def _reason(*missing: tuple[Column, str]) -> Column:
    """The first that holds of conditions with what they say; null where a record decodes."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), said) for c, said in missing]).alias("reason")


def waypoints(rec: DataFrame) -> DataFrame:
    return _kept(_waypoints(rec))


def _waypoints(rec: DataFrame) -> DataFrame:
    d = rec.filter("record_class in ('EA', 'PC')").select(
        "line_no", trimmed(7, 10).alias("airport_ident"), trimmed(14, 18).alias("ident"), field(20, 21).alias("region"), waypoint_type(field(27, 29)).alias("waypoint_type"),
        dms(field(33, 41)).alias("latitude_deg"), dms(field(42, 51)).alias("longitude_deg"), magnetic_variation(trimmed(75, 80)).alias("variation"),
        F.coalesce(trimmed(96, 120), trimmed(14, 18)).alias("name"), (F.col("record_class") == "EA").alias("is_enroute"), "record_class",
    )
    return d.withColumn("reason", _reason((F.col("ident").isNull(), "no ident"), (F.col("latitude_deg").isNull() | F.col("longitude_deg").isNull(), "bad position")))


def vhf_navaids(rec: DataFrame) -> DataFrame:
    """Stations of section D: kind from the class, the DME half as a row of its own."""
    d = _kept(_vhf_stations(rec))
    main = F.struct(F.col("kind").alias("navaid_type"), F.coalesce("lat", "dme_lat").alias("latitude_deg"), F.coalesce("lon", "dme_lon").alias("longitude_deg"))
    dme = F.struct(F.lit("DME").alias("navaid_type"), F.coalesce("dme_lat", "lat").alias("latitude_deg"), F.coalesce("dme_lon", "lon").alias("longitude_deg"))
    halves = F.when(F.col("kind").isin("VORTAC", "VOR-DME"), F.array(main, dme)).otherwise(F.array(main))
    return d.withColumn("h", F.explode(halves)).select("line_no", "airport_ident", "ident", "region", "frequency_khz", "elevation_ft", "variation", "name", "h.*")


def _vhf_stations(rec: DataFrame) -> DataFrame:
    khz = (trimmed(23, 27).try_cast("int") * 10)
    cls = field(28, 30)
    vor, dme_only, tacan = F.substring(cls, 1, 1) == "V", (F.substring(cls, 1, 1) == " ") & (F.substring(cls, 2, 1) == "D"), F.substring(cls, 2, 1).isin("T", "M")
    ils = F.substring(cls, 2, 1) == "I"
    d = rec.filter("record_class = 'D'").select(
        "line_no", trimmed(7, 10).alias("airport_ident"), trimmed(14, 17).alias("ident"), trimmed(20, 21).alias("region"), khz.alias("frequency_khz"),
        dms(field(33, 41)).alias("lat"), dms(field(42, 51)).alias("lon"), dms(field(56, 64)).alias("dme_lat"), dms(field(65, 74)).alias("dme_lon"), _num(80, 84).alias("elevation_ft"),
        magnetic_variation(trimmed(75, 79)).alias("variation"), trimmed(91, 120).alias("name"),
        F.when(ils, "ILS-LOC").when(vor & tacan, "VORTAC").when(vor & (F.substring(cls, 2, 1) == "D"), "VOR-DME").when(vor, "VOR").when(dme_only, "DME").when(tacan, "TACAN").otherwise("DME").alias("kind"),
        "record_class",
    )
    placed = (F.col("lat").isNotNull() & F.col("lon").isNotNull()) | (F.col("dme_lat").isNotNull() & F.col("dme_lon").isNotNull())
    return d.withColumn("reason", _reason((F.col("ident").isNull(), "no ident"), (~(F.col("frequency_khz") > 0), "bad frequency"), (~placed, "bad position")))


def ndb_navaids(rec: DataFrame) -> DataFrame:
    return _kept(_ndb_stations(rec))


def _ndb_stations(rec: DataFrame) -> DataFrame:
    d = rec.filter("record_class in ('DB', 'PN')").select(
        "line_no", trimmed(7, 10).alias("airport_ident"), trimmed(14, 17).alias("ident"), trimmed(20, 21).alias("region"), trimmed(23, 26).try_cast("int").alias("frequency_khz"),
        dms(field(33, 41)).alias("latitude_deg"), dms(field(42, 51)).alias("longitude_deg"), trimmed(94, 123).alias("name"), "record_class",
    )
    return d.withColumn("reason", _reason((F.col("ident").isNull(), "no ident"), (~(F.col("frequency_khz") > 0), "bad frequency"), (F.col("latitude_deg").isNull() | F.col("longitude_deg").isNull(), "bad position")))


def airway_legs(rec: DataFrame) -> DataFrame:
    """Consecutive records of a route make a leg; its altitudes are those of the earlier record."""
    w = Window.partitionBy("route_ident").orderBy("line_no")
    er = rec.filter("record_class = 'ER'").select(
        "line_no", trimmed(14, 18).alias("route_ident"), trimmed(26, 29).try_cast("int").alias("sequence_number"), trimmed(30, 34).alias("fix"), trimmed(35, 36).alias("icao"),
        field(45, 45).alias("route_type"), trimmed(46, 46).alias("level"), altitude(84, 88).alias("mea"), altitude(94, 98).alias("maa"),
    )
    p = er.withColumn("p", F.lag(F.struct("fix", "icao", "mea", "maa")).over(w)).filter("p is not null")
    return p.select(
        "line_no", "route_ident", "route_type", "level", "sequence_number", F.col("p.fix").alias("start_fix"), F.col("p.icao").alias("start_icao_code"), F.col("fix").alias("end_fix"),
        F.col("icao").alias("end_icao_code"), F.lit("N").alias("direction"), F.col("p.mea").alias("minimum_altitude_ft"), F.col("p.maa").alias("maximum_altitude_ft"),
    )


def procedure_legs(rec: DataFrame) -> DataFrame:
    return rec.filter("record_class in ('PD', 'PE', 'PF')").select(
        "line_no", trimmed(7, 10).alias("airport_ident"), trimmed(11, 12).alias("icao_code"), field(13, 13).alias("procedure_kind"), trimmed(14, 19).alias("procedure_ident"), field(20, 20).alias("route_type"),
        F.trim(field(21, 25)).alias("transition_ident"), trimmed(27, 29).try_cast("int").alias("sequence_number"), F.trim(field(30, 34)).alias("fix_ident"), trimmed(35, 36).alias("fix_icao_code"),
        field(37, 38).alias("fix_section"), field(40, 43).alias("waypoint_description"), trimmed(44, 44).alias("turn_direction"), _positive(_num(45, 47, 100)).alias("rnp_nm"), field(48, 49).alias("path_terminator"),
        trimmed(51, 54).alias("recommended_navaid"), _positive(_num(57, 62, 100)).alias("arc_radius_nm"), _num(63, 66, 10).alias("course_a_deg"), _num(67, 70, 10).alias("distance_a_nm"),
        _num(71, 74, 10).alias("course_b_deg"), _num(75, 78, 10).alias("distance_b_nm"), trimmed(83, 83).alias("altitude_descriptor"), altitude(85, 89).alias("altitude_1_ft"), altitude(90, 94).alias("altitude_2_ft"),
        F.floor(_num(95, 99, 100)).cast("int").alias("speed_limit_kts"), _positive(_num(100, 102)).alias("course_c_deg"), F.nullif(_num(103, 106, 100), F.lit(0.0)).alias("vertical_angle_deg"), trimmed(107, 111).alias("msa_center_fix"),
    )


def localizers(rec: DataFrame) -> DataFrame:
    """A localizer and, where it has an angle, a glide path of each PI record."""
    r = rec.filter("record_class = 'PI'").select(
        "line_no", trimmed(7, 10).alias("airport_ident"), trimmed(14, 17).alias("ident"), (trimmed(23, 27).try_cast("int") * 10).alias("frequency_khz"), F.regexp_replace(trimmed(28, 32), "^RW", "").alias("runway"),
        dms(field(33, 41)).alias("lat"), dms(field(42, 51)).alias("lon"), _num(52, 55, 10).alias("bearing_mag"), dms(field(56, 64)).alias("gs_lat"), dms(field(65, 74)).alias("gs_lon"), _num(88, 90, 100).alias("gs_angle"),
    )
    loc = F.struct(F.lit("ILS-LOC").alias("navaid_type"), F.col("lat").alias("latitude_deg"), F.col("lon").alias("longitude_deg"))
    gs = F.when((F.col("gs_angle") > 0) & F.col("gs_lat").isNotNull(), F.struct(F.lit("ILS-GS").alias("navaid_type"), F.col("gs_lat").alias("latitude_deg"), F.col("gs_lon").alias("longitude_deg")))
    return r.withColumn("h", F.explode(F.array_compact(F.array(loc, gs)))).select("line_no", "airport_ident", "ident", "frequency_khz", "runway", "bearing_mag", "gs_angle", "h.*", F.lit(18).alias("service_volume_nm"))


def merge_localizers(pi: DataFrame, d: DataFrame) -> DataFrame:
    """Localizers of both record classes by ident and airport: the fields of PI hold, even where they are null."""
    a = pi.select("ident", "airport_ident", F.struct("latitude_deg", "longitude_deg", "frequency_khz").alias("p"))
    b = d.select("ident", "airport_ident", F.struct("latitude_deg", "longitude_deg", "frequency_khz").alias("q"))
    j = a.join(b, ["ident", "airport_ident"], "full_outer")
    pick = lambda c: F.when(F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(f"q.{c}")).alias(c)
    return j.select("ident", "airport_ident", pick("latitude_deg"), pick("longitude_deg"), pick("frequency_khz"), F.col("p").isNotNull().alias("from_pi"))


def runways(rec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paired runways, ends without a partner of the same length) of PG records; 18 pairs with 36."""
    e = rec.filter("record_class = 'PG'").select(
        trimmed(7, 10).alias("airport_ident"), trimmed(11, 12).alias("icao_code"), F.regexp_replace(trimmed(14, 18), "^RW", "").alias("designator"), (trimmed(23, 27).try_cast("int")).alias("length_ft"),
        dms(field(33, 41)).alias("lat"), dms(field(42, 51)).alias("lon"), _num(67, 71).alias("elevation_ft"),
    )
    a = e.withColumn("back", reciprocal_designator(F.col("designator")))
    b = e.select("airport_ident", "icao_code", F.col("designator").alias("back"), "length_ft", F.col("lat").alias("he_lat"), F.col("lon").alias("he_lon"), F.col("elevation_ft").alias("he_elevation_ft"))
    keys = ["airport_ident", "icao_code", "back", "length_ft"]
    pairs = a.join(b, keys).filter("designator < back")
    alone = a.join(b.select(*keys), keys, "left_anti")
    out = pairs.select("airport_ident", "icao_code", F.concat_ws("/", "designator", "back").alias("official_designator"), "length_ft", F.col("designator").alias("le_ident"), F.col("lat").alias("le_lat"), F.col("lon").alias("le_lon"), F.col("back").alias("he_ident"), "he_lat", "he_lon")
    return out, alone.select("airport_ident", "designator", "length_ft")


def path_points(rec: DataFrame) -> DataFrame:
    """Path points: a primary record joined to its continuation by airport, approach and runway, the last of each."""
    pp = rec.filter("record_class = 'PP'").select("line_no", trimmed(7, 10).alias("airport_ident"), trimmed(14, 19).alias("approach"), trimmed(20, 24).alias("runway"), field(27, 27).alias("part"), "value")
    key = ["airport_ident", "approach", "runway"]
    prim = pp.filter("part in ('0', '1')").groupBy(*key).agg(F.max_by("value", "line_no").alias("value"))
    prim = prim.select(*key, dms_high(field(38, 48)).alias("ltp_lat"), dms_high(field(49, 60)).alias("ltp_lon"), _num(67, 70, 100).alias("glide_path_deg"), dms_high(field(71, 81)).alias("fpap_lat"), dms_high(field(82, 93)).alias("fpap_lon"), _num(99, 102).alias("offset_m"), _num(103, 108, 10).alias("tch_ft"))
    cont = pp.filter("part = '2'").groupBy(*key).agg(F.max_by("value", "line_no").alias("value"))
    cont = cont.select(*key, F.round(_num(41, 46, 10) * 3.280839895).cast("int").alias("ltp_height_ft"), F.coalesce(trimmed(47, 56), F.lit("LPV")).alias("approach_type"), F.coalesce(trimmed(57, 61).try_cast("int"), F.lit(0)).alias("channel"))
    return prim.join(cont, key)


def msa(rec: DataFrame) -> DataFrame:
    """Sectors of minimum sector altitudes: bearing to, altitude in feet, radius."""
    n = (119 - 10 - 43) // 11 + 1
    sector = lambda i: F.struct(
        F.substring("value", 43 + 11 * i + 3, 3).try_cast("int").alias("bearing_to"), (F.substring("value", 43 + 11 * i + 6, 3).try_cast("int") * 100).alias("altitude_ft"),
        F.coalesce(F.trim(F.substring("value", 43 + 11 * i + 9, 2)).try_cast("int"), F.lit(25)).alias("radius_nm"),
    )
    all_ = F.filter(F.array(*[sector(i) for i in range(n)]), lambda s: s["altitude_ft"].isNotNull() & s["bearing_to"].isNotNull())
    return rec.filter("record_class = 'PS'").select("line_no", trimmed(7, 10).alias("airport_ident"), trimmed(14, 18).alias("center_fix"), all_.alias("sectors"))


def mora(rec: DataFrame) -> DataFrame:
    """Thirty grid altitudes (hundreds of feet) from a south-western corner; what is no number is 0."""
    sign = lambda c, plus: F.when(F.substring(c, 1, 1) == plus, 1).otherwise(-1)
    lat, lon = field(14, 16), field(17, 20)
    values = F.array(*[F.coalesce(F.trim(field(31 + 3 * i, 33 + 3 * i)).try_cast("int"), F.lit(0)) for i in range(30)])
    return rec.filter("record_class = 'AS'").select(
        "line_no", (sign(lat, "N") * F.substring(lat, 2, 2).try_cast("int")).alias("lat_deg"), (sign(lon, "E") * F.substring(lon, 2, 3).try_cast("int")).alias("lon_deg"), values.alias("values")
    )


def ils_associations(legs: DataFrame) -> DataFrame:
    """Approach to localizer: the first CF or TF leg to a runway with a navaid of an approach whose ident starts with I."""
    runway = F.col("fix_ident").startswith("RW")
    c = legs.filter((F.col("procedure_kind") == "F") & F.col("procedure_ident").startswith("I") & runway & F.col("path_terminator").isin("CF", "TF") & F.col("recommended_navaid").isNotNull())
    first = c.groupBy("airport_ident", "procedure_ident").agg(F.min_by(F.struct("fix_ident", "recommended_navaid", "course_b_deg", "vertical_angle_deg"), "line_no").alias("r"))
    return first.select("airport_ident", F.col("procedure_ident").alias("approach_ident"), F.regexp_replace("r.fix_ident", "^RW", "").alias("runway"), F.col("r.recommended_navaid").alias("localizer_ident"), F.col("r.course_b_deg").alias("bearing_mag_deg"), F.abs("r.vertical_angle_deg").alias("glideslope_deg"))


def first_wins(rows: DataFrame, key: list[str], payload: list[str], order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(first row per key, keys whose later rows say something else); exact repetitions are silent."""
    v = F.struct(*payload)
    g = rows.groupBy(*key).agg(F.min_by(v, order).alias("v"), F.count_distinct(F.to_json(v)).alias("n"))
    return g.select(*key, "v.*"), g.filter("n > 1").select(*key, (F.col("n") - 1).alias("conflicts"))


#: Which table a record class fills; a class that is not named fills none that closes by absence.
FILLS = {"EA": "waypoints", "PC": "waypoints", "D": "navaids", "DB": "navaids", "PN": "navaids", "PI": "navaids", "ER": "airway_legs", "PD": "procedure_legs", "PE": "procedure_legs", "PF": "procedure_legs", "PG": "runways"}


@dataclass
class Load:
    """What one file holds: entities by table, rejected records with their reason, repeated keys that disagree, and the
    report of the scan by class."""

    entities: dict[str, DataFrame]
    rejects: DataFrame
    conflicts: DataFrame
    report: DataFrame

    def masked(self) -> DataFrame:
        """(table_name, masked): whether records that did not decode may hide rows, so that absence closes nothing."""
        named = F.create_map(*[F.lit(x) for kv in FILLS.items() for x in kv])
        return self.report.withColumn("table_name", F.element_at(named, F.col("record_class"))).filter("table_name is not null").groupBy("table_name").agg((F.sum("rejected") > 0).alias("masked"))


def load(lines: DataFrame) -> Load:
    """A whole file (line_no, value) to entities, each class decoded from the one scan of ``records``.

    Localizers of both classes are merged, navaids and waypoints of one key keep the first record and count the others
    that say something else, localizers take the glide path and course that approaches name where they have none. A line
    of another width is rejected as such; one whose ident, position or frequency does not decode with its reason.
    """
    known = records(lines)
    wp, vhf, ndb = _waypoints(known), _vhf_stations(known), _ndb_stations(known)
    short = lines.filter(F.length("value") < WIDTH).select("line_no", F.lit("short").alias("record_class"), F.lit("short line").alias("reason"))
    rejects = reduce(DataFrame.unionByName, [short, *[x.filter("reason is not null").select("line_no", "record_class", "reason") for x in (wp, vhf, ndb)]])
    legs = procedure_legs(known)
    station = ["ident", "region", "navaid_type"]
    both = vhf_navaids(known).select("line_no", *station, "airport_ident", "frequency_khz", "latitude_deg", "longitude_deg", "name").unionByName(
        ndb_navaids(known).withColumn("navaid_type", F.lit("NDB")).select("line_no", *station, "airport_ident", "frequency_khz", "latitude_deg", "longitude_deg", "name")
    )
    is_loc = F.col("navaid_type") == "ILS-LOC"
    aids, aid_conflicts = first_wins(both.filter(~is_loc).withColumn("region", F.coalesce("region", F.lit(""))), station, ["airport_ident", "frequency_khz", "latitude_deg", "longitude_deg", "name"])
    points, point_conflicts = first_wins(_kept(wp).withColumn("airport_ident", F.coalesce("airport_ident", F.lit(""))), ["airport_ident", "ident", "region"], ["latitude_deg", "longitude_deg", "name"])
    pi = localizers(known)
    loc = merge_localizers(pi.filter("navaid_type = 'ILS-LOC'"), both.filter(is_loc))
    associations = ils_associations(legs)
    paired, alone = runways(known)
    named = lambda d, t, key: d.select(F.lit(t).alias("table_name"), F.concat_ws("/", *key).alias("key"), "conflicts")
    seen = known.groupBy("record_class").agg(F.count("*").alias("seen"))
    lost = rejects.groupBy("record_class").agg(F.count("*").alias("rejected"))
    report = seen.join(lost, "record_class", "full_outer").select("record_class", F.coalesce("seen", "rejected").alias("seen"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
    return Load(
        {
            "waypoints": points, "navaids": aids, "localizers": enriched(loc, associations), "glide_paths": pi.filter("navaid_type = 'ILS-GS'"), "airway_legs": airway_legs(known), "procedure_legs": legs, "runways": paired,
            "unpaired_ends": alone, "path_points": path_points(known), "msa": msa(known), "mora": mora(known), "ils_associations": associations,
        },
        rejects, named(aid_conflicts, "navaids", station).unionByName(named(point_conflicts, "waypoints", ["airport_ident", "ident", "region"])), report,
    )


def enriched(loc: DataFrame, associations: DataFrame) -> DataFrame:
    """Localizers with the runway, course and glide path of the first approach that names them."""
    a = associations.groupBy("airport_ident", F.col("localizer_ident").alias("ident")).agg(F.min_by(F.struct("runway", "bearing_mag_deg", "glideslope_deg"), "approach_ident").alias("a"))
    return loc.join(a, ["airport_ident", "ident"], "left").select(*loc.columns, "a.runway", "a.bearing_mag_deg", "a.glideslope_deg")


def line(fields: dict[int, Column]) -> Column:
    """A record of full width with each text at its column, counted from 1; a null text is blank."""
    out, at = F.lit(""), 0
    for col in sorted(fields):
        out = F.concat(F.rpad(out, col - 1, " "), F.coalesce(fields[col], F.lit("")))
        at = col
    return F.rpad(out, max(WIDTH, at), " ")
