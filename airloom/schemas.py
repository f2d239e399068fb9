"""Entity and metadata schemas. Every entity row carries its validity period and the snapshot it came from."""

from pyspark.sql import types as T

VERSION = 13
_VALID = "valid_from timestamp, valid_until timestamp, source_snapshot_id string"



DDL = {
    "airports": f"id string, ident string, name string, airport_type string, latitude_deg double, longitude_deg double, elevation_ft double, iso_country string, municipality string, {_VALID}",
    "runways": f"id string, airport_id string, airport_ident string, official_designator string, computed_magnetic_designator string, true_heading_deg double, length_ft int, width_ft int, surface string, le_ident string, le_lat double, le_lon double, le_elevation_ft double, he_ident string, he_lat double, he_lon double, he_elevation_ft double, {_VALID}",
    "navaids": f"id string, ident string, name string, navaid_type string, frequency_khz int, latitude_deg double, longitude_deg double, elevation_ft double, region string, associated_airport string, magnetic_variation_deg double, associated_runway string, localizer_bearing_true_deg double, localizer_bearing_mag_deg double, glideslope_angle_deg double, slaved_variation_deg double, service_volume_nm int, dme_paired boolean, {_VALID}",
    "waypoints": f"id string, ident string, name string, latitude_deg double, longitude_deg double, datum string, region string, is_enroute boolean, waypoint_type long, terminal_area_ident string, {_VALID}",
    "airway_legs": f"id string, route_ident string, route_type string, level string, sequence_number int, start_fix string, start_icao_code string, end_fix string, end_icao_code string, direction string, minimum_altitude_ft int, maximum_altitude_ft int, {_VALID}",
    "procedure_legs": f"id string, airport_ident string, icao_code string, procedure_kind string, procedure_ident string, route_type string, transition_ident string, sequence_number int, fix_ident string, fix_icao_code string, fix_section string, waypoint_description string, turn_direction string, rnp_nm double, path_terminator string, recommended_navaid string, arc_radius_nm double, course_a_deg double, distance_a_nm double, course_b_deg double, distance_b_nm double, altitude_descriptor string, altitude_1_ft int, altitude_2_ft int, speed_limit_kts int, course_c_deg double, vertical_angle_deg double, msa_center_fix string, route_qualifiers string, raw string, {_VALID}",
    "lpv_fas": f"id string, airport_ident string, approach_ident string, runway string, ltp_lat double, ltp_lon double, fpap_lat double, fpap_lon double, glide_path_deg double, offset_m double, tch_ft double, ltp_height_ft int, approach_type string, channel int, {_VALID}",
    "msa": f"id string, airport_ident string, center_fix string, sectors array<struct<bearing_to:int,altitude_ft:int,radius_nm:int>>, {_VALID}",
    "mora": f"id string, lat_deg int, lon_deg int, values array<int>, {_VALID}",
    "ils_associations": "airport_ident string, approach_ident string, runway string, localizer_ident string, bearing_mag_deg double, glideslope_deg double",
    "source_snapshots": "id string, provider string, dataset string, uri string, content_sha256 string, retrieved_at timestamp",
    "observations": "entity_table string, entity_id string, valid_from timestamp, source_snapshot_id string",
    "cycles": "id string, status string, effective_from timestamp, effective_until timestamp",
    "tombstones": "entity_table string, entity_id string, effective_from timestamp, source_snapshot_id string, outcome string",
    "publication_applications": "publication_id string, provider string, kind string, content_sha256 string, applied_at timestamp, created long, updated long, unchanged long, closed long",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
