"""Explicit schemas (DDL) of the documents and feeds."""

OSM = (
    "elements ARRAY<STRUCT<type: STRING, id: BIGINT, lon: DOUBLE, lat: DOUBLE, nodes: ARRAY<BIGINT>, "
    "tags: MAP<STRING, STRING>, members: ARRAY<STRUCT<type: STRING, ref: BIGINT, role: STRING>>>>"
)
_TRANSLATED = "STRUCT<Translations: ARRAY<STRUCT<Text: STRING, Language: STRING>>>"
_TRIP = "STRUCT<TripId: STRING, RouteId: STRING, schedule_relationship: INT>"
_TIME = "STRUCT<Time: BIGINT, Delay: INT>"
FEED_ENTITY = {
    "vehicles": (
        f"STRUCT<Id: STRING, Vehicle: STRUCT<Trip: {_TRIP}, Vehicle: STRUCT<Id: STRING, Label: STRING>, "
        "Position: STRUCT<Latitude: DOUBLE, Longitude: DOUBLE, Bearing: DOUBLE, Speed: DOUBLE>, CurrentStopSequence: INT, "
        "StopId: STRING, CurrentStatus: INT, Timestamp: BIGINT, congestion_level: INT, occupancy_status: INT>>"
    ),
    "trips": (
        f"STRUCT<Id: STRING, TripUpdate: STRUCT<Trip: {_TRIP}, StopTimeUpdates: ARRAY<STRUCT<StopId: STRING, "
        f"StopSequence: INT, Arrival: {_TIME}, Departure: {_TIME}>>>>"
    ),
    "alerts": (
        "STRUCT<Id: STRING, Alert: STRUCT<ActivePeriods: ARRAY<STRUCT<Start: BIGINT, End: BIGINT>>, "
        "InformedEntities: ARRAY<STRUCT<AgencyId: STRING, RouteId: STRING, StopId: STRING>>, cause: INT, effect: INT, "
        f"Url: STRING, HeaderText: {_TRANSLATED}, DescriptionText: {_TRANSLATED}>>"
    ),
}


def feed(kind: str) -> str:
    header = "Header STRUCT<GtfsRealtimeVersion: STRING, incrementality: INT, Timestamp: BIGINT>"
    return f"{header}, Entities ARRAY<{FEED_ENTITY[kind]}>"


GTFS = {
    "routes": ["route_id", "route_short_name", "route_long_name", "route_color", "route_text_color", "route_sort_order"],
    "trips": ["route_id", "shape_id", "trip_id"],
    "shapes": ["shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon"],
    "stops": ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "location_type"],
    "stop_times": ["stop_id", "trip_id"],
}
GEOJSON = "features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, properties: MAP<STRING, STRING>>>"
CALIBRATION = (
    "version INT, note STRING, cameras MAP<STRING, STRUCT<intersection: STRING, quads: MAP<STRING, STRUCT<imgW: INT, imgH: INT, "
    "H: ARRAY<DOUBLE>, points: ARRAY<STRUCT<img: ARRAY<DOUBLE>, scene: ARRAY<DOUBLE>>>, reprojError: DOUBLE>>>>"
)
_VEC = "ARRAY<DOUBLE>"
LAYERS = {
    "roads": f"STRUCT<pts: ARRAY<{_VEC}>, width: DOUBLE, class: STRING, name: STRING>",
    "intersections": (
        f"STRUCT<id: STRING, center: {_VEC}, degree: INT, control: STRING, controllingClass: STRING, footprintRadius: DOUBLE, "
        f"legs: ARRAY<STRUCT<idx: INT, bearingDeg: DOUBLE, roadIndex: INT, roadName: STRING, class: STRING, width: DOUBLE, "
        f"stopLine: ARRAY<{_VEC}>, stopPoint: {_VEC}, signalGroup: STRING, stopSign: BOOLEAN, pedSignal: BOOLEAN>>, "
        "phasePlan: STRUCT<cycleSec: INT, offsetSec: INT, groups: ARRAY<STRING>, phases: ARRAY<STRUCT<groupStates: "
        "MAP<STRING, STRING>, pedStates: MAP<STRING, STRING>, durSec: INT>>>>"
    ),
    "cameras": (
        f"STRUCT<id: STRING, name: STRING, lat: DOUBLE, lon: DOUBLE, pos: {_VEC}, camPos: {_VEC}, intersection: STRING, "
        "snapDist: DOUBLE, matched: BOOLEAN, still: STRING>"
    ),
    "routes": (
        f"STRUCT<id: STRING, shortName: STRING, longName: STRING, color: STRING, textColor: STRING, sortOrder: INT, "
        f"shapes: ARRAY<ARRAY<{_VEC}>>>"
    ),
    "stops": f"STRUCT<id: STRING, code: STRING, name: STRING, lat: DOUBLE, lon: DOUBLE, pos: {_VEC}, routes: ARRAY<STRING>>",
}
EPISODE = (
    "meta STRUCT<seed: BIGINT, agent_type: STRING, instruction: STRING, goal_name: STRING, goal: ARRAY<DOUBLE>, "
    "optimal_dist: DOUBLE, steps: BIGINT, success: BOOLEAN, ret: DOUBLE, path_len: DOUBLE>, "
    "action ARRAY<DOUBLE>, reward DOUBLE, terminated BOOLEAN, truncated BOOLEAN"
)
_TILE = (
    "STRUCT<name: STRING, mesh: STRING, mesh_bin: STRING, bin: STRING, texture: STRING, jpg: STRING, image: STRING, "
    f"translation_cm: {_VEC}, translationCm: {_VEC}, rotation_deg: {_VEC}, rotation_pyr_deg: {_VEC}, scale: {_VEC}, visible: BOOLEAN>"
)
_BUILDING = (
    f"STRUCT<name: STRING, file: STRING, bounds_min_cm: {_VEC}, boundsMinCm: {_VEC}, bounds_max_cm: {_VEC}, boundsMaxCm: {_VEC}, "
    "height_cm: DOUBLE, heightCm: DOUBLE, footprint_area_m2: DOUBLE, footprintAreaM2: DOUBLE, point_count: BIGINT, "
    "pointCount: BIGINT, vertex_count: BIGINT, vertexCount: BIGINT, index_count: BIGINT, indexCount: BIGINT, "
    "ground_y_m: DOUBLE, groundYm: DOUBLE, bridge: BOOLEAN>"
)
MANIFEST = (
    f"origin_cm {_VEC}, originCm {_VEC}, terrain STRUCT<tiles: ARRAY<{_TILE}>>, tiles ARRAY<{_TILE}>, "
    f"lidar STRUCT<offset_cm: {_VEC}, offsetCm: {_VEC}, original_coordinates: {_VEC}, originalCoordinates: {_VEC}, "
    "chunks: ARRAY<STRUCT<file: STRING, path: STRING, url: STRING, count: BIGINT, points: BIGINT>>>, "
    f"buildings STRUCT<tiles: ARRAY<{_BUILDING}>>"
)
