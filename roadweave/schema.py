"""Explicit schemas for every table, as DDL text; nothing is inferred."""

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """The schema object; needs a running session."""
    return T.StructType.fromDDL(ddl)


TRAFFIC_SEGMENTS = (
    "segment_id string, geometry array<struct<lon:double,lat:double>>, current_speed double, "
    "freeflow_speed double, timestamp timestamp, quality double, road_class string"
)

TRAFFIC_CSV = (
    "segment_id string, geometry string, current_speed double, freeflow_speed double, "
    "timestamp timestamp, quality double"
)

TILE_FEATURES = (
    "layer string, extent int, x int, y int, zoom int, feature_idx int, geom_type string, "
    "coordinates array<array<array<double>>>, properties map<string,string>"
)

TILE_FILE = (
    "x int, y int, zoom int, layers map<string,struct<extent:int,features:array<struct<"
    "properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>>"
)

FLOW_RESPONSE = (
    "flowSegmentData struct<frc:string,currentSpeed:double,freeFlowSpeed:double,confidence:double,"
    "coordinates:struct<coordinate:array<struct<latitude:double,longitude:double>>>>"
)

OBSERVED_EDGES = (
    "edge_id string, segment_id string, current_speed double, freeflow_speed double, "
    "timestamp timestamp, match_confidence double"
)

NET_EDGE_XML = (
    "_id string, _priority string, _type string, lane array<struct<_index:string,_allow:string,"
    "_disallow:string,_speed:string,_shape:string>>"
)

NET_CONNECTION_XML = ("_from string, _to string, _fromLane string, _toLane string")

NET_LOCATION_XML = ("_projParameter string, _netOffset string")

INTERVAL_XML = ("_begin string, _end string, edge array<struct<_id:string,_speed:string>>")

TRIPINFO_XML = ("_id string, _duration string, _waitingTime string")

STATISTICS_XML = (
    "vehicles struct<_loaded:string,_inserted:string,_running:string,_waiting:string,_teleports:string>, "
    "teleports struct<_total:string>"
)

TRIP_XML = ("_id string, _depart string, _from string, _to string")

VEHICLE_XML = ("_id string, _depart string, route struct<_edges:string>")

DATASET_META = (
    "dataset_name string, created_at string, "
    "bbox struct<west:double,south:double,east:double,north:double>, traffic_tile_zoom int, "
    "provider map<string,string>, "
    "stats struct<fetched_segments:bigint,matched_edges:bigint,total_network_edges:bigint>, "
    "quality struct<score:double,label:string,recommendation:string,summary:string,warnings:array<string>>, "
    "files map<string,string>"
)

SIMULATED_SPEEDS = ("area_id string, scenario_id string, edge_id string, speed_kmh double")

METRICS = (
    "e_loss double, fail_total double, routing_failures double, teleports double, "
    "reliability_penalty double, zero_flow_edges double, total_vehicles bigint, "
    "avg_trip_duration double, avg_waiting_time double, worker_error boolean, error string"
)
