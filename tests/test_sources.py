import json

import pytest
from pyspark.sql import functions as F

from roadweave.operators import catalog, cleaning, logs, matching
from roadweave.plans import calibration
from roadweave.sources import readers, store, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


NET = """<net><location netOffset="{offset}" projParameter="{proj}"/>
<edge id=":int" ><lane id="i_0" index="0" shape="0,0 1,1"/></edge>
<edge id="A" priority="4" type="road"><lane id="A_0" index="0" allow="bus" speed="8.5" shape="0.0,0.0 10.0,0.0"/><lane id="A_1" index="1" shape="0.0,2.0 10.0,2.0 20.0,2.0"/></edge>
<edge id="B"><lane id="B_0" index="0" disallow="truck" speed="10" shape="20.0,2.0 30.0,2.0"/></edge>
<edge id="bare"/>
<connection from="A" to="B" fromLane="{lane}" toLane="0"/><connection from=":int" to="B"/></net>"""


@pytest.mark.parametrize(("lane", "linked"), [(0, False), (1, True)])
def test_network_files(spark, tmp_path, lane, linked):
    put(tmp_path / "area_id=x" / "net.xml", NET.format(offset="12.5,-7.25", proj="+proj=utm +zone=33 +ellps=WGS84", lane=lane))
    root = str(tmp_path)
    lanes = readers.read_net_lanes(spark, root)
    edges = {r["edge_id"]: r for r in matching.build_edges(lanes).collect()}
    assert set(edges) == {"A", "B"} and edges["A"]["speed"] == 13.89 and len(edges["A"]["geometry"]) == 3
    assert (edges["A"]["num_lanes"], edges["A"]["priority"], edges["B"]["priority"], edges["A"]["area_id"]) == (2, 4, -1, "x")
    links = matching.build_links(readers.read_net_connections(spark, root), lanes).collect()
    assert [(r["from_edge"], r["to_edge"]) for r in links] == ([("A", "B")] if linked else [])
    where = readers.read_net_location(spark, root).first()
    assert (where["x_off"], where["y_off"]) == (12.5, -7.25)


def test_bad_offset_is_zero(spark, tmp_path):
    put(tmp_path / "net.xml", NET.format(offset="oops", proj="!", lane=0))
    where = readers.read_net_location(spark, str(tmp_path)).first()
    assert (where["x_off"], where["y_off"]) == (0.0, 0.0)


@pytest.mark.parametrize(
    ("legacy", "own", "teleports"),
    [('', '<teleports total="7" jam="1"/>', 7), ('teleports="2"', "", 2), ('teleports="2"', '<teleports total="9"/>', 9), ("", "", 0), ('teleports="2"', "<teleports/>", 0)],
)
def test_statistics(spark, tmp_path, legacy, own, teleports):
    put(tmp_path / "scenario_id=s" / "stat.xml", f'<root><statistics><vehicles loaded="100" inserted="90" running="10" waiting="5" {legacy}/>{own}</statistics></root>')
    r = readers.read_sim_statistics(spark, str(tmp_path)).first()
    assert (r["loaded"], r["inserted"], r["running"], r["waiting"], r["scenario_id"]) == (100, 90, 10, 5, "s")
    assert r["teleports"] == (teleports if own != "<teleports/>" else r["teleports"])


def test_statistics_with_the_element_as_root(spark, tmp_path):
    put(tmp_path / "scenario_id=s" / "stat.xml", '<?xml version="1.0"?>\n<statistics xmlns="urn:x"><vehicles loaded="3" inserted="2" running="1" waiting="0"/><teleports total="4"/></statistics>')
    r = readers.read_sim_statistics(spark, str(tmp_path)).first()
    assert (r["loaded"], r["teleports"]) == (3, 4)


def test_intervals_and_unreadable_files(spark, tmp_path):
    put(tmp_path / "scenario_id=a" / "e.xml", '<meandata><interval begin="0" end="60"><edge id="x" speed="5"/></interval><interval begin="60" end="120"><edge id="x" speed="10"/><edge id="y" speed="-1.00"/><edge id="z"/></interval><interval begin="120" end="180"/></meandata>')
    put(tmp_path / "scenario_id=b" / "e.xml", '<meandata><interval begin="0" end="60"><edge id="x" spe')
    rows = readers.read_edge_intervals(spark, str(tmp_path))
    from roadweave.operators import objective

    speeds = objective.mean_edge_speeds(rows, 60).collect()
    assert [(r["scenario_id"], r["edge_id"], r["speed_kmh"]) for r in speeds] == [("a", "x", 36.0)]
    c = {r["scenario_id"]: r for r in objective.interval_coverage(rows, 60).collect()}["a"]
    assert (c["total_intervals"], c["warmup_intervals"], c["edges_in_warmup"], c["edges_in_measurement"], c["only_in_warmup"]) == (3, 1, 1, 1, False)


def test_trips_from_both_forms(spark, tmp_path):
    put(tmp_path / "t.xml", '<routes><trip id="1" depart="5.5" from="a" to="b"/><trip id="2" from="a"/><vehicle id="3" depart="7"><route edges=" x y  z "/></vehicle><vehicle id="4" depart="7"><route edges=""/></vehicle></routes>')
    rows = {r["trip_id"]: (r["departure"], r["origin"], r["destination"]) for r in readers.read_trips(spark, str(tmp_path)).collect()}
    assert rows == {"1": (5.5, "a", "b"), "3": (7.0, "x", "z")}


def test_traffic_and_observed_csv(spark, tmp_path):
    put(tmp_path / "t.csv", 'segment_id,geometry,current_speed,freeflow_speed,timestamp,quality\nFRC1_2,"[(20.01, 50.0), (20.02, 50.1)]",31.0,50.0,2026-02-17 15:07:39.123456,0.9\n')
    r = readers.read_traffic_csv(spark, str(tmp_path / "t.csv")).first()
    assert (r["geometry"][1]["lon"], r["geometry"][1]["lat"], r["current_speed"], r["timestamp"].microsecond) == (20.02, 50.1, 31.0, 123456)
    put(tmp_path / "o.csv", "edge_id,segment_id,current_speed,freeflow_speed,timestamp,match_confidence\n-12#3,s,31.0,,2026-02-17 15:07:39,1.0\n")
    o = readers.read_observed_csv(spark, str(tmp_path / "o.csv")).first()
    assert (o["edge_id"], o["freeflow_speed"], o["match_confidence"]) == ("-12#3", None, 1.0)


def test_tiles(spark, tmp_path):
    def feature(properties, kind="LineString", coordinates=((1, 2), (3, 4))):
        return {"properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}

    features = [
        feature({"id": 5, "road": 1}), feature({"traffic_level": 37}), {"properties": {"speed": 3}}, feature({"speed": 3}, "Point", (1, 2)),
        feature({"speed": 3}, "MultiLineString", [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]]), feature({"speed": 3}, "LineString", [[1, 2]]),
        feature({"speed": 3}, "LineString", [[1, 2], [1, 2, 3]]), feature({"speed": 3}, "MultiLineString", []), feature({"uuid": "u", "cs": "x", "s": "9", "ff": 60, "conf": 0.5}),
    ]
    put(tmp_path / "t.json", json.dumps({"x": 18206, "y": 11103, "zoom": 15, "layers": {"flow": {"extent": 4096, "features": features}}}))
    rows = {r["feature_idx"]: r for r in cleaning.decode_features(readers.read_tile_features(spark, str(tmp_path))).collect()}
    assert [rows[i]["drop_reason"] for i in range(9)] == [
        "missing_speed_property", None, "missing_geometry", "unsupported_geometry_type", None, "short_geometry_line", "invalid_geometry_point", "empty_geometry_lines", None]
    assert (rows[1]["current_speed"], rows[1]["freeflow_speed"], rows[1]["quality"]) == (37.0, 37.0, 0.9)
    assert rows[1]["segment_id"].startswith("flow_") and len(rows[4]["geometry"]) == 3
    assert (rows[8]["segment_id"], rows[8]["current_speed"], rows[8]["freeflow_speed"], rows[8]["quality"]) == ("u", 9.0, 60.0, 0.5)


def test_ingest_diagnostics_account_for_every_feature(spark):
    point = "array<struct<lon:double,lat:double>>"
    rows = [("A", "s1", [(1.0, 1.0)], None), ("A", "s1", [(1.0, 1.0)], None), ("A", "s2", [(9.0, 9.0)], None), ("A", None, [(1.0, 1.0)], None),
            ("A", None, [(1.0, 1.0)], None), ("A", None, None, "missing_geometry"), ("B", None, None, "short_geometry_line")]
    decoded = spark.createDataFrame(rows, f"area_id string, segment_id string, geometry {point}, drop_reason string")
    areas = spark.createDataFrame([("A", 0.0, 0.0, 2.0, 2.0)], "area_id string, west double, south double, east double, north double")
    r = {x["area_id"]: x for x in cleaning.ingest_diagnostics(decoded, areas, []).collect()}
    a = r["A"]
    assert (a["features_total"], a["segments_decoded"], a["missing_geometry"]) == (6, 5, 1)
    assert (a["segments_dropped_outside_bbox"], a["segments_dropped_duplicate_id"], a["segments_kept"]) == (1, 1, 3)
    assert (r["B"]["short_geometry_line"], r["B"]["segments_kept"]) == (1, 0)


def test_catalog_scan_and_lookup(spark, tmp_path):
    box = {"west": 1.0, "south": 2.0, "east": 3.0, "north": 4.0}
    for root, name, meta in (
        ("gen", "alpha", {"bbox": box, "quality": {"score": 95, "label": "excellent"}, "created_at": "2026-01-01"}), ("gen", "beta", {"bbox": {**box, "east": 0.5}}),
        ("gen", "gamma", {"bbox": {"west": 1.0}}), ("pack", "alpha", {"bbox": box}), ("pack", "delta", {"bbox": box}),
    ):
        put(tmp_path / root / name / "dataset_meta.json", json.dumps(meta, indent=2))
    put(tmp_path / "gen" / "broken" / "dataset_meta.json", "{nope")
    gen = readers.scan_dataset_catalog(spark, str(tmp_path / "gen"), "generated")
    pack = readers.scan_dataset_catalog(spark, str(tmp_path / "pack"), "packaged")
    both = catalog.union_catalogs(gen, pack)
    listed = catalog.catalog_listing(both).collect()
    assert [r["id"] for r in listed] == ["generated:alpha", "packaged:alpha", "packaged:delta"]
    assert (listed[0]["quality_score"], listed[0]["quality_label"]) == (95.0, "excellent")
    refs = spark.createDataFrame([("alpha",), ("delta",), ("generated:alpha",), ("beta",), (" ",)], "ref string")
    status = {r["ref"]: (r["status"], r["dataset_id"]) for r in catalog.resolve_datasets(refs, both).collect()}
    assert status == {"alpha": ("ambiguous", None), "delta": ("ok", "packaged:delta"), "generated:alpha": ("ok", "generated:alpha"), "beta": ("not_found", None), " ": ("required", None)}


def test_runs_logs_and_storage(spark, tmp_path):
    lines = "".join(f"2026-01-01 00:00:{i % 60:02} - app - INFO - step {i} - a - b \n" for i in range(170))
    put(tmp_path / "runs" / "run_one" / "logs" / "pipeline.log", lines + "2026 - app - DEBUG - x\nplain\n2026 - app - ERROR - bad\n2026 - app - INFO -   \n")
    put(tmp_path / "runs" / "run_two" / "logs" / "pipeline.log", "2026 - app - WARNING - careful\n")
    put(tmp_path / "runs" / "other" / "file.txt", "x")
    assert sorted(r["run_id"] for r in readers.scan_runs(spark, str(tmp_path / "runs")).collect()) == ["one", "two"]
    parsed = cleaning.parse_log_lines(readers.read_pipeline_log(spark, str(tmp_path / "runs" / "run_*" / "logs")))
    kept = logs.recent_logs(parsed, 100).where("run_id = 'one'").orderBy("line_no").collect()
    assert len(kept) == 100 and (kept[-1]["level"], kept[-1]["message"]) == ("error", "bad") and kept[0]["message"] == "step 71 - a - b"
    put(tmp_path / "cache" / "osm" / "a.osm", "12345")
    put(tmp_path / "cache" / "osm" / "a.osm.meta.json", "{}")
    r = store.storage_stats(readers.list_files(spark, str(tmp_path / "cache"))).first()
    assert (r["category"], r["files"], r["size_mb"]) == ("osm", 1, pytest.approx(7 / 1024 / 1024))


def test_materialize_builds_a_key_once(spark, tmp_path):
    root, built = str(tmp_path / "store"), []

    def build(missing):
        built.append(sorted(r["cache_key"] for r in missing.collect()))
        return missing.where("n > 0").select("cache_key", (F.col("n") * 2).alias("twice"))

    def keys(*rows):
        return spark.createDataFrame(rows, "cache_key string, n int")

    store.materialize(keys(("1", 1), ("2", 0)), build, root)
    out = store.materialize(keys(("1", 1), ("2", 0), ("3", 3)), build, root)
    assert built == [["1", "2"], ["2", "3"]]
    assert sorted((r["cache_key"], r["twice"]) for r in out.collect()) == [("1", 2), ("3", 6)]


def test_bundle_completeness(spark):
    files = spark.createDataFrame([("a", f) for f in store.REQUIRED_FILES] + [("b", "dataset_meta.json"), ("b", "x")], "dataset string, rel_path string")
    rows = {r["dataset"]: r for r in store.bundle_completeness(files).collect()}
    assert rows["a"]["complete"] and rows["a"]["missing"] == []
    assert rows["b"]["missing"] == ["data/observed_edges.csv", "data/traffic_data_raw.csv", "sumo/network.net.xml"]


def test_demand_files_round_trip(spark, tmp_path):
    rows = [("s", "trip_0", "a", "b", 30.0), ("s", "trip_1", "a", "b", 12.3456789), ("t", "trip_0", "c", "d", 1.0)]
    trips = spark.createDataFrame(rows, "scenario_id string, trip_id string, origin string, destination string, departure double")
    writers.write_demand_csv(trips, str(tmp_path / "csv"))
    text = [p.read_text() for p in (tmp_path / "csv" / "scenario_id=s").glob("*.csv")]
    assert text[0].splitlines()[0] == "ID,origin link id,destination link id,departure timestep" and "trip_1" in text[0].splitlines()[1]
    writers.write_trips_xml(trips, str(tmp_path / "xml"))
    back = sorted((r["trip_id"], r["departure"]) for r in readers.read_trips(spark, str(tmp_path / "xml")).where("scenario_id = 's'").collect())
    assert back == [("trip_0", 30.0), ("trip_1", 12.345679)]


def test_preparation_of_two_areas(spark):
    """A straight road and one observed segment 30 m beside it, far apart in two areas."""
    areas = spark.createDataFrame([("A", 2.9, 47.9, 3.1, 48.1), ("B", 2.9, 47.9, 3.1, 48.1)], "area_id string, west double, south double, east double, north double")
    places = spark.createDataFrame([("A", "+proj=utm +zone=31", -500000.0, -5316000.0), ("B", "+proj=merc", 0.0, 0.0)], "area_id string, proj string, x_off double, y_off double")
    lane = "area_id string, edge_id string, priority int, type string, lane_pos int, lane_index int, allow string, disallow string, speed double, shape string"
    lanes = spark.createDataFrame([(a, "road", 1, "", 0, 0, "", "", 10.0, "-500,330 500,330") for a in "AB"], lane)
    links = spark.createDataFrame([("A", "road", "road", 0, 0)], "area_id string, from_edge string, to_edge string, from_lane int, to_lane int")
    point = "array<struct<lon:double,lat:double>>"
    rows = [(a, i, "s", [(3.0, 48.0), (3.001, 48.0)], 30.0, 50.0, None, 0.9) for a in "AB" for i in range(3)] + [("A", 9, "far", [(9.0, 48.0), (9.1, 48.0)], 1.0, 1.0, None, 0.9)]
    segments = spark.createDataFrame(rows, f"area_id string, n int, segment_id string, geometry {point}, current_speed double, freeflow_speed double, timestamp timestamp, quality double")
    calibration.register_provider("fixed", lambda s, a: segments)
    got = calibration.prepare(calibration.fetch_segments("fixed", spark, areas), lanes, links, places, areas, ["n"])
    matched = got.observed.collect()
    assert [(r["area_id"], r["edge_id"], r["segment_id"]) for r in matched] == [("A", "road", "s")] and matched[0]["match_confidence"] == pytest.approx(0.702, abs=0.002)
    scores = {r["area_id"]: r for r in got.quality.collect()}
    assert scores["B"]["recommendation"] == "do_not_proceed" and scores["A"]["fetched_segments"] == 1
    assert [r["area_id"] for r in got.passed.collect()] == ["A"]


def test_provider_result_is_checked(spark):
    calibration.register_provider("thin", lambda s, a: s.range(1))
    with pytest.raises(ValueError, match="lacks columns"):
        calibration.fetch_segments("thin", spark, None)


def test_files_may_hold_many_areas(spark, tmp_path):
    loc = spark.createDataFrame([("a", "+proj=utm +zone=3", "1,2"), ("b", None, "bad")], "_area_id string, _projParameter string, _netOffset string")
    loc.coalesce(1).write.format("xml").option("rootTag", "net").option("rowTag", "location").save(f"{tmp_path}/net")
    got = readers.read_net_location(spark, f"{tmp_path}/net", "area_id").collect()
    assert {(r["area_id"], r["proj"], r["x_off"], r["y_off"]) for r in got} == {("a", "+proj=utm +zone=3", 1.0, 2.0), ("b", None, 0.0, 0.0)}
    trips = spark.createDataFrame([("s", "1", "2.5", "0"), ("t", "1", "x", "1")], "_scenario_id string, _id string, _duration string, _waitingTime string")
    trips.coalesce(1).write.format("xml").option("rootTag", "tripinfos").option("rowTag", "tripinfo").save(f"{tmp_path}/trips")
    assert {(r["scenario_id"], r["id"]) for r in readers.read_tripinfo(spark, f"{tmp_path}/trips", "scenario_id").collect()} == {("s", "1"), ("t", "1")}
    seen = spark.createDataFrame([("e1", "s1", 3.0, 4.0, "2026-02-17 15:07:39.5", 0.5, "a"), ("e1", "s1", 5.0, 6.0, "2026-02-17 15:07:39.5", 0.5, "b")],
                                 "edge_id string, segment_id string, current_speed double, freeflow_speed double, timestamp string, match_confidence double, area_id string")
    seen.coalesce(1).write.option("header", True).csv(f"{tmp_path}/seen")
    assert {(r["area_id"], r["current_speed"]) for r in readers.read_observed_csv(spark, f"{tmp_path}/seen", "area_id").collect()} == {("a", 3.0), ("b", 5.0)}
    table = spark.createDataFrame([("s", "e", 1.0), ("t", "e", 2.0)], "scenario_id string, edge_id string, observed_speed double")
    writers.write_speed_comparison(table, f"{tmp_path}/compared", folders=False)
    assert not list((tmp_path / "compared").glob("scenario_id=*"))
    back = spark.read.option("header", True).csv(f"{tmp_path}/compared")
    assert back.columns[-1] == "scenario_id" and {(r["scenario_id"], r["observed_speed"]) for r in back.collect()} == {("s", "1.0"), ("t", "2.0")}


def test_a_stored_key_is_not_spread_over_all_tasks(spark, tmp_path):
    inputs = spark.createDataFrame([(f"k{i}",) for i in range(5)], "cache_key string")

    def build(missing):
        return missing.crossJoin(spark.range(40)).repartition(8, "id")

    stored = store.materialize(inputs, build, f"{tmp_path}/store")
    assert stored.count() == 200
    assert len(list((tmp_path / "store").glob("cache_key=*/*.parquet"))) == 5


def test_catalog_of_files_that_datasets_share(spark, tmp_path):
    box = "named_struct('west', 1.0D, 'south', 1.0D, 'east', 2.0D, 'north', id)"
    rows = spark.range(40).selectExpr("concat('ds', id) AS dataset", f"{box} AS bbox", "named_struct('label', 'good', 'score', 7.0D) AS quality")
    writers.write_meta_json(rows.coalesce(2), str(tmp_path / "shared"))
    found = readers.scan_dataset_catalog(spark, str(tmp_path / "shared"), "packaged", "*.json", "dataset").collect()
    # A box without height is not listed; no folder is made for a dataset.
    assert {(r["id"], r["name"], r["north"], r["quality_label"]) for r in found} == {(f"packaged:ds{i}", f"ds{i}", float(i), "good") for i in range(2, 40)}
    assert len(list((tmp_path / "shared").glob("*.json"))) == 2


def test_trips_of_files_that_scenarios_share(spark, tmp_path):
    trips = spark.range(60).selectExpr("concat('s', id % 20) AS scenario_id", "concat('t', id) AS trip_id", "'a' AS origin", "'b' AS destination", "id * 0.5D AS departure")
    writers.write_trips_xml(trips, str(tmp_path / "xml"), folders=False)
    back = readers.read_trips(spark, str(tmp_path / "xml"), "scenario_id").collect()
    assert {(r["scenario_id"], r["trip_id"], r["departure"]) for r in back} == {(f"s{i % 20}", f"t{i}", i * 0.5) for i in range(60)}
    assert not [p for p in (tmp_path / "xml").iterdir() if p.is_dir()]
