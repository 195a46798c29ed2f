import hashlib
import json

import pytest
from pyspark.sql import functions as F

from roadweave.functions import geo, keys, observe, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def boxed(*values):
    return [F.lit(float(v)) for v in values]


@pytest.mark.parametrize(
    ("start", "end", "n", "expected"),
    [(0, 120, 4, [30, 60, 90, 120]), (60, 120, 1, [120]), (10, 10, 3, [10] * 3), (20, 10, 2, [10, 10]), (0, 9, 0, []), (0, 9, -5, [])],
)
def test_departure_times(spark, start, end, n, expected):
    assert one(spark, observe.departure_times(F.lit(start), F.lit(end), F.lit(n))) == expected


@pytest.mark.parametrize(("value", "text"), [(30.0, "30"), (12.5, "12.5"), (33.333333333, "33.333333"), (0.0, "0"), (100.0, "100")])
def test_format_departure(spark, value, text):
    assert one(spark, observe.format_departure(F.lit(value))) == text


@pytest.mark.parametrize(("value", "n"), [(2.5, 2), (3.5, 4), (-1.2, 0), (0.5, 0), (7.0, 7)])
def test_gene_to_count_rounds_half_even(spark, value, n):
    assert one(spark, observe.gene_to_count(F.lit(value))) == n


def test_tile_of_point(spark):
    tile = one(spark, geo.lonlat_to_tile(F.lit(20.0174), F.lit(50.0702), F.lit(15)))
    bounds = one(spark, geo.tile_bounds(F.lit(tile["x"]), F.lit(tile["y"]), F.lit(15)))
    assert (tile["x"], tile["y"]) == (18206, 11103)
    assert bounds["west"] <= 20.0174 < bounds["east"] and bounds["south"] < 50.0702 <= bounds["north"]
    corner = one(spark, geo.tile_to_lonlat(F.lit(0.0), F.lit(0.0), F.lit(18206), F.lit(11103), F.lit(15), F.lit(4096)))
    assert corner["lon"] == pytest.approx(bounds["west"]) and corner["lat"] == pytest.approx(bounds["north"])


def test_utm_control_points(spark):
    def xy(lon, lat, zone, south=False):
        return one(spark, geo.to_network_xy(F.lit(lon), F.lit(lat), F.lit(zone), F.lit(south), F.lit(0.0), F.lit(0.0)))

    centre = xy(3.0, 0.0, 31)
    assert (centre["x"], centre["y"]) == pytest.approx((500000.0, 0.0), abs=1e-6)
    tower = xy(-79.387139, 43.642567, 17)
    assert (tower["x"], tower["y"]) == pytest.approx((630084, 4833438), abs=1.0)
    # Mirror images across the central meridian and the equator.
    a, b, s = xy(4.0, 40.0, 31), xy(2.0, 40.0, 31), xy(4.0, -40.0, 31, True)
    assert a["x"] - 500000 == pytest.approx(500000 - b["x"]) and a["y"] == pytest.approx(10000000 - s["y"])


@pytest.mark.parametrize(("lon", "lat", "code"), [(20.0, 50.0, "EPSG:32634"), (-180.0, -1.0, "EPSG:32701"), (180.0, 0.0, "EPSG:32660")])
def test_utm_epsg(spark, lon, lat, code):
    assert one(spark, geo.utm_epsg(*boxed(lon, lat, lon, lat))) == code


def test_projection_zone_rejects_other_projections(spark):
    utm = one(spark, geo.projection_zone(F.lit("+proj=utm +zone=33 +south +ellps=WGS84")))
    assert (utm["zone"], utm["south"]) == (33, True)
    assert one(spark, geo.projection_zone(F.lit("+proj=merc +zone=33"))) is None


@pytest.mark.parametrize(
    ("box", "message"),
    [
        ((2, 48, 3, 49), "Valid bbox"), ((-190, 48, 3, 49), "Longitude must be between -180 and 180"),
        ((2, -91, 3, 49), "Latitude must be between -90 and 90"), ((3, 48, 3, 49), "West must be less than East"),
        ((2, 49, 3, 49), "South must be less than North"),
    ],
)
def test_valid_bbox(spark, box, message):
    result = one(spark, geo.valid_bbox(*boxed(*box)))
    assert result["message"] == message and result["ok"] == (message == "Valid bbox")


def test_segment_distance(spark):
    def distance(*p):
        return one(spark, geo.segment_distance(*boxed(*p)))

    assert distance(0, 0, 10, 0, 5, -5, 5, 5) == 0
    assert distance(0, 0, 10, 0, 0, 3, 10, 3) == 3
    assert distance(0, 0, 10, 0, 13, 4, 20, 4) == 5
    assert distance(1, 1, 1, 1, 4, 5, 4, 5) == 5


def test_centroid_without_geometry(spark):
    empty = F.array().cast("array<struct<x:double,y:double>>")
    assert tuple(one(spark, geo.line_centroid(empty))) == (0.0, 0.0)


@pytest.mark.parametrize(
    ("allow", "disallow", "ok"),
    [("", "", True), ("bus", "", False), ("bus passenger", "passenger", True), ("", "passenger", False), ("", "truck", True), (None, None, True)],
)
def test_vclass(spark, allow, disallow, ok):
    assert one(spark, observe.vclass_allowed(F.lit(allow).cast("string"), F.lit(disallow).cast("string"))) is ok


def test_speed_no_data_is_an_exact_text(spark):
    assert one(spark, observe.speed_kmh(F.lit("-1.00"))) is None
    assert one(spark, observe.speed_kmh(F.lit(""))) is None
    assert one(spark, observe.speed_kmh(F.lit("-1.0"))) == pytest.approx(-3.6)
    assert one(spark, observe.speed_kmh(F.lit("10"))) == pytest.approx(36.0)


def test_first_prop_skips_unreadable(spark):
    props = F.create_map(F.lit("traffic_level"), F.lit("fast"), F.lit("speed"), F.lit("37"))
    assert one(spark, observe.first_prop_double(props, observe.CURRENT_SPEED_KEYS)) == 37.0


def test_keys_equal_compact_sorted_json(spark):
    def digest(data):
        return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    box = {"type": "bbox", "west": 2.2961, "south": 48.8469, "east": 2.3071, "north": 48.8532}
    assert one(spark, keys.bbox_key(*boxed(2.29610000001, 48.8469, 2.3071, 48.8532))) == digest(box)
    traffic = {"type": "traffic", "bbox_key": "k", "provider": "p", "timestamp_bucket": "b"}
    plain = keys.traffic_key(F.lit("k"), F.lit("p"), F.lit("b"))
    assert one(spark, plain) == digest(traffic)
    zoomed = keys.traffic_key(F.lit("k"), F.lit("p"), F.lit("b"), F.lit(12))
    assert one(spark, zoomed) == digest({**traffic, "zoom": 12})


@pytest.mark.parametrize(("genes", "base"), [([1, 2, 3], 42), ([1, 2, 4], 42), ([1, 2, 3], 7), ([0], 0), ([-5, 2**40], 2**35 + 9)])
def test_stable_seed(spark, genes, base):
    raw = b"".join(g.to_bytes(8, "little", signed=True) for g in genes)
    expected = (int.from_bytes(hashlib.sha256(raw).digest()[:8], "little") ^ base) % (2**32 - 1)
    assert one(spark, keys.stable_seed(F.array(*[F.lit(g) for g in genes]), F.lit(base))) == expected


def test_uniform_depends_on_values_only(spark):
    df = spark.range(1000).select(keys.uniform(1, "id", F.lit("a")).alias("u"), "id")
    same = df.repartition(7).orderBy("id").collect() == df.orderBy("id").collect()
    values = [r["u"] for r in df.collect()]
    assert same and len(set(values)) > 990 and 0.45 < sum(values) / 1000 < 0.55


def metrics(**given):
    types = {"worker_error": "boolean", "error": "string"}
    names = ("e_loss", "fail_total", "routing_failures", "teleports", "reliability_penalty", "worker_error", "error")
    return {n: F.lit(given.get(n)).cast(types.get(n, "double")) for n in names}


@pytest.mark.parametrize(
    ("loss", "given", "ok"),
    [
        (10.0, {"fail_total": 0.0}, True), (10.0, {"fail_total": 2.0}, False), (10.0, {"fail_total": 0.0, "worker_error": True}, False),
        (None, {"fail_total": 0.0}, False), (float("inf"), {"fail_total": 0.0}, False), (10.0, {"routing_failures": 1.0}, False), (10.0, {}, True),
    ],
)
def test_feasible(spark, loss, given, ok):
    assert one(spark, scoring.is_feasible(F.lit(loss).cast("double"), metrics(**given))) is ok


def test_error_only_evaluation_counts_as_one_failure(spark):
    assert one(spark, scoring.effective_fail_total(metrics(error="boom"))) == 1
    assert one(spark, scoring.effective_e_loss(F.lit(3.0), metrics(error="boom"))) == float("inf")
    assert one(spark, scoring.effective_penalty(F.lit(9.0), metrics(e_loss=7.0))) == 2.0


def test_parse_bbox(spark):
    assert tuple(one(spark, observe.parse_bbox(F.lit("2.29, 48.84,2.31 ,48.86")))) == (2.29, 48.84, 2.31, 48.86)
    assert one(spark, observe.parse_bbox(F.lit("1,2,3"))) is None
    assert one(spark, observe.parse_bbox(F.lit("1,2,3,x"))) is None


def test_time_bucket_is_five_minutes_utc(spark):
    b = one(spark, observe.time_bucket(F.lit("2024-01-28 18:09:59").cast("timestamp")))
    assert b["label"] == "2024-01-28T18:05"
