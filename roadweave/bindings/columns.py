"""Column functions over whole base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.bindings import proxies as P
from roadweave.bindings.proxies import r6, s6
from roadweave.bindings.registry import query
from roadweave.functions import geo, keys, observe, scoring
from roadweave.operators import areas, population

c = F.col


def _num(expr):
    return expr.cast("double")


def _boxes(spark, d):
    e = c("event_id")
    w, s = _num(e * 7 % 400 - 200), _num(e * 3 % 200 - 100)
    return P.table(spark, d, "events").select(
        e, w.alias("w"), s.alias("s"), (w + _num(e % 5 - 1)).alias("e"), (s + _num(e % 3 - 1) / 2).alias("n")
    )


_BOXES = """WITH b AS (SELECT event_id, (event_id * 7 % 400 - 200)::DOUBLE AS w, (event_id * 3 % 200 - 100)::DOUBLE AS s,
    (event_id * 7 % 400 - 200)::DOUBLE + (event_id % 5 - 1)::DOUBLE AS e,
    (event_id * 3 % 200 - 100)::DOUBLE + (event_id % 3 - 1)::DOUBLE / 2 AS n FROM events) """


def _box():
    return c("w"), c("s"), c("e"), c("n")


@query("c1_valid_bbox", _BOXES + """SELECT event_id, w BETWEEN -180 AND 180 AND e BETWEEN -180 AND 180 AND s BETWEEN -90 AND 90
    AND n BETWEEN -90 AND 90 AND w < e AND s < n AS ok,
    CASE WHEN NOT (w BETWEEN -180 AND 180 AND e BETWEEN -180 AND 180) THEN 'Longitude must be between -180 and 180'
    WHEN NOT (s BETWEEN -90 AND 90 AND n BETWEEN -90 AND 90) THEN 'Latitude must be between -90 and 90'
    WHEN w >= e THEN 'West must be less than East' WHEN s >= n THEN 'South must be less than North'
    ELSE 'Valid bbox' END AS message FROM b""")
def _(spark, d):
    return _boxes(spark, d).select("event_id", geo.valid_bbox(*_box()).alias("v")).select("event_id", "v.ok", "v.message")


_AREA = "(e - w) * (111.0::DOUBLE * cos(radians((s + n) / 2))) * ((n - s) * 111.0::DOUBLE)"


@query("c2_bbox_area_km2", _BOXES + f"SELECT event_id, {s6(_AREA)} AS area_km2 FROM b")
def _(spark, d):
    return _boxes(spark, d).select("event_id", r6(geo.bbox_area_km2(*_box())).alias("area_km2"))


@query("c3_oversize_bbox", _BOXES + f"SELECT event_id, {_AREA} > 25 AS oversize FROM b")
def _(spark, d):
    return _boxes(spark, d).select("event_id", geo.oversize_bbox(*_box()).alias("oversize"))


def _points(spark, d):
    e = c("event_id")
    return P.table(spark, d, "events").select(
        e, (F.lit(-170.0) + (e * 13 % 3400) / 10.0).alias("lon"), (F.lit(-80.0) + (e * 29 % 1600) / 10.0).alias("lat"),
        _num(e % 12 + 4).alias("z"),
    )


_POINTS = """WITH p AS (SELECT event_id, -170.0::DOUBLE + (event_id * 13 % 3400) / 10.0::DOUBLE AS lon,
    -80.0::DOUBLE + (event_id * 29 % 1600) / 10.0::DOUBLE AS lat, (event_id % 12 + 4)::DOUBLE AS z FROM events), q AS (
    SELECT *, trunc((lon + 180.0) / 360.0 * pow(2.0, z))::BIGINT AS x,
    trunc((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * pow(2.0, z))::BIGINT AS y FROM p) """


@query("c4_lonlat_to_tile", _POINTS + "SELECT event_id, x, y FROM q")
def _(spark, d):
    return _points(spark, d).select("event_id", geo.lonlat_to_tile(c("lon"), c("lat"), c("z")).alias("t")).select(
        "event_id", "t.x", "t.y"
    )


@query("c5_tile_bounds", _POINTS + f"""SELECT event_id, {s6('x / pow(2.0, z) * 360.0 - 180.0')} AS west,
    {s6('degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, z)))))')} AS south,
    {s6('(x + 1) / pow(2.0, z) * 360.0 - 180.0')} AS east,
    {s6('degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, z)))))')} AS north FROM q""")
def _(spark, d):
    tiles = _points(spark, d).withColumn("t", geo.lonlat_to_tile(c("lon"), c("lat"), c("z")))
    bounds = tiles.select("event_id", geo.tile_bounds(c("t.x"), c("t.y"), c("z")).alias("b"))
    return bounds.select("event_id", *[r6(c(f"b.{n}")).alias(n) for n in ("west", "south", "east", "north")])


@query("c6_tile_to_lonlat", P.sql("features", select=f"""SELECT event_id,
    {s6('(x * 4096 + px) / (32768.0 * 4096) * 360.0 - 180.0')} AS lon,
    {s6('degrees(atan(sinh(pi() * (1.0 - 2.0 * ((y * 4096 + py) / (32768.0 * 4096))))))')} AS lat FROM features"""))
def _(spark, d):
    e = c("event_id")
    f = P.tile_features(spark, d)
    px, py = _num(e * 31 % 4096), _num(e * 17 % 4096)
    p = geo.tile_to_lonlat(px, py, c("x"), c("y"), c("zoom"), c("extent"))
    return f.select("event_id", p.alias("p")).select("event_id", r6(c("p.lon")).alias("lon"), r6(c("p.lat")).alias("lat"))


def _small_boxes(spark, d):
    e = c("event_id")
    w, s = F.lit(20.0) + (e % 997) / 10000.0, F.lit(50.0) + (e % 89) / 10000.0
    return P.table(spark, d, "events").select(
        e, w.alias("w"), s.alias("s"), (w + (e % 7 + 1) / 100.0).alias("e"), (s + (e % 5 + 1) / 100.0).alias("n")
    )


def _named(boxes):
    return boxes.select("event_id", c("w").alias("west"), c("s").alias("south"), c("e").alias("east"), c("n").alias("north"))


_SMALL = """WITH b0 AS (SELECT event_id, 20.0::DOUBLE + (event_id % 997) / 10000.0::DOUBLE AS w,
    50.0::DOUBLE + (event_id % 89) / 10000.0::DOUBLE AS s FROM events),
    b AS (SELECT event_id, w, s, w + (event_id % 7 + 1) / 100.0::DOUBLE AS e, s + (event_id % 5 + 1) / 100.0::DOUBLE AS n FROM b0) """


def _ty(lat: str) -> str:
    return f"trunc((1.0 - ln(tan(radians({lat})) + 1.0 / cos(radians({lat}))) / pi()) / 2.0 * 4096)::BIGINT"


def _tx(lon: str) -> str:
    return f"trunc(({lon} + 180.0) / 360.0 * 4096)::BIGINT"


@query("c7_bbox_tiles", _SMALL + f"""SELECT event_id, x, unnest(range({_ty('n')}, {_ty('s')} + 1)) AS y
    FROM (SELECT *, unnest(range({_tx('w')}, {_tx('e')} + 1)) AS x FROM b)""")
def _(spark, d):
    return areas.bbox_tiles(_named(_small_boxes(spark, d)), 12).select("event_id", "x", "y")


_SIZE = "greatest(3, least(20, trunc(sqrt(abs(e - w) * abs(n - s)) / 0.002)::INT))"


@query("c8_bbox_grid_points", _SMALL + f"""SELECT event_id, count(*) AS n, {s6('sum(lat)')} AS lat_sum, {s6('sum(lon)')} AS lon_sum,
    {s6('max(lat)')} AS lat_max, {s6('min(lon)')} AS lon_min, {s6('arg_min(lon, i * 100 + j)')} AS first_lon, {s6('arg_min(lon, abs(i * 100 + j - 1))')} AS second_lon
    FROM (SELECT event_id, i, j, s + (n - s) * (i / (g - 1)::DOUBLE) AS lat, w + (e - w) * (j / (g - 1)::DOUBLE) AS lon
      FROM (SELECT *, unnest(range(0, g)) AS j FROM (SELECT *, unnest(range(0, g)) AS i FROM (SELECT *, {_SIZE} AS g FROM b)))) GROUP BY 1""")
def _(spark, d):
    points = areas.bbox_grid_points(_named(_small_boxes(spark, d)))
    place = c("i") * 100 + c("j")
    return points.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("lat")).alias("lat_sum"), r6(F.sum("lon")).alias("lon_sum"),
        r6(F.max("lat")).alias("lat_max"), r6(F.min("lon")).alias("lon_min"),
        r6(F.min_by("lon", place)).alias("first_lon"), r6(F.min_by("lon", F.abs(place - 1))).alias("second_lon"),
    )


@query("c9_geometry_bbox", P.sql("segments", select=f"""SELECT event_id, {s6('least(lon1, lon2)')} AS west,
    {s6('least(lat1, lat2)')} AS south, {s6('greatest(lon1, lon2)')} AS east, {s6('greatest(lat1, lat2)')} AS north FROM segments"""))
def _(spark, d):
    s = P.segments(spark, d).select("event_id", geo.geometry_bbox(c("geometry")).alias("b"))
    return s.select("event_id", *[r6(c(f"b.{n}")).alias(n) for n in ("west", "south", "east", "north")])


@query("c10_bbox_intersects", P.sql("segments", "areas", select="""SELECT event_id,
    NOT (lon2 < west OR east < lon1 OR lat2 < south OR north < lat1) AS meets FROM segments JOIN areas USING (area_id)"""))
def _(spark, d):
    joined = P.segments(spark, d).join(P.areas(spark, d), "area_id")
    box = F.struct("west", "south", "east", "north")
    return joined.select("event_id", geo.bbox_intersects(geo.geometry_bbox(c("geometry")), box).alias("meets"))


_INSIDE = """(lon1 BETWEEN west AND east AND lat1 BETWEEN south AND north) OR
    (lon2 BETWEEN west AND east AND lat2 BETWEEN south AND north)"""


@query("c11_has_point_in_bbox", P.sql("segments", "areas", select=f"SELECT event_id, {_INSIDE} AS inside FROM segments JOIN areas USING (area_id)"))
def _(spark, d):
    joined = P.segments(spark, d).join(P.areas(spark, d), "area_id")
    return joined.select(
        "event_id", geo.has_point_in_bbox(c("geometry"), c("west"), c("south"), c("east"), c("north")).alias("inside")
    )


@query("c12_first_prop_double", P.sql("features", select="""SELECT event_id,
    CASE WHEN event_id % 5 <> 2 THEN k::DOUBLE END AS current_speed,
    CASE WHEN event_id % 3 = 0 THEN (k + 20)::DOUBLE END AS freeflow_speed,
    CASE WHEN event_id % 6 = 0 THEN 0.75::DOUBLE END AS confidence FROM features"""))
def _(spark, d):
    p = c("properties")
    return P.tile_features(spark, d).select(
        "event_id",
        observe.first_prop_double(p, observe.CURRENT_SPEED_KEYS).alias("current_speed"),
        observe.first_prop_double(p, observe.FREEFLOW_SPEED_KEYS).alias("freeflow_speed"),
        observe.first_prop_double(p, observe.CONFIDENCE_KEYS).alias("confidence"),
    )


@query("c13_segment_id_from_props", P.sql("features", select="""SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id <> 0
    THEN event_id::VARCHAR ELSE layer || '_' || sha1('[' || event_id || ',' || k || ']') END AS segment_id FROM features"""))
def _(spark, d):
    e = c("event_id")
    base = P.tile_features(spark, d)
    k = F.coalesce(*[c("properties").getItem(n) for n in ("traffic_level", "cs", "k", "s", "currentSpeed")]).cast("bigint")
    return base.select(
        "event_id", observe.segment_id_from_props(c("properties"), c("layer"), F.array(e, k)).alias("segment_id")
    )


@query("c14_longest_line", P.sql("features", select="""SELECT event_id, CASE WHEN kind IN (0, 2) THEN NULL
    WHEN kind IN (1, 3) THEN 1 WHEN kind = 5 THEN 3 ELSE 2 END::INT AS n_points,
    CASE WHEN kind IN (0, 2) THEN NULL WHEN kind = 5 THEN px + 2 ELSE px END AS first_x FROM features"""))
def _(spark, d):
    line = geo.longest_line(c("coordinates"))
    return P.tile_features(spark, d).select("event_id", line.alias("line")).select(
        "event_id", F.when(c("line").isNotNull(), F.size("line")).alias("n_points"),
        F.get(F.get("line", F.lit(0)), F.lit(0)).alias("first_x"),
    )


@query("c15_parse_shape", P.sql("lanes", select="""SELECT edge_id, i, CASE WHEN p % 23 <> 0 THEN 2 END::INT AS n,
    CASE WHEN p % 23 <> 0 THEN (p % 100)::DOUBLE END AS x1, CASE WHEN p % 23 <> 0 THEN (i + 3)::DOUBLE END AS y2 FROM lanes"""))
def _(spark, d):
    s = P.lanes(spark, d).select("edge_id", c("lane_index").cast("bigint").alias("i"), observe.parse_shape(c("shape")).alias("g"))
    return s.select(
        "edge_id", "i", F.when(c("g").isNotNull(), F.size("g")).alias("n"),
        F.get("g", F.lit(0))["x"].alias("x1"), F.get("g", F.lit(1))["y"].alias("y2"),
    )


@query("c16_vclass_allowed", P.sql("lanes", select="SELECT edge_id, i, ok AS allowed FROM lanes"))
def _(spark, d):
    return P.lanes(spark, d).select(
        "edge_id", c("lane_index").cast("bigint").alias("i"), observe.vclass_allowed(c("allow"), c("disallow")).alias("allowed")
    )


_ZONE = "greatest(1, least(60, floor((({w}) + 180) / 6)::INT + 1))"


@query("c17_utm_epsg", _BOXES + f"""SELECT event_id, CASE WHEN (s + n) / 2 >= 0 THEN 'EPSG:326' ELSE 'EPSG:327' END ||
    lpad({_ZONE.format(w='(w + e) / 2')}::VARCHAR, 2, '0') AS epsg FROM b""")
def _(spark, d):
    return _boxes(spark, d).select("event_id", geo.utm_epsg(*_box()).alias("epsg"))


def _utm_sql() -> str:
    """The Krueger series once more, as SQL text over lon, lat, zone."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    k = 2 * n**0.5 / (1 + n)
    t = f"sinh(atanh(sin(radians(lat))) - {k!r}::DOUBLE * atanh({k!r}::DOUBLE * sin(radians(lat))))"
    east = "eta" + "".join(f" + {v!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(a, 1))
    north = "xi" + "".join(f" + {v!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(a, 1))
    scale = 0.9996 * radius
    return f"""WITH p AS (SELECT event_id, 20.0::DOUBLE + (event_id % 997) / 1000.0::DOUBLE AS lon,
        -40.0::DOUBLE + (event_id % 89) AS lat FROM events),
        q AS (SELECT *, {_ZONE.format(w='lon')} AS zone, {t} AS t FROM p),
        r AS (SELECT *, atan2(t, cos(radians(lon - (zone * 6 - 183)))) AS xi,
              atanh(sin(radians(lon - (zone * 6 - 183))) / sqrt(1 + t * t)) AS eta FROM q)
        SELECT event_id, (round_even(({east}) * {scale!r}::DOUBLE + 500000.0 + 12.5, 3) + 0.0) AS x,
        (round_even(({north}) * {scale!r}::DOUBLE + CASE WHEN lat < 0 THEN 10000000.0 ELSE 0.0 END - 7.25, 3) + 0.0) AS y FROM r"""


@query("c18_to_network_xy", _utm_sql())
def _(spark, d):
    e = c("event_id")
    lon, lat = F.lit(20.0) + (e % 997) / 1000.0, F.lit(-40.0) + e % 89
    xy = geo.to_network_xy(lon, lat, geo.utm_zone(lon), lat < 0, F.lit(12.5), F.lit(-7.25))
    return P.table(spark, d, "events").select("event_id", xy.alias("p")).select(
        "event_id", F.bround("p.x", 3).alias("x"), F.bround("p.y", 3).alias("y")
    )


def _centroid_sql(axis: str) -> str:
    step = {"x": "+ 35", "y": "- 15"}[axis]
    l1, l2 = "sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)", "sqrt(35.0::DOUBLE ** 2 + 15.0::DOUBLE ** 2)"
    return s6(f"({l1} * ({axis}0 + {axis}1) / 2.0 + {l2} * ({axis}1 + {axis}1 {step}) / 2.0) / ({l1} + {l2})")


@query("c19_line_centroid", P.sql("edge_lines", select=f"SELECT edge_id, {_centroid_sql('x')} AS x, {_centroid_sql('y')} AS y FROM edge_lines"))
def _(spark, d):
    e = P.line_edges(spark, d).select("edge_id", geo.line_centroid(c("geometry")).alias("m"))
    return e.select("edge_id", r6(c("m.x")).alias("x"), r6(c("m.y")).alias("y"))


def point_piece_sql(px, py, x1, y1, x2, y2) -> str:
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    length = f"({dx} * {dx} + {dy} * {dy})"
    t = f"""CASE WHEN {length} > 0 THEN greatest(0.0, least(1.0, (({px} - {x1}) * {dx} + ({py} - {y1}) * {dy}) / {length})) ELSE 0.0 END"""
    return f"(({px} - ({x1} + ({t}) * {dx})) ** 2 + ({py} - ({y1} + ({t}) * {dy})) ** 2)"


def piece_distance_sql(a=("ax", "ay"), b=("bx", '"by"'), e=("cx", "cy"), f=("dx", "dy")) -> str:
    def side(p, q, r):
        return f"(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"

    near = ", ".join(
        point_piece_sql(*p, *q, *r) for p, q, r in ((a, e, f), (b, e, f), (e, a, b), (f, a, b))
    )
    crossing = f"{side(a, b, e)} * {side(a, b, f)} < 0 AND {side(e, f, a)} * {side(e, f, b)} < 0"
    return f"CASE WHEN {crossing} THEN 0.0 ELSE sqrt(least({near})) END"


@query("c20_segment_distance", f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 97)::DOUBLE AS ax, (l_suppkey % 89)::DOUBLE AS ay,
    (l_orderkey % 83)::DOUBLE AS bx, (l_partkey % 79)::DOUBLE AS "by", l_quantity AS cx, (l_orderkey % 61)::DOUBLE AS cy,
    (l_suppkey % 53)::DOUBLE AS dx, (l_linenumber * 9)::DOUBLE AS dy FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, {s6(piece_distance_sql())} AS distance FROM l""")
def _(spark, d):
    def m(name, n):
        return _num(c(name) % n)

    distance = geo.segment_distance(
        m("l_partkey", 97), m("l_suppkey", 89), m("l_orderkey", 83), m("l_partkey", 79),
        c("l_quantity"), m("l_orderkey", 61), m("l_suppkey", 53), _num(c("l_linenumber") * 9),
    )
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(distance).alias("distance"))


@query("c21_match_confidence", f"""SELECT event_id, CASE WHEN value <= 100 THEN {s6('greatest(0.0, 1.0 - value / 100)')} END AS confidence FROM events""")
def _(spark, d):
    return P.table(spark, d, "events").select("event_id", r6(observe.match_confidence(c("value"))).alias("confidence"))


@query("c22_edge_weight", """SELECT 'e' || p_partkey AS edge_id, (greatest(1, p_partkey % 5 - 1) * greatest(5.0, p_size + 3.0)
    * greatest(1, p_partkey % 3 + 1))::DOUBLE AS weight FROM part""")
def _(spark, d):
    return P.line_edges(spark, d).select(
        "edge_id", observe.edge_weight(c("priority"), c("speed"), c("num_lanes")).alias("weight")
    )


@query("c23_centroid_distance", f"""SELECT l_orderkey, l_linenumber, l_partkey,
    {s6('sqrt((l_partkey - l_suppkey)::DOUBLE ** 2 + (l_quantity - l_linenumber) ** 2)')} AS distance FROM lineitem""")
def _(spark, d):
    return P.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r6(F.hypot(_num(c("l_partkey") - c("l_suppkey")), c("l_quantity") - c("l_linenumber"))).alias("distance"),
    )


@query("c24_min_trip_distance", _SMALL + f"""SELECT event_id, {s6('least(1000.0, greatest(200.0, sqrt(((e - w) * 75000.0) ** 2 + ((n - s) * 111000.0) ** 2) * 0.1))')} AS metres FROM b""")
def _(spark, d):
    return _small_boxes(spark, d).select("event_id", r6(geo.min_trip_distance(*_box())).alias("metres"))


@query("c25_speed_kmh", f"SELECT event_id, CASE WHEN value >= 3 THEN {s6('value * 3.6')} END AS kmh FROM events")
def _(spark, d):
    text = F.when(c("value") < 3, "-1.00").otherwise(c("value").cast("string"))
    return P.table(spark, d, "events").select("event_id", r6(observe.speed_kmh(text)).alias("kmh"))


@query("c26_time_bucket", """SELECT event_id, (floor(epoch(ts))::BIGINT // 300) * 300 AS start_s,
    strftime(to_timestamp((floor(epoch(ts))::BIGINT // 300) * 300) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M') AS label FROM events""")
def _(spark, d):
    b = P.table(spark, d, "events").select("event_id", observe.time_bucket(c("ts").cast("timestamp")).alias("b"))
    return b.select("event_id", F.unix_timestamp("b.start").alias("start_s"), c("b.label").alias("label"))


_DEPART = "CASE WHEN fin <= start OR k = n THEN fin ELSE start + (fin - start) / n * k END"


@query("c27_departure_times", f"""WITH b AS (SELECT o_orderkey, (o_orderkey % 50)::DOUBLE AS start, (o_custkey % 400)::DOUBLE AS fin, o_orderkey % 9 - 1 AS n FROM orders),
    e AS (SELECT *, unnest(range(1, n + 1)) AS k FROM b) SELECT o_orderkey, k, {s6(_DEPART)} AS departure FROM e""")
def _(spark, d):
    o = c("o_orderkey")
    times = observe.departure_times(o % 50, c("o_custkey") % 400, o % 9 - 1)
    return P.table(spark, d, "orders").select("o_orderkey", F.posexplode(times).alias("i", "t")).select(
        "o_orderkey", _k_index().alias("k"), r6(c("t")).alias("departure")
    )


def _k_index():
    return (c("i") + 1).cast("bigint")


@query("c28_format_departure", """SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.6f', (o_orderkey % 1000) / 8.0::DOUBLE), '0+$', ''), '\\.$', '')
    AS text FROM orders""")
def _(spark, d):
    return P.table(spark, d, "orders").select(
        "o_orderkey", observe.format_departure((c("o_orderkey") % 1000) / 8.0).alias("text")
    )


@query("c29_gene_to_count", """SELECT o_orderkey, greatest(0, round_even((o_orderkey % 41 - 10) / 4.0::DOUBLE, 0)::BIGINT) AS n FROM orders""")
def _(spark, d):
    return P.table(spark, d, "orders").select("o_orderkey", observe.gene_to_count((c("o_orderkey") % 41 - 10) / 4.0).alias("n"))


@query("c30_content_key", """WITH k AS (SELECT o_orderkey, sha256('{"bbox_key":"' || o_custkey || '","provider":"p' || o_orderkey % 3 ||
    '","timestamp_bucket":"2024-01-28T18:05","type":"traffic"}') AS traffic, sha256('{"bbox_key":"' || o_custkey || '","provider":"p' || o_orderkey % 3 ||
    '","style":"absolute","timestamp_bucket":"2024-01-28T18:05","type":"traffic","zoom":12}') AS tiled,
    sha256('{"bbox_key":"' || o_custkey || '","type":"osm"}') AS map_key FROM orders)
    SELECT o_orderkey, traffic, tiled, map_key, sha256('{"car_only":true,"osm_key":"' || map_key || '","seed":42,"type":"network"}') AS network,
    sha256('{"bbox_key":"' || map_key || '","network_key":"' || traffic || '","provider":"p","timestamp_bucket":"b","type":"matching"}') AS matching FROM k""")
def _(spark, d):
    box, provider = c("o_custkey").cast("string"), F.concat(F.lit("p"), (c("o_orderkey") % 3).cast("string"))
    bucket = F.lit("2024-01-28T18:05")
    base = P.table(spark, d, "orders").select(
        "o_orderkey", keys.traffic_key(box, provider, bucket).alias("traffic"),
        keys.traffic_key(box, provider, bucket, F.lit(12), F.lit("absolute")).alias("tiled"),
        keys.map_key(box).alias("map_key"),
    )
    return base.select(
        "*", keys.network_key(c("map_key"), F.lit(True), F.lit(42)).alias("network"),
        keys.matching_key(c("map_key"), c("traffic"), F.lit("p"), F.lit("b")).alias("matching"),
    )


_BYTES = "concat(" + ", ".join(f"substr(h, {i}, 2)" for i in range(15, 0, -2)) + ")"


@query("c31_stable_seed", P.sql("pop_base", select=f"""SELECT individual_id, (xor(('0x' || {_BYTES})::UBIGINT, 42::UBIGINT) % 4294967295)::BIGINT AS seed FROM (
    SELECT v AS individual_id, substr(sha256(unhex(string_agg({_BYTES}, '' ORDER BY i))), 1, 16) AS h FROM (
    SELECT v, i, lpad(to_hex(genes[i]::BIGINT), 16, '0') AS h FROM (SELECT v, genes, unnest(range(1, len(genes) + 1)) AS i FROM pop_base)) GROUP BY v)"""))
def _(spark, d):
    pop = P.population(spark, d)
    return pop.select("individual_id", keys.stable_seed(c("genes"), F.lit(42)).alias("seed"))


def _metrics():
    return {n: c("metrics")[n] for n in population.METRIC_FIELDS}


@query("c32_fail_total", P.sql("pop_base", "pop_loss", "population", select="""SELECT v AS individual_id,
    (coalesce(routing_failures, 0) + coalesce(teleports, 0))::BIGINT AS fail_total FROM population"""))
def _(spark, d):
    return P.population(spark, d).select(
        "individual_id", scoring.fail_total(c("metrics.routing_failures"), c("metrics.teleports")).alias("fail_total")
    )


@query("c33_reliability_penalty", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 AND o_custkey % 40 > 0
    THEN {s6('(o_orderkey % 5)::DOUBLE / (o_custkey % 40) * 2000.0')} ELSE 0.0 END AS penalty FROM orders""")
def _(spark, d):
    return P.table(spark, d, "orders").select(
        "o_orderkey", r6(scoring.reliability_penalty(c("o_orderkey") % 5, c("o_custkey") % 40)).alias("penalty")
    )


@query("c34_safe_casts", """SELECT page_id, coalesce(try_cast(part AS DOUBLE), -1.0) AS as_double, coalesce(try_cast(part AS BIGINT), -1) AS as_int,
    CASE WHEN page_id % 4 = 0 THEN true WHEN page_id % 4 = 1 THEN false ELSE true END AS as_bool
    FROM (SELECT page_id, regexp_extract(url, '/([a-z]*[0-9]*)', 1) AS raw, CASE WHEN page_id % 3 = 0 THEN 'x' || page_id ELSE page_id::VARCHAR END AS part FROM pages)""")
def _(spark, d):
    p = c("page_id")
    part = F.when(p % 3 == 0, F.concat(F.lit("x"), p.cast("string"))).otherwise(p.cast("string"))
    word = F.when(p % 4 == 0, " Yes ").when(p % 4 == 1, "OFF").otherwise("maybe")
    return P.table(spark, d, "pages").select(
        "page_id", observe.safe_double(part, -1).alias("as_double"), observe.safe_int(part, -1).alias("as_int"),
        observe.as_bool(word, True).alias("as_bool"),
    )


_RATED = ("pop_base", "pop_loss", "population", "scored", "rated")


@query("c35_is_feasible", P.sql(*_RATED, select="SELECT v AS individual_id, feasible, fails::BIGINT AS fail_total FROM rated"))
def _(spark, d):
    return P.population(spark, d).select(
        "individual_id", scoring.is_feasible(c("loss"), _metrics()).alias("feasible"),
        scoring.effective_fail_total(_metrics()).cast("bigint").alias("fail_total"),
    )


@query("c36_effective_losses", P.sql(*_RATED, select="SELECT v AS individual_id, e_eff AS e_loss, pen AS penalty FROM rated"))
def _(spark, d):
    return P.population(spark, d).select(
        "individual_id", scoring.effective_e_loss(c("loss"), _metrics()).alias("e_loss"),
        scoring.effective_penalty(c("loss"), _metrics()).alias("penalty"),
    )


def ladder_sql(value: str, steps, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {b} THEN {p if isinstance(p, int) else repr(p)}" for b, p in steps) + f" ELSE {rest} END"


MATCHED_SQL = ladder_sql("{v}", ((40, 35), (25, 30), (15, 24), (8, 16), (5, 10), (1, 4)), "0")
RATE_SQL = ladder_sql("{v}", ((0.95, 25), (0.9, 22), (0.8, 18), (0.7, 14), (0.5, 8)), "CASE WHEN {v} > 0 THEN 3 ELSE 0 END")
DENSITY_SQL = "CASE WHEN {v} IS NULL THEN 8 ELSE " + ladder_sql(
    "{v}", ((10, 15), (6, 12), (3, 8), (1.5, 5)), "CASE WHEN {v} > 0 THEN 2 ELSE 0 END") + " END"
COVERAGE_SQL = "CASE WHEN {v} IS NULL THEN 5 ELSE " + ladder_sql(
    "{v}", ((0.03, 10), (0.02, 8), (0.01, 6), (0.005, 4)), "CASE WHEN {v} > 0 THEN 2 ELSE 0 END") + " END"
CONFIDENCE_SQL = """CASE WHEN {v} IS NULL THEN 10 WHEN {v} >= 0.99 AND {s} <= 0.02 THEN 15 WHEN {v} >= 0.97 AND {s} <= 0.1 THEN 13
    WHEN {v} >= 0.94 AND {s} <= 0.2 THEN 10 WHEN {v} >= 0.9 THEN 6 ELSE 2 END"""
LABEL_SQL = ladder_sql("{v}", ((85, "excellent"), (70, "good"), (55, "fair"), (40, "weak")), "'poor'")
RECOMMEND_SQL = """CASE WHEN {m} = 0 THEN 'do_not_proceed' WHEN {m} < 5 OR {v} < 40 THEN 'high_risk' WHEN {v} < 55 THEN 'caution' ELSE 'proceed' END"""


@query("c37_quality_scores", f"""SELECT o_orderkey, {MATCHED_SQL.format(v='o_orderkey % 50')}::INT AS availability,
    {RATE_SQL.format(v='(o_orderkey % 21) / 20.0::DOUBLE')}::INT AS rate, {DENSITY_SQL.format(v='(o_orderkey % 120) / 10.0::DOUBLE')}::INT AS density,
    {COVERAGE_SQL.format(v='(o_orderkey % 40) / 1000.0::DOUBLE')}::INT AS coverage,
    {CONFIDENCE_SQL.format(v='(80 + o_orderkey % 21) / 100.0::DOUBLE', s='(o_custkey % 30) / 100.0::DOUBLE')}::INT AS confidence,
    {LABEL_SQL.format(v='(o_orderkey % 101)')} AS label, {RECOMMEND_SQL.format(m='(o_orderkey % 50)', v='(o_orderkey % 101)')} AS recommendation FROM orders""")
def _(spark, d):
    o = c("o_orderkey")
    return P.table(spark, d, "orders").select(
        "o_orderkey", scoring.matched_score(o % 50).alias("availability"),
        scoring.match_rate_score((o % 21) / 20.0).alias("rate"), scoring.density_score((o % 120) / 10.0).alias("density"),
        scoring.coverage_score((o % 40) / 1000.0).alias("coverage"),
        scoring.confidence_score((o % 21 + 80) / 100.0, (c("o_custkey") % 30) / 100.0).alias("confidence"),
        scoring.quality_label(o % 101).alias("label"), scoring.recommendation(o % 101, o % 50).alias("recommendation"),
    )


@query("c38_valid_dataset_name", """SELECT page_id, regexp_full_match(trim(name), '[A-Za-z0-9_-]+') AS valid
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN ' ds_' || page_id || ' ' ELSE '' END AS name FROM pages)""")
def _(spark, d):
    p = c("page_id")
    name = F.when(p % 3 == 0, c("url")).when(p % 3 == 1, F.concat(F.lit(" ds_"), p.cast("string"), F.lit(" "))).otherwise("")
    return P.table(spark, d, "pages").select("page_id", observe.valid_dataset_name(name).alias("valid"))


@query("c39_parse_bbox", """SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN (event_id % 180)::DOUBLE END AS west,
    CASE WHEN event_id % 3 <> 2 THEN value END AS north FROM events""")
def _(spark, d):
    e = c("event_id")
    text = F.when(
        e % 3 == 2, F.concat_ws(",", (e % 180).cast("string"), F.lit("1"), F.lit("x"), c("value").cast("string"))
    ).otherwise(F.concat_ws(", ", (e % 180).cast("string"), F.lit("1"), F.lit("2.5"), c("value").cast("string")))
    return P.table(spark, d, "events").select("event_id", observe.parse_bbox(text).alias("b")).select(
        "event_id", c("b.west").alias("west"), c("b.north").alias("north")
    )


@query("c40_report_round", P.sql("pop_base", "pop_loss", select="""SELECT v AS individual_id,
    CASE WHEN loss < 'inf'::DOUBLE THEN (round_even(loss / 7, 2) + 0.0) END AS rounded FROM pop_loss"""))
def _(spark, d):
    return P.population(spark, d).select("individual_id", scoring.report_round(c("loss") / 7).alias("rounded"))
