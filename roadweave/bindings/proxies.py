"""Traffic tables derived from the benchmark tables, once as DataFrames and once as SQL text.

Every view covers its whole base table. Area, run and scenario keys come from integer division of a key, so
their number grows with the data while one city keeps its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS_PER_AREA = 250
CUSTOMERS_PER_AREA = 188
ORDERS_PER_GRAPH = 25
GRAPH_NODES = 100
MEMBERS_PER_RUNS = 500  # one run a label among so many members, so that runs grow in number and not in size
N_OD = 6
N_BINS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col):
    return F.bround(col, 6)


def s6(expr: str) -> str:
    return f"(round_even({expr}, 6) + 0.0)"


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def div(col, n):
    return F.floor(F.col(col) / n) if isinstance(col, str) else F.floor(col / n)


# ---- observed and simulated speeds ------------------------------------------------------------------------------


def observed(spark, d) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, d, "part").select(
        _cat("area_", div("p_partkey", PARTS_PER_AREA)).alias("area_id"),
        _cat("e", p).alias("edge_id"),
        _cat("s", p).alias("segment_id"),
        F.col("p_size").cast("double").alias("current_speed"),
        (F.col("p_size") + 10.0).alias("freeflow_speed"),
        (F.lit(1.0) - (p % 20) / 100.0).alias("match_confidence"),
    )


def _line_scenario():
    return _cat("area_", div("l_partkey", PARTS_PER_AREA), "_", F.col("l_linenumber"), F.col("l_returnflag"))


def simulated(spark, d) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy(
            _cat("area_", div("l_partkey", PARTS_PER_AREA)).alias("area_id"),
            _line_scenario().alias("scenario_id"),
            _cat("e", F.col("l_partkey")).alias("edge_id"),
        )
        .agg(F.avg("l_quantity").alias("speed_kmh"))
    )


def scenarios(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        _cat("area_", div("l_partkey", PARTS_PER_AREA)).alias("area_id"), _line_scenario().alias("scenario_id")
    ).distinct()


def expected(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(_line_scenario().alias("scenario_id")).agg(
        F.count(F.lit(1)).alias("expected_vehicles")
    )


def _order_scenario():
    o = F.col("o_orderkey")
    flag = F.when(o % 3 == 0, "A").when(o % 3 == 1, "N").otherwise("R")
    return _cat("area_", div("o_custkey", CUSTOMERS_PER_AREA), "_", o % 7 + 1, flag)


def tripinfo(spark, d) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        _order_scenario().alias("scenario_id"),
        _cat("t", o).alias("id"),
        (o * 37 % 900 + 60).cast("double").alias("duration"),
        (o % 120).cast("double").alias("waiting"),
    )


def statistics(spark, d) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, d, "orders").groupBy(_order_scenario().alias("scenario_id")).agg(
        F.count_if(o % 7 != 6).alias("loaded"),
        F.count_if((o % 7 != 6) & (F.col("o_orderstatus") != "F")).alias("inserted"),
        F.count_if(F.col("o_orderstatus") == "O").alias("running"),
        F.count_if(F.col("o_orderstatus") == "F").alias("waiting"),
        F.count_if(F.col("o_orderstatus") == "P").alias("teleports"),
    )


def intervals(spark, d) -> DataFrame:
    begin = F.floor(F.pmod(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(1200)) / 60) * 60
    return table(spark, d, "events").select(
        _cat("s", div("user_id", 30)).alias("scenario_id"),
        begin.cast("double").alias("begin"),
        (begin + 60).cast("double").alias("end"),
        _cat(F.col("event_type"), "_", F.col("user_id") % 20).alias("edge_id"),
        F.when(F.col("value") < 3, "-1.00").otherwise(F.col("value").cast("string")).alias("speed"),
    )


# ---- raw segments, areas, tile features --------------------------------------------------------------------------


def segments(spark, d) -> DataFrame:
    e = F.col("event_id")
    lon = F.lit(20.0) + (e % 997) / 10000.0
    lat = F.lit(50.0) + (F.col("user_id") % 89) / 10000.0

    def point(x, y):
        return F.struct(x.alias("lon"), y.alias("lat"))

    return table(spark, d, "events").select(
        _cat("city_", div("user_id", 20)).alias("area_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("snapshot_id"),
        F.when(e % 11 == 0, "").otherwise(_cat("seg_", F.col("user_id"), "_", F.col("event_type"))).alias("segment_id"),
        F.array(point(lon, lat), point(lon + 0.001, lat + 0.0005)).alias("geometry"),
        F.col("value").alias("current_speed"),
        (F.col("value") + 10.0).alias("freeflow_speed"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(0.9).alias("quality"),
        e.alias("event_id"),
    )


def areas(spark, d) -> DataFrame:
    n = div("user_id", 20)
    city = table(spark, d, "events").select(n.alias("n")).distinct()
    west = F.lit(20.0) + (F.col("n") % 7) / 200.0
    return city.select(
        _cat("city_", F.col("n")).alias("area_id"), west.alias("west"), F.lit(50.001).alias("south"),
        (west + 0.05).alias("east"), F.lit(50.006).alias("north"),
    )


def tile_features(spark, d) -> DataFrame:
    e = F.col("event_id")
    kind = e % 9
    px, py = (e * 31 % 4096).cast("double"), (e * 17 % 4096).cast("double")

    def at(dx, dy):
        return F.array(px + dx, py + dy)

    geom_type = F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, "Point").when(
        kind.isin(2, 5, 6), "MultiLineString"
    ).otherwise("LineString")
    coordinates = (
        F.when(kind == 0, F.lit(None).cast("array<array<array<double>>>"))
        .when(kind == 1, F.array(F.array(at(0, 0))))
        .when(kind == 2, F.array().cast("array<array<array<double>>>"))
        .when(kind == 3, F.array(F.array(at(0, 0))))
        .when(kind == 4, F.array(F.array(at(0, 0), F.array(px, py, px))))
        .when(kind == 5, F.array(F.array(at(0, 0), at(1, 1)), F.array(at(2, 2), at(3, 3), at(4, 4))))
        .when(kind == 6, F.array(F.array(at(0, 0), at(1, 1)), F.array(at(2, 2), at(3, 3))))
        .otherwise(F.array(F.array(at(0, 0), at(10, 5))))
    )
    k = F.get_json_object("props", "$.k")
    key = (
        F.when(e % 5 == 0, "traffic_level").when(e % 5 == 1, "cs").when(e % 5 == 2, "k").when(e % 5 == 3, "s")
        .otherwise("currentSpeed")
    )
    properties = F.map_filter(
        F.map_from_arrays(
            F.array(key, F.lit("speed"), F.lit("id"), F.lit("ff"), F.lit("conf")),
            F.array(
                k,
                F.when(e % 5 == 3, "abc"),
                F.when(e % 4 == 0, e.cast("string")),
                F.when(e % 3 == 0, (k.cast("int") + 20).cast("string")),
                F.when(e % 6 == 0, "0.75"),
            ),
        ),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, d, "events").select(
        _cat("city_", div("user_id", 20)).alias("area_id"),
        e.alias("event_id"),
        _cat("flow_", F.col("event_type")).alias("layer"),
        F.lit(4096).alias("extent"),
        (e % 3 + 18206).alias("x"),
        (F.col("user_id") % 2 + 11103).alias("y"),
        F.lit(15).alias("zoom"),
        e.alias("feature_idx"),
        geom_type.alias("geom_type"),
        coordinates.alias("coordinates"),
        properties.alias("properties"),
    )


def tile_areas(spark, d) -> DataFrame:
    n = div("user_id", 20)
    city = table(spark, d, "events").select(n.alias("n")).distinct()
    west = F.lit(20.02) + (F.col("n") % 5) / 500.0
    return city.select(
        _cat("city_", F.col("n")).alias("area_id"), west.alias("west"), F.lit(50.055).alias("south"),
        (west + 0.01).alias("east"), F.lit(50.065).alias("north"),
    )


# ---- planar lines, lanes, connections, graph ---------------------------------------------------------------------


def _xy(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line_edges(spark, d) -> DataFrame:
    p = F.col("p_partkey")
    x, y = p * 389 % 2000, p * 761 % 2000
    x1, y1 = x + (p % 7 - 3) * 40, y + (p % 5 - 2) * 40
    return table(spark, d, "part").select(
        _cat("area_", div("p_partkey", PARTS_PER_AREA)).alias("area_id"),
        _cat("e", p).alias("edge_id"),
        F.array(_xy(x, y), _xy(x1, y1), _xy(x1 + 35, y1 - 15)).alias("geometry"),
        (F.col("p_size") + 3.0).alias("speed"),
        (p % 5 - 1).cast("int").alias("priority"),
        (p % 3 + 1).cast("int").alias("num_lanes"),
    )


def line_segments(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    x, y = c * 577 % 2000, c * 311 % 2000
    return table(spark, d, "customer").select(
        _cat("area_", div("c_custkey", CUSTOMERS_PER_AREA)).alias("area_id"),
        _cat("seg", c).alias("segment_id"),
        F.array(_xy(x, y), _xy(x + 30, y + (c % 9 - 4) * 10)).alias("geometry"),
        F.col("c_acctbal").alias("current_speed"),
    )


def lanes(spark, d) -> DataFrame:
    p, i = F.col("p_partkey"), F.col("i")
    numbered = table(spark, d, "part").select("*", F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)).alias("i"))
    allow = F.when((p + i) % 5 == 0, "bus").when((p + i) % 5 == 1, "bus passenger").otherwise("")
    return numbered.select(
        _cat("area_", div("p_partkey", PARTS_PER_AREA)).alias("area_id"),
        _cat("e", p).alias("edge_id"),
        (p % 9).cast("int").alias("priority"),
        F.lit("highway").alias("type"),
        i.alias("lane_pos"),
        i.alias("lane_index"),
        allow.alias("allow"),
        F.when((p + i) % 7 == 0, "truck passenger").otherwise("").alias("disallow"),
        (F.col("p_size") + i).cast("double").alias("speed"),
        F.when(p % 23 == 0, "1,2").otherwise(_cat(p % 100, ",", i, " ", p % 100 + 5, ",", i + 3)).alias("shape"),
    )


def connections(spark, d) -> DataFrame:
    area = div("l_partkey", PARTS_PER_AREA)
    target = area * PARTS_PER_AREA + (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 300
    return table(spark, d, "lineitem").select(
        _cat("area_", area).alias("area_id"),
        _cat("e", F.col("l_partkey")).alias("from_edge"),
        F.when(F.col("l_linenumber") == 7, _cat(":j", target)).otherwise(_cat("e", target)).alias("to_edge"),
        (F.col("l_linenumber") % 3).alias("from_lane"),
        (F.col("l_orderkey") % 2).cast("int").alias("to_lane"),
    )


def links(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        _cat("g", div("l_orderkey", ORDERS_PER_GRAPH)).alias("area_id"),
        _cat("p", F.col("l_partkey") % GRAPH_NODES).alias("from_edge"),
        _cat("p", (F.col("l_suppkey") * 4 + F.col("l_linenumber")) % GRAPH_NODES).alias("to_edge"),
    )


def graph_edges(spark, d) -> DataFrame:
    """Known nodes of each graph; links that leave them do not count for components."""
    o = table(spark, d, "orders")
    area = _cat("g", div("o_orderkey", ORDERS_PER_GRAPH)).alias("area_id")
    own = links(spark, d).select("area_id", F.col("from_edge").alias("edge_id"))
    return own.union(o.select(area, _cat("p", F.col("o_custkey") % GRAPH_NODES))).distinct()


def graph_pairs(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        _cat("g", div("o_orderkey", ORDERS_PER_GRAPH)).alias("area_id"),
        _cat("p", F.col("o_custkey") % GRAPH_NODES).alias("origin"),
        _cat("p", F.col("o_orderkey") * 3 % GRAPH_NODES).alias("destination"),
    )


# ---- demand ------------------------------------------------------------------------------------------------------


def genes(spark, d) -> DataFrame:
    o, n = F.col("o_orderkey"), div("o_custkey", 30)
    return table(spark, d, "orders").groupBy(
        _cat("s", n).alias("scenario_id"), _cat("area_", div(n, 7)).alias("area_id"),
        (o % N_OD).cast("int").alias("od_idx"), (div("o_orderkey", N_OD) % N_BINS).cast("int").alias("bin_idx"),
    ).agg((F.count(F.lit(1)) % 7).alias("value"))


def demand_areas(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(div(div("o_custkey", 30), 7).alias("n")).distinct().select(
        _cat("area_", F.col("n")).alias("area_id"), "n",
        F.lit(5.0).alias("warmup_minutes"), F.lit(15.0).alias("window_minutes"), F.lit(5.0).alias("bin_minutes"),
    )


def od_pairs(spark, d) -> DataFrame:
    n, i = F.col("n"), F.col("od_idx")
    return demand_areas(spark, d).select("area_id", "n", F.explode(F.sequence(F.lit(0), F.lit(N_OD - 1))).alias("od_idx")).select(
        "area_id", "od_idx", _cat("n", (n * 13 + i * 7) % 50).alias("origin"), _cat("n", (n * 11 + i * 5 + 3) % 50).alias("destination")
    )


def trips(spark, d) -> DataFrame:
    """One trip per order, grouped into runs."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        _cat("run_", div("o_custkey", 300)).alias("run_id"),
        _cat("trip_", o).alias("trip_id"),
        _cat("n", c % 83).alias("origin"),
        _cat("n", o % 61).alias("destination"),
        (o % 1200 + F.lit(0.5)).alias("departure"),
    )


# ---- search ------------------------------------------------------------------------------------------------------


def population(spark, d, whole: bool = False) -> DataFrame:
    """Members of one run a label among ``MEMBERS_PER_RUNS``; ``whole``: of one run a label, whose size grows with the data."""
    v = F.col("vec_id")
    run = ["run_", F.col("label")] + ([] if whole else ["_", div("vec_id", MEMBERS_PER_RUNS)])
    genes_col = F.transform("embedding", lambda x: (x.cast("double") * 20).cast("int"))
    total = F.aggregate(F.col("genes"), F.lit(0), lambda acc, g: acc + F.abs(g))
    failed = v % 29 == 0
    loss = F.when(failed, float("inf")).otherwise(total + (v % 7) * 0.25)
    base = (
        table(spark, d, "embeddings")
        .withColumn("genes", genes_col)
        .withColumn("loss", loss)
        .select("*", (v % 2).alias("generation"), _cat(*run).alias("run_id"))
    )
    null = F.lit(None)
    metrics = F.struct(
        F.when(v % 5 == 0, null).otherwise(F.col("loss") - 1.5).alias("e_loss"),
        F.when(v % 6 == 0, null).otherwise((v % 3).cast("double")).alias("fail_total"),
        F.when(v % 4 == 0, null).otherwise((v % 3).cast("double")).alias("routing_failures"),
        F.when(v % 4 == 0, null).otherwise(F.lit(0.0)).alias("teleports"),
        F.when(v % 7 == 0, null).otherwise((v % 3) * F.lit(2.0)).alias("reliability_penalty"),
        F.when(v % 11 == 0, null).otherwise((v % 13).cast("double")).alias("zero_flow_edges"),
        F.lit(100).cast("bigint").alias("total_vehicles"),
        F.lit(1.0).alias("avg_trip_duration"),
        F.lit(1.0).alias("avg_waiting_time"),
        failed.alias("worker_error"),
        F.when(failed, "boom").alias("error"),
    )
    return base.select("run_id", "generation", v.alias("individual_id"), "genes", "loss", metrics.alias("metrics"))


def generations(spark, d) -> DataFrame:
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    price = F.col("o_totalprice") / 1000.0
    return table(spark, d, "orders").groupBy(
        _cat("run_", div("o_custkey", 300)).alias("run_id"), month.cast("int").alias("generation")
    ).agg(F.min(price).alias("best_loss"), F.avg(price).alias("mean_loss"), F.stddev_pop(price).alias("std_loss"))


# ---- catalogs and logs -------------------------------------------------------------------------------------------


def generated_catalog(spark, d) -> DataFrame:
    return table(spark, d, "pages").select(
        _cat("d", F.col("page_id") * 7 % 997).alias("name"), F.length("url").cast("double").alias("quality_score")
    )


def packaged_catalog(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        _cat("d", F.col("doc_id") % 1500).alias("name"), (F.col("n_chars") % 100).cast("double").alias("quality_score")
    )


def log_lines(spark, d) -> DataFrame:
    i = F.col("doc_id") % 4
    level = F.when(i == 0, "INFO").when(i == 1, "WARNING").when(i == 2, "ERROR").otherwise("DEBUG")
    return table(spark, d, "documents").select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("line_no"),
        F.concat_ws(" - ", F.lit("2024-01-01 00:00:00"), F.lit("app"), level, "text").alias("line"),
    )


# ---- the same views in SQL -----------------------------------------------------------------------------------------

_LINE_SCENARIO = f"'area_' || (l_partkey // {PARTS_PER_AREA}) || '_' || l_linenumber || l_returnflag"
_ORDER_SCENARIO = (
    f"'area_' || (o_custkey // {CUSTOMERS_PER_AREA}) || '_' || (o_orderkey % 7 + 1) || "
    "CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END"
)

VIEWS: dict[str, str] = {
    "observed": f"""SELECT 'area_' || (p_partkey // {PARTS_PER_AREA}) AS area_id, 'e' || p_partkey AS edge_id,
        's' || p_partkey AS segment_id, p_size::DOUBLE AS current_speed, p_size + 10.0::DOUBLE AS freeflow_speed,
        1.0::DOUBLE - (p_partkey % 20) / 100.0::DOUBLE AS match_confidence FROM part""",
    "simulated": f"""SELECT 'area_' || (l_partkey // {PARTS_PER_AREA}) AS area_id, {_LINE_SCENARIO} AS scenario_id,
        'e' || l_partkey AS edge_id, avg(l_quantity) AS speed_kmh FROM lineitem GROUP BY 1, 2, 3""",
    "scenarios": "SELECT DISTINCT area_id, scenario_id FROM simulated",
    "expected": f"SELECT {_LINE_SCENARIO} AS scenario_id, count(*) AS expected_vehicles FROM lineitem GROUP BY 1",
    "tripinfo": f"""SELECT {_ORDER_SCENARIO} AS scenario_id, 't' || o_orderkey AS id,
        (o_orderkey * 37 % 900 + 60)::DOUBLE AS duration, (o_orderkey % 120)::DOUBLE AS waiting FROM orders""",
    "statistics": f"""SELECT {_ORDER_SCENARIO} AS scenario_id, count(*) FILTER (o_orderkey % 7 <> 6) AS loaded,
        count(*) FILTER (o_orderkey % 7 <> 6 AND o_orderstatus <> 'F') AS inserted,
        count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'F') AS waiting,
        count(*) FILTER (o_orderstatus = 'P') AS teleports FROM orders GROUP BY 1""",
    "intervals": """SELECT 's' || (user_id // 30) AS scenario_id,
        ((floor(epoch(ts))::BIGINT % 1200) // 60 * 60)::DOUBLE AS "begin",
        ((floor(epoch(ts))::BIGINT % 1200) // 60 * 60 + 60)::DOUBLE AS "end",
        event_type || '_' || (user_id % 20) AS edge_id, CASE WHEN value >= 3 THEN value END AS speed FROM events""",
    "joined": """SELECT s.area_id, s.scenario_id, o.edge_id, o.segment_id, o.current_speed, o.freeflow_speed, m.speed_kmh
        FROM scenarios s JOIN observed o USING (area_id)
        LEFT JOIN simulated m ON m.scenario_id = s.scenario_id AND m.edge_id = o.edge_id""",
    "trip_stats": """SELECT e.scenario_id, e.expected_vehicles, coalesce(t.completed_trips, 0) AS completed_trips,
        coalesce(t.avg_duration, 0.0) AS avg_duration, coalesce(t.avg_waiting_time, 0.0) AS avg_waiting_time,
        CASE WHEN st.loaded > 0 THEN st.loaded - st.inserted
             ELSE greatest(0, e.expected_vehicles - coalesce(t.completed_trips, 0)) END AS routing_failures,
        CASE WHEN st.loaded > 0 THEN st.teleports ELSE 0 END AS teleports,
        CASE WHEN st.loaded > 0 THEN st.loaded ELSE e.expected_vehicles END AS total_trips
        FROM expected e LEFT JOIN (SELECT scenario_id, count(*) AS completed_trips, avg(duration) AS avg_duration,
            avg(waiting) AS avg_waiting_time FROM tripinfo GROUP BY 1) t USING (scenario_id)
        LEFT JOIN statistics st USING (scenario_id)""",
    "losses": """SELECT j.area_id, j.scenario_id, sum(abs(coalesce(speed_kmh, freeflow_speed) - current_speed)::DECIMAL(28, 12))::DOUBLE / count(*) AS mae,
        sum(((coalesce(speed_kmh, freeflow_speed) - current_speed) ** 2)::DECIMAL(28, 12))::DOUBLE / count(*) AS mse,
        sum((coalesce(speed_kmh, freeflow_speed) - current_speed)::DECIMAL(28, 12))::DOUBLE / count(*) AS diff,
        count(*) AS total, count(speed_kmh) AS matched, count(*) - count(speed_kmh) AS missing
        FROM joined j GROUP BY 1, 2""",
    "loss_components": """SELECT l.area_id, l.scenario_id, mae, missing::DOUBLE / total * 10.0 AS coverage_penalty,
        mae + missing::DOUBLE / total * 10.0 AS e_loss, t.routing_failures + t.teleports AS fail_total,
        CASE WHEN t.routing_failures + t.teleports > 0 AND t.expected_vehicles > 0
             THEN (t.routing_failures + t.teleports)::DOUBLE / t.expected_vehicles * 2000.0 ELSE 0.0 END
             AS reliability_penalty, missing AS missing_edges
        FROM losses l JOIN trip_stats t USING (scenario_id)""",
    "segments": """SELECT 'city_' || (user_id // 20) AS area_id, strftime(ts, '%Y-%m-%d') AS snapshot_id,
        CASE WHEN event_id % 11 = 0 THEN '' ELSE 'seg_' || user_id || '_' || event_type END AS segment_id,
        20.0::DOUBLE + (event_id % 997) / 10000.0::DOUBLE AS lon1, 50.0::DOUBLE + (user_id % 89) / 10000.0::DOUBLE AS lat1,
        20.0::DOUBLE + (event_id % 997) / 10000.0::DOUBLE + 0.001::DOUBLE AS lon2,
        50.0::DOUBLE + (user_id % 89) / 10000.0::DOUBLE + 0.0005::DOUBLE AS lat2,
        value AS current_speed, value + 10.0 AS freeflow_speed, ts AS "timestamp", event_id FROM events""",
    "areas": """SELECT 'city_' || n AS area_id, 20.0::DOUBLE + (n % 7) / 200.0::DOUBLE AS west, 50.001::DOUBLE AS south,
        20.0::DOUBLE + (n % 7) / 200.0::DOUBLE + 0.05::DOUBLE AS east, 50.006::DOUBLE AS north
        FROM (SELECT DISTINCT user_id // 20 AS n FROM events)""",
    "features": """SELECT 'city_' || (user_id // 20) AS area_id, event_id, 'flow_' || event_type AS layer,
        event_id % 3 + 18206 AS x, user_id % 2 + 11103 AS y, event_id % 9 AS kind,
        (event_id * 31 % 4096)::DOUBLE AS px, (event_id * 17 % 4096)::DOUBLE AS py,
        json_extract_string(props, '$.k')::INT AS k FROM events""",
    "tile_areas": """SELECT 'city_' || n AS area_id, 20.02::DOUBLE + (n % 5) / 500.0::DOUBLE AS west, 50.055::DOUBLE AS south,
        20.02::DOUBLE + (n % 5) / 500.0::DOUBLE + 0.01::DOUBLE AS east, 50.065::DOUBLE AS north
        FROM (SELECT DISTINCT user_id // 20 AS n FROM events)""",
    "decoded": """SELECT f.*, CASE WHEN kind = 0 THEN 'missing_geometry' WHEN kind = 1 THEN 'unsupported_geometry_type'
        WHEN kind = 2 THEN 'empty_geometry_lines' WHEN kind = 3 THEN 'short_geometry_line'
        WHEN kind = 4 THEN 'invalid_geometry_point' WHEN event_id % 5 = 2 THEN 'missing_speed_property' END AS drop_reason,
        CASE kind WHEN 5 THEN 3 ELSE 2 END AS n_points,
        CASE kind WHEN 5 THEN 2.0 ELSE 0.0 END AS dx1, CASE kind WHEN 5 THEN 4.0 WHEN 6 THEN 1.0 ELSE 10.0 END AS dx2,
        CASE kind WHEN 5 THEN 4.0 WHEN 6 THEN 1.0 ELSE 5.0 END AS dy2 FROM features f""",
    "located": """SELECT d.*, (x * 4096 + px + dx1) / (32768.0 * 4096) * 360.0 - 180.0 AS lon1,
        degrees(atan(sinh(pi() * (1.0 - 2.0 * ((y * 4096 + py + dx1) / (32768.0 * 4096)))))) AS lat1,
        (x * 4096 + px + dx2) / (32768.0 * 4096) * 360.0 - 180.0 AS lon2,
        degrees(atan(sinh(pi() * (1.0 - 2.0 * ((y * 4096 + py + dy2) / (32768.0 * 4096)))))) AS lat2,
        CASE WHEN event_id % 4 = 0 AND event_id <> 0 THEN event_id::VARCHAR END AS given_id FROM decoded d""",
    "edge_lines": f"""SELECT area_id, edge_id, p, x0, y0, x0 + (p % 7 - 3) * 40 AS x1, y0 + (p % 5 - 2) * 40 AS y1, p_size FROM (
        SELECT 'area_' || (p_partkey // {PARTS_PER_AREA}) AS area_id, 'e' || p_partkey AS edge_id, p_partkey AS p,
        p_partkey * 389 % 2000 AS x0, p_partkey * 761 % 2000 AS y0, p_size FROM part)""",
    "edge_pieces": """SELECT area_id, edge_id, x0::DOUBLE AS cx, y0::DOUBLE AS cy, x1::DOUBLE AS dx, y1::DOUBLE AS dy FROM edge_lines
        UNION ALL SELECT area_id, edge_id, x1, y1, x1 + 35, y1 - 15 FROM edge_lines""",
    "segment_pieces": f"""SELECT 'area_' || (c_custkey // {CUSTOMERS_PER_AREA}) AS area_id, 'seg' || c_custkey AS segment_id,
        (c_custkey * 577 % 2000)::DOUBLE AS ax, (c_custkey * 311 % 2000)::DOUBLE AS ay,
        (c_custkey * 577 % 2000 + 30)::DOUBLE AS bx, (c_custkey * 311 % 2000 + (c_custkey % 9 - 4) * 10)::DOUBLE AS "by",
        c_acctbal AS current_speed FROM customer""",
    "lanes": f"""SELECT 'area_' || (p_partkey // {PARTS_PER_AREA}) AS area_id, 'e' || p_partkey AS edge_id, p_partkey AS p, i,
        CASE (p_partkey + i) % 5 WHEN 0 THEN false WHEN 1 THEN true ELSE (p_partkey + i) % 7 <> 0 END AS ok,
        (p_size + i)::DOUBLE AS speed FROM (SELECT *, unnest(range(0, p_size % 3 + 1)) AS i FROM part)""",
    "connections": f"""SELECT 'area_' || (l_partkey // {PARTS_PER_AREA}) AS area_id, 'e' || l_partkey AS from_edge,
        CASE WHEN l_linenumber = 7 THEN ':j' ELSE 'e' END ||
        (l_partkey // {PARTS_PER_AREA} * {PARTS_PER_AREA} + (l_suppkey * 7 + l_linenumber) % 300) AS to_edge,
        l_linenumber % 3 AS from_lane, l_orderkey % 2 AS to_lane FROM lineitem""",
    "links": f"""SELECT DISTINCT 'g' || (l_orderkey // {ORDERS_PER_GRAPH}) AS area_id, 'p' || (l_partkey % {GRAPH_NODES}) AS from_edge,
        'p' || ((l_suppkey * 4 + l_linenumber) % {GRAPH_NODES}) AS to_edge FROM lineitem""",
    "graph_edges": f"""SELECT area_id, from_edge AS edge_id FROM links UNION
        SELECT 'g' || (o_orderkey // {ORDERS_PER_GRAPH}), 'p' || (o_custkey % {GRAPH_NODES}) FROM orders""",
    "graph_pairs": f"""SELECT DISTINCT 'g' || (o_orderkey // {ORDERS_PER_GRAPH}) AS area_id, 'p' || (o_custkey % {GRAPH_NODES}) AS origin,
        'p' || (o_orderkey * 3 % {GRAPH_NODES}) AS destination FROM orders""",
    "genes": f"""SELECT 's' || (o_custkey // 30) AS scenario_id, 'area_' || (o_custkey // 30 // 7) AS area_id,
        (o_orderkey % {N_OD})::INT AS od_idx, (o_orderkey // {N_OD} % {N_BINS})::INT AS bin_idx, count(*) % 7 AS value
        FROM orders GROUP BY 1, 2, 3, 4""",
    "demand_areas": "SELECT DISTINCT 'area_' || (o_custkey // 30 // 7) AS area_id, o_custkey // 30 // 7 AS n FROM orders",
    "od_pairs": f"""SELECT area_id, i::INT AS od_idx, 'n' || ((n * 13 + i * 7) % 50) AS origin, 'n' || ((n * 11 + i * 5 + 3) % 50)
        AS destination FROM demand_areas, range(0, {N_OD}) t(i)""",
    "expanded": f"""SELECT scenario_id, area_id, od_idx, bin_idx, value AS n, k,
        sum(value) OVER (PARTITION BY scenario_id ORDER BY od_idx * {N_BINS} + bin_idx, k ROWS UNBOUNDED PRECEDING) AS unused,
        row_number() OVER (PARTITION BY scenario_id ORDER BY od_idx * {N_BINS} + bin_idx, k) - 1 AS number
        FROM (SELECT *, unnest(range(1, value + 1)) AS k FROM genes)""",
    "expanded_trips": """SELECT scenario_id, od_idx, bin_idx, number, origin, destination,
        CASE WHEN k = n THEN (bin_idx + 1) * 300.0 ELSE bin_idx * 300.0 + 300.0 / n * k END AS departure
        FROM expanded JOIN od_pairs USING (area_id, od_idx)""",
    "trips": """SELECT 'run_' || (o_custkey // 300) AS run_id, 'trip_' || o_orderkey AS trip_id, 'n' || (o_custkey % 83) AS origin,
        'n' || (o_orderkey % 61) AS destination, o_orderkey % 1200 + 0.5::DOUBLE AS departure FROM orders""",
    "pop_base": f"""SELECT vec_id AS v, 'run_' || label || '_' || (vec_id // {MEMBERS_PER_RUNS}) AS run_id, vec_id % 2 AS generation,
        list_transform(embedding, lambda x: trunc(x::DOUBLE * 20)::INT) AS genes FROM embeddings""",
    "pop_loss": """SELECT *, list_sum(genes)::BIGINT AS magnitude, CASE WHEN v % 29 = 0 THEN 'inf'::DOUBLE
        ELSE list_sum(list_transform(genes, lambda g: abs(g))) + (v % 7) * 0.25 END AS loss FROM pop_base""",
    "population": """SELECT *, CASE WHEN v % 5 <> 0 THEN loss - 1.5 END AS e_loss, CASE WHEN v % 6 <> 0 THEN v % 3 END AS fail_total,
        CASE WHEN v % 4 <> 0 THEN v % 3 END AS routing_failures, CASE WHEN v % 4 <> 0 THEN 0 END AS teleports,
        CASE WHEN v % 7 <> 0 THEN (v % 3) * 2.0::DOUBLE END AS penalty, CASE WHEN v % 11 <> 0 THEN v % 13 END AS zero_flow,
        v % 29 = 0 AS failed FROM pop_loss""",
    "scored": """SELECT *, CASE WHEN failed THEN 'inf'::DOUBLE ELSE coalesce(e_loss, loss) END AS e_eff,
        CASE WHEN fail_total IS NOT NULL THEN fail_total
             WHEN routing_failures IS NULL AND failed THEN 1 ELSE coalesce(routing_failures, 0) END AS fails,
        CASE WHEN failed THEN 'inf'::DOUBLE WHEN penalty IS NOT NULL THEN penalty
             ELSE greatest(0.0, loss - coalesce(e_loss, loss)) END AS pen FROM population""",
    "rated": "SELECT *, NOT failed AND fails = 0 AS feasible FROM scored",
    "generations": """SELECT 'run_' || (o_custkey // 300) AS run_id,
        ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INT AS generation, min(o_totalprice / 1000.0) AS best_loss,
        avg(o_totalprice / 1000.0) AS mean_loss, stddev_pop(o_totalprice / 1000.0) AS std_loss FROM orders GROUP BY 1, 2""",
    "catalog": """SELECT 'generated' AS source, 'd' || (page_id * 7 % 997) AS name, length(url)::DOUBLE AS quality_score FROM pages
        UNION ALL SELECT 'packaged', 'd' || (doc_id % 1500), (n_chars % 100)::DOUBLE FROM documents""",
    "log_lines": """SELECT source AS run_id, doc_id AS line_no, CASE doc_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning'
        WHEN 2 THEN 'error' END AS level, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS message FROM documents""",
}


def whole_runs(text: str) -> str:
    """The twin over populations of whole labels."""
    return text.replace(f" || '_' || (vec_id // {MEMBERS_PER_RUNS}) AS run_id", " AS run_id")


def sql(*views: str, select: str) -> str:
    """``WITH`` the named views in order, then ``select``."""
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + " " + select
