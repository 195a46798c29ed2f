"""Cleaning, joins, aggregations, windows and set operations over the derived traffic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.bindings import proxies as P
from roadweave.bindings.columns import (
    CONFIDENCE_SQL, COVERAGE_SQL, DENSITY_SQL, LABEL_SQL, MATCHED_SQL, RATE_SQL, RECOMMEND_SQL, _INSIDE, piece_distance_sql,
)
from roadweave.bindings.proxies import r6, s6
from roadweave.bindings.registry import query
from roadweave.functions import geo, observe
from roadweave.operators import catalog, cleaning, logs, matching, objective, quality, reporting
from roadweave.plans import calibration
from roadweave.sources import store

c = F.col


def _rounded(df, *names):
    return df.select(*[r6(c(n)).alias(n) if n in names else c(n) for n in df.columns])


# ---- K: cleaning ---------------------------------------------------------------------------------------------------

_TILES = ("features", "decoded", "located")


@query("k1_decode_features", P.sql(*_TILES, select=f"""SELECT event_id, drop_reason,
    CASE WHEN drop_reason IS NULL AND given_id IS NOT NULL THEN given_id END AS segment_id,
    CASE WHEN drop_reason IS NULL THEN n_points END::INT AS n_points, CASE WHEN drop_reason IS NULL THEN {s6('lon1')} END AS lon1,
    CASE WHEN drop_reason IS NULL THEN {s6('lat2')} END AS lat2, CASE WHEN event_id % 5 <> 2 THEN k::DOUBLE END AS current_speed,
    CASE WHEN event_id % 3 = 0 THEN k + 20.0 WHEN event_id % 5 <> 2 THEN k::DOUBLE END AS freeflow_speed,
    CASE WHEN event_id % 6 = 0 THEN 0.75 ELSE 0.9 END::DOUBLE AS quality FROM located"""))
def _(spark, d):
    s = cleaning.decode_features(P.tile_features(spark, d))
    # The id of features without one is a hash of text that SQL does not print alike; the given ids are compared.
    given = F.when(~c("segment_id").startswith("flow_"), c("segment_id"))
    g = c("geometry")
    return s.select(
        "event_id", "drop_reason", given.alias("segment_id"), F.when(g.isNotNull(), F.size(g)).alias("n_points"),
        r6(F.get(g, F.lit(0))["lon"]).alias("lon1"), r6(F.try_element_at(g, F.lit(-1))["lat"]).alias("lat2"),
        "current_speed", "freeflow_speed", "quality",
    )


def _responses(spark, d):
    e = c("event_id")
    s = P.segments(spark, d)
    points = F.transform("geometry", lambda p: F.struct(p["lat"].alias("latitude"), p["lon"].alias("longitude")))
    data = F.struct(
        F.when(e % 4 > 0, F.concat(F.lit("FRC"), (e % 6).cast("string"))).alias("frc"),
        F.when(e % 7 > 0, c("current_speed")).alias("currentSpeed"),
        F.when(e % 3 > 0, c("freeflow_speed")).alias("freeFlowSpeed"),
        F.when(e % 5 > 0, 0.8).alias("confidence"),
        F.struct(F.when(e % 13 > 0, points).otherwise(F.slice(points, 1, 0)).alias("coordinate")).alias("coordinates"),
    )
    return s.select("area_id", "event_id", "timestamp", data.alias("flowSegmentData"))


_FLOW = """SELECT event_id, CASE WHEN event_id % 4 > 0 THEN 'FRC' || event_id % 6 ELSE 'unknown' END AS road_class,
    CASE WHEN event_id % 7 > 0 THEN current_speed ELSE 0.0 END AS current_speed,
    CASE WHEN event_id % 3 > 0 THEN freeflow_speed WHEN event_id % 7 > 0 THEN current_speed ELSE 0.0 END AS freeflow_speed,
    CASE WHEN event_id % 5 > 0 THEN 0.8 ELSE 0.9 END::DOUBLE AS quality FROM segments WHERE event_id % 13 > 0"""


@query("k2_parse_flow_responses", P.sql("segments", select=_FLOW))
def _(spark, d):
    return cleaning.parse_flow_responses(_responses(spark, d)).select(
        "event_id", "road_class", "current_speed", "freeflow_speed", "quality"
    )


_DIAG_REASONS = ", ".join(f"count(*) FILTER (drop_reason = '{r}') AS {r}" for r in cleaning.DROP_REASONS)


@query("k3_ingest_diagnostics", P.sql(*_TILES, "tile_areas", select=f"""SELECT a.*, b.* EXCLUDE (area_id) FROM
    (SELECT area_id, count(*) AS features_total, {_DIAG_REASONS}, count(*) FILTER (drop_reason IS NULL) AS segments_decoded
     FROM located GROUP BY 1) a JOIN (SELECT l.area_id, count(*) FILTER (NOT inside) AS segments_dropped_outside_bbox,
     count(*) FILTER (inside) - count(DISTINCT CASE WHEN inside THEN id END) AS segments_dropped_duplicate_id,
     count(DISTINCT CASE WHEN inside THEN id END) AS segments_kept FROM (
       SELECT l.area_id, coalesce(given_id, layer || lon1 || ',' || lat1 || ',' || lon2 || ',' || lat2) AS id,
       NOT (greatest(lon1, lon2) < west OR east < least(lon1, lon2) OR greatest(lat1, lat2) < south OR north < least(lat1, lat2)) AS inside
       FROM located l JOIN tile_areas t USING (area_id) WHERE drop_reason IS NULL) l GROUP BY 1) b USING (area_id)"""))
def _(spark, d):
    decoded = cleaning.decode_features(P.tile_features(spark, d))
    return cleaning.ingest_diagnostics(decoded, P.tile_areas(spark, d), ["x", "y", "feature_idx"])


@query("k4_clip_to_bbox", P.sql("segments", "areas", select="""SELECT event_id, area_id FROM segments JOIN areas USING (area_id)
    WHERE NOT (lon2 < west OR east < lon1 OR lat2 < south OR north < lat1)"""))
def _(spark, d):
    return cleaning.clip_to_bbox(P.segments(spark, d), P.areas(spark, d)).select("event_id", "area_id")


@query("k5_dedup_segments", P.sql("segments", select="""SELECT area_id, segment_id, event_id, current_speed FROM segments
    QUALIFY segment_id = '' OR row_number() OVER (PARTITION BY area_id, segment_id ORDER BY "timestamp", event_id) = 1"""))
def _(spark, d):
    kept = cleaning.dedup_segments(P.segments(spark, d), ["area_id"], ["timestamp", "event_id"])
    return kept.select("area_id", "segment_id", "event_id", "current_speed")


@query("k6_dedup_by_first_point", P.sql("segments", select="""SELECT area_id, event_id, current_speed FROM segments
    QUALIFY row_number() OVER (PARTITION BY area_id, lon1, lat1 ORDER BY event_id) = 1"""))
def _(spark, d):
    kept = cleaning.dedup_by_first_point(P.segments(spark, d), ["area_id"], ["event_id"])
    return kept.select("area_id", "event_id", "current_speed")


@query("k7_parse_log_lines", P.sql("log_lines", select="""SELECT run_id, line_no, level, message FROM log_lines
    WHERE level IS NOT NULL AND message <> ''"""))
def _(spark, d):
    return cleaning.parse_log_lines(P.log_lines(spark, d))


@query("k8_usable_snapshots", P.sql("segments", "areas", select=f"""SELECT area_id, snapshot_id, bool_or({_INSIDE}) AS usable
    FROM segments JOIN areas USING (area_id) GROUP BY 1, 2"""))
def _(spark, d):
    return cleaning.usable_snapshots(P.segments(spark, d), P.areas(spark, d))


@query("k9_snapshot_timestamp", P.sql("segments", select="""SELECT area_id,
    epoch_us(coalesce(arg_min("timestamp", event_id) FILTER (event_id % 3 = 0 AND ascii(area_id[6:6]) % 2 = 0), TIMESTAMP '2024-06-01'))
    AS snapshot_us FROM segments GROUP BY 1"""))
def _(spark, d):
    s = P.segments(spark, d)
    even = F.ascii(F.substring("area_id", 6, 1)) % 2 == 0
    text = F.when((c("event_id") % 3 == 0) & even, c("timestamp").cast("string")).otherwise("unknown")
    meta = s.select("area_id").distinct().withColumn("created_at", F.lit("2024-06-01 00:00:00"))
    stamped = cleaning.snapshot_timestamp(s.withColumn("timestamp", text), meta, ["event_id"])
    return stamped.select("area_id", F.unix_micros("snapshot_ts").alias("snapshot_us"))


# ---- J: joins --------------------------------------------------------------------------------------------------------


@query("j1_match_segments", P.sql("edge_lines", "edge_pieces", "segment_pieces", select=f"""SELECT area_id, segment_id, edge_id, current_speed,
    {s6('1.0 - distance / 100')} AS match_confidence FROM (SELECT *, row_number() OVER (PARTITION BY area_id, segment_id ORDER BY distance, edge_id) AS r
    FROM (SELECT s.area_id, s.segment_id, e.edge_id, s.current_speed, min({piece_distance_sql()}) AS distance
    FROM segment_pieces s JOIN edge_pieces e ON s.area_id = e.area_id GROUP BY 1, 2, 3, 4))
    WHERE r = 1 AND distance <= 100 AND 1.0 - distance / 100 >= 0.1"""))
def _(spark, d):
    matched = matching.match_segments(P.line_segments(spark, d), P.line_edges(spark, d))
    return matched.select("area_id", "segment_id", "edge_id", "current_speed", r6(c("match_confidence")).alias("match_confidence"))


_SPEEDS = ("observed", "simulated", "scenarios", "joined")


def _speed_tables(spark, d):
    return P.observed(spark, d), P.simulated(spark, d), P.scenarios(spark, d)


@query("j2_join_observed_simulated", P.sql(*_SPEEDS, select=f"""SELECT scenario_id, edge_id, speed_kmh IS NULL AS missing,
    {s6('coalesce(speed_kmh, freeflow_speed)')} AS effective_speed FROM joined"""))
def _(spark, d):
    joined = objective.join_observed_simulated(*_speed_tables(spark, d))
    return joined.select("scenario_id", "edge_id", "missing", r6(c("effective_speed")).alias("effective_speed"))


@query("j3_missing_edges", P.sql(*_SPEEDS, select="SELECT scenario_id, edge_id FROM joined WHERE speed_kmh IS NULL"))
def _(spark, d):
    return objective.missing_edges(*_speed_tables(spark, d))


@query("j4_covered_edges", P.sql(*_SPEEDS, select="SELECT scenario_id, edge_id FROM joined WHERE speed_kmh IS NOT NULL"))
def _(spark, d):
    return objective.covered_edges(P.observed(spark, d), P.simulated(spark, d))


@query("j5_build_links", P.sql("lanes", "connections", select="""SELECT DISTINCT area_id, from_edge, to_edge FROM connections co
    WHERE to_edge NOT LIKE ':%'
    AND (NOT EXISTS (SELECT 1 FROM lanes l WHERE l.area_id = co.area_id AND l.edge_id = from_edge)
      OR EXISTS (SELECT 1 FROM lanes l WHERE l.area_id = co.area_id AND l.edge_id = from_edge AND l.i = from_lane AND ok))
    AND (NOT EXISTS (SELECT 1 FROM lanes l WHERE l.area_id = co.area_id AND l.edge_id = to_edge)
      OR EXISTS (SELECT 1 FROM lanes l WHERE l.area_id = co.area_id AND l.edge_id = to_edge AND l.i = to_lane AND ok))"""))
def _(spark, d):
    return matching.build_links(P.connections(spark, d), P.lanes(spark, d))


@query("j6_build_edges", P.sql("lanes", select="""SELECT area_id, edge_id, count(*)::INT AS num_lanes, arg_min(speed, i) FILTER (ok) AS speed,
    any_value(p % 9)::INT AS priority, (any_value(p % 100) + 5)::DOUBLE AS x2, (min(i) FILTER (ok))::DOUBLE AS y1
    FROM lanes GROUP BY 1, 2 HAVING bool_or(ok) AND any_value(p) % 23 <> 0"""))
def _(spark, d):
    e = matching.build_edges(P.lanes(spark, d))
    return e.select(
        "area_id", "edge_id", "num_lanes", "speed", "priority", c("geometry")[1]["x"].alias("x2"), c("geometry")[0]["y"].alias("y1")
    )


def _catalog(spark, d):
    return catalog.union_catalogs(P.generated_catalog(spark, d), P.packaged_catalog(spark, d))


def _refs(spark, d):
    o = c("doc_id")
    name = F.concat(F.lit("d"), (o % 1700).cast("string"))
    ref = F.when(o % 3 == 0, F.concat(F.lit("generated:"), name)).when(o % 101 == 1, "  ").otherwise(name)
    return P.table(spark, d, "documents").select(ref.alias("ref"))


@query("j7_resolve_datasets", P.sql("catalog", select="""SELECT r.ref, CASE WHEN trim(r.ref) = '' THEN 'required' WHEN count(k.name) = 0 THEN 'not_found'
    WHEN count(k.name) > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN count(k.name) = 1 THEN min(k.source || ':' || k.name) END AS dataset_id,
    count(k.name) AS n_matches FROM (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'generated:d' || doc_id % 1700 WHEN doc_id % 101 = 1 THEN '  '
    ELSE 'd' || doc_id % 1700 END AS ref FROM documents) r LEFT JOIN catalog k ON k.name = trim(r.ref) OR k.source || ':' || k.name = trim(r.ref) GROUP BY 1"""))
def _(spark, d):
    return catalog.resolve_datasets(_refs(spark, d), _catalog(spark, d))


@query("j9_flag_observed", P.sql("edge_lines", select="""SELECT area_id, count(*) AS edges, count(*) FILTER (p % 4 = 0) AS observed_plotted,
    count(*) FILTER (p % 4 = 0) + count(*) FILTER (p % 8 = 0) AS observed_total FROM edge_lines GROUP BY 1"""))
def _(spark, d):
    edges = P.line_edges(spark, d)
    n = F.substring("edge_id", 2, 20).cast("bigint")
    known = edges.select("area_id", F.when(n % 4 == 0, c("edge_id")).alias("edge_id"))
    foreign = edges.select("area_id", F.when(n % 8 == 0, F.concat(F.lit("x"), "edge_id")).alias("edge_id"))
    obs = known.union(foreign)
    return matching.overlay_counts(matching.flag_observed(edges, obs), obs)


# ---- A: aggregations ---------------------------------------------------------------------------------------------------


@query("a1_mean_edge_speeds", P.sql("intervals", select=f"""SELECT scenario_id, edge_id, {s6('avg(speed * 3.6)')} AS speed_kmh FROM intervals
    WHERE "begin" >= 300 AND speed IS NOT NULL GROUP BY 1, 2"""))
def _(spark, d):
    return _rounded(objective.mean_edge_speeds(P.intervals(spark, d), 300), "speed_kmh")


@query("a2_interval_coverage", P.sql("intervals", select="""SELECT scenario_id, count(DISTINCT "begin") AS total_intervals,
    count(DISTINCT CASE WHEN "begin" < 300 THEN "begin" END) AS warmup_intervals,
    count(DISTINCT CASE WHEN "begin" >= 300 THEN "begin" END) AS measurement_intervals,
    count(DISTINCT CASE WHEN "begin" < 300 AND speed IS NOT NULL THEN edge_id END) AS edges_in_warmup,
    count(DISTINCT CASE WHEN "begin" >= 300 AND speed IS NOT NULL THEN edge_id END) AS edges_in_measurement,
    count(DISTINCT CASE WHEN "begin" >= 300 AND speed IS NOT NULL THEN edge_id END) = 0
      AND count(DISTINCT CASE WHEN "begin" < 300 AND speed IS NOT NULL THEN edge_id END) > 0 AS only_in_warmup
    FROM intervals GROUP BY 1"""))
def _(spark, d):
    return objective.interval_coverage(P.intervals(spark, d), 300)


_TRIPS = ("expected", "tripinfo", "statistics", "trip_stats")


def _trip_stats(spark, d):
    return objective.trip_stats(P.tripinfo(spark, d), P.statistics(spark, d), P.expected(spark, d))


@query("a3_trip_stats", P.sql(*_TRIPS, select=f"""SELECT scenario_id, expected_vehicles, completed_trips, {s6('avg_duration')} AS avg_duration,
    {s6('avg_waiting_time')} AS avg_waiting_time, routing_failures::BIGINT AS routing_failures, teleports::BIGINT AS teleports,
    total_trips::BIGINT AS total_trips FROM trip_stats"""))
def _(spark, d):
    return _rounded(_trip_stats(spark, d), "avg_duration", "avg_waiting_time")


def loss_components(spark, d):
    df = objective.loss_components(*_speed_tables(spark, d), _trip_stats(spark, d), P.expected(spark, d))
    return _rounded(df, "mae", "coverage_penalty", "e_loss", "reliability_penalty", "loss")


@query("a4_loss_components", P.sql(*_SPEEDS, *_TRIPS, "losses", "loss_components", select=f"""SELECT area_id, scenario_id, {s6('mae')} AS mae,
    {s6('coverage_penalty')} AS coverage_penalty, {s6('e_loss')} AS e_loss, fail_total::BIGINT AS fail_total,
    {s6('reliability_penalty')} AS reliability_penalty, {s6('e_loss + reliability_penalty')} AS loss, missing_edges FROM loss_components"""))
def _(spark, d):
    return loss_components(spark, d)


def _quality(spark, d):
    o = P.observed(spark, d)
    seg = P.table(spark, d, "customer").select(
        F.concat(F.lit("area_"), P.div("c_custkey", P.CUSTOMERS_PER_AREA).cast("string")).alias("area_id")
    )
    net = P.table(spark, d, "lineitem").select(
        F.concat(F.lit("area_"), P.div("l_partkey", P.PARTS_PER_AREA).cast("string")).alias("area_id")
    )
    boxes = o.select("area_id").distinct().withColumn("n", F.substring("area_id", 6, 20).cast("double"))
    west, south = F.lit(20.0) + c("n") / 10, F.lit(50.0) + c("n") / 100
    areas = boxes.select("area_id", west.alias("west"), south.alias("south"), (west + 0.05).alias("east"), (south + 0.03).alias("north"))
    return quality.assess_quality(seg, o, net, areas)


_QUALITY_FIGURES = """, figures AS (SELECT a.area_id, coalesce(f.n, 0) AS fetched, a.matched, e.n AS edges, a.matched::DOUBLE / nullif(f.n, 0) AS rate,
    a.matched::DOUBLE / e.n AS ratio, a.matched / ((0.05::DOUBLE) * (111.0::DOUBLE * cos(radians(50.0::DOUBLE + a.i / 100 + 0.015))) * (0.03::DOUBLE * 111.0)) AS density,
    a.median, a.low FROM (SELECT area_id, substr(area_id, 6)::DOUBLE AS i, count(*) AS matched, median(match_confidence) AS median,
    avg((match_confidence < 0.85)::INT) AS low FROM observed GROUP BY 1, 2) a
    LEFT JOIN (SELECT 'area_' || (c_custkey // 188) AS area_id, count(*) AS n FROM customer GROUP BY 1) f USING (area_id)
    LEFT JOIN (SELECT 'area_' || (l_partkey // 250) AS area_id, count(*) AS n FROM lineitem GROUP BY 1) e USING (area_id)),
    points AS (SELECT *, {m} AS availability, {r} AS rate_points, {c} AS confidence, {d} AS density_points, {v} AS coverage FROM figures),
    scored AS (SELECT *, availability + rate_points + confidence + density_points + coverage AS score FROM points)""".format(
    m=MATCHED_SQL.format(v="matched"), r=RATE_SQL.format(v="coalesce(rate, 0)"), c=CONFIDENCE_SQL.format(v="median", s="low"),
    d=DENSITY_SQL.format(v="density"), v=COVERAGE_SQL.format(v="ratio"),
)


@query("a5_assess_quality", "WITH observed AS (" + P.VIEWS["observed"] + ")" + _QUALITY_FIGURES + f""" SELECT area_id, fetched AS fetched_segments,
    matched AS matched_edges, edges AS total_network_edges, {s6('coalesce(rate, 0)')} AS match_rate, {s6('density')} AS edges_per_km2,
    {s6('median')} AS median_match_confidence, {s6('low')} AS low_confidence_share, score::INT AS score, {LABEL_SQL.format(v='score')} AS label,
    {RECOMMEND_SQL.format(v='score', m='matched')} AS recommendation, upper({LABEL_SQL.format(v='score')}) || ' quality (' || score || '/100): ' || matched ||
    ' matched edges from ' || fetched || ' traffic segments (match rate ' || round_even(coalesce(rate, 0) * 100, 1) || '%).' AS summary,
    concat_ws(',', CASE WHEN fetched = 0 THEN 'no_traffic_segments' END, CASE WHEN matched < 5 THEN 'very_few_matched_edges' END,
      CASE WHEN coalesce(rate, 0) < 0.7 THEN 'low_match_rate' END, CASE WHEN density < 1.5 THEN 'sparse_observed_edges' END,
      CASE WHEN ratio < 0.005 THEN 'low_network_coverage' END, CASE WHEN median < 0.94 THEN 'low_match_confidence' END) AS warnings FROM scored""")
def _(spark, d):
    q = _quality(spark, d).select(
        "area_id", "fetched_segments", "matched_edges", "total_network_edges", "match_rate", "edges_per_km2",
        "median_match_confidence", "low_confidence_share", "score", "label", "recommendation", "summary",
        F.concat_ws(",", "warnings").alias("warnings"),
    )
    return _rounded(q, "match_rate", "edges_per_km2", "median_match_confidence", "low_confidence_share")


@query("a6_speed_metrics", P.sql(*_SPEEDS, "losses", select=f"""SELECT area_id, scenario_id, {s6('mae')} AS mae, {s6('mse')} AS mse, matched AS matched_edges,
    missing AS missing_edges, missing AS zero_flow_edges, total AS total_edges, {s6('diff')} AS avg_speed_diff FROM losses"""))
def _(spark, d):
    return _rounded(objective.speed_metrics(*_speed_tables(spark, d)), "mae", "mse", "avg_speed_diff")


@query("a7_fit_stats", P.sql(*_SPEEDS, select=f"""SELECT scenario_id, count(speed_kmh) AS n_matched,
    CASE WHEN count(speed_kmh) >= 2 THEN {s6('CASE WHEN var_pop(current_speed) FILTER (speed_kmh IS NOT NULL) > 0 THEN 1 - sum((speed_kmh - current_speed) ** 2) / (var_pop(current_speed) FILTER (speed_kmh IS NOT NULL) * count(speed_kmh)) ELSE 0.0 END')} END AS r_squared,
    CASE WHEN count(speed_kmh) >= 2 THEN {s6('sqrt(avg((speed_kmh - current_speed) ** 2))')} END AS rmse,
    CASE WHEN count(speed_kmh) >= 2 THEN {s6('avg(abs(speed_kmh - current_speed))')} END AS mae FROM joined GROUP BY 1"""))
def _(spark, d):
    return _rounded(objective.fit_stats(*_speed_tables(spark, d)), "r_squared", "rmse", "mae")


@query("a8_match_rate_percent", P.sql(*_SPEEDS, "losses", select="""SELECT scenario_id, CASE WHEN total > 0 THEN (round_even(matched * 100.0::DOUBLE / total, 1) + 0.0)
    ELSE 0.0 END AS match_rate_percent FROM losses"""))
def _(spark, d):
    m = objective.speed_metrics(*_speed_tables(spark, d))
    return m.select("scenario_id", reporting.match_rate_percent(c("matched_edges"), c("total_edges")).alias("match_rate_percent"))


def _genomes(spark, d):
    """One two-gene candidate per scenario, plus one per area that was never simulated."""
    e = P.expected(spark, d)
    sim = P.scenarios(spark, d).join(e, "scenario_id").select(
        "area_id", "scenario_id", F.array(c("expected_vehicles").cast("int"), F.lit(0)).alias("genes")
    )
    lost = P.observed(spark, d).select("area_id").distinct().select(
        "area_id", F.concat("area_id", F.lit("_lost")).alias("scenario_id"), F.array(F.lit(7), F.lit(3)).alias("genes")
    )
    return sim.union(lost)


@query("a9_evaluate_scenarios", P.sql(*_SPEEDS, *_TRIPS, "losses", "loss_components", select=f"""SELECT scenario_id, {s6('e_loss + reliability_penalty')} AS loss,
    {s6('e_loss')} AS e_loss, {s6('l.mae')} AS mae, {s6('l.mse')} AS mse, l.matched AS matched_edges, l.missing AS zero_flow_edges, fail_total::BIGINT AS fail_total,
    t.routing_failures::BIGINT AS routing_failures, t.teleports::BIGINT AS teleports, t.expected_vehicles::BIGINT AS total_vehicles,
    {s6('t.avg_duration')} AS avg_trip_duration, false AS worker_error FROM loss_components JOIN losses l USING (scenario_id) JOIN trip_stats t USING (scenario_id)
    UNION ALL SELECT DISTINCT area_id || '_lost', 'inf'::DOUBLE, 'inf'::DOUBLE, NULL, NULL, NULL, NULL, 1, 1, 0, 0, 0.0, true FROM observed"""))
def _(spark, d):
    o, m, _s = _speed_tables(spark, d)
    r = objective.evaluate_scenarios(_genomes(spark, d), o, m, P.tripinfo(spark, d), P.statistics(spark, d))
    r = r.select(
        "scenario_id", "loss", "e_loss", "mae", "mse", "matched_edges", "zero_flow_edges", "fail_total", "routing_failures", "teleports",
        "total_vehicles", "avg_trip_duration", "worker_error",
    )
    finite = F.when(c("loss") < float("inf"), r6(c("loss"))).otherwise(c("loss"))
    e_finite = F.when(c("e_loss") < float("inf"), r6(c("e_loss"))).otherwise(c("e_loss"))
    return _rounded(r.withColumn("loss", finite).withColumn("e_loss", e_finite), "mae", "mse", "avg_trip_duration")


@query("a10_magnitude", P.sql("pop_base", select="SELECT v AS individual_id, list_sum(genes)::BIGINT AS magnitude FROM pop_base"))
def _(spark, d):
    return objective.magnitude(P.population(spark, d)).select("individual_id", "magnitude")


@query("a15_catalog_listing", P.sql("catalog", select="SELECT source || ':' || name AS id, name, source, quality_score FROM catalog"))
def _(spark, d):
    return catalog.catalog_listing(_catalog(spark, d))


@query("a17_dataset_manifest", "WITH observed AS (" + P.VIEWS["observed"] + ")" + _QUALITY_FIGURES + f""" SELECT area_id, 'ds_' || area_id AS dataset_name,
    {s6("20.0::DOUBLE + substr(area_id, 6)::DOUBLE / 10")} AS west, matched AS stats_matched, score::INT AS score, {LABEL_SQL.format(v='score')} AS label,
    density_points::INT AS density_points, 'data/observed_edges.csv' AS observed_file FROM scored""")
def _(spark, d):
    q = _quality(spark, d)
    meta = q.select(
        "area_id", F.concat(F.lit("ds_"), "area_id").alias("dataset_name"), F.lit("2024-01-01").alias("created_at"),
        F.lit(12).alias("traffic_tile_zoom"), F.create_map(F.lit("provider"), F.lit("p")).alias("provider"),
    )
    m = quality.dataset_manifest(q, meta)
    return m.select(
        "area_id", "dataset_name", r6(c("bbox.west")).alias("west"), c("stats.matched_edges").alias("stats_matched"),
        c("quality.score").alias("score"), c("quality.label").alias("label"), c("quality.components.density").alias("density_points"),
        c("files").getItem("observed_edges_csv").alias("observed_file"),
    )


# ---- W, R: rankings and reports ----------------------------------------------------------------------------------------


@query("w1_top_mismatches", P.sql(*_SPEEDS, select="""SELECT scenario_id, edge_id, observed, simulated, error, note, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY error DESC, edge_id, segment_id)::INT AS rank FROM (
    SELECT scenario_id, edge_id, segment_id, round_even(current_speed, 1) AS observed, round_even(coalesce(speed_kmh, 0.0), 1) AS simulated,
    round_even(coalesce(abs(speed_kmh - current_speed), current_speed), 1) AS error,
    CASE WHEN speed_kmh IS NULL THEN '(No Traffic)' ELSE '' END AS note FROM joined)) WHERE rank <= 10"""))
def _(spark, d):
    return reporting.top_mismatches(*_speed_tables(spark, d))


@query("w11_recent_logs", P.sql("log_lines", select="""SELECT run_id, line_no, level, message FROM log_lines WHERE level IS NOT NULL AND message <> ''
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) <= 100"""))
def _(spark, d):
    return logs.recent_logs(cleaning.parse_log_lines(P.log_lines(spark, d)))


def progress_events(spark, d):
    o = P.table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("run_"), P.div("o_custkey", 30).cast("string")).alias("run_id"), c("o_orderkey").alias("event_no"),
        (c("o_orderkey") % 9).alias("stage"), c("o_orderpriority").alias("stage_name"), c("o_orderstatus").alias("status"),
    )


PROGRESS_SQL = """SELECT 'run_' || (o_custkey // 30) AS run_id, arg_max(o_orderkey % 9, o_orderkey) AS stage,
    arg_max(o_orderpriority, o_orderkey) AS stage_name, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1"""


@query("w12_run_progress", PROGRESS_SQL)
def _(spark, d):
    return logs.run_progress(progress_events(spark, d))


@query("r1_speed_comparison", P.sql(*_SPEEDS, select=f"""SELECT scenario_id, edge_id, current_speed AS observed_speed, {s6('speed_kmh')} AS simulated_speed,
    CASE WHEN speed_kmh IS NULL THEN 'missing_in_sim' ELSE 'matched' END AS status FROM joined"""))
def _(spark, d):
    return _rounded(reporting.speed_comparison(*_speed_tables(spark, d)), "simulated_speed")


@query("r3_run_parameters", """SELECT 'run_' || o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100)::INT ELSE 42 END AS seed,
    CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 10) / 10.0::DOUBLE ELSE 0.5 END AS ga_mutation_rate,
    CASE WHEN o_orderkey % 5 = 0 THEN greatest(1, o_custkey % 20)::INT ELSE 10 END AS ga_checkpoint_interval,
    o_orderkey % 2 = 0 AS ga_assortative_mating, 50 AS ga_population FROM orders""")
def _(spark, d):
    o = c("o_orderkey")
    raw = P.table(spark, d, "orders").select(
        F.concat(F.lit("run_"), o.cast("string")).alias("run_id"),
        F.when(o % 3 == 0, (o % 100).cast("string")).otherwise("n/a").alias("seed"),
        F.when(o % 4 == 0, ((o % 10) / 10.0).cast("string")).alias("ga_mutation_rate"),
        F.when(o % 5 == 0, (c("o_custkey") % 20).cast("string")).alias("ga_checkpoint_interval"),
        F.when(o % 2 == 0, "On").otherwise("no").alias("ga_assortative_mating"),
    )
    return reporting.run_parameters(raw).select(
        "run_id", "seed", "ga_mutation_rate", "ga_checkpoint_interval", "ga_assortative_mating", "ga_population"
    )


# ---- U: set operations ---------------------------------------------------------------------------------------------------


@query("u1_union_catalogs", P.sql("catalog", select="SELECT source, name, source || ':' || name AS id FROM catalog"))
def _(spark, d):
    return _catalog(spark, d).select("source", "name", "id")


@query("u2_common_edges", P.sql("observed", "simulated", select="SELECT area_id, edge_id FROM observed INTERSECT SELECT area_id, edge_id FROM simulated"))
def _(spark, d):
    return objective.common_edges(P.observed(spark, d), P.simulated(spark, d))


def _slow(simulated):
    """Edges that some scenario drives at least at 47 km/h: leaves part of the observed edges uncovered."""
    return simulated.where("speed_kmh >= 47")


@query("u3_uncovered_edges", P.sql("observed", "simulated", select="""SELECT area_id, edge_id FROM observed EXCEPT
    SELECT area_id, edge_id FROM simulated WHERE speed_kmh >= 47"""))
def _(spark, d):
    return objective.uncovered_edges(P.observed(spark, d), _slow(P.simulated(spark, d)))


@query("u4_existing_names", P.sql("catalog", select="""SELECT DISTINCT 'd' || o_custkey AS name FROM orders WHERE 'd' || o_custkey IN (SELECT name FROM catalog)"""))
def _(spark, d):
    names = P.table(spark, d, "orders").select(F.concat(F.lit(" d"), c("o_custkey").cast("string"), F.lit(" ")).alias("name"))
    return catalog.existing_names(names, _catalog(spark, d))


@query("u6_observed_ids", P.sql("segments", select="""SELECT DISTINCT area_id, segment_id AS edge_id FROM segments WHERE segment_id <> ''"""))
def _(spark, d):
    s = P.segments(spark, d).select("area_id", F.when(c("segment_id") != "", c("segment_id")).alias("edge_id"))
    return matching.observed_ids(s)


# ---- X: extension points -------------------------------------------------------------------------------------------------


@query("x1_registered_provider", P.sql("segments", select="SELECT area_id, count(*) AS n FROM segments GROUP BY 1"))
def _(spark, d):
    calibration.register_provider("landed", lambda s, areas: P.segments(s, d).join(areas.select("area_id"), "area_id"))
    return calibration.fetch_segments("landed", spark, P.areas(spark, d)).groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))


@query("x4_gate", "WITH observed AS (" + P.VIEWS["observed"] + ")" + _QUALITY_FIGURES + " SELECT area_id FROM scored WHERE matched > 0 AND score >= 70 AND "
       + RECOMMEND_SQL.format(v="score", m="matched") + " IN ('proceed', 'caution')")
def _(spark, d):
    return quality.gate(_quality(spark, d), 70, ("proceed", "caution"))


# ---- S22: bundle check over derived file lists -----------------------------------------------------------------------------


@query("s22_bundle_completeness", """WITH f AS (SELECT DISTINCT 'ds_' || (o_custkey) AS dataset, CASE o_orderkey % 5 WHEN 0 THEN 'data/traffic_data_raw.csv'
    WHEN 1 THEN 'data/observed_edges.csv' WHEN 2 THEN 'sumo/network.net.xml' WHEN 3 THEN 'dataset_meta.json' ELSE 'plots/network.png' END AS p FROM orders),
    r AS (SELECT unnest(['data/traffic_data_raw.csv', 'data/observed_edges.csv', 'sumo/network.net.xml', 'dataset_meta.json']) AS p),
    x AS (SELECT d.dataset, r.p, f.p IS NOT NULL AS present FROM (SELECT DISTINCT dataset FROM f) d, r LEFT JOIN f ON f.dataset = d.dataset AND f.p = r.p)
    SELECT dataset, coalesce(string_agg(CASE WHEN NOT present THEN p END, ',' ORDER BY p), '') AS missing, bool_and(present) AS complete FROM x GROUP BY 1""")
def _(spark, d):
    o = c("o_orderkey") % 5
    path = (
        F.when(o == 0, store.REQUIRED_FILES[0]).when(o == 1, store.REQUIRED_FILES[1]).when(o == 2, store.REQUIRED_FILES[2])
        .when(o == 3, store.REQUIRED_FILES[3]).otherwise("plots/network.png")
    )
    files = P.table(spark, d, "orders").select(
        F.concat(F.lit("ds_"), c("o_custkey").cast("string")).alias("dataset"), path.alias("rel_path")
    )
    return store.bundle_completeness(files).select("dataset", F.concat_ws(",", "missing").alias("missing"), "complete")
