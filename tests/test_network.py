import math
import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import demand, graph, matching


def point_to_piece(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else min(1.0, max(0.0, ((px - x1) * dx + (py - y1) * dy) / n))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def piece_distance(a, b, c, d):
    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
        return 0.0
    return min(point_to_piece(*a, *c, *d), point_to_piece(*b, *c, *d), point_to_piece(*c, *a, *b), point_to_piece(*d, *a, *b))


def line_distance(p, q):
    return min(piece_distance(p[i], p[i + 1], q[j], q[j + 1]) for i in range(len(p) - 1) for j in range(len(q) - 1))


LINE = "area_id string, {} string, geometry array<struct<x:double,y:double>>"


def random_lines(rnd, prefix, n, spread, step):
    rows = []
    for i in range(n):
        x, y = rnd.uniform(-spread, spread), rnd.uniform(-spread, spread)
        line = [(x, y)]
        for _ in range(rnd.randint(1, 3)):
            x, y = x + rnd.uniform(-step, step), y + rnd.uniform(-step, step)
            line.append((x, y))
        rows.append((rnd.choice("AB"), f"{prefix}{i}", line))
    return rows


def brute_match(segments, edges):
    best = {}
    for area, seg, line in segments:
        if len(line) < 2:
            continue
        near = min(
            ((line_distance(line, geometry), e) for a, e, geometry in edges if a == area and len(geometry) > 1), default=(math.inf, None)
        )
        if 1 - near[0] / 100 >= 0.1:
            best[area, seg] = (near[1], max(0.0, 1 - near[0] / 100))
    return best


@pytest.mark.parametrize("partitions", [5])
def test_match_equals_brute_force(spark, partitions):
    rnd = random.Random(3)
    edges = random_lines(rnd, "e", 120, 800, 260)
    segments = random_lines(rnd, "s", 80, 900, 120)
    segments += [(a, f"copy{i}_{s}", g) for i in range(3) for a, s, g in segments[:5]]  # other snapshots of the same line
    edges += [(a, "0" + e, g) for a, e, g in edges[:10]]  # equal geometry: the smaller id must win
    segments.append(("A", "point", [(0.0, 0.0)]))
    edges.append(("A", "dot", [(0.0, 0.0)]))
    seg_df = spark.createDataFrame(segments, LINE.format("segment_id")).repartition(partitions)
    edge_df = spark.createDataFrame(edges, LINE.format("edge_id")).repartition(partitions)
    got = {(r["area_id"], r["segment_id"]): (r["edge_id"], r["match_confidence"]) for r in matching.match_segments(seg_df, edge_df).collect()}
    want = brute_match(segments, edges)
    assert got.keys() == want.keys()
    for key, (edge, confidence) in want.items():
        assert got[key][1] == pytest.approx(confidence, abs=1e-9) and got[key][0] == edge


LANE = "edge_id string, priority int, type string, lane_pos int, lane_index int, allow string, disallow string, speed double, shape string"
CONNECTION = "from_edge string, to_edge string, from_lane int, to_lane int"


def test_lane_permissions_decide_links(spark):
    lanes = spark.createDataFrame(
        [
            ("A", 3, "road", 0, 0, "bus", "", 8.0, "0,0 1,1"), ("A", 3, "road", 1, 1, "", "", 9.0, "0,1 1,2"),
            ("B", 1, "", 0, 0, "", "", 13.89, "1,1 2,2"), ("C", 1, "", 0, 0, "bus", "", 5.0, "1,1 2,2"),
            ("D", 1, "", 0, 0, "", "", 5.0, "1,1"),
        ],
        LANE,
    )
    edges = {r["edge_id"]: r for r in matching.build_edges(lanes).collect()}
    assert set(edges) == {"A", "B"}
    assert (edges["A"]["speed"], edges["A"]["num_lanes"], edges["A"]["geometry"][0]["y"]) == (9.0, 2, 1.0)
    given = [("A", "B", 0, 0), ("A", "B", 1, 0), ("A", "C", 1, 0), ("A", "unknown", 1, 7), ("A", ":x", 1, 0), ("B", "A", 0, None), (None, "A", 0, 0)]
    links = matching.build_links(spark.createDataFrame(given, CONNECTION), lanes).collect()
    # An unreadable lane number switches the lane check off; an edge outside the lane table does not block.
    assert {tuple(r) for r in links} == {("A", "B"), ("A", "unknown"), ("B", "A")}
    only_bus = matching.build_links(spark.createDataFrame(given[:1], CONNECTION), lanes)
    assert only_bus.isEmpty()


def random_graph(rnd, areas, nodes, links):
    return [(a, f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for a in areas for _ in range(links)]


def brute_reach(links, area, start, hops=None):
    seen, layer, hop = {start}, {start}, 0
    while layer and (hops is None or hop < hops):
        layer = {t for a, f, t in links if a == area and f in layer} - seen
        seen |= layer
        hop += 1
    return seen


@pytest.mark.parametrize(("hops", "growth"), [(None, 32), (None, 2), (3, 32)])
def test_reachable_equals_bfs(spark, monkeypatch, hops, growth):
    monkeypatch.setattr(graph, "HUB_GROWTH", growth)
    rnd = random.Random(9)
    links = random_graph(rnd, "AB", 40, 55)
    pairs = {(a, f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for a in "AB" for _ in range(120)}
    pairs.add(("A", "lonely", "lonely"))
    got = graph.reachable(
        spark.createDataFrame(sorted(pairs), "area_id string, origin string, destination string"),
        spark.createDataFrame(links, "area_id string, from_edge string, to_edge string"), hops,
    )
    rows = [tuple(r) for r in got.select("area_id", "origin", "destination").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(a, o, d) for a, o, d in pairs if d in brute_reach(links, a, o, hops)}


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    links = random_graph(rnd, "AB", 60, 35) + [("A", f"chain{i:03}", f"chain{i + 1:03}") for i in range(50)]
    links.append(("A", "n1", "outside"))
    nodes = {(a, f"n{i}") for a in "AB" for i in range(60)} | {("A", f"chain{i:03}") for i in range(51)}
    label = {n: n[1] for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, f, t in links:
            if (a, f) in label and (a, t) in label and label[a, f] != label[a, t]:
                label[a, f] = label[a, t] = min(label[a, f], label[a, t])
                changed = True
    got = graph.components(
        spark.createDataFrame(sorted(nodes), "area_id string, edge_id string"),
        spark.createDataFrame(links, "area_id string, from_edge string, to_edge string"),
    )
    assert {(r["area_id"], r["edge_id"]): r["component"] for r in got.collect()} == label
    sizes = {}
    for (a, _), c in label.items():
        sizes[a, c] = sizes.get((a, c), 0) + 1
    for r in graph.largest_component(got).collect():
        best = min((-n, c) for (a, c), n in sizes.items() if a == r["area_id"])
        assert (r["component"], r["size"]) == (best[1], -best[0])


def test_neighbors(spark):
    links = spark.createDataFrame([("A", "x", "y"), ("A", "x", "y"), ("A", "x", "z")], "area_id string, from_edge string, to_edge string")
    rows = {r["edge_id"]: (r["out_degree"], r["in_degree"]) for r in graph.neighbors(links).collect()}
    assert rows == {"x": (2, 0), "y": (0, 1), "z": (0, 1)}
    assert {(r["from_edge"], r["to_edge"], r["degree"]) for r in graph.neighbor_lists(links).collect()} == {("x", "y", 2), ("x", "z", 2)}


@pytest.fixture(scope="module")
def city(spark):
    rnd = random.Random(2)
    edges = [("A", f"e{i}", [(rnd.uniform(0, 3000), rnd.uniform(0, 3000)), (rnd.uniform(0, 3000), rnd.uniform(0, 3000))], 1 + i % 4, 10.0, 1) for i in range(60)]
    edges += [("B", "b0", [(0.0, 0.0), (1.0, 0.0)], 1, 10.0, 1), ("B", "b1", [(5.0, 0.0), (6.0, 0.0)], 1, 10.0, 1)]
    links = [("A", f"e{rnd.randrange(60)}", f"e{rnd.randrange(60)}") for _ in range(150)]
    return (
        edges, links,
        spark.createDataFrame(edges, "area_id string, edge_id string, geometry array<struct<x:double,y:double>>, priority int, speed double, num_lanes int"),
        spark.createDataFrame(links, "area_id string, from_edge string, to_edge string"),
        spark.createDataFrame([("A", 800.0), ("B", 800.0)], "area_id string, min_distance double"),
    )


def test_od_pairs_are_valid_and_stable(spark, city):
    edges, links, edge_df, link_df, areas = city
    pairs = demand.select_od_pairs(edge_df, link_df, areas, max_pairs=25)
    rows = [tuple(r) for r in pairs.orderBy("area_id", "od_idx").collect()]
    again = demand.select_od_pairs(edge_df.repartition(6), link_df.repartition(3), areas, max_pairs=25)
    assert rows == [tuple(r) for r in again.orderBy("area_id", "od_idx").collect()]
    centre = {e: ((g[0][0] + g[1][0]) / 2, (g[0][1] + g[1][1]) / 2) for a, e, g, *_ in edges}
    assert [r[1] for r in rows] == list(range(25))
    assert len({(r[2], r[3]) for r in rows}) == 25
    for area, _, o, d, distance, tier in rows:
        assert o != d and d in brute_reach(links, area, o)
        assert distance == pytest.approx(math.dist(centre[o], centre[d])) and distance >= 800 * 0.8**tier - 1e-6
    status = {r["area_id"]: (r["n_pairs"], r["status"]) for r in demand.od_status(pairs, areas, 25).collect()}
    assert status == {"A": (25, "ok"), "B": (0, "no_pairs")}


def brute_pairs(draws, links, min_distance, max_pairs):
    """One attempt after the other, as a plain loop."""
    reach, taken, failures, attempts, distance_needed = {}, [], 0, 0, min_distance
    while len(taken) < max_pairs and attempts <= max(100 * max_pairs, 10_000) and failures <= 10_000:
        if failures > 500 and failures % 500 == 0:
            distance_needed *= 0.8
        o, d, distance = draws[attempts]
        attempts += 1
        if o not in reach:
            reach[o] = brute_reach(links, "A", o)
        if distance >= distance_needed and (o, d) not in taken and d in reach[o]:
            taken.append((o, d))
            failures = 0
        else:
            failures += 1
    return taken


@pytest.mark.parametrize("min_distance, max_pairs", [(2600.0, 12), (800.0, 30)])
def test_od_pairs_equal_one_attempt_after_the_other(spark, city, min_distance, max_pairs):
    _, links, edge_df, link_df, _ = city
    areas = spark.createDataFrame([("A", min_distance)], "area_id string, min_distance double")
    budget = spark.createDataFrame([("A", demand.attempt_limit(max_pairs))], "area_id string, draws int")
    drawn = demand.draw_ends(demand.weighted_edges(edge_df), budget, "draws", 42).orderBy("draw").collect()
    want = brute_pairs([(r["origin"], r["destination"], r["distance"]) for r in drawn], links, min_distance, max_pairs)
    got = demand.select_od_pairs(edge_df, link_df, areas, max_pairs=max_pairs).orderBy("od_idx").collect()
    assert [(r["origin"], r["destination"]) for r in got] == want


def test_od_pairs_keep_the_distance_while_draws_qualify(spark):
    # A star of 100 edges of which two lie 5 km off: about 4 % of the draws are long enough.
    edges = [("A", f"e{i}", [(5000.0 * (i % 50 == 0), float(i)), (5001.0 * (i % 50 == 0), float(i))], 1, 10.0, 1) for i in range(100)]
    links = [link for i in range(1, 100) for link in (("A", "e0", f"e{i}"), ("A", f"e{i}", "e0"))]
    edge_df = spark.createDataFrame(edges, "area_id string, edge_id string, geometry array<struct<x:double,y:double>>, priority int, speed double, num_lanes int")
    link_df = spark.createDataFrame(links, "area_id string, from_edge string, to_edge string")
    areas = spark.createDataFrame([("A", 1000.0)], "area_id string, min_distance double")
    pairs = demand.select_od_pairs(edge_df, link_df, areas, max_pairs=15).collect()
    assert len(pairs) == 15 and all(r["distance"] >= 1000 and r["tier"] == 0 for r in pairs)


def test_draws_follow_the_weights(spark):
    edges = spark.createDataFrame(
        [("A", f"e{i}", [(0.0, float(i)), (1.0, float(i))], p, 10.0, 1) for i, p in enumerate((1, 1, 8))],
        "area_id string, edge_id string, geometry array<struct<x:double,y:double>>, priority int, speed double, num_lanes int",
    )
    areas = spark.createDataFrame([("A", 4000)], "area_id string, draws int")
    drawn = demand.draw_ends(demand.weighted_edges(edges), areas, "draws", 42)
    share = drawn.agg(F.avg((F.col("origin") == "e2").cast("double"))).first()[0]
    assert 0.77 < share < 0.83 and drawn.where("origin = destination").isEmpty()


POINT = "array<struct<x:double,y:double>>"


def test_cells_follow_the_length_of_a_piece(spark):
    line = spark.createDataFrame([("A", "d", [(0.0, 0.0), (100_000.0, 100_000.0)])], f"area_id string, edge_id string, geometry {POINT}")
    cells, crowded = matching.network_cells(line, 100.0)
    assert 1000 <= cells.count() <= 3200 and crowded.isEmpty()
    pieces = matching._flat_pieces(line, ["area_id", "edge_id"], "s")
    assert matching._in_cells(pieces, "s", 90.0, 100.0).count() < 8000


def test_matches_in_crowded_cells_equal_all_pairs(spark, monkeypatch):
    import math
    import random

    rnd = random.Random(4)

    def line(scale):
        x, y = rnd.uniform(-150, 350), rnd.uniform(-150, 350)
        return [(x, y), (x + rnd.uniform(-scale, scale), y + rnd.uniform(-scale, scale))]

    edges = [("A", f"e{i}", line(rnd.choice([0, 10, 300]))) for i in range(160)] + [("A", "v", [(50.0, -300.0), (50.0, 300.0)])]
    segments = [("A", f"s{i}", line(rnd.choice([0, 20, 400]))) for i in range(80)] + [("A", "none", None), ("A", "nan", [(None, 1.0), (2.0, 2.0)])]

    def distance(a, b):
        def to_piece(p, q1, q2):
            dx, dy = q2[0] - q1[0], q2[1] - q1[1]
            t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((p[0] - q1[0]) * dx + (p[1] - q1[1]) * dy) / (dx * dx + dy * dy)))
            return math.hypot(p[0] - q1[0] - t * dx, p[1] - q1[1] - t * dy)

        def side(p, q1, q2):
            return (q2[0] - q1[0]) * (p[1] - q1[1]) - (q2[1] - q1[1]) * (p[0] - q1[0])

        if side(a[0], *b) * side(a[1], *b) < 0 and side(b[0], *a) * side(b[1], *a) < 0:
            return 0.0
        return min(to_piece(a[0], *b), to_piece(a[1], *b), to_piece(b[0], *a), to_piece(b[1], *a))

    want = {}
    for _, s, g in segments[:80]:
        d, e = min((distance(g, h), e) for _, e, h in edges)
        if 1 - d / 100 >= 0.1:
            want[s] = (e, round(1 - d / 100, 6))
    frame = [spark.createDataFrame(r, f"area_id string, {n} string, geometry {POINT}") for r, n in ((segments, "segment_id"), (edges, "edge_id"))]
    for crowd in (256, 3):
        monkeypatch.setattr(matching, "CROWD", crowd)
        assert matching.network_cells(frame[1], 100.0)[1].isEmpty() == (crowd == 256)
        got = {r["segment_id"]: (r["edge_id"], round(r["match_confidence"], 6)) for r in matching.match_segments(*frame).collect()}
        assert got == want and len(want) > 50


@pytest.mark.parametrize("limit", [0, 60, 200_000])
def test_areas_of_any_size_are_searched_whole(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "LOCAL_ROWS", limit)
    rnd = random.Random(limit)
    links, pairs, edges, routes, parts = [], [], [], set(), {}
    for area, n in (("small", 8), ("large", 40), ("empty", 3)):
        names = [f"e{i}" for i in range(n)]
        ways = [(rnd.choice(names), rnd.choice(names)) for _ in range(0 if area == "empty" else n)] + [(names[0], "outside")]
        asked = [(a, b) for a in names for b in names if rnd.random() < 0.3 or a == b]
        links += [(area, a, b) for a, b in ways] * 2
        pairs += [(area, a, b) for a, b in asked]
        edges += [(area, a) for a in names]
        reach, around = {a: {a} for a in names}, {a: {a} for a in names}
        for _ in names:
            for a, b in ways:
                if b != "outside":
                    for seen in reach.values():
                        seen |= {b} if a in seen else set()
                    for seen in around.values():
                        seen |= {a, b} if seen & {a, b} else set()
        routes |= {(area, a, b) for a, b in asked if b in reach[a]}
        parts |= {(area, a): min(around[a]) for a in names}
    links = spark.createDataFrame(links + [(None, "e0", "e1"), ("small", None, "e1")], "area_id string, from_edge string, to_edge string")
    got = graph.reachable(spark.createDataFrame(pairs * 2, "area_id string, origin string, destination string"), links).collect()
    assert sorted(map(tuple, got)) == sorted(routes)
    got = graph.components(spark.createDataFrame(edges * 2, "area_id string, edge_id string"), links).collect()
    assert len(got) == len(parts) and {(r["area_id"], r["edge_id"]): r["component"] for r in got} == parts
    here = graph.large_areas(links, links, False).count()
    assert here == {0: 4, 60: 1, 200_000: 0}[limit]


def test_links_are_built_from_two_joins_that_hold_edges_only(spark):
    lanes = spark.createDataFrame([("A", 3, "road", 0, 0, "bus", "", 8.0, "0,0 1,1"), ("A", 3, "road", 1, 1, "", "", 9.0, "0,1 1,2")], LANE)
    links = matching.build_links(spark.createDataFrame([("A", "B", 1, 0), ("A", "B", 1, 1), ("A", "C", 0, 0)], CONNECTION), lanes)
    assert {tuple(r) for r in links.collect()} == {("A", "B")}
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and plan.count("rightHint=(strategy=shuffle_hash)") == 2


def test_routes_of_many_origins_follow_each_link_once():
    looked_up = [0]

    class Node(int):
        def __hash__(self):
            looked_up[0] += 1
            return int.__hash__(self)

    nodes = [Node(i) for i in range(400)]
    links = [(nodes[i], nodes[i + 1]) for i in range(399)] + [(nodes[i], nodes[i - 3]) for i in range(203, 400, 50)]
    rnd = random.Random(5)
    pairs = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(800)]
    found = set(graph.routed(links, pairs))
    assert looked_up[0] < 100 * (len(links) + len(pairs))
    back = {int(i): int(i) - 3 for i in range(203, 400, 50)}

    def leads(a, b):
        return b >= a or any(a <= i and back[i] <= b for i in back)

    assert found == {p for p in pairs if leads(int(p[0]), int(p[1]))}
