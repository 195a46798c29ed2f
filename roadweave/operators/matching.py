"""Road network from lanes and connections, and the nearest-edge join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions import geo, observe

INTERNAL = ":"
#: Edge pieces of a cell beyond which it is halved, again and again; at most so often.
CROWD = 256
MOST_HALVINGS = 5


def build_edges(lanes: DataFrame, vclass: str = "passenger") -> DataFrame:
    """One row per edge: the first allowed lane in file order gives shape and speed."""
    keys = [c for c in ("area_id",) if c in lanes.columns]
    allowed = observe.vclass_allowed(F.col("allow"), F.col("disallow"), vclass)
    lane = F.struct("speed", "shape", "priority", "type")
    built = (
        lanes.withColumn("_ok", allowed & F.col("lane_index").isNotNull())
        .groupBy(*keys, "edge_id")
        .agg(
            F.min_by(lane, F.col("lane_pos")).alias("_any"),
            F.min_by(F.when(F.col("_ok"), lane), F.when(F.col("_ok"), F.col("lane_pos"))).alias("_lane"),
            F.count(F.lit(1)).cast("int").alias("num_lanes"),
            F.bool_or("_ok").alias("_drivable"),
        )
    )
    return built.where("_drivable").select(
        *keys,
        "edge_id",
        observe.parse_shape(F.col("_lane.shape")).alias("geometry"),
        F.coalesce(F.col("_lane.speed"), F.lit(observe.DEFAULT_LANE_SPEED)).alias("speed"),
        F.coalesce(F.col("_any.priority"), F.lit(-1)).alias("priority"),
        "num_lanes",
        F.coalesce(F.col("_any.type"), F.lit("")).alias("type"),
    ).where("geometry is not null")


def lane_permissions(lanes: DataFrame, vclass: str = "passenger") -> DataFrame:
    keys = [c for c in ("area_id",) if c in lanes.columns]
    return lanes.where("lane_index is not null").select(
        *keys, "edge_id", "lane_index",
        observe.vclass_allowed(F.col("allow"), F.col("disallow"), vclass).alias("ok"),
    )


def build_links(connections: DataFrame, lanes: DataFrame, vclass: str = "passenger") -> DataFrame:
    """Distinct edge pairs whose two lanes may be used; edges absent from the lane table do not block."""
    keys = [c for c in ("area_id",) if c in lanes.columns]
    permitted = lane_permissions(lanes, vclass)
    # One row an edge: the lanes of it that may be used, none for a known edge that is closed.
    open_lanes = permitted.groupBy(*keys, "edge_id").agg(F.collect_set(F.when(F.col("ok"), F.col("lane_index"))).alias("open"))
    outer = connections.where(
        F.col("from_edge").isNotNull() & F.col("to_edge").isNotNull()
        & (F.col("from_edge") != "") & (F.col("to_edge") != "")
        & ~F.col("from_edge").startswith(INTERNAL) & ~F.col("to_edge").startswith(INTERNAL)
    )
    # Both lane numbers must be readable for a lane check to apply.
    readable = F.col("from_lane").isNotNull() & F.col("to_lane").isNotNull()
    checked = outer
    for side in ("from", "to"):
        # Built from the edges, never from the connections, which only stream by.
        known = open_lanes.select(*keys, F.col("edge_id").alias(f"{side}_edge"), F.col("open").alias("_open")).hint("shuffle_hash")
        blocked = readable & F.col("_open").isNotNull() & ~F.array_contains("_open", F.col(f"{side}_lane"))
        checked = checked.join(known, [*keys, f"{side}_edge"], "left").where(~F.coalesce(blocked, F.lit(False))).drop("_open")
    # Equal pairs are rare among the rows a task reads, so they meet before any of them is held.
    pair = [*keys, "from_edge", "to_edge"]
    return checked.select(*pair).repartition(*pair).distinct()


def _cells(low, high, size: float):
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _flat_pieces(shapes: DataFrame, keep: list[str], side: str) -> DataFrame:
    """One row per piece with its ends, its direction and the inverse of its squared length (0 for a point)."""
    return _named_pieces(shapes.select(*keep, F.explode(geo.line_pieces(F.col("geometry"))).alias("_p")), keep, side)


def _named_pieces(pieces: DataFrame, keep: list[str], side: str) -> DataFrame:
    named = pieces.select(*keep, *[F.col(f"_p.{c}").alias(f"{side}{c}") for c in ("x1", "y1", "x2", "y2")])
    dx, dy = F.col(f"{side}x2") - F.col(f"{side}x1"), F.col(f"{side}y2") - F.col(f"{side}y1")
    return named.withColumns({f"{side}dx": dx, f"{side}dy": dy}).withColumn(
        f"{side}inv", F.coalesce(F.try_divide(F.lit(1.0), F.col(f"{side}dx") ** 2 + F.col(f"{side}dy") ** 2), F.lit(0.0))
    )


def _rows_touched(pieces: DataFrame, side: str, reach: float, size, column: str, low=None, high=None) -> DataFrame:
    """Adds ``cell_y`` or ``fine_y``: the rows of a column of cells that the piece comes within ``reach`` of.

    The piece is cut to the strip around the column; only what remains of it counts.
    """
    c = F.col
    x1, y1, dx, dy = (c(f"{side}{n}") for n in ("x1", "y1", "dx", "dy"))
    left, right = c(column) * size - reach, (c(column) + 1) * size + reach
    # Where the piece enters and leaves the strip, as a share of its length; a vertical piece never leaves.
    ta, tb = F.try_divide(left - x1, dx), F.try_divide(right - x1, dx)
    enter = F.when(dx == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(ta, tb))))
    leave = F.when(dx == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(ta, tb))))
    cut = pieces.withColumns({"_ya": y1 + enter * dy, "_yb": y1 + leave * dy})
    first, last = F.floor((F.least("_ya", "_yb") - reach) / size), F.floor((F.greatest("_ya", "_yb") + reach) / size)
    if low is not None:
        first, last = F.greatest(first, low), F.least(last, high)
    rows = F.when(first <= last, F.sequence(first, last))
    return cut.select("*", F.explode_outer(rows).alias(column[:-1] + "y")).drop("_ya", "_yb")


def _in_cells(pieces: DataFrame, side: str, reach: float, size: float) -> DataFrame:
    """Copy every piece to the grid cells that it comes within ``reach`` of; a piece without coordinates stays, without a cell.

    The number of cells follows the length of a piece, not the area of its bounds.
    """
    one, two = F.col(f"{side}x1"), F.col(f"{side}x2")
    known = F.expr(f"coalesce({side}x1 + {side}y1 + {side}dx + {side}dy, double('NaN'))")
    columns = F.when(~F.isnan(known), _cells(F.least(one, two) - reach, F.greatest(one, two) + reach, size))
    return _rows_touched(pieces.select("*", F.explode_outer(columns).alias("cell_x")), side, reach, F.lit(size), "cell_x")


def _crowded(edge_cells: DataFrame) -> DataFrame:
    """Cells with many pieces and the number of halvings that leaves about ``CROWD`` pieces in each part."""
    counts = edge_cells.groupBy("area_id", "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD)
    halvings = F.least(F.lit(MOST_HALVINGS), F.ceil(F.log(F.col("_n") / CROWD) / F.log(F.lit(4.0)))).cast("int")
    return counts.select("area_id", "cell_x", "cell_y", halvings.alias("_halvings"))


def _divided(in_cells: DataFrame, crowded: DataFrame, side: str, reach: float, size: float) -> DataFrame:
    """Split crowded cells: adds ``fine_x`` and ``fine_y`` within a cell, (0, 0) in a cell that is whole."""
    joined = in_cells.join(crowded, ["area_id", "cell_x", "cell_y"], "left")
    parts = F.expr("shiftleft(1, coalesce(_halvings, 0))")
    fine = F.lit(size) / parts
    one, two = F.col(f"{side}x1"), F.col(f"{side}x2")
    first = F.greatest(F.floor((F.least(one, two) - reach) / fine), F.col("cell_x") * parts)
    last = F.least(F.floor((F.greatest(one, two) + reach) / fine), (F.col("cell_x") + 1) * parts - 1)
    columns = joined.withColumns({"_parts": parts, "_fine": fine}).select(
        "*", F.explode_outer(F.when(first <= last, F.sequence(first, last))).alias("fine_x")
    )
    rows = _rows_touched(
        columns, side, reach, F.col("_fine"), "fine_x", F.col("cell_y") * F.col("_parts"), (F.col("cell_y") + 1) * F.col("_parts") - 1
    )
    return rows.drop("_halvings", "_parts", "_fine")


CELL = ("area_id", "cell_x", "cell_y", "fine_x", "fine_y")


def network_cells(edges: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Edge pieces in the cells that they cross, and the crowded cells. Equal pieces compete as their smallest edge id."""
    ends = ["ex1", "ey1", "ex2", "ey2"]
    pieces = (
        _flat_pieces(edges.where(F.size("geometry") >= 2), ["area_id", "edge_id"], "e")
        .groupBy("area_id", *ends, "edx", "edy", "einv")
        .agg(F.min("edge_id").alias("edge_id"))
    )
    # A hair of reach, so that rounding at a cell border loses nothing.
    hair = size * 1e-7
    in_cells = _in_cells(pieces, "e", hair, size).where("cell_y is not null")
    crowded = _crowded(in_cells)
    return _divided(in_cells, crowded, "e", hair, size).where("fine_y is not null"), crowded


def _piece_distance(pairs: DataFrame) -> DataFrame:
    """Adds ``distance`` between the pieces of sides ``s`` and ``e``.

    Built column by column, so that each step compiles to a small method of its own.
    """
    c = F.col
    ends = [("s", 1, "e"), ("s", 2, "e"), ("e", 1, "s"), ("e", 2, "s")]
    for p, end, q in ends:
        along = (c(f"{p}x{end}") - c(f"{q}x1")) * c(f"{q}dx") + (c(f"{p}y{end}") - c(f"{q}y1")) * c(f"{q}dy")
        pairs = pairs.withColumn(f"_t{p}{end}", F.greatest(F.lit(0.0), F.least(F.lit(1.0), along * c(f"{q}inv"))))
    offsets = {}
    for p, end, q in ends:
        for axis in ("x", "y"):
            foot = c(f"{q}{axis}1") + c(f"_t{p}{end}") * c(f"{q}d{axis}")
            offsets[f"_{axis}{p}{end}"] = c(f"{p}{axis}{end}") - foot
    pairs = pairs.withColumns(offsets)
    squares = [c(f"_x{p}{end}") * c(f"_x{p}{end}") + c(f"_y{p}{end}") * c(f"_y{p}{end}") for p, end, _ in ends]
    sides = {
        f"_side{p}{end}": c(f"{q}dx") * (c(f"{p}y{end}") - c(f"{q}y1")) - c(f"{q}dy") * (c(f"{p}x{end}") - c(f"{q}x1"))
        for p, end, q in ends
    }
    pairs = pairs.withColumns({**sides, "_near": F.least(*squares)})
    crossing = (c("_sides1") * c("_sides2") < 0) & (c("_sidee1") * c("_sidee2") < 0)
    return pairs.withColumn("distance", F.when(crossing, 0.0).otherwise(F.sqrt("_near")))


def search_reach(max_distance: float, min_confidence: float) -> float:
    return max_distance * (1.0 - min_confidence) * (1.0 + 1e-9)


def geometry_key():
    return F.unhex(F.sha1(F.to_json("geometry")))


def candidate_edges(segments: DataFrame, edges: DataFrame, keep: list[str], max_distance: float, min_confidence: float) -> DataFrame:
    """(keep, first, distance, edge_id): every edge piece near a piece of a segment, without any grouping.

    ``first`` marks one row of every segment, whether anything is near or not, so that rows of it can be counted. Works on
    a stream of segments too.
    """
    reach = search_reach(max_distance, min_confidence)
    edge_cells, crowded = network_cells(edges, max_distance)
    pieces = F.coalesce(geo.line_pieces(F.col("geometry")), F.array())
    nothing = F.array(F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"))
    exploded = segments.select(*keep, F.posexplode(F.concat(nothing, pieces)).alias("_i", "_p"))
    flat = _named_pieces(exploded, [*keep, "_i"], "s")
    placed = _divided(_in_cells(flat, "s", reach, max_distance), crowded, "s", reach, max_distance)
    pairs = _piece_distance(placed.join(edge_cells, list(CELL), "left"))
    near = F.when(F.col("distance") <= max_distance, F.col("distance"))
    return pairs.select(*keep, (F.col("_i") == 0).alias("first"), near.alias("distance"), "edge_id")


def match_segments(
    segments: DataFrame, edges: DataFrame, max_distance: float = 100.0, min_confidence: float = 0.1
) -> DataFrame:
    """Nearest edge of every segment within reach; ties go to the smallest edge id.

    Both sides hold planar ``geometry`` (x, y points) and an ``area_id``. Copies collapse first: a geometry
    seen in many snapshots is matched once and edges with equal pieces compete as their smallest id. The
    candidates then meet on grid cells, crowded ones split, and the nearest one is a mergeable minimum, so nothing is ranked
    or collected per segment. Only the reach that can still give ``min_confidence`` is searched.
    """
    reach = search_reach(max_distance, min_confidence)
    usable = segments.where(F.size("geometry") >= 2).withColumn("_gkey", geometry_key())
    shapes = usable.groupBy("area_id", "_gkey").agg(F.first("geometry").alias("geometry"))
    edge_cells, crowded = network_cells(edges, max_distance)
    seg_cells = _in_cells(_flat_pieces(shapes, ["area_id", "_gkey"], "s"), "s", reach, max_distance)
    fine_cells = _divided(seg_cells, crowded, "s", reach, max_distance)
    candidates = _piece_distance(fine_cells.join(edge_cells, list(CELL)))
    nearest = (
        candidates.groupBy("area_id", "_gkey")
        .agg(F.min(F.when(F.col("distance") <= max_distance, F.struct("distance", "edge_id"))).alias("hit"))
        .select(
            "area_id", "_gkey", F.col("hit.edge_id").alias("edge_id"),
            observe.match_confidence(F.col("hit.distance"), max_distance).alias("match_confidence"),
        )
        .where(F.col("match_confidence") >= min_confidence)
    )
    rest = [c for c in segments.columns if c not in ("area_id", "geometry")]
    return usable.join(nearest, ["area_id", "_gkey"]).select("area_id", "edge_id", *rest, "match_confidence")


def project_segments(segments: DataFrame, locations: DataFrame) -> DataFrame:
    """Longitude/latitude geometry to network x, y. ``locations``: area_id, zone, south, x_off, y_off."""
    joined = segments.join(locations, "area_id")
    geometry = F.transform(
        "geometry",
        lambda p: geo.to_network_xy(p["lon"], p["lat"], F.col("zone"), F.col("south"), F.col("x_off"), F.col("y_off")),
    )
    return joined.where("zone is not null").withColumn("geometry", geometry).drop("zone", "south", "x_off", "y_off")


def network_locations(net_location: DataFrame, areas: DataFrame) -> DataFrame:
    """Zone and offset per area: from the projection text if it names a UTM zone, from the box if there is none.

    An area whose network names another kind of projection gets a null zone and is not matched.
    """
    named = geo.projection_zone(F.col("proj"))
    lon, lat = (F.col("west") + F.col("east")) / 2, (F.col("south_lat") + F.col("north")) / 2
    boxes = areas.select("area_id", "west", F.col("south").alias("south_lat"), "east", "north")
    joined = boxes.join(net_location, "area_id", "left")
    absent = F.col("proj").isNull()
    return joined.select(
        "area_id",
        F.when(absent, geo.utm_zone(lon)).otherwise(named["zone"]).alias("zone"),
        F.when(absent, lat < 0).otherwise(named["south"]).alias("south"),
        F.coalesce("x_off", F.lit(0.0)).alias("x_off"),
        F.coalesce("y_off", F.lit(0.0)).alias("y_off"),
    )


def observed_ids(observed: DataFrame) -> DataFrame:
    return observed.select("area_id", "edge_id").dropna().distinct()


def flag_observed(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """Network edges with a flag for observed ones."""
    flagged = observed_ids(observed).withColumn("observed", F.lit(True))
    return edges.join(flagged, ["area_id", "edge_id"], "left").withColumn(
        "observed", F.coalesce("observed", F.lit(False))
    )


def overlay_counts(flagged: DataFrame, observed: DataFrame) -> DataFrame:
    """Plotted (found in the network) against all distinct observed ids per area."""
    total = observed_ids(observed).groupBy("area_id").agg(F.count(F.lit(1)).alias("observed_total"))
    plotted = flagged.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if("observed").alias("observed_plotted")
    )
    return plotted.join(total, "area_id", "left").fillna(0, ["observed_total"])
