"""Origin-destination pairs, departure bins, genomes and the trips they expand to."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.functions import geo, keys as K, observe
from roadweave.operators.graph import reachable
from roadweave.operators.ordering import explode_range, number_rows, running_sum
from roadweave.session import cut, pickle_by_value

pickle_by_value(__name__)

WEIGHT_SCALE = 1000
WEIGHT_BUCKETS = 256
# The minimum distance shrinks by 0.8 after 1000 failures in a row and after every 500 more; a search ends
# after 10 000 failures in a row, or after 100 attempts per wanted pair, 10 000 at least.
RELAXATION = 0.8
RELAX_AFTER = 1000
RELAX_EVERY = 500
MAX_FAILURES = 10_000
ATTEMPTS_PER_PAIR = 100
LEAST_ATTEMPTS = 10_000
# Draws per wanted pair in the first round, and how much each further round draws more. The result does not depend on them.
FIRST_ATTEMPTS = 16
ATTEMPTS_GROWTH = 8
GENE_SLICE = 1024


def weighted_edges(edges: DataFrame, buckets: int = WEIGHT_BUCKETS) -> DataFrame:
    """Edges with their integer selection weight and centroid; give large areas more ``buckets``."""
    weight = observe.edge_weight(F.col("priority"), F.col("speed"), F.col("num_lanes"))
    return edges.select(
        "area_id",
        "edge_id",
        F.round(weight * WEIGHT_SCALE).cast("bigint").alias("weight"),
        geo.line_centroid(F.col("geometry")).alias("centroid"),
        F.pmod(F.xxhash64("edge_id"), F.lit(buckets)).cast("int").alias("bucket"),
    )


def draw_ends(weighted: DataFrame, areas: DataFrame, draws: str, seed: int) -> DataFrame:
    """``draws`` weighted picks of two different edges per area (area_id, draw, origin, destination, distance).

    Integer cumulative weights make the picks independent of partitioning. Edges are hashed into a fixed number of
    buckets: a pick first finds its bucket in the short per-area table, then its edge among the bucket's edges. The
    second pick draws from the weight that is left and steps over the interval of the first one.
    """
    within = W.partitionBy("area_id", "bucket").orderBy("edge_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    cumulative = weighted.withColumn("hi", F.sum("weight").over(within)).select(
        "area_id", "bucket", "edge_id", "centroid", "weight", (F.col("hi") - F.col("weight")).alias("lo"), "hi"
    )
    per_bucket = weighted.groupBy("area_id", "bucket").agg(F.sum("weight").alias("weight"))
    # One row per bucket of an area.
    upto = W.partitionBy("area_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    bounds = per_bucket.withColumn("hi", F.sum("weight").over(upto))
    table = bounds.groupBy("area_id").agg(
        F.array_sort(F.collect_list(F.struct("hi", "bucket", "weight"))).alias("table"), F.max("hi").alias("total")
    )

    def find(aimed: DataFrame, keep: list[str]) -> DataFrame:
        """The edge whose interval holds ``_x``; adds edge_id, centroid, weight and the start of the interval."""
        hit = F.try_element_at(F.filter("table", lambda t: t["hi"] > F.col("_x")), F.lit(1))
        placed = aimed.join(table.select("area_id", "table"), "area_id").withColumn("_hit", hit)
        start = F.col("_hit.hi") - F.col("_hit.weight")
        local = placed.select(*keep, F.col("_hit.bucket").alias("bucket"), start.alias("_start"), (F.col("_x") - start).alias("_x"))
        met = local.join(cumulative, ["area_id", "bucket"]).where((F.col("_x") >= F.col("lo")) & (F.col("_x") < F.col("hi")))
        return met.select(*keep, "edge_id", "centroid", "weight", (F.col("_start") + F.col("lo")).alias("start"))

    slots = explode_range(areas.select("area_id", F.col(draws).alias("_draws")), "_draws", "draw").select("area_id", "draw")
    totals = table.select("area_id", "total")
    first = slots.join(totals, "area_id").withColumn(
        "_x", K.uniform_int(F.col("total"), seed, "area_id", "draw", F.lit("origin"))
    )
    origins = find(first, ["area_id", "draw", "total"]).select(
        "area_id", "draw", F.col("edge_id").alias("origin"), F.col("centroid").alias("o"), "start", "weight",
        (F.col("total") - F.col("weight")).alias("_left"),
    )
    rest = K.uniform_int(F.col("_left"), seed, "area_id", "draw", F.lit("destination"))
    second = (
        origins.where("_left > 0")
        .withColumn("_y", rest)
        .withColumn("_x", F.when(F.col("_y") < F.col("start"), F.col("_y")).otherwise(F.col("_y") + F.col("weight")))
        .select("area_id", "draw", "origin", "o", "_x")
    )
    return find(second, ["area_id", "draw", "origin", "o"]).select(
        "area_id", "draw", "origin", F.col("edge_id").alias("destination"),
        F.hypot(F.col("centroid.x") - F.col("o.x"), F.col("centroid.y") - F.col("o.y")).alias("distance"),
    )


def attempt_limit(max_pairs: int) -> int:
    """Attempts after which the search of an area ends in any case."""
    return max(ATTEMPTS_PER_PAIR * max_pairs, LEAST_ATTEMPTS) + 1


def relaxations(failures: int) -> int:
    """How often a run of failures has relaxed the distance."""
    return 0 if failures < RELAX_AFTER else (failures - RELAX_AFTER) // RELAX_EVERY + 1


def _accept(tries: pd.DataFrame, max_pairs: int, max_failures: int) -> pd.DataFrame:
    """The attempts of one area that yield a pair. Attempts that never can are left out: gaps between draws count as failures."""
    tier, last, seen, taken = 0, 0, set(), []
    ordered = tries.sort_values("draw", ignore_index=True)
    for at, (draw, origin, destination, need) in enumerate(
        ordered[["draw", "origin", "destination", "tier"]].itertuples(index=False, name=None)
    ):
        failures = draw - 1 - last
        if len(taken) == max_pairs or failures > max_failures:
            break
        reached = tier + relaxations(failures)
        if need <= reached and (origin, destination) not in seen:
            seen.add((origin, destination))
            taken.append(at)
            tier, last = reached, draw
    return ordered.iloc[taken].assign(od_idx=range(len(taken)))


def od_candidates(candidates: DataFrame, areas: DataFrame, links: DataFrame) -> DataFrame:
    """The candidates (area_id, origin, destination, distance) that are far enough apart for their area and have a route.

    ``areas``: area_id and min_distance; an area without a positive minimum takes any distance, an unknown distance
    is too short elsewhere. Only pairs that pass the cheap test of distance are looked up in the network.
    """
    wanted = F.coalesce("min_distance", F.lit(0.0))
    far = candidates.join(areas.select("area_id", "min_distance"), "area_id").where(
        (wanted <= 0) | (F.col("distance") >= wanted)
    ).drop("min_distance")
    return routable(far, links)


def routable(candidates: DataFrame, links: DataFrame) -> DataFrame:
    ends = ["area_id", "origin", "destination"]
    return candidates.join(reachable(candidates.select(*ends), links), ends, "left_semi")


def _attempts(
    weighted: DataFrame, links: DataFrame, areas: DataFrame, max_pairs: int, seed: int, attempts: int, max_failures: int
) -> DataFrame:
    """Pairs that the first ``attempts`` draws of every area yield; an area's group holds ``attempts`` rows at most."""
    drawn = draw_ends(weighted, areas.select("area_id", F.lit(attempts).alias("draws")), "draws", seed)
    factors = [1.0]
    while len(factors) <= relaxations(attempts - 1):
        factors.append(factors[-1] * RELAXATION)
    wanted = F.coalesce("min_distance", F.lit(0.0))
    short = F.filter(F.array(*map(F.lit, factors)), lambda f: F.col("distance") < F.col("min_distance") * f)
    free = wanted <= 0
    tries = cut(
        drawn.join(areas, "area_id")
        .where(free | F.col("distance").isNotNull())
        .withColumn("tier", F.when(free, F.lit(0)).otherwise(F.size(short)))
        .where(F.col("tier") < len(factors))
        .select("area_id", "draw", "origin", "destination", "distance", "tier")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tries.schema) + ", od_idx int"
    return cut(routable(tries, links).groupBy("area_id").applyInPandas(lambda t: _accept(t, max_pairs, max_failures), schema))


def select_od_pairs(
    edges: DataFrame, links: DataFrame, areas: DataFrame, max_pairs: int = 50, seed: int = 42,
    max_failures: int = MAX_FAILURES, weight_buckets: int = WEIGHT_BUCKETS,
) -> DataFrame:
    """Weighted, distance-checked, unique, reachable pairs, at most ``max_pairs`` per area, in the order of their draws.

    ``areas``: area_id and min_distance. An attempt fails if its pair is too short, known or not routable; long runs of
    failures relax the distance of the area for good. ``tier`` is the number of relaxations a pair needs. Areas start
    with few draws; those that are full leave, the others go on with more draws of the same sequence up to the limit.
    """
    weighted = cut(weighted_edges(edges, weight_buckets))
    limit = attempt_limit(max_pairs)
    attempts, left, results = min(limit, FIRST_ATTEMPTS * max_pairs), areas.select("area_id", "min_distance"), []
    while True:
        found = _attempts(weighted, links, left, max_pairs, seed, attempts, max_failures)
        if attempts == limit:
            results.append(found)
            break
        ended = (F.count(F.lit(1)) >= max_pairs) | (F.lit(attempts) - F.max("draw") > max_failures)
        over = found.groupBy("area_id").agg(ended.alias("over")).where("over").select("area_id")
        results.append(found.join(over, "area_id", "left_semi"))
        left = cut(left.join(over, "area_id", "left_anti"))
        if left.isEmpty():
            break
        weighted = cut(weighted.join(left, "area_id", "left_semi"))
        links = cut(links.join(left, "area_id", "left_semi"))
        attempts = min(limit, attempts * ATTEMPTS_GROWTH)
    return reduce(DataFrame.unionByName, results).select("area_id", "od_idx", "origin", "destination", "distance", "tier")


def od_status(pairs: DataFrame, areas: DataFrame, max_pairs: int) -> DataFrame:
    """Per area ``ok``, ``short`` or ``no_pairs``."""
    counted = pairs.groupBy("area_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    n = F.coalesce("n_pairs", F.lit(0).cast("bigint"))
    return areas.select("area_id").join(counted, "area_id", "left").select(
        "area_id", n.alias("n_pairs"),
        F.when(n == 0, "no_pairs").when(n < max_pairs, "short").otherwise("ok").alias("status"),
    )


def od_endpoints(pairs: DataFrame) -> DataFrame:
    """Distinct origins and destinations in long form (area_id, role, edge_id)."""
    return pairs.select("area_id", F.lit("origin").alias("role"), F.col("origin").alias("edge_id")).union(
        pairs.select("area_id", F.lit("destination"), F.col("destination"))
    ).distinct()


def departure_bins(areas: DataFrame) -> DataFrame:
    """Bins over warm-up and window. ``areas``: area_id, warmup_minutes, window_minutes, bin_minutes."""
    total = ((F.col("warmup_minutes") + F.col("window_minutes")) * 60).cast("int")
    width = F.greatest(F.lit(1), (F.col("bin_minutes") * 60).cast("int"))
    n = F.greatest(F.lit(1), F.bround(total / width, 0).cast("int"))
    sized = areas.select("area_id", total.alias("_total"), width.alias("_width"), n.alias("n_bins"))
    return sized.select(
        "area_id", "n_bins", "_total", "_width", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin_idx")
    ).select(
        "area_id",
        "bin_idx",
        (F.col("bin_idx") * F.col("_width")).alias("start_s"),
        F.when(F.col("bin_idx") == F.col("n_bins") - 1, F.col("_total"))
        .otherwise((F.col("bin_idx") + 1) * F.col("_width"))
        .alias("end_s"),
        "n_bins",
    )


def init_bounds(areas: DataFrame) -> DataFrame:
    """Gene bounds and activation probability. ``areas``: area_id, initial_population, genome_size."""
    avg = F.col("initial_population") / F.greatest(F.lit(1), F.col("genome_size"))
    upper = F.greatest(F.lit(1), (F.col("avg_per_gene") * 2).cast("int"))
    active = F.col("upper_bound") / 2.0
    probability = F.least(F.lit(1.0), F.greatest(F.lit(0.001), F.col("avg_per_gene") / F.greatest(F.lit(0.1), active)))
    return (
        areas.withColumn("avg_per_gene", avg)
        .withColumn("lower_bound", F.lit(0))
        .withColumn("upper_bound", upper)
        .withColumn("activation", F.when(F.col("avg_per_gene") < active, probability))
    )


def explode_genome(genomes: DataFrame, n_bins: str | int) -> DataFrame:
    """Gene arrays to (gene_idx, od_idx, bin_idx, value); genes are od-major, a null is a place without a gene."""
    bins = F.col(n_bins) if isinstance(n_bins, str) else F.lit(n_bins)
    rest = [c for c in genomes.columns if c != "genes"]
    return genomes.select("*", F.posexplode("genes").alias("gene_idx", "value")).where("value is not null").select(
        *rest, "gene_idx", F.floor(F.col("gene_idx") / bins).cast("int").alias("od_idx"),
        (F.col("gene_idx") % bins).cast("int").alias("bin_idx"), "value",
    )


def collapse_genome(genes: DataFrame, n_od: int, n_bins: int) -> DataFrame:
    """Long genes to one array per scenario; ``complete`` says that every (od, bin) is there once.

    A gene stands at the place of its (od, bin), and the place of a missing one is null.
    The array length is fixed by the parameters, so one scenario is always small.
    """
    size = n_od * n_bins
    idx = F.col("od_idx") * n_bins + F.col("bin_idx")
    per_gene = genes.groupBy("scenario_id", idx.alias("_i")).agg(
        F.sum("value").alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    grouped = per_gene.where((F.col("_i") >= 0) & (F.col("_i") < size)).groupBy("scenario_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_genes"), F.max("_n").alias("_most")
    )
    return grouped.select(
        "scenario_id",
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("_genes", i)).alias("genes"),
        ((F.size("_genes") == size) & (F.col("_most") == 1)).alias("complete"),
    )


def expand_trips(
    genes: DataFrame, od_pairs: DataFrame, bins: DataFrame, n_bins: int, id_style: str = "trip", chunk: int = 4096
) -> DataFrame:
    """One row per trip: id, origin, destination, departure.

    ``genes``: scenario_id, area_id, od_idx, bin_idx, value. Ids run od-major, then bin, then departure. The first id
    of every gene comes from a two-level running sum, and rows multiply only at the very end, in chunks.
    """
    gene_idx = F.col("od_idx") * n_bins + F.col("bin_idx")
    counted = (
        genes.withColumn("n", observe.gene_to_count(F.col("value")).cast("bigint"))
        .withColumn("gene_idx", gene_idx)
        .where("n > 0")
        .select("scenario_id", "area_id", "od_idx", "bin_idx", "gene_idx", "n")
    )
    slices = F.floor(F.col("gene_idx") / GENE_SLICE)
    numbered = running_sum(counted, ["scenario_id"], slices, ["gene_idx"], "n", "first_id")
    placed = numbered.join(od_pairs.select("area_id", "od_idx", "origin", "destination"), ["area_id", "od_idx"]).join(
        bins.select("area_id", "bin_idx", "start_s", "end_s"), ["area_id", "bin_idx"]
    )
    trips = explode_range(placed, "n", "k", chunk)
    number = F.col("first_id") + F.col("k") - 1
    if id_style == "trip":
        trip_id = F.concat(F.lit("trip_"), number.cast("string"))
    else:
        trip_id = F.concat_ws("_", F.lit("t"), "od_idx", "bin_idx", number.cast("string"))
    return trips.select(
        "scenario_id",
        trip_id.alias("trip_id"),
        "origin",
        "destination",
        observe.departure_time(F.col("start_s"), F.col("end_s"), F.col("n"), F.col("k")).alias("departure"),
    )


def order_trips(trips: DataFrame) -> DataFrame:
    """Departure, origin, destination, id (as text) within a scenario; a range sort, so one scenario may span tasks."""
    return trips.orderBy("scenario_id", "departure", "origin", "destination", "trip_id")


def index_agents(trips: DataFrame) -> DataFrame:
    """Trips to agents with dense indexes over the sorted origins and destinations of their run."""
    indexed = trips
    for end in ("origin", "destination"):
        ids = number_rows(trips.select("run_id", end).distinct(), ["run_id"], [end], f"{end}_idx")
        indexed = indexed.join(ids, ["run_id", end])
    return indexed.select(
        "run_id",
        F.col("trip_id").alias("id"),
        F.col("origin_idx").alias("origin"),
        F.col("destination_idx").alias("destination"),
        F.col("departure").cast("int").alias("start_time"),
        F.lit("Human").alias("kind"),
    )


def od_dictionary(trips: DataFrame) -> DataFrame:
    """Sorted distinct ends per run with their index, in long form (run_id, role, idx, edge_id)."""
    parts = []
    for role, end in (("origins", "origin"), ("destinations", "destination")):
        ids = trips.select("run_id", F.col(end).alias("edge_id")).distinct()
        parts.append(
            number_rows(ids, ["run_id"], ["edge_id"], "idx").select("run_id", F.lit(role).alias("role"), "idx", "edge_id")
        )
    return parts[0].unionByName(parts[1])
