"""Reachability, components and degrees of the directed edge-to-edge graph, as iterated joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadweave.session import Scratch, cut, pickle_by_value


def neighbors(links: DataFrame) -> DataFrame:
    """Out-degree and in-degree per node."""
    pairs = links.select("area_id", "from_edge", "to_edge").distinct()
    ends = pairs.select("area_id", F.col("from_edge").alias("edge_id"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
        pairs.select("area_id", F.col("to_edge"), F.lit(0), F.lit(1))
    )
    return ends.groupBy("area_id", "edge_id").agg(F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"))


def neighbor_lists(links: DataFrame) -> DataFrame:
    """Distinct neighbours of every node in long form with the node's degree: no array per node is built."""
    pairs = links.select("area_id", "from_edge", "to_edge").distinct()
    degree = pairs.groupBy("area_id", "from_edge").agg(F.count(F.lit(1)).alias("degree"))
    return pairs.join(degree, ["area_id", "from_edge"])


def spread(seeds: DataFrame, links: DataFrame, keys: list[str], max_hops: int | None = None) -> DataFrame:
    """All (keys, node) that the seeds (keys, node) reach along ``links`` (area_id, from_edge, to_edge).

    ``keys`` starts with area_id. Each round joins only the newest nodes and is written to the shared folder.
    """
    steps = links.select("area_id", F.col("from_edge").alias("node"), F.col("to_edge").alias("next"))
    frontier = cut(seeds.select(*keys, "node").distinct())
    visited = frontier
    hop = 0
    while not frontier.isEmpty() and (max_hops is None or hop < max_hops):
        reached = frontier.join(steps, ["area_id", "node"]).select(*keys, F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(visited, [*keys, "node"], "left_anti"))
        visited = visited.unionByName(frontier)
        hop += 1
        if hop % 8 == 0:
            visited = cut(visited)
    return visited


SHORTCUT_GROWTH = 6
SHORTCUT_ROUNDS = 2


def shortcuts(links: DataFrame, growth: int = SHORTCUT_GROWTH, rounds: int = SHORTCUT_ROUNDS) -> DataFrame:
    """Links plus the pairs two, four, eight ... hops apart, as long as the table stays below ``growth`` times its size.

    What is reachable does not change, but each round of a traversal gets that much further.
    """
    limit = links.count() * growth
    for _ in range(rounds):
        onward = links.select("area_id", F.col("from_edge").alias("to_edge"), F.col("to_edge").alias("far"))
        # The exact number of joined rows is known from the degrees before any of them is built.
        out = links.groupBy("area_id", F.col("from_edge").alias("node")).agg(F.count(F.lit(1)).alias("o"))
        into = links.groupBy("area_id", F.col("to_edge").alias("node")).agg(F.count(F.lit(1)).alias("i"))
        paths = out.join(into, ["area_id", "node"]).agg(F.sum(F.col("o").cast("double") * F.col("i"))).first()[0] or 0
        if paths == 0 or paths > limit:
            break
        longer = links.join(onward, ["area_id", "to_edge"]).select("area_id", "from_edge", F.col("far").alias("to_edge"))
        grown = cut(links.unionByName(longer).distinct())
        size = grown.count()
        if size > limit:
            break
        done = size == links.count()
        links = grown
        if done:
            break
    return links


# An area is searched in one task if it has at most so many rows, and its rows times its seeds are at most so many steps.
LOCAL_ROWS = 200_000
LOCAL_STEPS = 100_000_000


def large_areas(links: DataFrame, others: DataFrame, seeds: bool) -> DataFrame:
    """Stored area_ids that are too much for one task; with ``seeds`` each row of ``others`` is followed through its links."""
    counted = links.select("area_id", F.lit(1).alias("link")).union(others.select("area_id", F.lit(0)))
    n, n_links = F.count(F.lit(1)), F.sum("link")
    many = n > LOCAL_ROWS
    if seeds:
        many = many | (n_links.cast("double") * (n - n_links) > LOCAL_STEPS)
    return cut(counted.groupBy("area_id").agg(many.alias("many")).where("many").select("area_id"))


def per_area(links: DataFrame, others: DataFrame, search: Callable, output: list[str]) -> DataFrame:
    """``search(links, others)`` of every area, both as lists of pairs; gives rows of two values, named in ``output`` behind area_id.
    Inputs: area_id and two columns.

    The rows of an area meet in a task, one area after the other: a task holds one area, however many it has.
    """
    names = ["area_id", "a", "b"]
    rows = links.toDF(*names).withColumn("link", F.lit(True)).union(others.toDF(*names).withColumn("link", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area, known, asked, out, types = None, [], [], [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], output)

        for batch in batches:
            types = batch.schema.types[:3]
            for name, a, b, link in zip(*(c.to_pylist() for c in batch.columns)):
                if name != area:
                    out.extend((area, x, y) for x, y in search(known, asked))
                    area, known, asked = name, [], []
                    if len(out) >= 10_000:
                        yield flush()
                        out = []
                (known if link else asked).append((a, b))
        out.extend((area, x, y) for x, y in search(known, asked))
        if out:
            yield flush()

    ddl = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(output, rows.schema.fields))
    return rows.repartition("area_id").sortWithinPartitions("area_id").mapInArrow(run, ddl)


def routed(links: list, pairs: list) -> Iterator[tuple]:
    """The pairs of one area that have a route.

    Nodes that reach each other are found first and share one set of the destinations they reach, a bit for each of those; a
    group is complete once all it leads to is, so every link is followed once, whatever the number of origins.
    """
    onward: dict = {}
    for a, b in links:
        onward.setdefault(a, set()).add(b)
    wanted: dict = {}
    for origin, destination in pairs:
        wanted.setdefault(origin, set()).add(destination)
    place = {end: i for i, end in enumerate({destination for _, destination in pairs})}
    number, low, reach, waiting = {}, {}, {}, []
    for origin in wanted:
        calls = []
        if origin not in number:
            number[origin] = low[origin] = len(number)
            waiting.append(origin)
            calls.append((origin, iter(onward.get(origin, ()))))
        while calls:
            node, rest = calls[-1]
            for after in rest:
                if after not in number:
                    number[after] = low[after] = len(number)
                    waiting.append(after)
                    calls.append((after, iter(onward.get(after, ()))))
                    break
                if after not in reach:
                    low[node] = min(low[node], number[after])
            else:
                calls.pop()
                if calls:
                    low[calls[-1][0]] = min(low[calls[-1][0]], low[node])
                if low[node] == number[node]:
                    group, got = [waiting.pop()], 0
                    while group[-1] != node:
                        group.append(waiting.pop())
                    for member in group:
                        if member in place:
                            got |= 1 << place[member]
                        for after in onward.get(member, ()):
                            got |= reach.get(after, 0)
                    for member in group:
                        reach[member] = got
    for origin, ends in wanted.items():
        yield from ((origin, end) for end in ends if reach[origin] >> place[end] & 1)


def joined_nodes(links: list, nodes: list) -> Iterator[tuple]:
    """Every node of one area with the smallest node it is linked to."""
    parent = {node: node for node, _ in nodes}

    def root(node):
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    for a, b in links:
        if a in parent and b in parent:
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return ((node, root(node)) for node in parent)


HUB_GROWTH = 32
PAIR = ["area_id", "origin", "destination"]


def reachable(pairs: DataFrame, links: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Pairs (area_id, origin, destination) with a route, as distinct rows.

    With a hop limit every origin is followed. Without one an area that is small enough is searched in one task, and the pairs of
    the others are looked up in hub labels (:func:`hub_labels`): a pair has a route if a hub that the origin reaches also reaches the destination. Hubs are added in batches that grow, and
    pairs leave as soon as they are decided; once an area has fewer open origins than the next batch has hubs, its origins
    are followed instead, but never past a node that a label already covers, so no table of origins and all their nodes arises.
    """
    scratch = Scratch(links.sparkSession, "reach")
    links, pairs = links.select("area_id", "from_edge", "to_edge"), pairs.select(*PAIR)
    if max_hops is None:
        known = links.where("area_id is not null and from_edge is not null and to_edge is not null")
        asked = pairs.where("area_id is not null and origin is not null and destination is not null")
        large = large_areas(known, asked, seeds=True)
        if large.isEmpty():
            return per_area(known, asked, routed, PAIR)
        here = per_area(known.join(large, "area_id", "left_anti"), asked.join(large, "area_id", "left_anti"), routed, PAIR)
        rest = _looked_up(asked.join(large, "area_id", "left_semi"), known.join(large, "area_id", "left_semi"), None, scratch)
        return here.unionByName(rest)
    return _looked_up(pairs, links, max_hops, scratch)


def _looked_up(pairs: DataFrame, links: DataFrame, max_hops: int | None, scratch: Scratch) -> DataFrame:
    links = scratch.put("links", links.distinct())
    pairs = pairs.distinct()
    same = pairs.where(F.col("origin") == F.col("destination"))
    # A node without an outgoing (incoming) link cannot start (end) a route.
    starts = links.select("area_id", F.col("from_edge").alias("origin")).distinct()
    ends = links.select("area_id", F.col("to_edge").alias("destination")).distinct()
    open_pairs = pairs.where(F.col("origin") != F.col("destination"))
    open_pairs = scratch.put(
        "open", open_pairs.join(starts, ["area_id", "origin"], "left_semi").join(ends, ["area_id", "destination"], "left_semi")
    )
    origins = open_pairs.select("area_id", F.col("origin").alias("node")).distinct()
    if max_hops is not None:
        visited = spread(origins.select("area_id", F.col("node").alias("origin"), "node"), links, ["area_id", "origin"], max_hops)
        rest = open_pairs.join(visited.withColumnRenamed("node", "destination"), PAIR, "left_semi")
        return same.unionByName(rest)
    links = shortcuts(links)
    found, labels, done, size = same, None, 0, 1
    ranked = _ranked_nodes(links)
    while True:
        most = open_pairs.select("area_id", "origin").distinct().groupBy("area_id").count().agg(F.max("count")).first()[0] or 0
        if most == 0:
            return found
        if labels is not None and most <= size:
            break
        wanted = open_pairs.select("area_id").distinct()
        hubs = ranked.where((F.col("rank") > done) & (F.col("rank") <= done + size)).join(wanted, "area_id", "left_semi")
        if hubs.isEmpty():
            return found
        both = hubs.select("area_id", "node", F.explode(F.array(F.lit(True), F.lit(False))).alias("forward"))
        grown = hub_labels(both, links, labels)
        decided = scratch.put(f"decided{done}", _decide(open_pairs, grown if labels is None else labels.unionByName(grown), labels is None))
        labels = grown if labels is None else labels.unionByName(grown)
        found = found.unionByName(decided.where("yes").select(*PAIR))
        open_pairs = scratch.put("open", decided.where("not yes and not no").select(*PAIR))
        done, size = done + size, size * HUB_GROWTH
    seeds = open_pairs.select("area_id", F.col("origin").alias("node"), F.lit(True).alias("forward")).distinct()
    own = hub_labels(seeds, links, labels).select("area_id", F.col("hub").alias("origin"), F.col("node").alias("destination"))
    return found.unionByName(open_pairs.join(own, PAIR, "left_semi"))


def _ranked_nodes(links: DataFrame) -> DataFrame:
    """(area_id, node, rank): nodes with many links on their narrower side first, from 1."""
    through = F.least("in_degree", "out_degree")
    order = [F.desc(through), F.desc("out_degree"), "edge_id"]
    numbered = neighbors(links).withColumn("rank", F.row_number().over(W.partitionBy("area_id").orderBy(*order)))
    return numbered.select("area_id", F.col("edge_id").alias("node"), "rank")


def hub_labels(seeds: DataFrame, links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(area_id, hub, node, forward): what each seed reaches (forward) or is reached from, itself included.

    A node whose connection to the seed runs over a hub of ``labels`` is left out and not gone past: that hub, or one
    before it, already speaks for everything behind. Each round joins only the newest entries.
    """
    steps = links.select("area_id", F.lit(True).alias("forward"), F.col("from_edge").alias("node"), F.col("to_edge").alias("next")).union(
        links.select("area_id", F.lit(False), "to_edge", "from_edge")
    )
    entry = ["area_id", "hub", "node", "forward"]
    scratch = Scratch(links.sparkSession, "labels")
    frontier = scratch.put("0", seeds.select("area_id", F.col("node").alias("hub"), "node", "forward"))
    visited, hop = frontier, 0
    while not frontier.isEmpty():
        hop += 1
        moved = frontier.join(steps, ["area_id", "forward", "node"]).select("area_id", "hub", F.col("next").alias("node"), "forward").distinct()
        fresh = moved.join(visited, entry, "left_anti")
        if labels is not None:
            fresh = fresh.join(_covered(fresh, labels), entry, "left_anti")
        frontier = scratch.put(str(hop), fresh)
        visited = visited.unionByName(frontier)
        if hop % 8 == 0:
            visited = scratch.put(f"upto{hop}", visited)
            scratch.drop(*map(str, range(hop - 8, hop)), f"upto{hop - 8}")
    return visited


def _ends(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hubs that a node reaches, and hubs that reach it."""
    return (
        labels.where("not forward").select("area_id", F.col("node").alias("start"), F.col("hub").alias("via")),
        labels.where("forward").select("area_id", F.col("node").alias("end"), F.col("hub").alias("via")),
    )


def _covered(entries: DataFrame, labels: DataFrame) -> DataFrame:
    leaves, arrives = _ends(labels)
    ways = entries.withColumns({
        "start": F.when(F.col("forward"), F.col("hub")).otherwise(F.col("node")),
        "end": F.when(F.col("forward"), F.col("node")).otherwise(F.col("hub")),
    })
    met = ways.join(leaves, ["area_id", "start"]).join(arrives, ["area_id", "end", "via"], "left_semi")
    return met.select("area_id", "hub", "node", "forward").distinct()


def _decide(open_pairs: DataFrame, labels: DataFrame, complete: bool) -> DataFrame:
    """Adds ``yes`` and ``no``. ``complete`` labels list everything a hub reaches and is reached from: a pair that leaves
    either set has no route."""
    leaves, arrives = _ends(labels)
    out = leaves.select("area_id", F.col("start").alias("origin"), "via")
    into = arrives.select("area_id", F.col("end").alias("destination"), "via")
    routed = open_pairs.join(out, ["area_id", "origin"]).join(into, ["area_id", "destination", "via"], "left_semi").select(*PAIR).distinct()
    marked = open_pairs.join(routed.withColumn("yes", F.lit(True)), PAIR, "left").fillna(False, ["yes"])
    if not complete:
        return marked.withColumn("no", F.lit(False))
    sides = labels.groupBy("area_id", "node").agg(F.bool_or("forward").alias("from"), F.bool_or(~F.col("forward")).alias("to"))
    for end in ("origin", "destination"):
        side = sides.select("area_id", F.col("node").alias(end), F.col("from").alias(f"{end}_from"), F.col("to").alias(f"{end}_to"))
        marked = marked.join(side, ["area_id", end], "left").fillna(False, [f"{end}_from", f"{end}_to"])
    no = (F.col("origin_from") & ~F.col("destination_from")) | (F.col("destination_to") & ~F.col("origin_to"))
    return marked.select(*PAIR, "yes", no.alias("no"))


def components(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Weakly connected component of every edge; the label is the smallest edge id of the component.

    An area that is small enough is joined up in one task, the others by :func:`star_components`.
    """
    links, edges = links.select("area_id", "from_edge", "to_edge"), edges.select("area_id", "edge_id")
    known = links.where("area_id is not null and from_edge is not null and to_edge is not null")
    asked = edges.where("area_id is not null and edge_id is not null")
    large = large_areas(known, asked, seeds=False)
    whole = large.isEmpty()
    own_links, own_edges = (known, asked) if whole else (x.join(large, "area_id", "left_anti") for x in (known, asked))
    here = per_area(own_links, own_edges.withColumn("same", F.col("edge_id")), joined_nodes, ["area_id", "edge_id", "component"])
    here = here.unionByName(edges.where("area_id is null or edge_id is null").distinct().withColumn("component", F.col("edge_id")))
    if whole:
        return here
    return here.unionByName(_star_labelled(asked.join(large, "area_id", "left_semi"), known.join(large, "area_id", "left_semi")))


def _star_labelled(edges: DataFrame, links: DataFrame) -> DataFrame:
    nodes = edges.distinct()
    inner = (
        links.join(nodes.withColumnRenamed("edge_id", "from_edge"), ["area_id", "from_edge"], "left_semi")
        .join(nodes.withColumnRenamed("edge_id", "to_edge"), ["area_id", "to_edge"], "left_semi")
    )
    labels = star_components(inner.select("area_id", F.col("from_edge").alias("a"), F.col("to_edge").alias("b")), ["area_id"])
    return nodes.join(labels.withColumnRenamed("node", "edge_id"), ["area_id", "edge_id"], "left").select(
        "area_id", "edge_id", F.coalesce("component", "edge_id").alias("component")
    )


FOREST_LINKS = 500_000


def star_components(links: DataFrame, keys: list[str], scratch: Scratch | None = None, name: str = "stars") -> DataFrame:
    """(keys, node, component) of every node in ``links`` (keys, a, b); the component is its smallest node.

    Tasks first reduce the links they read to stars, a bounded number at a time and without a shuffle, so that only what
    several tasks share is left. Large-star and small-star steps then finish in rounds that follow the logarithm of the size,
    not the diameter; each is one job, which counts and hashes the stars while it writes them. A node's least neighbour is a
    mergeable aggregate, and the join that brings it back is one that Spark splits where a hub makes it skewed.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    apart = links.where("a <> b").select(*keys, "a", "b")
    kind = apart.schema["a"].dataType.simpleString()
    ddl = ", ".join([f"{k} {apart.schema[k].dataType.simpleString()}" for k in keys] + [f"u {kind}", f"v {kind}"])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        seen, schema = 0, None

        def root(node):
            while parent[node] != node:
                parent[node] = node = parent[parent[node]]
            return node

        def stars() -> pa.RecordBatch:
            rows = [(*node[:-1], node[-1], top[-1]) for node in parent if (top := root(node)) != node]
            columns = list(zip(*rows)) or [()] * (len(keys) + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], [*keys, "u", "v"])

        for batch in batches:
            schema = [*batch.schema.types]
            columns = [c.to_pylist() for c in batch.columns]
            for *key, a, b in zip(*columns):
                x, y = (*key, a), (*key, b)
                x, y = root(parent.setdefault(x, x)), root(parent.setdefault(y, y))
                if x[-1] < y[-1]:
                    parent[y] = x
                elif y[-1] < x[-1]:
                    parent[x] = y
            seen += batch.num_rows
            if seen >= FOREST_LINKS:
                yield stars()
                parent, seen = {}, 0
        if parent:
            yield stars()

    columns = [*keys, "u", "v"]
    stars = scratch.put(name, apart.mapInArrow(forest, ddl).distinct())
    before = None
    while True:
        seen = Observation()
        figures = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("hash")]
        stars = scratch.put(name, _small_star(_large_star(stars, keys), keys).observe(seen, *figures))
        state = (seen.get["n"], seen.get["hash"])
        if state == before:
            break
        before = state
    leaves = stars.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return leaves.union(stars.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(stars: DataFrame, keys: list[str]) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    around = stars.select(*keys, F.col("u").alias("a"), F.col("v").alias("b")).union(stars.select(*keys, "v", "u"))
    least = around.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(*keys, "a", F.least("a", "m").alias("m"))
    return around.where(F.col("b") > F.col("a")).join(least, [*keys, "a"]).select(*keys, F.col("b").alias("u"), F.col("m").alias("v"))


def _small_star(stars: DataFrame, keys: list[str]) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = stars.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    moved = stars.join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(*keys, "u", F.col("m").alias("v"))
    return moved.union(own).where(F.col("u") != F.col("v")).distinct()


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("area_id", "component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(labelled: DataFrame) -> DataFrame:
    """Label, size and share of the largest component per area; ties go to the smallest label."""
    sizes = component_sizes(labelled)
    return sizes.groupBy("area_id").agg(
        F.min_by("component", F.struct((-F.col("size")).alias("order"), "component")).alias("component"),
        F.max("size").alias("size"),
        F.count(F.lit(1)).alias("n_components"),
        (F.max("size") / F.sum("size")).alias("share"),
    )


def largest_component_edges(labelled: DataFrame) -> DataFrame:
    best = largest_component(labelled).select("area_id", "component")
    return labelled.join(best, ["area_id", "component"], "left_semi").select("area_id", "edge_id")


pickle_by_value(__name__)
