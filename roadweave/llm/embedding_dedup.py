"""Near-duplicate embeddings, every pair within the threshold found, by cells of space that overlap exactly as far as needed.

Equal vectors are one node. The nodes of a label and dimension are a cell; a cell with more than ``CELL`` nodes is split by
centres, again and again, as long as that saves comparisons. A node is at home with its nearest centre and visits every other cell
that a vector within the threshold of it can be at home in: two unit vectors with cosine t are sqrt(2 - 2t) apart, so
a cell takes in what lies up to that distance behind the plane between its centre and the visitor's. A linked pair so meets in the
home cell of either vector. A cell that is still large is dealt into blocks and every two blocks meet in a task. A task
compares its pairs in double precision, counts the links of the nodes at home and gives a spanning set of links, so no
list of pairs is made; nodes that links join are a group.

Centres are fitted on a bounded sample of a cell; they decide the cost only. Vectors without cluster structure in many
dimensions cannot be split, and each is compared with every vector of its label.

Defined results: a null label, or a vector that is null, empty, zero or has null or non-finite components, links with
nothing; vectors of different length never link; repeated rows are equal vectors; rows that repeat an id are counted as
vectors of their own; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.components import connected
from roadweave.session import cut, pickle_by_value

THRESHOLD = 0.98
CELL = 4096
SAMPLE = 4096
CENTRES = 32
LEVELS = 6
MOST_PAIRS = 0.5
MOST_COPIES = 3.0
SLACK = 1e-6
BLOCK = 4096
STRIP = 512


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def unit(rows: pd.Series) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first so that no square overflows or vanishes."""
    x = np.array(rows.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


KEY = ["label", "dim", "cell"]
PLACED = "label int, dim int, cell string, home boolean, node long, embedding array<float>, copies long"


def reach(threshold: float) -> float:
    """The largest distance of two unit vectors within the threshold."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def cells_of(x: np.ndarray, c: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, visited): the nearest centre of each vector, and all cells that hold the homes of vectors up to ``far`` away."""
    cos = x @ c.T
    home = cos.argmax(axis=1)
    apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2)
    return home, np.take_along_axis(cos, home[:, None], 1) - cos <= far * apart[home] + SLACK


def fit_cell(sample: pd.DataFrame, far: float) -> pd.DataFrame:
    """(label, dim, cell, centres): the centres of one cell, or no row if a split by them does not pay."""
    x, rng = unit(sample["embedding"]), np.random.default_rng(5)
    wanted = min(CENTRES, int(-(-2 * sample["size"].iloc[0] // CELL)), len(x))
    c = x[rng.choice(len(x), wanted, replace=False)]
    for _ in range(10):
        near = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    home, visited = cells_of(x, c, far)
    inside, copies = visited.sum(axis=0), visited.sum() / len(x)
    pays = (np.bincount(home, minlength=len(c)) @ inside) / len(x) ** 2 <= MOST_PAIRS and copies <= MOST_COPIES
    out = sample[KEY].head(int(pays))
    return out.assign(centres=pd.Series([c.ravel().tolist()] * len(out), index=out.index, dtype=object))


def assign(rows: pd.DataFrame, fitted: pd.DataFrame, far: float) -> pd.DataFrame:
    """A part of one cell in the cells of its centres; what only visits the cell visits its parts."""
    names = [*KEY, "home", "node", "embedding", "copies"]
    if not len(rows) or not len(fitted):
        return rows[names].head(0)
    home, visited = cells_of(unit(rows["embedding"]), np.array(fitted["centres"].iloc[0]).reshape(-1, int(rows["dim"].iloc[0])), far)
    at, cell = np.nonzero(visited)
    out = rows.iloc[at].reset_index(drop=True)
    out["home"] = out["home"].to_numpy(bool) & (home[at] == cell)
    out["cell"] = out["cell"] + "/" + pd.Series(cell.astype(str), dtype=object)
    return out[names]


def cell_sizes(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("home"), 1)).alias("size")))


def place_in_cells(nodes: DataFrame, threshold: float) -> DataFrame:
    """Every node in its home cell and in the cells it visits, with the number of nodes of the cell (``total``)."""
    far = reach(threshold)
    rows = nodes.select(
        "label", F.size("embedding").alias("dim"), F.lit("").alias("cell"), F.lit(True).alias("home"), "node", "embedding", "copies"
    )
    done = []
    for level in range(LEVELS + 1):
        sizes = cell_sizes(rows)
        large = sizes.where(F.col("size") > CELL)
        if level == LEVELS or large.isEmpty():
            done.append(rows.join(sizes, KEY))
            break
        # Bounded: about SAMPLE rows of a cell.
        drawn = F.pmod(F.xxhash64(F.lit(11 + level), "node"), F.col("size")) < SAMPLE
        sample = rows.where("home").join(large, KEY).where(drawn).select(*KEY, "size", "embedding")
        fitted = cut(sample.groupBy(*KEY).applyInPandas(lambda s: fit_cell(s, far), "label int, dim int, cell string, centres array<double>"))
        split = cut(fitted.select(*KEY))
        done.append(rows.join(split, KEY, "left_anti").join(sizes, KEY))
        if split.isEmpty():
            break
        parts = F.ceil(F.col("total") / BLOCK).cast("int")
        dealt = rows.join(split, KEY).join(sizes, KEY).withColumn("part", F.pmod(F.xxhash64(F.lit(31), "node"), parts).cast("int"))
        every = fitted.join(sizes, KEY).select(*KEY, "centres", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        both = dealt.groupBy(*KEY, "part").cogroup(every.groupBy(*KEY, "part"))
        rows = cut(both.applyInPandas(lambda r, c: assign(r, c, far), PLACED))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def spanning(near: np.ndarray) -> tuple[list[int], list[int]]:
    """(rows, columns) of links that join all that the links of ``near`` join: a tree for each part."""
    back = np.ascontiguousarray(near.T)
    new_row, new_col = near.any(axis=1), back.any(axis=1)
    a: list[int] = []
    b: list[int] = []
    for first in np.flatnonzero(new_row).tolist():
        if not new_row[first]:
            continue
        new_row[first] = False
        todo = [(True, first)]
        while todo:
            is_row, i = todo.pop()
            fresh = np.flatnonzero(near[i] & new_col if is_row else back[i] & new_row).tolist()
            (new_col if is_row else new_row)[fresh] = False
            a += [i] * len(fresh) if is_row else fresh
            b += fresh if is_row else [i] * len(fresh)
            todo += [(not is_row, j) for j in fresh]
    return a, b


def compare(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(a, b, links) of two blocks of a cell: the links of each node at home, as (node, node, links), equal vectors counted each,
    and links (a, b, 0) that join the nodes."""
    i, j = int(block["i"].iloc[0]), int(block["j"].iloc[0])
    left, right = block[block["mine"] == i], block[block["mine"] == j]
    x, y = unit(left["embedding"]) if len(left) else np.empty((0, 0)), unit(right["embedding"]) if len(right) else np.empty((0, 0))
    if not len(x) or not len(y):
        return pd.DataFrame({"a": [], "b": [], "links": []}, dtype=np.int64)
    p, q = left["node"].to_numpy(), right["node"].to_numpy()
    near = np.empty((len(x), len(y)), bool)
    for low in range(0, len(x), STRIP):
        near[low : low + STRIP] = (x[low : low + STRIP] @ y.T >= threshold) & (p[low : low + STRIP, None] != q[None, :])
    parts = [(left, near @ right["copies"].to_numpy())]
    if i != j:
        parts.append((right, left["copies"].to_numpy() @ near))
    counted = [pd.DataFrame({"a": side["node"], "b": side["node"], "links": n})[side["home"].to_numpy(bool) & (n > 0)] for side, n in parts]
    a, b = spanning(near)
    return pd.concat([*counted, pd.DataFrame({"a": p[a], "b": q[b], "links": 0})]).astype(np.int64)


def compared(placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) of all cells, every two blocks of a cell in one task, ``BLOCK`` by ``BLOCK``."""
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    rows = placed.withColumn("mine", F.pmod(F.xxhash64(F.lit(13), "node"), blocks).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        *KEY, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "home", "node", "embedding", "copies"
    )
    return met.groupBy(*KEY, "i", "j").applyInPandas(lambda b: compare(b, threshold), "a long, b long, links long")


def dedup(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<float>").alias("embedding")
    )
    fit_for = F.col("label").isNotNull() & F.coalesce(usable(F.col("embedding")), F.lit(False)) & F.col("vec_id").isNotNull()
    good = rows.where(fit_for)
    nodes = cut(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    found = cut(compared(place_in_cells(nodes, threshold), threshold))
    groups = connected(found.where("a <> b").select("a", "b"))
    counted = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.join(groups, "node", "left").join(counted, "node", "left").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"),
    )
    same = (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
    linked = good.join(known, same).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit_for).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def recall(embeddings: DataFrame, result: DataFrame, queries: int = 200, threshold: float = THRESHOLD) -> float:
    """Audit: the share of the true links of a bounded number of query vectors that ``result`` counts."""
    asked = embeddings.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).toPandas()
    asked = asked[[v is not None and len(v) > 0 for v in asked["embedding"]]].reset_index(drop=True)
    q, labels, ids = unit(asked["embedding"]), asked["label"].to_numpy(), asked["vec_id"].to_numpy()

    def run(batches):
        for batch in batches:
            near = (q @ unit(batch["embedding"]).T >= threshold) & (labels[:, None] == batch["label"].to_numpy()[None, :])
            near &= ids[:, None] != batch["vec_id"].to_numpy()[None, :]
            yield pd.DataFrame({"vec_id": ids, "true": near.sum(axis=1)})

    good = embeddings.where(usable(F.col("embedding")) & F.col("label").isNotNull() & (F.size("embedding") == q.shape[1]))
    true = good.select("vec_id", "embedding", "label").mapInPandas(run, "vec_id long, true long").groupBy("vec_id").agg(F.sum("true").alias("true"))
    both = true.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("true", "n_links")), F.sum("true")).first()
    return both[0] / both[1] if both[1] else 1.0


pickle_by_value(__name__)
