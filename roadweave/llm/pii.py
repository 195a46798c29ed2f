"""Personal data in texts: candidate spans, boosted trees, calibrated thresholds - Spark expressions only.

Generators with high recall propose overlapping spans: emails, dotted quads, runs of digits, phone numbers with and
without a plus, spelled-out emails, secrets behind a key word, long hexadecimal strings. The base rules decide some of
them (address parts, Luhn, digit counts) and always stay. The others are scored by boosted trees over format and context
features. All features are small integers, so the corpus is summed to one row per feature combination (a table bounded by
the features' ranges) and the trees are fitted on that, over all documents; they are compiled to one expression. Per kind
the threshold is the lowest one at which ``PRECISION`` of the candidates above it are confirmed ones.

Patterns are written without backtracking (possessive groups, a start only where a run starts), so they take time in
proportion to the text. Places are code points. Defined results: a null or empty text has no span; repeated rows are
searched one by one; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import let, text_or_empty

PRECISION = 0.9
ROUNDS = 16
LEARNING_RATE = 0.3

# Kinds in the order in which equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "local_phone", "spelled_email", "secret", "hex_key")
EMAIL, IP, CARD, PHONE, LOCAL_PHONE, SPELLED_EMAIL, SECRET, HEX_KEY = range(8)

# The base patterns, with a start only at the start of a run or behind the match before.
PATTERNS = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
    LOCAL_PHONE: r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    SPELLED_EMAIL: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,}+",
    SECRET: r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?[^\x20\x09-\x0D]{6,}+",
    HEX_KEY: r"(?<![0-9A-Za-z])[0-9a-f]{16,}+(?![0-9A-Za-z])",
}
#: Strings one of which a text must contain to hold the kind; kinds that are not named need a digit.
MAYBE = {EMAIL: ("@",), PHONE: ("+",), SPELLED_EMAIL: ("(at)", "[at]"), SECRET: ("=", ":")}
CONTEXT = r"(?i)(?:card|visa|account|phone|tel|call|mail|contact|write|password|secret|key|token|server|host|addr)"
SPAN = "struct<s:int,k:int,e:int,ok:boolean,f0:int,f1:int,f2:int,f3:int,f4:int,f5:int,f6:int>"
FEATURES = tuple(f"f{i}" for i in range(7))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    last = F.length(digits)
    state = F.lit(0)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, last - i, F.lit(1)).cast("int")
        double = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(double - F.when(double > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), last - 1), state, add) % 10 == 0


def confirmed(kind: int, found: Column, digits: Column) -> Column:
    """The base rule of a kind; for the other kinds, the format that counts as a confirmed example."""
    n = F.length(digits)
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return found.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == CARD:
        return F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == PHONE:
        return n.between(9, 15)
    if kind == SECRET:
        return (F.length(found) >= 14) & (n >= 2)
    return F.lit(False)


def spans(text: Column, kind: int) -> Column:
    """The leftmost matches of a kind that do not overlap, with place, base verdict and features.

    The gaps between matches and the matches themselves give the places; both come from the same pattern.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    pattern = PATTERNS[kind]

    def level(value: Column, *limits: int) -> Column:
        out = F.lit(0)
        for i, limit in enumerate(limits, 1):
            out = F.when(value >= limit, i).otherwise(out)
        return out

    def walk(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]

        def add(acc: Column, i: Column) -> Column:
            item, gap = F.get(found, i), F.get(gaps, i)
            start = acc["at"] + F.length(gap)
            end = start + F.length(item)

            def span(digits: Column) -> Column:
                ok, n, size = confirmed(kind, item, digits), F.length(digits), F.length(item)
                after, before = F.left(F.get(gaps, i + 1), F.lit(1)), F.right(gap, F.lit(1))
                features = (
                    F.lit(kind),
                    level(n, 4, 9, 12, 14, 16, 17),
                    level(size, 9, 13, 17, 25),
                    level(size - n, 1, 2, 4, 8),
                    F.right(gap, F.lit(24)).rlike(CONTEXT).cast("int"),
                    F.when(before == "", 0).when(before.rlike("[\\x20\\x09-\\x0D]"), 1).when(before.rlike("[0-9A-Za-z]"), 2).otherwise(3),
                    F.when(after == "", 0).when(after.rlike("[\\x20\\x09-\\x0D.,;]"), 1).when(after.rlike("[0-9A-Za-z]"), 2).otherwise(3),
                )
                made = F.struct(
                    start.cast("int").alias("s"), F.lit(kind).alias("k"), end.cast("int").alias("e"), ok.alias("ok"),
                    *[f.cast("int").alias(name) for name, f in zip(FEATURES, features)],
                ).cast(SPAN)
                return F.array(F.when(ok | (n >= 9) | F.lit(kind >= SPELLED_EMAIL), made))

            more = F.filter(let(F.regexp_replace(item, "[^0-9]", ""), span), lambda x: x.isNotNull())
            out = F.when(F.length(item) < 9 if kind == CARD else F.lit(False), acc["out"]).otherwise(F.concat(acc["out"], more))
            return F.struct(end.cast("int").alias("at"), out.alias("out"))

        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, add, lambda acc: acc["out"])
        return F.when(F.size(found) > 0, walked).otherwise(empty)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    possible = F.lit(False)
    for part in MAYBE.get(kind, ()):
        possible = possible | text.contains(part)
    return F.when(possible if kind in MAYBE else text.rlike("[0-9]"), let(both, walk)).otherwise(empty)


def candidates(text: Column) -> Column:
    """All spans of all kinds, by start and kind."""
    return F.array_sort(F.concat(*[spans(text, k) for k in range(len(KINDS))]))


def base_of(found: Column) -> Column:
    return F.filter(found, lambda c: c["ok"] & (c["k"] <= PHONE))


class Trees:
    """Boosted depth-two trees over small integer features; ``thresholds`` holds the least margin of each kind."""

    def __init__(self, prior: float, trees: list, thresholds: dict[int, float]):
        self.prior, self.trees, self.thresholds = prior, trees, thresholds

    def margin(self, c: Column) -> Column:
        total = F.lit(self.prior)
        for (f, t), low, high in self.trees:
            leaf = [F.when(c[FEATURES[g]] <= u, F.lit(a)).otherwise(F.lit(b)) for (g, u), a, b in (low, high)]
            total = total + F.when(c[FEATURES[f]] <= t, leaf[0]).otherwise(leaf[1])
        return total

    def selects(self, c: Column) -> Column:
        if not self.thresholds:
            return F.lit(False)
        limit = F.lit(math.inf)
        for kind, threshold in self.thresholds.items():
            limit = F.when(c["k"] == kind, F.lit(threshold)).otherwise(limit)
        return let(limit, lambda at: self.margin(c) >= at)


def _best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[tuple[int, int], float]:
    best, gain = (0, 1 << 20), 0.0
    whole = grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1].tolist():
            low = x[:, f] <= t
            g = grad[low].sum() ** 2 / (hess[low].sum() + 1.0) + grad[~low].sum() ** 2 / (hess[~low].sum() + 1.0) - whole
            if g > gain + 1e-9:
                best, gain = (f, t), g
    return best, gain


def boost(x: np.ndarray, pos: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Trees fitted on weighted feature combinations by Newton steps of the logistic loss, and thresholds by kind."""
    if not len(x):
        return Trees(0.0, [], {})
    rate = (pos.sum() + 0.5) / (n.sum() + 1.0)
    prior = math.log(rate / (1 - rate))
    margin, trees = np.full(len(x), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = pos - n * p, n * p * (1 - p)
        root, _ = _best_split(x, grad, hess)
        low = x[:, root[0]] <= root[1]
        sides = []
        for side in (low, ~low):
            split, _ = _best_split(x[side], grad[side], hess[side]) if side.any() else ((0, 1 << 20), 0.0)
            below = side & (x[:, split[0]] <= split[1])
            value = [LEARNING_RATE * grad[m].sum() / (hess[m].sum() + 1.0) for m in (below, side & ~below)]
            margin[below] += value[0]
            margin[side & ~below] += value[1]
            sides.append((split, float(value[0]), float(value[1])))
        trees.append((root, *sides))
    thresholds = {}
    for kind in range(len(KINDS)):
        mine = x[:, 0] == kind
        order = np.argsort(-margin[mine], kind="stable")
        m, share = margin[mine][order], np.cumsum(pos[mine][order]) / np.maximum(np.cumsum(n[mine][order]), 1)
        last = np.append(m[1:] < m[:-1] - 1e-9, True)  # only between different margins
        good = np.flatnonzero((share >= PRECISION) & last) if len(m) else []
        if len(good):
            thresholds[kind] = float(m[good[-1]]) - 1e-9
    return Trees(prior, trees, thresholds)


def fit(docs: DataFrame, text_col: str = "text") -> Trees:
    """Trees from the feature table of all candidates of all documents."""

    def labelled(found: Column) -> Column:
        base = base_of(found)
        return F.transform(
            found,
            lambda c: F.struct(
                *[c[f].alias(f) for f in FEATURES],
                (c["ok"] | ((c["k"] == LOCAL_PHONE) & F.exists(base, lambda b: (b["k"] == PHONE) & (b["s"] <= c["s"]) & (b["e"] >= c["e"])))).cast("int").alias("y"),
            ),
        )

    rows = docs.select(F.explode(let(candidates(text_or_empty(text_col)), labelled)).alias("c")).select("c.*")
    # Bounded: the product of the ranges of the features.
    cells = rows.groupBy(*FEATURES).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    cells.sort(key=lambda r: tuple(r))
    x = np.array([[c[f] for f in FEATURES] for c in cells], dtype=int).reshape(len(cells), len(FEATURES))
    return boost(x, np.array([c["pos"] for c in cells], float), np.array([c["n"] for c in cells], float))


def chosen(text: Column, trees: Trees) -> Column:
    """The base spans and the candidates that the trees select beside them, by start and kind."""

    def pick(found: Column) -> Column:
        base = base_of(found)
        free = F.filter(
            found,
            lambda c: ~(c["ok"] & (c["k"] <= PHONE)) & trees.selects(c) & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"])),
        )
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, free)).alias("all"))

    return let(candidates(text), pick)


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def detect(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, a checksum of the base spans, and all spans."""
    found = docs.select(F.col(id_col).alias("doc_id"), chosen(text_or_empty(text_col), trees).alias("c"))

    def count(kind: int) -> Column:
        return F.size(F.filter("c.base", lambda c: c["k"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [count(kind) for kind in range(PHONE + 1)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("c.base")), 256).alias("base_sha256"), _listed(F.col("c.all")).alias("spans"))


def redact(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; a text without spans stays as it is."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(text: Column) -> Column:
        def cut_out(both: Column) -> Column:
            def add(acc: Column, c: Column) -> Column:
                fresh = c["s"] >= acc["at"]
                kept = F.concat(acc["out"], F.substr(text, acc["at"] + 1, c["s"] - acc["at"]), F.get(names, c["k"]))
                return F.struct(F.greatest(acc["at"], c["e"]).alias("at"), F.when(fresh, kept).otherwise(acc["out"]).alias("out"))

            start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
            done = F.aggregate(both["all"], start, add)
            return let(done, lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1, F.length(text))))

        return let(chosen(text, trees), lambda both: F.when(F.size(both["all"]) == 0, text).otherwise(cut_out(both)))

    # A nullable array element keeps a null text null.
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), let(F.col(text_col), replaced)))
