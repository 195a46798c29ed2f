"""URL verdicts: host rules first, else naive Bayes over the words of host and path.

Names in a URL often join words ("cheapflights"). Every distinct name is split by a unigram Viterbi: its substrings are
joined with the word counts of all page texts, and the best split by summed log frequency wins; a stretch that is no
known word costs more the longer it is. The classes of the multinomial naive Bayes come from the pages that a rule
decides. Counting goes by distinct name before words are split out, and the last join is salted, so a host that holds a
third of all pages never meets in one task. No table is cut. Spark sizes rows that an explode multiplies by the table
before it, so joins are written such that those rows never go to the driver for a broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict of no words;
without pages that a rule decides the method allows; the method blocks from ``BLOCK_AT`` posterior on; repeated rows give
repeated results; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.session import cut, pickle_by_value

# Rules as verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCK_AT = 0.9
MAX_WORD = 20
SALT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def names_of(host: Column, path: Column) -> Column:
    """Names of a url: runs of letters in host and path; runs of digits become ``#``."""
    joined = F.lower(F.concat_ws("/", host, path))
    return F.regexp_extract_all(F.regexp_replace(joined, "[0-9]+", " # "), F.lit(r"\p{L}+|#"), 0)


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n) over the texts of all pages."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), "<[^>]*+>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), 0)).alias("word"))
    return words.where(F.length("word") <= MAX_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(name: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """The split of a name into words with the largest summed log frequency; of equal ones the fewest, then longest."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, length, n in found:
        ends.setdefault(start + length, []).append((start, math.log(n / total)))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = [(best[end - 1][0] - math.log(total * 10.0), end - 1)]
        options += [(best[start][0] + p, start) for start, p in ends.get(end, ())]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    words, end, run = [], len(name), ""
    known = {(s, s + n) for s, n, _ in found}
    while end:
        start = best[end][1]
        if (start, end) in known:
            words += [run] * bool(run) + [name[start:end]]
            run = ""
        else:
            run = name[start:end] + run  # letters in no known word stay together
        end = start
    return (words + [run] * bool(run))[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct ``names``; substrings meet the word counts in a join."""
    total = int(counts.agg(F.sum("n")).first()[0] or 0) + 1
    size = F.length("name")
    starts = names.select("name", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    spans = starts.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), size - F.col("start")))).alias("len"))
    spans = spans.withColumn("word", F.substr("name", F.col("start") + 1, F.col("len")))
    found = spans.hint("merge").join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("start", "len", "n")).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [
                viterbi(name, [(r["start"], r["len"], r["n"]) for r in (found if found is not None else [])], total)
                for name, found in zip(batch["name"], batch["found"])
            ]
            yield pd.DataFrame({"name": batch["name"], "words": words})

    return names.join(found, "name", "left").mapInPandas(run, "name string, words array<string>")


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, block_at: float = BLOCK_AT
) -> DataFrame:
    """One row per page: host, path, rule, verdict and the method's log odds of a block."""
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = cut(urls.select("*", rule.alias("rule"), verdict.alias("ruled")))
    named = urls.select("page_id", "host", "path", "ruled", "copies", F.explode(names_of(F.col("host"), F.col("path"))).alias("name"))
    by_name = cut(
        named.groupBy("name").agg(
            F.coalesce(F.sum(F.when(F.col("ruled") == "block", F.col("copies"))), F.lit(0)).alias("block"),
            F.coalesce(F.sum(F.when(F.col("ruled") == "allow", F.col("copies"))), F.lit(0)).alias("allow"),
        )
    )
    split = cut(segment(by_name.select("name"), word_counts(pages, html_col)))
    words = by_name.join(split, "name").select("name", "block", "allow", F.explode("words").alias("word"))
    per_word = cut(words.groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    size = per_word.agg(F.count(F.lit(1)), F.sum("block"), F.sum("allow")).first()
    classes = urls.agg(F.sum(F.when(F.col("ruled") == "block", F.col("copies"))), F.sum(F.when(F.col("ruled") == "allow", F.col("copies")))).first()
    if not (classes[0] and classes[1]):
        return _rows(urls.withColumn("odds", F.lit(0.0)), math.inf)
    prior = math.log(classes[0] / classes[1])
    odds = F.log((F.col("block") + 1) / float(size[1] + size[0])) - F.log((F.col("allow") + 1) / float(size[2] + size[0]))
    # Left joins: every name and word is found, and only the other side may be broadcast.
    scores = split.select("name", F.explode("words").alias("word")).join(per_word, "word", "left").groupBy("name").agg(F.sum(odds).alias("odds"))
    salted = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    per_url = (
        named.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
        .join(salted, ["name", "salt"], "left")
        .groupBy("page_id", "host", "path")
        .agg(F.sum("odds").alias("odds"))
    )
    scored = _attach(urls, per_url)
    return _rows(scored.withColumn("odds", F.round(F.coalesce("odds", F.lit(0.0)) + prior, 6)), math.log(block_at / (1 - block_at)))


def _attach(urls: DataFrame, per_url: DataFrame) -> DataFrame:
    """The sums beside their urls; null ids compare as equal."""
    got = per_url.select(F.col("page_id").alias("_id"), F.col("host").alias("_host"), F.col("path").alias("_path"), "odds")
    same = urls["page_id"].eqNullSafe(got["_id"]) & (urls["host"] == got["_host"]) & (urls["path"] == got["_path"])
    return urls.join(got, same, "left").drop("_id", "_host", "_path")


def _rows(scored: DataFrame, limit: float) -> DataFrame:
    method = F.when(F.col("odds") >= F.lit(limit), "block").otherwise("allow")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")
    out = scored.select("*", F.coalesce("ruled", method).alias("verdict"), copies)
    return out.select("page_id", "host", "path", "rule", "verdict", F.col("odds").alias("block_odds"))


pickle_by_value(__name__)
