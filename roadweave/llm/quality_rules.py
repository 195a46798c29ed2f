"""Quality rules: a threshold table compiled into one projection of Spark expressions, without user functions.

Defined results: a null or empty text has no words and fails; repeated rows are judged one by one; other columns are
never read, so names that clash with the measures do no harm; an empty table gives an empty result. Texts are measured
whole: word windows are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import SPACE, let, text_or_empty, words_of

WINDOW = 8

# Frequent short words of the languages in the corpus.
STOP_WORDS = (
    "a", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "als", "auch", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "avec", "dans", "de", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "como", "con", "del", "el", "los", "las", "no", "para", "por", "se", "su", "y",
)


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within ``low``..``high`` percent of ``base`` (``base`` None: the plain number)."""

    measure: str
    base: str | None
    low: int | None
    high: int | None


BASE_RULES = (Rule("n_words", None, 20, None), Rule("n_repeat_words", "n_words", None, 30))
METHOD_RULES = (
    Rule("word_chars", "n_words", 200, 2000),
    Rule("n_symbols", "n_words", None, 30),
    Rule("n_stop_words", None, 2, None),
    Rule("n_dup_lines", "n_lines", None, 50),
)


def covered_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more; ``hashes``: one hash per window start."""

    def count(sorted_: Column) -> Column:
        twice = F.transform(
            sorted_,
            lambda s, k: F.when(
                (s["h"] == F.get(sorted_, k - 1)["h"]) | (s["h"] == F.get(sorted_, k + 1)["h"]), s["i"]
            ),
        )
        starts = F.array_sort(F.filter(twice, lambda i: i.isNotNull()))
        state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            state,
            lambda acc, i: F.struct(
                (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + WINDOW).alias("end")
            ),
            lambda acc: acc["n"],
        )

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
        let(F.array_sort(placed), count)
    )


def measures(text: Column) -> Column:
    """All measures of a text as one struct of longs; the text is split into words once."""

    def of_words(words: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))
        )
        repeated = F.when(F.size(words) > WINDOW, let(windows, covered_words)).otherwise(F.lit(0).cast("bigint"))
        stop = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            repeated.alias("n_repeat_words"),
            stop.cast("bigint").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    return F.struct(
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )


def passes(rule: Rule, value: dict[str, Column]) -> Column:
    """The rule as an integer comparison, so that it means the same in every engine."""
    measure, base = value[rule.measure], value[rule.base] if rule.base else None
    scaled = measure if base is None else measure * 100
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (scaled >= (rule.low if base is None else base * rule.low))
    if rule.high is not None:
        ok = ok & (scaled <= (rule.high if base is None else base * rule.high))
    return ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """One row per document with its measures, ``base_failed`` and ``kept``."""
    measured = docs.select(F.col(id_col).alias("doc_id"), measures(text_or_empty(text_col)).alias("m"))
    names = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_stop_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    value = {k: F.col(f"m.{part}.{k}") for k, part in names.items()} | {"n_symbols": F.col("m.n_symbols")}
    flat = measured.select("doc_id", *[c.alias(k) for k, c in value.items()])
    return flat.select("*", *verdict({k: F.col(k) for k in value}, rules))


def verdict(value: dict[str, Column], rules: tuple[Rule, ...] = METHOD_RULES) -> tuple[Column, Column]:
    base, method = F.lit(True), F.lit(True)
    for rule in BASE_RULES:
        base = base & passes(rule, value)
    for rule in rules:
        method = method & passes(rule, value)
    return (~base).alias("base_failed"), (base & method).alias("kept")


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """The documents that pass, with all their columns."""

    def kept(m: Column) -> Column:
        value = {k: m["w"][k] for k in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")}
        value |= {k: m["l"][k] for k in ("n_lines", "n_dup_lines")} | {"n_symbols": m["n_symbols"]}
        return verdict(value, rules)[1]

    return docs.where(let(measures(text_or_empty(text_col)), kept))


def _sql_rule(rule: Rule) -> str:
    scaled = rule.measure if rule.base is None else f"{rule.measure} * 100"
    parts = []
    for sign, limit in ((">=", rule.low), ("<=", rule.high)):
        if limit is not None:
            parts.append(f"{scaled} {sign} {limit}" + (f" * {rule.base}" if rule.base else ""))
    return " and ".join(parts)


def twin_sql(rules: tuple[Rule, ...] = METHOD_RULES) -> str:
    """The same result in DuckDB's SQL."""
    base = " and ".join(_sql_rule(r) for r in BASE_RULES)
    method = " and ".join(_sql_rule(r) for r in rules)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), w as (
  select r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
         list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) as lines
  from d
), win as (
  select r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as g
  from (select r, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from w)
), dup as (
  select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1
), covered as (
  select r, count(distinct p) as n from (select r, unnest(range(i, i + {WINDOW})) as p from dup) group by r
), m as (
  select doc_id, cast(len(words) as bigint) as n_words,
         cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n, 0) as bigint) as n_repeat_words,
         cast(len(list_filter(words, lambda x: lower(x) in ({stop}))) as bigint) as n_stop_words,
         cast(len(lines) as bigint) as n_lines
  from w left join covered using (r)
)
select *, not ({base}) as base_failed, ({base}) and ({method}) as kept from m
"""
