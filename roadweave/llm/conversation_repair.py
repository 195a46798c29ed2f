"""Repair of the role structure of conversations by an integer-minimum path with scalar big-integer weights.

A conversation is a path of its rows through the automaton of ``(s?(ua)+)?`` over role initials. Every row is kept, given
the role user or assistant, or deleted, and one row may be inserted before it or behind the last. The weight of an edit
is one integer: its cost in the high digits, and in the low digits, at the two places that belong to its row, the letters
of the audit (D < I < K < R as 1 to 4), zeros behind them. A row's letters are never the beginning of another choice's
letters, so comparing the integers compares costs first and then the audits, letter by letter; the smallest integer over
the paths decides everything. Two insertions next to each other are never cheapest: without both the rest is still legal,
or the one system row before them is cheaper deleted; so two places a row are enough. After every ``BLOCK`` rows the audit so far
moves to a list, and its rank among the states takes its place as one digit, so the integers stay short.

Rows are damaged and judged where they are read. One shuffle brings a conversation's rows to one task, sorted on disk;
there they pass one by one, and the four states of the path with their digests are all that is held, beside two digits of
audit a row and state. The digest of the repaired text is sequential, so a conversation cannot be split further.

Defined results: a null role or text is one space, and so is a null id or turn in the checksum; the null id is a
conversation of its own; rows of one turn stand in the order of role, then text, as they are after damage; an empty role
can only be given a role or deleted; a conversation whose rows are all dropped has zeros and empty
strings; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweave.llm.common import SPACE_CHARS
from roadweave.session import pickle_by_value

# Costs of edits, letters of the audit, damages by checksum.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = "DIKR"
DIGIT = {"": 0} | {c: k + 1 for k, c in enumerate(LETTERS)}
DAMAGES = 20
DROP, EMPTY, UNPUNCTUATED, REPEAT, TO_USER = range(5)
#: States of the automaton: nothing yet, a system row, a user row that waits for its answer, complete exchanges.
START, SYSTEM, USER, DONE = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": DONE}, DONE: {"u": USER}}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT = 1, 2, 3
BITS = 3
SLOT = 2  # letters a row can have
BLOCK = 64
ORDER = ("turn", "role", "text")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after damage; of a dropped row only its conversation stays."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % DAMAGES
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNPUNCTUATED, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == TO_USER, "user").otherwise(F.col("role"))
    gone = F.col("kind") == DROP
    whole = [F.when(~gone, c).alias(n) for c, n in ((F.col("turn"), "turn"), (role, "role"), (text, "text"))]
    return rows.withColumn("_copy", F.explode(copies)).select("conv_id", *whole, gone.alias("gone"))


def own_fault(text: Column) -> Column:
    """Blank or truncated, as far as the text alone tells; 0 otherwise."""
    last = F.substring(F.rtrim(text, F.lit(SPACE_CHARS)), -1, 1)
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0)


class Path:
    """The cheapest way to one state: its weight, audit so far in blocks, and the digest of its repaired rows."""

    __slots__ = ("weight", "audit", "digest", "rows")

    def __init__(self, weight: int, audit: tuple | None, digest: object, rows: int):
        self.weight, self.audit, self.digest, self.rows = weight, audit, digest, rows


class Repair:
    """Folds the rows of one conversation, in order."""

    #: Digits of a block: one for the rank of the audit before it, then the places of its rows and of a last insertion.
    WIDTH = 1 + SLOT * (BLOCK + 1)
    COST = BITS * WIDTH

    def __init__(self) -> None:
        self.paths: list[Path | None] = [Path(0, None, hashlib.sha256(), 0), None, None, None]
        self.in_block = 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        self.first = self.last = None
        self.turns = 0

    def weigh(self, letters: str, cost: int) -> int:
        """An edit's weight: its cost above all digits, its letters at the places of the next row, left-aligned."""
        low = 0
        for k in range(SLOT):
            low = low << BITS | DIGIT[letters[k : k + 1]]
        return cost << self.COST | low << BITS * (self.WIDTH - 1 - SLOT * (self.in_block + 1))

    def edges(self, state: int, role: str, fault: int, deleted_only: bool) -> Iterator[tuple[int, str, int, tuple[str, ...]]]:
        """(next state, letters, cost, roles that the repaired text gains) of every edit of one row."""
        extra = TRUNCATED if fault == CUT else 0
        for insert in ("", *NEXT[state]):
            if insert == "s":
                continue
            at, lead, paid = (NEXT[state][insert], "I", INSERT) if insert else (state, "", 0)
            gained = (ROLE[insert],) if insert else ()
            yield at, lead + "D", paid + DELETE, gained
            if deleted_only:
                continue
            if role[:1] in NEXT[at]:
                yield NEXT[at][role[:1]], lead + "K", paid + KEEP + extra, (*gained, role)
            for to in NEXT[at]:
                if to != "s":
                    yield NEXT[at][to], lead + "R", paid + REROLE + extra, (*gained, ROLE[to])

    def add(self, turn: object, role: str, text: str, fault: int) -> None:
        self.count(turn, role, fault)
        best: list[tuple[int, Path, tuple[str, ...], bool] | None] = [None] * 4
        for state, path in enumerate(self.paths):
            if path is None:
                continue
            for to, letters, cost, gained in self.edges(state, role, fault, fault in (BLANK, DUPLICATE)):
                weight = path.weight + self.weigh(letters, cost)
                if best[to] is None or weight < best[to][0]:
                    best[to] = (weight, path, gained, not letters.endswith("D"))
        self.paths = [self.extend(b, text) if b else None for b in best]
        self.in_block += 1
        if self.in_block == BLOCK:
            self.close_block()

    def extend(self, step: tuple[int, Path, tuple[str, ...], bool], text: str) -> Path:
        weight, path, gained, own = step
        digest, rows = path.digest, path.rows
        if gained:
            digest = digest.copy()
            for k, role in enumerate(gained):
                row = f"{role}:{text if own and k == len(gained) - 1 else ''}"
                digest.update((("\n" if rows else "") + row).encode("utf-8", "replace"))
                rows += 1
        return Path(weight, path.audit, digest, rows)

    def close_block(self) -> None:
        """Move the letters of the block to the lists; a rank of the audits among the states stands for them."""
        low = (1 << self.COST) - 1
        ranks = {v: k for k, v in enumerate(sorted({p.weight & low for p in self.paths if p}))}
        for p in filter(None, self.paths):
            p.audit = (p.audit, p.weight & low)
            p.weight = p.weight >> self.COST << self.COST | ranks[p.weight & low] << BITS * (self.WIDTH - 1)
        self.in_block = 0

    def count(self, turn: object, role: str, fault: int) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest)."""
        ends = [p for p in (self.paths[START], self.paths[DONE]) if p]
        if self.paths[USER]:
            p = self.paths[USER]
            ends.append(self.extend((p.weight + self.weigh("I", INSERT), p, (ROLE["a"],), False), ""))
        best = min(ends, key=lambda p: p.weight)
        low = (1 << self.COST) - 1
        blocks, more = [best.weight & low], best.audit
        while more:
            more, block = more
            blocks.append(block)
        audit = "".join(self.letters(b) for b in reversed(blocks))
        gaps = 0 if self.first is None else int(self.last - self.first) + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.weight >> self.COST, audit, best.digest.hexdigest()

    def letters(self, block: int) -> str:
        digits = (block >> BITS * k & (1 << BITS) - 1 for k in reversed(range(self.WIDTH - 1)))
        return "".join(LETTERS[d - 1] for d in digits if d)


MEASURES = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def in_order(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows with their first fault, every conversation in one partition and in order.

    Whether role and text were seen earlier is a row number over rows that the one shuffle has already brought together.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fault = F.when(F.col("gone"), 0).otherwise(own_fault(F.col("text")))
    same = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    dealt = rows.select("conv_id", "turn", "role", "text", "gone", fault.alias("_own"), same.alias("_same")).repartition(n, "conv_id")
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    seen = F.row_number().over(W.partitionBy("conv_id", "gone", "_same").orderBy(order[0])) > 1
    faulty = F.when(~F.col("gone") & (F.col("_own") != BLANK) & seen, DUPLICATE).otherwise(F.col("_own"))
    judged = dealt.select("conv_id", "turn", "role", "text", "gone", faulty.alias("fault"))
    # Of equal rows the one that is no duplicate stands first.
    return judged.sortWithinPartitions("conv_id", *order, F.col("fault") == DUPLICATE)


def repair(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per conversation: faults, cheapest cost, audit and digest of the repaired rows.

    ``rows`` has the columns of :func:`damage`."""
    ordered = in_order(rows, partitions)
    key = rows.schema["conv_id"]
    schema = T.StructType([T.StructField("conv_id", key.dataType), *T.StructType.fromDDL(MEASURES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, fold, kind = [], None, None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            out.clear()
            kinds = [kind or pa.int64()] + [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema.names)

        for b in batches:
            kind = b.column(0).type
            for conv, turn, role, text, gone, fault in zip(*(b.column(k).to_pylist() for k in range(6))):
                if fold is None or conv != current:
                    if fold is not None:
                        out.append((current, *fold.result()))
                    current, fold = conv, Repair()
                if not gone:
                    fold.add(turn, role, text, fault)
            if len(out) >= 2_000:
                yield batch()
        if fold is not None:
            out.append((current, *fold.result()))
        if out:
            yield batch()

    return ordered.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, from their rows and the audits of :func:`repair`.

    A letter finds its row by number. The role of an inserted or reroled row follows from its place: users and assistants take
    turns behind a kept system row.
    """
    by_conv = W.partitionBy("conv_id")
    letters = found.select("conv_id", F.posexplode(F.filter(F.split("audit", ""), lambda c: c != "")).alias("_at", "_letter"))
    numbered = letters.withColumn(
        "_row", F.when(F.col("_letter") != "I", F.sum((F.col("_letter") != "I").cast("long")).over(by_conv.orderBy("_at")))
    )
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    own = rows.where(~F.col("gone")).select("conv_id", "role", "text", F.row_number().over(by_conv.orderBy(*order)).alias("_row"))
    left, right = numbered.alias("l"), own.alias("r")
    joined = left.join(right, F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l._row") == F.col("r._row")), "left")
    stays = joined.where("_letter <> 'D'").select("l.conv_id", "_at", "_letter", "role", "text")
    place = F.row_number().over(by_conv.orderBy("_at")) - 1
    system = F.first(F.when(F.col("_letter") == "K", F.substring("role", 1, 1)) == "s").over(by_conv.orderBy("_at"))
    placed = stays.withColumn("place", place).withColumn("_lead", F.coalesce(system, F.lit(False)).cast("int"))
    given = F.when((F.col("place") - F.col("_lead")) % 2 == 0, "user").otherwise("assistant")
    return placed.select(
        "conv_id", "place", F.when(F.col("_letter") == "K", F.col("role")).otherwise(given).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def twin_sql() -> str:
    """The result of ``repair(damage(conversations))`` in DuckDB SQL: a fold over the rows of every conversation.

    Each state holds its cheapest (cost, audit, text), compared in this order as one struct.
    """
    far = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"

    def step(path: str, letter: str, cost: str, line: str = "''", when: str = "true") -> str:
        return f"CASE WHEN {when} THEN {{'c': {path}.c + {cost}, 'a': {path}.a || '{letter}', 'r': {path}.r || {line}}} ELSE {far} END"

    def line(role: str, text: str = "''") -> str:
        return f"chr(10) || {role} || ':' || {text}"

    insert_user = [step(p, "I", "3", line("'user'")) for p in ("d.s0", "d.s1", "d.s3")]
    lead_user = f"list_min([d.s2, {', '.join(insert_user)}])"
    lead_done = f"list_min([d.s3, {step('d.s2', 'I', '3', line(chr(39) + 'assistant' + chr(39)))}])"
    keep = lambda p, initial: step(p, "K", "d.more", line("d.role", "d.text"), f"d.kept AND d.role[1] = '{initial}'")
    rerole = lambda p, role: step(p, "R", "3 + d.more", line(f"'{role}'", "d.text"), "d.kept")
    into_user = [step("d.p2", "D", "4")] + [f(p, x) for p in ("d.s0", "d.s1", "d.p3") for f, x in ((keep, "u"), (rerole, "user"))]
    into_done = [step("d.p3", "D", "4"), keep("d.p2", "a"), rerole("d.p2", "assistant")]
    last = step("s2", "I", "3", line("'assistant'"))
    return f"""WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
        CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    dealt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS no,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM keyed, crc_table),
    rows AS (SELECT no, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM dealt, range(2) copies(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
    placed AS (SELECT *, row_number() OVER (PARTITION BY no, role, text ORDER BY i) > 1 AS again,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS mark FROM ordered),
    faulty AS (SELECT *, CASE WHEN mark = '' THEN 1 WHEN again THEN 2 WHEN mark NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(role[1]) OVER (PARTITION BY no ORDER BY i) || role[1] AS two FROM placed),
    w AS (SELECT *, fault NOT IN (1, 2) AS kept, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS more FROM faulty),
    dp AS (SELECT DISTINCT no, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM dealt
        UNION ALL SELECT no, i, {step('d.s0', 'D', '4')}, list_min([{step('d.s1', 'D', '4')}, {keep('d.s0', 's')}]),
            list_min([{', '.join(into_user)}]), list_min([{', '.join(into_done)}])
        FROM (SELECT w.no, w.i, d.s0, d.s1, d.s2, d.s3, {lead_user} AS p2, {lead_done} AS p3, w.role, w.text, w.kept, w.more
            FROM dp d JOIN w ON w.no = d.no AND w.i = d.i + 1) d),
    ends AS (SELECT no, list_min([s0, s3, {last}]) AS best FROM dp QUALIFY row_number() OVER (PARTITION BY no ORDER BY i DESC) = 1),
    figures AS (SELECT no, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY 1)
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
    FROM (SELECT DISTINCT no, conv_id FROM dealt) JOIN ends USING (no) LEFT JOIN figures USING (no)"""


pickle_by_value(__name__)
