"""Conversation structure repair: cheapest edits to alternating turns, by Four-Russians block tables."""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, modest_batches, release, table, written

DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5
#: What the repaired roles so far can be: nothing, a system turn, or a last turn of the user or the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A row's symbol: its role's initial (s, u, a, other), four more if its text is truncated; or a row that has to go.
INITIALS, N_SYMBOLS, MUST_GO = "sua", 9, 8
#: Rows in a block.
BLOCK = 4


def _next_role(state: int) -> int:
    """The turn that an inserted or reroled row becomes: the assistant's after the user's, else the user's."""
    return ASSISTANT if state == USER else USER


def _row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, new state) of what can be done with a row."""
    edits = [("D", DELETE_COST, state)]
    if symbol != MUST_GO:
        extra = TRUNCATED_COST * (symbol >= 4)
        kept = {0: SYSTEM, 1: USER, 2: ASSISTANT}.get(symbol % 4)
        if kept == (SYSTEM if state == START and kept == SYSTEM else _next_role(state)):
            edits.append(("K", extra, kept))
        edits.append(("R", REROLE_COST + extra, _next_role(state)))
    return edits


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs by state when rows may be inserted first; three in a row are never of use."""
    for _ in range(3):
        costs = [min(c, INSERT_COST + costs[_next_role(q)]) for q, c in enumerate(costs)]
    return tuple(costs)


class Tables:
    """Costs to go as vectors over states, less their least entry, and what symbols and blocks of symbols make of them.

    Any state can stand in for any other at a bounded price, so only a few such vectors exist; they are numbered. ``step`` and
    ``block`` take a symbol's or block's code and the number of the vector behind it to that before it and what was subtracted.
    """

    def __init__(self, size: int = BLOCK):
        self.size = size
        end = _with_inserts([0, 10**6, 10**6, 0])
        self.vectors, known = [end], {end: 0}
        self.step: list[list[tuple[int, int]]] = [[] for _ in range(N_SYMBOLS)]
        done = 0
        while done < len(self.vectors):
            after = self.vectors[done]
            for symbol in range(N_SYMBOLS):
                costs = _with_inserts([min(c + after[to] for _, c, to in _row_edits(symbol, q)) for q in range(4)])
                low = min(costs)
                own = tuple(c - low for c in costs)
                if own not in known:
                    known[own] = len(self.vectors)
                    self.vectors.append(own)
                self.step[symbol].append((known[own], low))
            done += 1
        self.block = []
        for symbols in product(range(N_SYMBOLS), repeat=size):
            row = []
            for vector in range(len(self.vectors)):
                total = 0
                for symbol in reversed(symbols):
                    vector, low = self.step[symbol][vector]
                    total += low
                row.append((vector, total))
            self.block.append(row)
        self.expanded: dict[tuple[bytes, int, int], tuple[str, int]] = {}

    def code(self, symbols: bytes) -> int:
        out = 0
        for symbol in symbols:
            out = out * N_SYMBOLS + symbol
        return out

    def expand(self, symbols: bytes, vector: int, state: int) -> tuple[str, int]:
        """The edits of a block that starts in ``state`` and has the vector behind it, and the state after it.

        The vectors inside the block are made again from its end backward. With the costs to go at hand the first edit that
        keeps the optimum is taken at every place, in ASCII order, which gives the least of all optimal strings of edits.
        """
        key = (symbols, vector, state)
        if key not in self.expanded:
            inner = []
            for symbol in reversed(symbols):
                before, low = self.step[symbol][vector]
                inner.append((symbol, before, low, vector))
                vector = before
            edits = ""
            for symbol, before, low, after in reversed(inner):
                while True:
                    togo, behind = self.vectors[before], self.vectors[after]
                    moves = {e: to for e, c, to in _row_edits(symbol, state) if c + behind[to] == togo[state] + low}
                    if togo[state] == INSERT_COST + togo[_next_role(state)]:
                        moves["I"] = _next_role(state)
                    edit = min(moves)
                    edits, state = edits + edit, moves[edit]
                    if edit != "I":
                        break
            self.expanded[key] = (edits, state)
        return self.expanded[key]

    def cheapest(self, symbols: bytes) -> tuple[int, str]:
        """The least cost of repairing a conversation, and the ASCII-least initials of edits that have it."""
        whole = len(symbols) - len(symbols) % self.size
        vector = cost = 0
        for symbol in reversed(symbols[whole:]):
            vector, low = self.step[symbol][vector]
            cost += low
        behind = bytearray()
        for at in range(whole - self.size, -1, -self.size):
            behind.append(vector)
            vector, low = self.block[self.code(symbols[at : at + self.size])][vector]
            cost += low
        cost += self.vectors[vector][START]
        state, edits = START, []
        for k, at in enumerate(range(0, whole, self.size)):
            more, state = self.expand(symbols[at : at + self.size], behind[-1 - k], state)
            edits.append(more)
        more, state = self.expand(symbols[whole:], 0, state)
        edits.append(more)
        edits.append({START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state])
        return cost, "".join(edits)


@cache
def tables() -> Tables:
    return Tables()


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _summaries(batches):
    """Streams narrow rows sorted by conversation and place; of a conversation it holds a byte a row."""
    none = object()
    conv, out, size = none, [], 0

    def close():
        cost, audit = tables().cheapest(bytes(symbols))
        gaps = high - low + 1 - turns if turns else 0
        out.append((conv, gaps, *faults[1:], illegal, cost, audit))

    def give():
        columns = zip(*out, strict=True)
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SUMMARY.split(", ")])

    for batch in batches:
        for own, place, turn, initial, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "turn", "initial", "fault")), strict=True):
            if conv is none or own != conv:
                if conv is not none:
                    close()
                    size += len(symbols)
                    if len(out) >= 1000 or size > 4 << 20:
                        yield give()
                        out, size = [], 0
                conv, symbols, faults, illegal, before = own, bytearray(), [0, 0, 0, 0], 0, None
                turns, low, high = 0, None, None
            if place < 0:  # stands for a conversation that may have no rows
                continue
            faults[fault] += 1
            symbols.append(MUST_GO if fault in (1, 2) else (INITIALS.find(initial) if initial and initial in INITIALS else 3) + 4 * (fault == 3))
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            before = initial
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
    if conv is not none:
        close()
    if out:
        yield give()


REPAIRED = "conv_id long, place long, role string, text string, edit string"


def _repaired(batches):
    """Streams, of each conversation, its audit and then its rows in order; gives the repaired rows."""
    none = object()
    conv, out, size = none, [], 0

    def give():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "place", "role", "text", "edit"])

    def inserts():
        nonlocal at, state, count
        while at < len(audit) and audit[at] == "I":
            state, at = _next_role(state), at + 1
            out.append((conv, count, "assistant" if state == ASSISTANT else "user", "", "I"))
            count += 1

    for batch in batches:
        for own, place, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text")), strict=True):
            if conv is none or own != conv:
                conv, audit, at, state, count = own, text, 0, START, 0
                inserts()
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                state = SYSTEM if edit == "K" and role[:1] == "s" else _next_role(state)
                role = role if edit == "K" else "assistant" if state == ASSISTANT else "user"
                out.append((conv, count, role, text, edit))
                count, size = count + 1, size + len(text)
            inserts()
            if len(out) >= 1000 or size > 4 << 20:
                yield give()
                out, size = [], 0
    if out:
        yield give()


def repair_conversations(turns: DataFrame, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired): what is wrong with each conversation and its cheapest repair, and the repaired rows.

    A conversation's rows are ordered by turn (nulls first), then role, then the text's md5. A row's first fault counts: blank
    (white space only), duplicate (its role and text stood in an earlier row), truncated (its last other character is none of
    ``.!?``). Rows are kept, deleted or given another role, or rows are inserted, so that the roles' initials are empty or an
    optional s and then ua once or more; blank and duplicate rows go. reports: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit. repaired: conv_id, place, role, text, edit; a conversation's rows come one after another in order.

    Rows are numbered in order by a range partitioning that cuts long conversations; faults and first occurrences are found with
    joins and partial aggregates on these numbers. Only the edits are chosen in one task a conversation, as its audit is one
    row: that task streams narrow rows and holds a byte or two for each. The tables turn four rows into one lookup.

    A null role or text is one space; rows with a null conv_id are one conversation; null turns make no gaps. Repeated rows
    are rows (and duplicates). ``every`` names conversations (conv_id) that are reported even where no row is left: zeros and an
    empty audit. An empty table gives no rows, extra columns are ignored.
    """
    spark = turns.sparkSession
    modest_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"], F.lit(" ")).alias("role"), F.coalesce(turns["text"], F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    order = ["conv_id", "turn", "role", "digest"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = written(rows, "repair-turns")
    same = F.unhex(F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.hex("digest"), "role")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)).isin(*".!?")
    narrow = rows.select("conv_id", "place", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), ended.alias("ended"), same.alias("same"))
    firsts = narrow.groupBy("same").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts.select("same", "first"), "repair-firsts")
    fault = F.when(F.col("blank"), 1).when(F.col("place") > F.col("first"), 2).when(~F.col("ended"), 3).otherwise(0)
    narrow = narrow.join(firsts.hint("merge"), "same", "left").select("conv_id", "place", "turn", "initial", fault.alias("fault"))
    if every is not None:
        marks = every.select(every["conv_id"].cast("long").alias("conv_id")).distinct()
        narrow = narrow.unionByName(marks.selectExpr("conv_id", "-1L as place", "cast(null as long) as turn", "'' as initial", "0 as fault"))
    dealt = narrow.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place")
    reports = written(dealt.mapInArrow(_summaries, SUMMARY), "repair-reports")
    release(firsts)
    audits = reports.selectExpr("conv_id", "-1L as place", "cast(null as string) as role", "audit as text")
    both = audits.unionByName(rows.select("conv_id", "place", "role", "text"))
    return reports, both.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_repaired, REPAIRED)


def _digests(batches):
    """The sha-256 of each conversation's repaired ``role:text`` rows, joined by newlines."""
    none = object()
    conv, ids, shas = none, [], []
    give = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], names=["conv_id", "repaired_sha256"])
    for batch in batches:
        for own, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if conv is none or own != conv:
                if conv is not none:
                    ids.append(conv)
                    shas.append(sha.hexdigest())
                conv, sha = own, hashlib.sha256(f"{role}:{text}".encode())
            else:
                sha.update(f"\n{role}:{text}".encode())
        if len(ids) >= 1000:
            yield give()
            ids, shas = [], []
    if conv is not none:
        ids.append(conv)
        shas.append(sha.hexdigest())
    if ids:
        yield give()


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with every twentieth row or so dropped, emptied, without sentence ends, repeated, or said by the user.

    The choice is crc32(``conv_id:turn``) modulo 20, with one space for a null, as for null roles and texts.
    """
    one = lambda name: F.coalesce(turns[name].cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    reports, repaired = repair_conversations(damaged(turns), turns)
    digests = repaired.mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "id")
    joined = reports.join(digests.hint("merge"), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
SQL = {
    "op11_conversation_repair": r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT c.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM c, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS ini FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
s AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
  WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
r AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM s GROUP BY conv_id),
more(q, q2, fee, mark, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'),
  (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'lines': ''} AS best FROM conversations
  UNION ALL
  SELECT conv_id, i, q, min(best) AS best FROM (
    SELECT p.conv_id, s.i, CASE WHEN x = 'D' THEN q2 WHEN x = 'K' AND ini = 's' THEN 1 WHEN q2 = 2 THEN 3 ELSE 2 END AS q,
      {'cost': best.cost + fee + CASE x WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN x <> 'D' AND fault = 3 THEN 5 ELSE 0 END, 'audit': best.audit || mark || x,
       'lines': best.lines || more.lines || CASE x WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE WHEN q2 = 2 THEN 'assistant' ELSE 'user' END || ':' || text END} AS best
    FROM p JOIN more ON p.q = more.q JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i + 1, (VALUES ('D'), ('K'), ('R')) AS e(x)
    WHERE x = 'D' OR fault IN (0, 3) AND (x = 'R' OR ini = 's' AND q2 = 0 OR ini = 'u' AND q2 <> 2 OR ini = 'a' AND q2 = 2)) GROUP BY conv_id, i, q),
z AS (SELECT p.conv_id, min({'cost': best.cost + fee, 'audit': best.audit || mark, 'lines': best.lines || more.lines}) AS best
  FROM p JOIN more ON p.q = more.q LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id WHERE q2 IN (0, 3) AND p.i = coalesce(r.n, 0) GROUP BY p.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
FROM z LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM z.conv_id"""
}
