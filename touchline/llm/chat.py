"""Chat formatting: conversations to training strings, assembled column-wise as bytes, with a loss mask."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .subwords import bytes_of, parts

#: The template: a turn is HEAD + role + MIDDLE + text + TAIL. Inside roles and texts every character of
#: SPECIAL gets a backslash before it (and a colon does inside roles), so no marker can appear unescaped.
HEAD, MIDDLE, TAIL = b"### ", b": ", b"</turn>\n"
SPECIAL, SPECIAL_ROLE = b"\\#<", b"\\#<:"

OUT = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,stop:long>>"


def _table(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[np.frombuffer(chars, np.uint8)] = True
    return flags


def escape(raw: np.ndarray, offsets: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts a backslash before every special byte; returns the bytes and the rows' new offsets."""
    hits = special[raw]
    before = np.concatenate([[0], np.cumsum(hits)])
    out = np.full(len(raw) + int(before[-1]), ord("\\"), np.uint8)
    out[np.arange(len(raw)) + before[1:]] = raw
    return out, offsets + before[offsets]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: the bytes, where each turn starts (and the end), and where its text starts and stops.

    Lengths of the five segments of every turn give cumulative offsets; each segment's bytes are scattered
    to their places in a single preallocated buffer.
    """
    role, role_at = escape(*bytes_of(roles), _table(SPECIAL_ROLE))
    text, text_at = escape(*bytes_of(texts), _table(SPECIAL))
    n, role_n, text_n = len(role_at) - 1, np.diff(role_at), np.diff(text_at)
    starts = np.concatenate([[0], np.cumsum(len(HEAD) + role_n + len(MIDDLE) + text_n + len(TAIL))])
    buffer = np.empty(int(starts[-1]), np.uint8)
    role_start = starts[:-1] + len(HEAD)
    text_start = role_start + role_n + len(MIDDLE)
    for marker, at in ((HEAD, starts[:-1]), (MIDDLE, role_start + role_n), (TAIL, text_start + text_n)):
        if n:
            buffer[at[:, None] + np.arange(len(marker))] = np.frombuffer(marker, np.uint8)
    buffer[np.arange(len(role)) + np.repeat(role_start - role_at[:-1], role_n)] = role
    buffer[np.arange(len(text)) + np.repeat(text_start - text_at[:-1], text_n)] = text
    return buffer, starts, text_start, text_start + text_n


def _formatted(batches, assistant: str):
    """Streams turns sorted by conversation; a conversation is given when its last turn has been seen."""
    waiting: list[pa.RecordBatch] = []

    def give(rows: pa.Table):
        rows = rows.combine_chunks()
        column = lambda name: rows.column(name).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(name).type)
        roles, texts, conv = column("role"), column("text"), column("conv_id")
        buffer, starts, text_start, text_stop = assemble(roles, texts)
        changes = np.flatnonzero(np.diff(pa.compute.fill_null(column("grp"), -1).to_numpy(zero_copy_only=False))) + 1
        first = np.concatenate([[0], changes, [rows.num_rows]]).astype(np.int64)
        at = starts[first]
        heads = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])  # bytes to code points
        trains = pa.compute.fill_null(pa.compute.equal(roles, assistant), False).to_numpy(zero_copy_only=False)
        base = np.repeat(heads[at[:-1]], np.diff(first))
        spans_at = np.concatenate([[0], np.cumsum(trains)])[first]
        spans = pa.StructArray.from_arrays([pa.array((heads[x] - base)[trains], pa.int64()) for x in (text_start, text_stop)], names=["start", "stop"])
        strings = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buffer)).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [conv.take(pa.array(first[:-1])), pa.array(np.diff(first), pa.int64()), strings, pa.ListArray.from_arrays(pa.array(spans_at, pa.int32()), spans)],
            names=["conv_id", "n_turns", "formatted", "loss_spans"],
        )

    last = None
    for batch in (part for whole in batches for part in parts(whole)):
        groups = batch.column("grp").to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(groups))
        if last is not None and groups[0] != last and waiting:
            yield give(pa.Table.from_batches(waiting))
            waiting = []
        last = groups[-1]
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            waiting.append(batch.slice(0, cut))
            yield give(pa.Table.from_batches(waiting))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield give(pa.Table.from_batches(waiting))


def format_chats(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted and loss_spans (code points of formatted; the escaped assistant texts, in order).

    Turns are ordered by turn, then role, then text (nulls first), so repeated or tied rows give one defined
    string. A null text or role is empty; turns with a null conv_id are one conversation. A conversation's
    string is a row, so one conversation has to fit in a task; beyond that a task holds some megabytes at a time. Extra columns are ignored; no rows give no rows.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"], turns["role"], turns["text"])
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).alias("grp"), "role", "text")
    return rows.mapInArrow(lambda it: _formatted(it, assistant), OUT)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    turns, at = [], 0
    while at < len(formatted):
        role, at = _until(formatted, at + len(HEAD), ":")
        text, at = _until(formatted, at + len(MIDDLE), "<")
        turns.append((role, text))
        at += len(TAIL)
    return turns


def _until(text: str, at: int, stop: str) -> tuple[str, int]:
    """What stands unescaped from ``at`` up to the next ``stop`` that has no backslash before it."""
    parts = []
    while True:
        slash, end = text.find("\\", at), text.find(stop, at)
        if slash < 0 or end < slash:
            return "".join([*parts, text[at:end]]), end
        parts += [text[at:slash], text[slash + 1]]
        at = slash + 2


def unescape(text: str) -> str:
    return _until(text + "<", 0, "<")[0]


def _read_back(batches):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        formatted, spans = batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()
        turns = [parse(f) for f in formatted]
        loss = ["".join(unescape(f[s["start"] : s["stop"]]) for s in own) for f, own in zip(formatted, spans, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                pa.array([len(t) for t in turns], pa.int64()),
                pa.array([sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns]),
                pa.array([len(x) for x in loss], pa.int64()),
                pa.array([sha(x) for x in loss]),
                pa.array([len(f) for f in formatted], pa.int64()),
            ],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return format_chats(turns.unionByName(extra)).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


QUERIES = {"op4_chat_format": op4_chat_format}

SQL = {
    "op4_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(role) - length(translate(role, '\#<:', '')) + length(text) + length(text) - length(translate(text, '\#<', ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
}
