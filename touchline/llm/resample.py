"""Importance resampling towards a target distribution over hashed word n-grams, with CRCs derived from running ones."""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import Words, each, folding
from .shared import modest_batches, release, table, written

#: Everything but letters, digits and what lies beyond ASCII separates words.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = folding(bytes(b for b in SEPARATORS if not 65 <= b <= 90))
LONGEST = 3


@cache
def _byte_steps() -> np.ndarray:
    """What a CRC-32 state's lowest byte adds to the state when a zero byte follows."""
    return np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return (c >> np.uint32(8)) ^ _byte_steps()[c & np.uint32(255)]


@cache
def _shifts() -> np.ndarray:
    """By digit place p, digit d, byte k and its value: that byte of a CRC after d * 256**p zero bytes.

    Shifting is linear over GF(2), so a CRC's shift is the sum of its bytes' shifts. Four places reach any length below 2**32.
    """
    start = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out, step = np.empty((4, 256, 4, 256), np.uint32), _zero_byte
    for place in range(4):
        out[place, 0] = start
        for digit in range(1, 256):
            out[place, digit] = step(out[place, digit - 1])
        step = lambda c, one=step, own=out[place]: one(_by_table(own[255], c))
    return out


def _by_table(own: np.ndarray, c: np.ndarray) -> np.ndarray:
    return own[0][c & np.uint32(255)] ^ own[1][(c >> np.uint32(8)) & np.uint32(255)] ^ own[2][(c >> np.uint32(16)) & np.uint32(255)] ^ own[3][c >> np.uint32(24)]


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC states after n zero bytes each."""
    for place, own in enumerate(_shifts()):
        digit = (n >> (8 * place)) & 255
        if digit.any():
            c = own[digit, 0, c & np.uint32(255)] ^ own[digit, 1, (c >> np.uint32(8)) & np.uint32(255)] ^ own[digit, 2, (c >> np.uint32(16)) & np.uint32(255)] ^ own[digit, 3, c >> np.uint32(24)]
    return c


@cache
def _top_bytes() -> np.ndarray:
    """The lowest byte that a state had before a zero byte, by the state's highest byte after it."""
    out = np.empty(256, np.uint32)
    out[_byte_steps() >> np.uint32(24)] = np.arange(256, dtype=np.uint32)
    return out


def before_space(c: np.ndarray) -> np.ndarray:
    """Running CRCs as they were before a last space."""
    c = c ^ np.uint32(zlib.crc32(b" "))
    low = _top_bytes()[c >> np.uint32(24)]
    return ((c ^ _byte_steps()[low]) << np.uint32(8)) | low


def running(words: Words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The CRCs of words lo to hi, read as one string, before and after each word."""
    crc, at = 0, [0]
    for word in (words.buffer[words.begins[lo] : words.ends[hi - 1]].replace(b" ", b" \0") + b" ").split(b"\0"):
        crc = zlib.crc32(word, crc)
        at.append(crc)
    at = np.array(at, np.uint32)
    return at[:-1], before_space(at[1:])


def run_crcs(words: Words, longest: int = LONGEST):
    """(places of texts, CRCs) of all runs of 1 to ``longest`` words that end in each slice of the words.

    A text is read once for its running CRCs; with them, CRC(AB) = shift(CRC(A), length of B) + CRC(B) gives the CRC of any B.
    """
    for lo, hi in words.slices():
        base = max(0, lo - longest + 1)
        before, after = running(words, base, hi)
        for n in range(1, longest + 1):
            stop = np.arange(max(lo, n - 1), hi)
            start = stop - n + 1
            inside = words.first[stop] <= start
            start, stop = start[inside], stop[inside]
            yield words.text[stop], after[stop - base] ^ shifted(before[start - base], words.ends[stop] - words.begins[start])


def _counts(batches, buckets: int):
    total = np.zeros(buckets, np.int64)
    for _, words in each(batches, _TABLE):
        for _, crc in run_crcs(words):
            total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
    found = np.flatnonzero(total)
    if len(found):
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all documents fall into each bucket: partial counts a task, summed by bucket, ``buckets`` numbers in the end."""
    found = docs.select("text").mapInArrow(lambda it: _counts(it, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier a bucket is under the target), with one added to every count."""
    all_source, all_target, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(batches, gain: np.ndarray):
    buckets = np.uint32(len(gain))
    for batch, words in each(batches, _TABLE):
        weight = np.zeros(batch.num_rows, np.int64)
        for text, crc in run_crcs(words):
            weight += np.bincount(text, gain[crc % buckets], batch.num_rows).astype(np.int64)  # whole numbers, exact in doubles
        n = sum(np.maximum(words.counts - k, 0) for k in range(LONGEST))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10000, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank: each document's log importance towards ``target`` and the draw.

    Features are runs of 1 to 3 words, in ``buckets`` by CRC-32. A document's weight adds up its features' gains; a Gumbel
    number made of its doc_id is added, and of the N documents with min_words words or more the floor(percent * N / 100)
    highest scores are drawn, which is sampling without replacement in proportion to importance. rank counts them from 1.

    Texts are read twice, for the counts and for the weights, and nothing of them is stored. Ranks come from one sort of
    small rows over all tasks, so neither ties nor the size of the draw matter. Null and empty texts have no features and
    weight 0. Rows with a null doc_id take part under the key of an empty id and come last among equal scores; repeated
    rows are documents of their own, ties among them broken by n_features and weight. An empty target or table gives
    defined gains (counts of zero), an empty table no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target.select(target["text"]), buckets))
    weighed = docs.mapInArrow(lambda it: _weights(it, gain), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= min_words).alias("able")), "resample-scores")
    able = scored.where("able")
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = able.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    sorted_ = written(sorted_, "resample-order")
    part, inside = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted_.groupBy(part.alias("part")).count().collect()  # a number a partition
    before, starts = 0, []
    for row in sorted(sizes):
        starts.append((row["part"], before))
        before += row["count"]
    starts = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "part int, before long"))
    rank = F.col("before") + inside + 1
    ranked = sorted_.withColumn("part", part).join(starts, "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.where("not able").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
SQL = {
    "op13_importance_resampling": r"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
w AS (SELECT doc_id AS id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
l AS (SELECT id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM w),
g AS (SELECT id, own, array_to_string(ws[i : i + n - 1], ' ') AS f FROM (SELECT id, own, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM l, (SELECT unnest([1, 2, 3]) AS n))),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM g)),
c AS (SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM x, tab),
b AS (SELECT g.id, g.own, c.bucket FROM g JOIN c USING (f)),
n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM b GROUP BY bucket),
k AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT count(*) FROM b WHERE own) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b WHERE NOT own) + 10000)))) AS gain FROM n),
e AS (SELECT id, count(*) AS n_features, sum(gain) AS weight FROM b JOIN k USING (bucket) WHERE own GROUP BY id),
y AS (SELECT l.id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || l.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM l LEFT JOIN e USING (id) WHERE own),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM z) * 5 // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id)"""
}
