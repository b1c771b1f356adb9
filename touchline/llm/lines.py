"""Line deduplication with levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, SPACES, UPPER, Bucketed, ascii_lower, base_columns, modest_batches, release, sliced, table, written

_FOLD = str.maketrans(UPPER, LOWER)
#: The column of a document's line hashes that go, by a name that no table is likely to carry.
GONE = "line hashes to drop"


class LineRuns:
    """A growing set of line keys, kept as sorted runs in levels.

    A run is a table bucketed and sorted by key hash ``h`` with one row per key:
    ``n`` documents that held it in the run's batches and ``keeper``, the document that keeps
    the line (null where an older run already has the key). Joins between a batch and the runs are
    merge joins, bucket by bucket, so no stored run is shuffled again. When a level holds
    ``fanout`` runs they are compacted into one run of the next level.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[Bucketed]] = []

    def _write(self, rows: DataFrame, level: int) -> Bucketed:
        return Bucketed(rows, f"line-run-{level}", self.buckets, "h")

    def runs(self) -> list[DataFrame]:
        return [run.table() for level in self.levels for run in level]

    def drop(self) -> None:
        for level in self.levels:
            for run in level:
                run.drop()
        self.levels = []

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-joins a batch (h, n, keeper) with every run; keys that no run has keep their keeper."""
        fresh, seen = batch, F.lit(False)
        for k, run in enumerate(self.runs()):
            flag = run.select("h", F.lit(True).alias(f"in_{k}")).hint("merge")
            fresh = fresh.join(flag, "h", "left")
            seen = seen | F.coalesce(F.col(f"in_{k}"), F.lit(False))
        rows = fresh.select("h", "n", F.when(~seen, F.col("keeper")).alias("keeper"))
        self._push(self._write(rows, 0), 0)

    def _push(self, run: Bucketed, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(self._write(self._merged([x.table() for x in old]), level + 1), level + 1)
            for one in old:
                one.drop()

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged bucket by bucket; keys are unique in a run, so they are unique in the result."""
        rows = runs[0]
        for run in runs[1:]:
            other = run.select("h", F.col("n").alias("n_2"), F.col("keeper").alias("keeper_2"))
            both = rows.join(other.hint("merge"), "h", "full")
            rows = both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("n_2", F.lit(0))).alias("n"), F.greatest("keeper", "keeper_2").alias("keeper"))
        return rows

    def counts(self) -> DataFrame:
        """Every key with the number of documents that hold it and its keeper."""
        return self._merged(self.runs())


def line_facts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h): each document's distinct keys of at least min_chars code points, as md5 of the key."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    keys = F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(SPACES))))
    long_keys = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))
    return docs.select("doc_id", F.explode(F.transform(long_keys, lambda k: F.unhex(F.md5(k)))).alias("h"))


def _without(batches, min_chars: int):
    """Removes from each text the lines whose key hash is in GONE; carries all other columns through."""
    for batch in sliced(batches):
        texts, gone = batch.column("text").to_pylist(), batch.column(GONE)
        kept, n_lines, n_dropped = [], [], []
        for i, text in enumerate(texts):
            lines = ("" if text is None else text).split("\n")
            n_lines.append(len(lines))
            if not gone[i].is_valid:
                kept.append(text)
                n_dropped.append(0)
                continue
            drop = set(gone[i].as_py())
            stay = []
            for line in lines:
                key = line.strip(SPACES)
                if len(key) < min_chars or hashlib.md5(key.translate(_FOLD).encode()).digest() not in drop:
                    stay.append(line)
            n_dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        rest = [n for n in batch.schema.names if n not in ("text", GONE)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in rest), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            names=[*rest, "text", "n_lines", "n_dropped"],
        )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, carry: tuple[str, ...] = (), batch_docs: int = 50_000_000) -> DataFrame:
    """Drops repeated lines: a key found in at least min_docs documents stays only in its largest doc_id.

    Returns doc_id, the columns named in ``carry``, text (kept lines joined by newlines), n_lines, n_dropped.
    Batches of documents (``batches``, or as many as make about ``batch_docs`` each) go through the runs from the
    largest doc_ids down, so the first batch that has a key also has its keeper and every later batch only adds to the count.

    A null or empty text is one empty line; a null text without drops stays null. Rows with a null doc_id
    are not counted and keep all lines. Rows that share a doc_id are one document. Lines shorter than
    min_chars never go. An empty table gives an empty result. Columns not named in carry are ignored, and so are those
    named like the result's own (n_lines, n_dropped). The session's bounds of Arrow batches are lowered, as ``modest_batches`` says.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    carry = tuple(c for c in carry if c not in ("doc_id", "text", "n_lines", "n_dropped"))
    docs = base_columns(docs, "doc_id", *carry, "text")
    known = docs.where("doc_id is not null")
    batches = max(batches, math.ceil(known.count() / batch_docs))
    cuts = known.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10000)).first()[0] if batches > 1 else None
    number = F.lit(0)
    for cut in cuts or []:
        number = number + (F.col("doc_id") <= F.lit(cut)).cast("int")  # batch 0 holds the largest ids
    facts = written(line_facts(known, min_chars).withColumn("batch", number), "line-facts", by="batch")
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    for k in range(batches):
        mine = facts.where(F.col("batch") == k).groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
        runs.add(mine.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")))
    repeated = written(runs.counts().where(F.col("n") >= min_docs).select("h", "keeper"), "line-repeats")
    gone = written(facts.join(repeated, "h").where(F.col("doc_id") != F.col("keeper")).groupBy("doc_id").agg(F.collect_set("h").alias(GONE)), "line-gone")
    runs.drop()
    release(facts, repeated)
    wide = docs.join(gone.hint("merge"), "doc_id", "left")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in ("doc_id", *carry)) + ", text string, n_lines long, n_dropped long"
    return wide.select("doc_id", *carry, "text", GONE).mapInArrow(lambda it: _without(it, min_chars), schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}

SQL = {
    "op10_line_dedup": """
WITH d AS (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
