"""SimHash near-duplicates: fingerprints of word shingles, linked by deletion variants of their halves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import components
from .runs import Words, each, folding
from .shared import SPACES, modest_batches, release, table, written

_TABLE = folding(SPACES.encode())
SEED = 42
#: Fingerprints have two segments: of two differing bits at most one lies in one of them.
SEGMENT = 32
#: Fingerprints that share a variant are compared pair by pair up to so many; in larger groups they meet at midpoints.
MOST_PAIRED = 16


def _bit_counts(hashes: np.ndarray, text: np.ndarray, out: np.ndarray) -> None:
    """Adds to out[text, bit] how many hashes have the bit; rows of a text come one after another.

    Eight counters of a byte each are added at a time, in blocks of at most 255 hashes of one text.
    """
    if not len(hashes):
        return
    starts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, np.arange(0, len(text), 255)]))
    for k in range(8):
        bytes_ = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        np.add.at(out[:, k::8], text[starts], bytes_.astype("<u8").view(np.uint8).reshape(-1, 8))


def _text_prints(words: Words, shingle: int) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is in over half of the text's shingle hashes, repeats counted."""
    ones = np.zeros((len(words.counts), 64), np.int64)
    for lo, hi in words.slices():
        start = np.arange(lo, hi)
        stop = start + shingle - 1
        held = (stop <= words.last[lo:hi]) | (start == words.first[lo:hi])
        start, stop = start[held], np.minimum(stop, words.last[lo:hi])[held]
        pairs = zip(words.begins[start].tolist(), words.ends[stop].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(words.buffer[a:b], SEED) for a, b in pairs], np.uint64)
        _bit_counts(hashes, words.text[start], ones)
    shingles = np.where(words.counts > 0, np.maximum(words.counts - shingle + 1, 1), 0)
    bits = ones * 2 > shingles[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def _prints(batches, shingle: int):
    for batch, words in each(batches, _TABLE):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_text_prints(words, shingle).view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and print: 64 bits as a signed long; texts without words have 0."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(lambda it: _prints(it, shingle), "doc_id long, print long")


def _differ(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def variants():
    """An array of a print's signatures: a segment with one bit taken out, told apart by segment and bit."""
    keys = []
    for segment in range(64 // SEGMENT):
        own = F.shiftrightunsigned("print", segment * SEGMENT).bitwiseAND((1 << SEGMENT) - 1)
        for bit in range(SEGMENT):
            keys.append(own.bitwiseAND(((1 << SEGMENT) - 1) ^ (1 << bit)).bitwiseOR(F.lit((segment * SEGMENT + bit) << SEGMENT)))
    return F.array(*keys)


def print_links(prints: DataFrame, most_paired: int = MOST_PAIRED) -> DataFrame:
    """(a, b): links that connect all distinct prints which differ in at most 2 bits.

    Two such prints differ by at most one bit in one of their halves, so they share that half with the bit taken out. Prints that
    share a variant with up to ``most_paired`` in all are met and checked one by one. In larger groups, as edits of one text make
    them, every print goes to its 64 neighbours and itself instead: prints that meet there differ in 2 bits at most, and those
    that do, meet. At most 65 can meet, so nothing grows with the square of a group, and no link is left out.
    """
    keyed = prints.select("print", F.explode(variants()).alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-variants")
    shared = written(keyed.join(sizes.hint("merge"), "key"), "simhash-shared")
    few = shared.where(F.col("n") <= most_paired).select("key", "print")
    pairs = few.withColumnRenamed("print", "a").join(few.withColumnRenamed("print", "b").hint("merge"), "key").where("a < b")
    near = pairs.where(_differ("a", "b") <= 2).select("a", "b").distinct()
    crowded = shared.where(F.col("n") > most_paired).select("print").distinct()
    points = F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit((1 << b) - (1 << 64) * (b == 63))) for b in range(64)])
    met = crowded.select("print", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("print").alias("met"))  # 65 at most
    met = met.where(F.size("met") > 1).select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a < b").distinct()
    links = written(near.unionByName(met), "simhash-links")
    release(sizes, shared)
    return links


def told(rows: DataFrame, known: DataFrame, key: str, value: str, parts: int) -> DataFrame:
    """Rows with what is known of their key; known: key, value and n, the rows that have the key, each key of rows once.

    Keys of more than a ``parts``-th of all rows are met by a broadcast of fewer than ``parts`` rows, wherever their rows lie; all others
    by a merge join.
    """
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.broadcast(known.where(F.col("n") * parts > total).select(key, value))
    other = known.where(F.col("n") * parts <= total).select(key, value)
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(other.hint("merge"), key))


def simhash_duplicates(docs: DataFrame, shingle: int = 3, most_paired: int = MOST_PAIRED) -> DataFrame:
    """doc_id, print, component_id: components of documents whose fingerprints differ in at most 2 bits.

    Equal prints are one class from the start, so copies cost nothing beyond their row. The links of ``print_links`` give
    components of classes, and each row gets the smallest doc_id of its print's component, without gathering the rows of a frequent
    print or the prints of a large component (``told``).

    Null and empty texts have the print 0 and are linked with each other and with prints near 0. A row with a null doc_id has a
    print, links nothing, and has a null component. Repeated rows give a row each; rows that share a doc_id are judged by their own
    text. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(fingerprints(docs, shingle), "simhash-prints")
    known = rows.where("doc_id is not null")
    classes = written(known.groupBy("print").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n")), "simhash-classes")
    links = print_links(classes.select("print"), most_paired)
    labels = components(links).withColumnRenamed("node", "print")
    own = labels.join(classes.select("print", "smallest").hint("merge"), "print")
    lowest = written(own.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count("*").alias("n")), "simhash-components")
    moved = told(labels, lowest, "component", "component_id", parts).select("print", F.col("component_id").alias("lowest"))
    ends = written(classes.join(moved.hint("merge"), "print", "left").select("print", F.coalesce("lowest", "smallest").alias("component_id"), "n"), "simhash-ends")
    found = told(known, ends, "print", "component_id", parts).select("doc_id", "print", "component_id")
    alone = rows.where("doc_id is null").select("doc_id", "print", F.lit(None).cast("long").alias("component_id"))
    release(links)
    return found.unionByName(alone)


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op12_simhash_dedup": op12_simhash_dedup}
#: XXH64 has no counterpart in DuckDB; the tests hold the query against brute force.
SQL: dict = {}
