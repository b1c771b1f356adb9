"""Cleaning a corpus: quality, repeated lines, near duplicates, benchmark leaks, then SentencePiece ids.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept, and returns a table that
is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.decontaminate import find_leaks
from touchline.llm.jaccard import near_duplicates, text_id
from touchline.llm.lines import dedup_lines
from touchline.llm.quality import score_quality
from touchline.llm.sentencepiece_scan import decode_pieces, encode_pieces
from touchline.llm.shared import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Every row is judged by its own text, so repeated rows stay or go together; ids play no part and may be null. Null and
    empty texts have nothing that speaks against them beyond what the model says of a text without words. An empty
    table stays empty. Columns other than those of documents are left out, here and in the next three stages.
    """
    return score_quality(docs.select(*COLUMNS)).where("keep").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one of them; n_chars follows the text.

    No row goes. Rows that share a doc_id are one document; rows with a null doc_id keep all lines; a null text stays
    null, with null n_chars, and an empty one empty. An empty table stays empty.
    """
    kept = dedup_lines(docs.select(*COLUMNS), carry=("lang", "source"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    A row goes if its own text is a copy of a smaller doc_id's, so other texts of its doc_id stay. Of rows that are
    equal in doc_id and text one stays. Rows with a null doc_id, null or empty texts (once a doc_id) are nobody's copies
    and stay. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    groups = near_duplicates(docs, words=5, num=80, den=100).where("doc_id is not null")
    own = groups.groupBy("doc_id", "text_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("copy"), F.count("*").alias("times"))
    marked = written(own.where("copy or times > 1"), "copies").withColumnRenamed("text_id", "_text")
    keyed = docs.withColumn("_text", text_id(F.col("text")))
    on = ["doc_id", "_text"]
    kept = keyed.join(marked.select(*on).hint("shuffle_hash"), on, "left_anti").select(*COLUMNS)  # texts are shuffled once and not sorted
    again = marked.where("times > 1 and not copy").select(*on)
    if again.limit(1).count():
        kept = kept.unionByName(keyed.join(again.hint("shuffle_hash"), on, "left_semi").dropDuplicates(on).select(*COLUMNS))
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; an item of a few letters, such as "yes", is no reason by itself.

    Rows that share a doc_id go together; rows with a null doc_id, null and empty texts stay, as do all rows where
    the benchmark is empty. An empty table stays empty.
    """
    leaks = written(find_leaks(docs, table(spark, sf_dir, "benchmark")).where("not short").select("doc_id").distinct(), "leaks")
    return docs.select(*COLUMNS).join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, checked by decoding: doc_id, n_tokens, ids_crc32 and the decoded text's sha-256.

    One row for every row, repeated ones and null doc_ids too. Null and empty texts have no tokens and decode to an empty
    text. An empty table gives no rows.
    """
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(docs, model).withColumn("ids_crc32", F.crc32("ids"))
    return decode_pieces(encoded, model).select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicate", near_duplicate), ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]

#: The quality and SentencePiece stages can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
