"""Token ids as chunk files: id blocks in byte or bit planes, each plane compressed, with a chunk index."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import base_columns, new_path, table
from .subwords import encoder, parts

#: A row is a chunk. A document is listed, with all its ids, in the chunk that holds its first one; ``carried`` ids at a
#: chunk's front belong to a document begun before it, at ``carried_from`` among the shard's ids.
CHUNKS = "shard int, chunk int, n_ids int, carried int, carried_from long, doc_ids array<long>, doc_lengths array<long>, planes string, plane_bytes array<int>, payload binary"


def shuffle_planes(ids: np.ndarray, planes: str, level: int = 3) -> tuple[list[int], bytes]:
    """Transposes a block of unsigned 32-bit ids into planes, lowest first, and compresses each."""
    import zstandard

    if planes == "bit":
        bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        parts = [np.packbits(bits[:, k]).tobytes() for k in range(32)]
    elif planes == "byte":
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        parts = [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    else:
        raise ValueError(f"planes are 'bit' or 'byte', not {planes!r}")
    while parts and not any(parts[-1]):  # empty high planes aren't stored
        parts.pop()
    packed = [zstandard.ZstdCompressor(level=level).compress(p) for p in parts]
    return [len(p) for p in packed], b"".join(packed)


def unshuffle_planes(payload: bytes, sizes: list[int], n: int, planes: str) -> np.ndarray:
    import zstandard

    parts, at = [], 0
    for size in sizes:
        parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[at : at + size]), np.uint8))
        at += size
    if planes == "bit":
        bits = np.zeros((n, 32), np.uint8)
        for k, part in enumerate(parts):
            bits[:, k] = np.unpackbits(part, count=n)
        rows = np.packbits(bits, axis=1, bitorder="little")
    else:
        rows = np.zeros((n, 4), np.uint8)
        for k, part in enumerate(parts):
            rows[:, k] = part
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def _encoded(batches, path: str, end_id: int, block: int, planes: str):
    """Streams a shard's documents into chunks of exactly ``block`` ids (the last may be shorter)."""
    coder, chunk, shard = encoder(path), 0, 0
    data, doc_ids, lengths, starts = np.zeros(0, np.uint32), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64)  # starts are places in data
    open_from = open_left = 0  # where the document that lies across the front of data began, and its ids still to come

    def flush(n: int):
        nonlocal chunk, data, doc_ids, lengths, starts, open_from, open_left
        own = int(np.searchsorted(starts, n))
        carried = min(open_left, n)
        sizes, payload = shuffle_planes(data[:n], planes)
        row = [[shard], [chunk], [n], [carried], [open_from if carried else None], [doc_ids[:own].tolist()], [lengths[:own].tolist()], [planes], [sizes], [payload]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int32()), pa.binary()]
        open_left -= carried
        if own and starts[own - 1] + lengths[own - 1] > n:
            open_from, open_left = chunk * block + int(starts[own - 1]), int(starts[own - 1] + lengths[own - 1]) - n
        chunk, data, doc_ids, lengths, starts = chunk + 1, data[n:], doc_ids[own:], lengths[own:], starts[own:] - n
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "chunk", "n_ids", "carried", "carried_from", "doc_ids", "doc_lengths", "planes", "plane_bytes", "payload"])

    for batch in batches:
        if batch.num_rows:
            shard = batch.column("shard")[0].as_py()
        for part in parts(batch):
            ids, counts = coder.encode_column(part.column("text"))
            ends = np.cumsum(counts)
            starts = np.concatenate([starts, len(data) + ends - counts + np.arange(len(ends))])
            data = np.concatenate([data, np.insert(ids, ends, np.uint32(end_id))])
            doc_ids, lengths = np.concatenate([doc_ids, np.array(part.column("doc_id").to_pylist(), object)]), np.concatenate([lengths, counts + 1])
            while len(data) >= block:
                yield flush(block)
    if len(data):
        yield flush(len(data))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block: int = 65536, planes: str = "byte") -> None:
    """Encodes doc_id, text and writes the chunk table to ``path``; shards and chunks follow ascending doc_id.

    A null text is empty (its only id is end_id); null doc_ids come first; rows that share a doc_id are
    separate documents in order of their text's hash. Extra columns are ignored. An empty table writes no chunk.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = base_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    rows.mapInArrow(lambda it: _encoded(it, tokenizer, end_id, block, planes), CHUNKS).write.option("compression", "none").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each chunk starts among all ids, its ids and its stored bytes, without reading any payload.

    One row a chunk, numbered inside its shard without ties; no column is null. Files without chunks give no rows.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    base = _bases(chunks)
    inside = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    stored = F.aggregate("plane_bytes", F.lit(0), lambda a, x: a + x)
    return chunks.join(F.broadcast(base), "shard").select("shard", "chunk", (F.col("base") + local).alias("start"), "n_ids", stored.alias("bytes"), F.size("doc_ids").alias("n_docs"))


def _bases(chunks: DataFrame) -> DataFrame:
    """Ids before each shard: one row a shard, as many as write partitions."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


_PIECES = "shard int, local long, chunk int, doc_id long, n_tokens long"


def _decoded(batches, whole: bool, checksums: bool):
    """Unpacks one chunk at a time: its whole documents, or what it holds of documents that reach into other chunks."""
    names = [part.split()[0] for part in _PIECES.split(", ")] + ["ids_crc32" if checksums else "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if checksums else pa.binary()]
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            lengths = np.array(row["doc_lengths"], np.int64)
            stops = row["carried"] + np.cumsum(lengths)
            inside = len(lengths) - (len(lengths) > 0 and stops[-1] > row["n_ids"])  # only the last one can reach on
            if not whole and inside == len(lengths) and not row["carried"]:
                continue
            data = unshuffle_planes(row["payload"], row["plane_bytes"], row["n_ids"], row["planes"]).astype("<u4", copy=False)
            base = row["chunk"] * row["block"]
            take = lambda a, b: zlib.crc32(data[a:b].tobytes()) if checksums else data[a:b].tobytes()
            cut = zip(row["doc_ids"], (stops - lengths).tolist(), stops.tolist(), strict=True)
            out = [(row["shard"], base + a, row["chunk"], doc_id, b - a, take(a, b)) for doc_id, a, b in cut if (b <= row["n_ids"]) == whole]
            if not whole and row["carried"]:
                out.append((row["shard"], row["carried_from"], row["chunk"], None, None, take(0, row["carried"])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)


def _joined(batches, checksums: bool):
    """The documents whose ids came in several pieces."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = b"".join(p["ids"] for p in batch.column("pieces")[k].as_py())
            own = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays(
                [own.column("shard"), own.column("local"), own.column("doc_id"), own.column("n_tokens"), pa.array([zlib.crc32(ids) if checksums else ids], pa.int64() if checksums else pa.binary())],
                names=["shard", "local", "doc_id", "n_tokens", "ids_crc32" if checksums else "ids"],
            )


def read_token_files(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the chunk files.

    With ``checksums``, ids_crc32 (unsigned crc32 of the ids' bytes) stands for ids. Chunks are unpacked where they are
    read, in any order; only the pieces of documents that lie across chunks are shuffled.

    One row for every row that was written: null doc_ids, repeated ones and documents that hold but the end id too. A
    folder of no chunks gives no rows. A document's ids are a row, so one document has to fit in a task.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    last = "ids_crc32 long" if checksums else "ids binary"
    block = chunks.agg(F.max("n_ids")).first()[0] or 1  # all chunks but a shard's last have so many ids
    rows = chunks.withColumn("block", F.lit(block))
    whole = rows.mapInArrow(lambda it: _decoded(it, True, checksums), f"{_PIECES}, {last}").drop("chunk")
    pieces = rows.mapInArrow(lambda it: _decoded(it, False, False), f"{_PIECES}, ids binary")
    # a document begins in the first chunk that has a piece of it, and only that piece knows its doc_id, which may be null
    together = pieces.groupBy("shard", "local").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("pieces"))
    across = together.mapInArrow(lambda it: _joined(it, checksums), f"shard int, local long, doc_id long, n_tokens long, {last}")
    docs = whole.select("shard", "local", "doc_id", "n_tokens", last.split()[0]).unionByName(across)
    return docs.join(F.broadcast(_bases(chunks)), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", last.split()[0])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, checksums=True)


QUERIES = {"op9_token_files": op9_token_files}
SQL: dict = {}
