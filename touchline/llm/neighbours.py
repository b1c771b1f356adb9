"""Nearest neighbours by inner product: randomly rotated one-bit codes, error bounds, exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import release, table, written

#: Codes have so many bits at least: vectors of fewer dimensions are padded with zeros before the rotation, as the
#: error of an estimate falls with the root of the bits. Queries are rounded to LEVELS bits a dimension.
BITS, LEVELS = 512, 4
RESULT = "query_id long, ask long, vec_id long, score double"
_INDEX = "vec array<double>, ids array<long>, times array<long>, code binary, length double, fit double"


def code_bits(dims: int) -> int:
    return max(BITS, -(-dims // 64) * 64)


def rotation(dims: int, bits: int, seed: int = 7) -> np.ndarray:
    """The columns of a random orthogonal matrix that a vector padded to ``bits`` dimensions meets; the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dims)))
    return q * np.sign(np.diag(r))


def encode_bits(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, their lengths, and the correction scalar <code, unit vector> of each."""
    rotated = vectors @ turn.T
    length = np.linalg.norm(rotated, axis=1)
    return np.packbits(rotated > 0, axis=1), length, np.abs(rotated).sum(axis=1) / (math.sqrt(len(turn)) * length)


class Codes:
    """The codes of some vectors, word by word, with what the estimates need of each."""

    def __init__(self, codes: np.ndarray, length: np.ndarray, fit: np.ndarray):
        self.words = np.ascontiguousarray(np.ascontiguousarray(codes).view(np.uint64).T)
        self.bits, self.n = 64 * len(self.words), len(length)
        self.unit = float(length.max()) if self.n else 1.0  # estimates are told in units of the longest vector, so that none leaves single precision
        self.scale = (length / self.unit / (fit * math.sqrt(self.bits))).astype(np.float32)
        self.miss = ((1 - fit**2).clip(0) * self.bits / (self.bits - 1)).astype(np.float32)
        self.counts = np.empty(self.words.shape, np.uint8)
        self.common = np.empty_like(self.words)
        np.bitwise_count(self.words, out=self.counts)
        self.balance = (2 * np.add.reduce(self.counts, axis=0, dtype=np.int32) - self.bits).astype(np.float32)


class Asked:
    """A rotated query of length 1, rounded to LEVELS bits a dimension and packed plane by plane; ``length`` is the query's own."""

    def __init__(self, query: np.ndarray, turn: np.ndarray):
        self.length = float(np.linalg.norm(query))
        turned = turn @ (query / self.length)
        self.low = float(turned.min())
        self.step = max(float(turned.max()) - self.low, 1e-300) / (2**LEVELS - 1)
        rounded = np.rint((turned - self.low) / self.step).astype(np.uint8)
        self.total = int(rounded.sum(dtype=np.int64))
        self.planes = [np.packbits(rounded >> b & 1).view(np.uint64)[:, None] for b in range(LEVELS)]
        self.power, self.slip = float(turned @ turned), float(((turned - self.low - self.step * rounded) ** 2).sum())


def estimates(codes: Codes, asked: Asked, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of a query with all coded vectors, and what they are at most within ``sure`` standard errors.

    Both are in units of the query's length times the codes' ``unit``.
    With x the unit code and o the unit vector, <x, q> / <x, o> estimates <o, q> without bias; its squared standard
    error is |q|^2 (1 - <x,o>^2) / (D - 1) and that of the query's rounding |q - rounded q|^2 / D, both over <x,o>^2.
    <x, rounded q> is counted from packed bits: it is a sum over the planes of the bits common to code and plane.
    """
    dot = np.zeros(codes.n, np.uint16)
    for b, plane in enumerate(asked.planes):
        np.bitwise_and(codes.words, plane, out=codes.common)
        np.bitwise_count(codes.common, out=codes.counts)
        dot += np.add.reduce(codes.counts, axis=0, dtype=np.uint16) << b
    guess = dot.astype(np.float32)
    guess *= np.float32(2 * asked.step)
    guess += np.float32(asked.low) * codes.balance - np.float32(asked.step * asked.total)
    guess *= codes.scale
    slack = np.sqrt(codes.miss * np.float32(asked.power) + np.float32(asked.slip))
    slack *= np.float32(sure)
    slack += np.float32(1e-5 * math.sqrt(asked.power * codes.bits))  # rounding of the numbers above
    slack *= codes.scale
    slack += guess
    return guess, slack


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the dimensions."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


class Search:
    """The nearest vectors of some queries so far, over vectors that come block by block.

    A query's bar is the score of its worst vector kept: a vector whose estimate, ``sure`` standard errors up, stays
    below the bar isn't scored. The bar goes from block to block, so later blocks rerank ever fewer vectors.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, keep: int, sure: float):
        self.query_ids, self.queries, self.keep, self.sure = query_ids, queries, keep, sure
        self.asked = [Asked(q, turn) for q in queries]
        self.best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)  # scores, first ids, places
        self.ids, self.times, self.seen = [], [], 0
        self.scored = self.met = 0

    def add(self, vectors: np.ndarray, codes: Codes, ids: list[list[int]], times: list[list[int]]) -> None:
        first = np.array([own[0] for own in ids], np.int64)
        for j, asked in enumerate(self.asked):
            guess, most = estimates(codes, asked, self.sure)
            scores, firsts, places = self.best[j]
            done = np.zeros(0, np.int64)
            if len(scores) < self.keep:  # no bar yet: the likeliest ones give one
                done = np.argpartition(-guess, 4 * self.keep)[: 4 * self.keep] if codes.n > 4 * self.keep else np.arange(codes.n)
                scores, firsts, places = self._kept(j, vectors, first, done)
            likely = most >= scores[-1] / asked.length / codes.unit if len(scores) == self.keep else np.ones(codes.n, bool)
            likely[done] = False
            pick = np.flatnonzero(likely)
            if len(pick):
                self._kept(j, vectors, first, pick)
            self.scored, self.met = self.scored + len(done) + len(pick), self.met + codes.n
        self.ids += ids
        self.times += times
        self.seen += codes.n

    def _kept(self, j: int, vectors: np.ndarray, first: np.ndarray, pick: np.ndarray):
        old, rows, query = self.best[j], vectors[pick], self.queries[j]
        near = rows @ query  # in any order of summation; what comes near the best is summed in the defined one
        bar = old[0][-1] if len(old[0]) == self.keep else -np.inf
        if len(near) > self.keep:
            bar = max(bar, np.partition(near, -self.keep)[-self.keep])
        close = near >= bar - 1e-9 * (1 + abs(bar)) if np.isfinite(bar) else np.ones(len(near), bool)
        scores, pick = exact_scores(rows[close], query), pick[close]
        scores, firsts, places = (np.concatenate(x) for x in zip(old, (scores, first[pick], self.seen + pick), strict=True))
        order = np.lexsort((firsts, -scores))[: self.keep]
        self.best[j] = scores[order], firsts[order], places[order]
        return self.best[j]

    def found(self, k: int):
        """(query's place, vec_id, score) of each query's k nearest rows but its own."""
        for j, (scores, _, places) in enumerate(self.best):
            rows = []
            for score, place in zip(scores.tolist(), places.tolist(), strict=True):
                for vec_id, n in zip(self.ids[place], self.times[place], strict=True):
                    if vec_id != self.query_ids[j]:
                        rows += [(-score, vec_id)] * min(n, k)
            for score, vec_id in sorted(rows)[:k]:
                yield j, vec_id, -score


def _flat(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _searched(batches, turn: np.ndarray, k: int, sure: float):
    """One cell, a block of queries and a stripe of vectors, at a time; its rows arrive together, queries first."""
    cell, search, asks, held = None, None, [], []
    at_once = max(256, (1 << 20) // turn.shape[1])  # vectors of a block: about 8 MB

    def look():
        if held and asks:
            nonlocal search
            if search is None:
                search = Search(np.concatenate([x[0] for x in asks]), np.concatenate([x[2] for x in asks]), turn, k + 1, sure)
                search.keys = np.concatenate([x[1] for x in asks])
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            search.add(_flat(part.column("vec")), Codes(codes, *(part.column(c).to_numpy() for c in ("length", "fit"))), part.column("ids").to_pylist(), part.column("times").to_pylist())
        held.clear()

    def give():
        look()
        if search is None:
            return
        rows = list(search.found(k))
        at = np.array([r[0] for r in rows], np.int64)
        columns = [search.query_ids[at], search.keys[at], [r[1] for r in rows], [r[2] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "ask", "vec_id", "score"])

    for batch in batches:
        own, is_query = batch.column("cell").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(is_query.astype(np.int8)) != 0), [True]])) if len(own) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if own[a] != cell:
                yield from give()
                cell, search, asks = own[a], None, []
            part = batch.slice(a, b - a)
            if is_query[a]:
                asks.append((part.column("vec_id").to_numpy(), part.column("ask").to_numpy(), _flat(part.column("vec"))))
                continue
            held.append(part)
            if sum(x.num_rows for x in held) >= at_once:
                look()
    yield from give()


def _indexed(batches, turn: np.ndarray):
    for batch in batches:
        codes, length, fit = encode_bits(_flat(batch.column("vec")), turn) if batch.num_rows else (np.zeros((0, 1)), np.zeros(0), np.zeros(0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(fit)], names=[*batch.schema.names, "code", "length", "fit"])


def usable_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id, vec (doubles) and times, the number of equal rows, of the vectors that take part."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vec") == dims) & ~odd & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec", "vec_id").agg(F.count("*").alias("times"))


def index_vectors(rows: DataFrame, dims: int, k: int, seed: int = 7) -> DataFrame:
    """Each distinct vector with its code (packed sign bits), length, fit and the k + 1 smallest ids that have it.

    No further copy can be among anyone's k nearest, so copies never meet the search; the ranking is cut
    before the shuffle as well, so a vector that a third of all rows share makes no large group.
    """
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    pairs = F.array_sort(F.collect_list(F.struct("vec_id", "times")))
    once = few.groupBy("vec").agg(pairs.alias("p")).select("vec", F.col("p.vec_id").alias("ids"), F.col("p.times").alias("times"))
    turn = rotation(dims, code_bits(dims), seed)
    return once.mapInArrow(lambda it: _indexed(it, turn), _INDEX)


def nearest(vectors: DataFrame, is_query, k: int = 20, stripe: int = 65536, query_block: int = 1024, sure: float = 4.0, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by inner product of every vector for which is_query holds.

    ``is_query`` is a condition on vec_id. Every row is a candidate but a query's own. Distinct vectors are dealt
    into stripes of up to ``stripe`` and queries into blocks of about ``query_block``; each pair of the two is one
    cell of work, cells share nothing, and each gives at most k rows a query, so a lost executor repeats only its
    cells. In a cell vectors come in blocks; one is scored exactly unless its estimate, ``sure`` standard errors up,
    stays below the worst of the query's nearest so far. Ties go to the smaller vec_id.

    Vectors that are null, zero, of another length than the most common one, or that hold null or non-finite
    components take no part; nor do rows with a null vec_id. Rows equal in vec_id and vector are candidates each, but
    are asked once; a vec_id with several vectors is asked with each of them, ranked apart. Fewer than k
    candidates give fewer rows; an empty table gives none. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    widths = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dims = widths[0]["n"] if widths else 1
    rows = written(usable_vectors(vectors, dims), "vectors")
    index = written(index_vectors(rows, dims, k, seed), "vector-index")
    n, asked = index.count(), rows.where(is_query).count()
    query_cells = max(1, math.ceil(asked / query_block))
    spare = math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / query_cells)  # small tables: a cell a core
    cells = max(1, math.ceil(n / stripe), min(spare, n // 4096))
    candidates = index.select(
        F.lit(False).alias("is_query"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("ask"), "vec", "ids", "times", "code", "length", "fit",
        F.pmod(F.xxhash64("vec"), F.lit(cells)).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_cells - 1).cast("long"))).alias("q"),
    )
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("ids", "array<long>"), ("times", "array<long>"), ("code", "binary"), ("length", "double"), ("fit", "double"))]
    asks = rows.where(is_query).select(
        F.lit(True).alias("is_query"), "vec_id", F.xxhash64("vec").alias("ask"), "vec", *none,
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("c"), F.pmod(F.xxhash64("vec_id", "vec"), F.lit(query_cells)).alias("q"),
    )
    dealt = candidates.unionByName(asks).withColumn("cell", F.col("c") * query_cells + F.col("q")).drop("c", "q")
    dealt = dealt.repartitionById(cells * query_cells, F.col("cell").cast("int")).sortWithinPartitions("cell", F.desc("is_query"))
    turn = rotation(dims, code_bits(dims), seed)
    found = written(dealt.mapInArrow(lambda it: _searched(it, turn, k, sure), RESULT), "neighbours")
    release(rows, index)
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_nearest": op5_nearest}

SQL = {
    "op5_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM g q JOIN g c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
