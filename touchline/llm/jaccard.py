"""Exact Jaccard join on word n-grams: a size-aware heavy-light join with connected components."""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hashing import mix, shingles, word_hashes
from .shared import Bucketed, modest_batches, release, sliced, table, written
from .subwords import groups

#: Largest set for which enumerating subsets is considered; past it their number explodes.
LIGHT_LIMIT = 20
#: Tokens found in more sets than this are told from rare ones. Every task gets one byte for each of 2**RANK_BITS
#: groups of tokens by hash, the logarithm of the count of the group's most frequent token: a rank for all tokens, of fixed size.
MIN_FREQUENT, RANK_BITS = 16, 22
#: Reading and comparing two whole sets is taken to cost as much as so many rows of a list.
CHECK_COST = 8
#: A token's list is met with itself in parts of so many rows, each in a task of its own.
LIST_PART = 2000
#: So many lists back a set remembers where it has been, when pairs are given.
LOOK_BACK = 8
#: A list of classes (an id and 16 bytes) is broadcast up to so many rows, about 80 MB; beyond that the documents are
#: stored once in buckets of their id, and lists are merge-joined to them without moving texts again.
MAX_BROADCAST_ROWS = 1_000_000


def least_overlap(n, m, num: int, den: int):
    """The smallest intersection of sets of n and m elements with den * intersection >= num * union."""
    return -((-num * (n + m)) // (num + den))


def prefix_length(n, num: int, den: int):
    """So many elements, the first in a common order, of which two linked sets share one at least."""
    return n + ((-num * n) // den) + 1


def _sets(texts: list[str], words: int):
    """The shingle set of each text as ascending hashes."""
    for part in groups(texts):  # hashing takes some fifty times a part's bytes for a moment
        own = [t.encode() for t in texts[part]]
        hashes, counts = word_hashes(own)
        first = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield shingles(hashes[a:b], words)


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _set_keys(batches, words: int):
    for batch in sliced(batches):
        n, keys = [], []
        for tokens in _sets([t or "" for t in batch.column("text").to_pylist()], words):
            n.append(len(tokens))
            keys.append(_key(tokens) if len(tokens) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "text_id", "n", "set_key"])


def _with_sets(batches, words: int):
    """(rep, set) of the rows whose text really is the class's."""
    for batch in sliced(batches):
        keys = batch.column("set_key").to_pylist()
        for rep, key, tokens in zip(batch.column("rep").to_pylist(), keys, _sets([t or "" for t in batch.column("text").to_pylist()], words), strict=True):
            if _key(tokens) == key:
                yield rep, tokens


def _packed(batches, words: int, bits: int, at_once: int = 1 << 20):
    """Tokens of many sets, dealt by their first bits; a row holds the next 24 bits of each token of one bucket."""
    held, total = [], 0

    def give():
        tokens = np.sort(np.concatenate(held))
        bucket = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        low = ((tokens >> np.uint64(40 - bits)) & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket) > 0, [True]]))
        blobs = [np.ascontiguousarray(low[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for k in range(0, len(blobs), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[k : k + 4096][: len(blobs[k : k + 4096])]]), pa.array(blobs[k : k + 4096], pa.binary())], names=["bucket", "low"])

    for _, tokens in _with_sets(batches, words):
        held.append(tokens)
        total += len(tokens)
        if total >= at_once:
            yield from give()
            held, total = [], 0
    if total:
        yield from give()


def _counted(batches, least: int):
    """The codes of a bucket with more than ``least`` sets; a bucket's rows come one after another."""
    bucket, blobs = None, []

    def give():
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 3).astype(np.int64)
        codes, counts = np.unique(raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16, return_counts=True)
        many = counts > least
        return pa.RecordBatch.from_arrays([pa.array((bucket << 24) | codes[many]), pa.array(counts[many].astype(np.int64))], names=["code", "sets"])

    for batch in batches:
        for own, low in zip(batch.column("bucket").to_pylist(), batch.column("low").to_pylist(), strict=True):
            if own != bucket:
                if blobs:
                    yield give()
                bucket, blobs = own, []
            blobs.append(low)
    if blobs:
        yield give()


def _postings(batches, words: int, num: int, den: int, frequent):
    """rep, n and the first tokens of each set, rare ones first; all tokens of sets up to LIGHT_LIMIT."""
    ranks = frequent.value
    reps, sizes, lists = [], [], []

    def give():
        return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["rep", "n", "tokens"])

    for rep, tokens in _with_sets(batches, words):
        order = tokens[np.argsort(ranks[(tokens >> np.uint64(64 - RANK_BITS)).astype(np.int64)], kind="stable")]
        take = len(order) if len(order) <= LIGHT_LIMIT else prefix_length(len(order), num, den)
        reps.append(rep)
        sizes.append(len(order))
        lists.append(order[:take].view(np.int64))
        if len(reps) >= 2000:
            yield give()
            reps, sizes, lists = [], [], []
    if reps:
        yield give()


def subset_sizes(n: int, num: int, den: int, most: int) -> list[int]:
    """The sizes of the subsets that a set of n elements has to show to meet every linked set of up to ``most``."""
    low, high = -((-num * n) // den), min(most, n * den // num)
    return sorted({least_overlap(n, m, num, den) for m in range(low, high + 1)} - {0})


def _subsets(batches, num: int, den: int, most: int):
    for batch in batches:
        reps, sizes, keys = [], [], []
        for rep, n, tokens in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            own = mix(np.array(sorted(tokens), np.int64).view(np.uint64))
            for c in subset_sizes(n, num, den, most):
                picks = np.array(list(combinations(range(n), c)))
                reps += [rep] * len(picks)
                sizes += [n] * len(picks)
                keys.append(mix(own[picks].sum(axis=1, dtype=np.uint64) + np.uint64(c)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(reps, pa.int64()), pa.array(sizes, pa.int32())], names=["token", "rep", "n"])


def _set_rows(batches, words: int):
    reps, sets, held = [], [], 0
    for rep, tokens in _with_sets(batches, words):
        reps.append(rep)
        sets.append(tokens.tobytes())
        held += len(sets[-1])
        if held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "elements"])
            reps, sets, held = [], [], 0
    if reps:
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "elements"])


def _linked(batches, num: int, den: int):
    for batch in batches:
        good = []
        for k in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
            spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[spot] == x).sum())
            good.append(den * both >= num * (len(x) + len(y) - both))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("c_a").filter(keep), batch.column("c_b").filter(keep)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over the links (a, b), for every node of a link.

    Labels go to neighbours and then jump to their own label's label, so rounds grow with the logarithm of
    a component's width; each round is written to the shared folder.
    """
    ends = F.inline(F.expr("array(named_struct('a', a, 'b', b), named_struct('a', b, 'b', a), named_struct('a', a, 'b', a), named_struct('a', b, 'b', b))"))  # every node is its own neighbour too
    edges = written(links.select("a", "b").where("a <> b").select(ends).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component").hint("merge"), "b")
        closer = near.groupBy(F.col("a").alias("node")).agg(F.max(F.expr("if(a = b, component, null)")).alias("component"), F.min("component").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("component").alias("jump"))
        moved = closer.join(jump.hint("merge"), "step", "left").select("node", F.least("step", F.coalesce("jump", "step")).alias("component"), F.col("component").alias("old"))
        moved = written(moved, "labels")
        release(labels)
        labels = moved
        if not moved.where("component <> old").limit(1).count():
            release(edges)
            return moved.drop("old")


class JaccardJoin:
    """One join: the rows, the threshold num/den and the tables it has written so far."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int):
        self.spark, self.words, self.num, self.den = docs.sparkSession, words, num, den
        self.docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], text_id(docs["text"]).alias("text_id"))
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.stored = self.few = None
        self.bits = max(8, min(24, (4 * self.parts - 1).bit_length()))

    def of_classes(self, classes: DataFrame) -> DataFrame:
        """rep, set_key and text of the documents that stand for the classes."""
        wanted = classes.select("doc_id", "rep", "set_key")
        if self.few or classes.count() <= MAX_BROADCAST_ROWS:
            found = self.docs.join(F.broadcast(wanted), "doc_id")
        else:
            found = self.in_buckets().join(wanted.hint("merge"), "doc_id")
        return found.select("rep", "set_key", "text")

    def in_buckets(self) -> DataFrame:
        """The documents as a table in buckets of doc_id, written at the first call."""
        if self.stored is None:
            self.stored = Bucketed(self.docs.where("doc_id is not null").select("doc_id", "text"), "jaccard-docs", self.parts, "doc_id")
        return self.stored.table()

    def frequent(self, texts: DataFrame):
        """The ranks of tokens by their first RANK_BITS bits: eight times the logarithm of how many sets hold a frequent one, else 0."""
        words, bits = self.words, self.bits
        packed = texts.mapInArrow(lambda it: _packed(it, words, bits), "bucket long, low binary")
        dealt = packed.repartition(self.parts, "bucket").sortWithinPartitions("bucket")
        counts = written(dealt.mapInArrow(lambda it: _counted(it, MIN_FREQUENT), "code long, sets long"), "frequent-tokens")
        group = F.shiftright("code", bits + 24 - RANK_BITS).cast("int").alias("g")
        found = counts.groupBy(group).agg(F.least(F.floor(F.log2(F.max("sets")) * 8), F.lit(255)).cast("short").alias("rank")).toArrow()
        ranks = np.zeros(1 << RANK_BITS, np.uint8)
        ranks[found.column("g").to_numpy()] = found.column("rank").to_numpy()
        release(counts)
        return self.spark.sparkContext.broadcast(ranks)

    def lists(self, classes: DataFrame) -> DataFrame:
        """token, rep, n, i, r: inverted lists of two classes or more, for prefixes of heavy sets and subsets of light ones.

        i is the token's place in its set's order, r its place among the tokens that are in such a list.
        """
        words, num, den = self.words, self.num, self.den
        self.few = classes.count() <= MAX_BROADCAST_ROWS
        texts = self.of_classes(classes)
        frequent = self.frequent(texts)
        post = texts.mapInArrow(lambda it: _postings(it, words, num, den, frequent), "rep long, n int, tokens array<long>")
        post = written(post, "postings")
        cut = F.expr(f"slice(tokens, 1, cast(n - ceil({num} * n / {den}D) + 1 as int))")
        rows = post.select("rep", "n", F.posexplode(cut).alias("i", "token"))
        size = F.count("*").over(Window.partitionBy("token"))
        shared = written(rows.withColumn("size", size).where("size > 1"), "shared-tokens")
        most = self.boundary = self._boundary(post, shared)
        heavy = shared.where(F.col("n") >= -((-num * (most + 1)) // den))
        place = F.row_number().over(Window.partitionBy("rep", "n").orderBy("i")) - 1
        heavy = heavy.select("token", "rep", "n", "i", place.alias("r"))
        light = post.where(F.col("n") <= most).mapInArrow(lambda it: _subsets(it, num, den, most), "token long, rep long, n int")
        light = light.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1")
        light = light.select("token", "rep", "n", F.lit(0).alias("i"), F.lit(0).alias("r"))
        out = written(heavy.unionByName(light), "lists")
        release(post, shared)
        return out

    def _boundary(self, post: DataFrame, shared: DataFrame) -> int:
        """The size up to which showing all subsets costs less than scanning the inverted lists would.

        A subset is a row, and sets that share one are linked but for their sizes. A list is read entry by entry, and
        an entry may be a pair to check on whole sets. Sizes are taken together from the smallest up.
        """
        sets = {r["n"]: r["count"] for r in post.where(F.col("n") <= LIGHT_LIMIT).groupBy("n").count().collect()}
        scans = {r["n"]: r["rows"] for r in shared.where(F.col("n") <= LIGHT_LIMIT).groupBy("n").agg(F.sum("size").alias("rows")).collect()}
        best = spent = saved = 0
        for n in range(1, LIGHT_LIMIT + 1):
            spent += sets.get(n, 0) * sum(comb(n, c) for c in subset_sizes(n, self.num, self.den, LIGHT_LIMIT))
            saved += scans.get(n, 0) * CHECK_COST + sets.get(n, 0) * prefix_length(n, self.num, self.den)
            if spent <= saved:
                best = n
        return best

    def possible(self, a: str, b: str):
        """Whether sizes and places leave room for enough common elements: before a common token no more than r
        are common, after it no more than the rest of either set."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        rest = F.least(n - F.col(f"{a}.i"), m - F.col(f"{b}.i"))
        room = F.least(F.col(f"{a}.r"), F.col(f"{b}.r")) + rest
        return (room * (self.num + self.den) >= self.num * (n + m)) & (F.least(n, m) * self.den >= F.greatest(n, m) * self.num)

    def labelled(self, lists: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return lists.withColumn("component", F.col("rep"))
        own = labels.select(F.col("node").alias("rep"), "component")
        return written(lists.join(own.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled-lists")

    def open_lists(self, lists: DataFrame) -> DataFrame:
        """The lists that still hold more than one component, with their pivot: the set with the token nearest its front."""
        heads = lists.groupBy("token").agg(F.min_by(F.struct("rep", "n", "i", "r", "component"), F.struct("i", "rep")).alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
        return heads.where("lo <> hi").select("token", "p", "size")

    def star(self, lists: DataFrame) -> DataFrame:
        """One pair (a, b and their components c_a, c_b) for each set at most: with the pivot that it shares most lists with."""
        pivot = self.open_lists(lists).alias("h")
        met = lists.alias("x").join(pivot.hint("merge"), F.col("x.token") == F.col("h.token")).select(F.col("x.rep").alias("b"), F.struct("x.n", "x.i", "x.r", "x.component").alias("x"), F.col("h.p").alias("p"))
        met = met.where((F.col("p.component") != F.col("x.component")) & self.possible("x", "p"))
        counts = met.groupBy("b", F.col("x.component").alias("c_b"), F.col("p.rep").alias("a"), F.col("p.component").alias("c_a")).agg(F.count("*").alias("lists"))
        best = counts.groupBy("b", "c_b").agg(F.max_by(F.struct("a", "c_a"), F.struct("lists", -F.col("a"))).alias("p"))
        return best.select("p.a", "b", "p.c_a", "c_b")

    def rest(self, lists: DataFrame) -> DataFrame:
        """Every possible pair (as of ``star``) of sets of different components that share a list; a long list is met part by part.

        A pair isn't given again at a list where both sets were in one of the other's last LOOK_BACK lists before; at the first list that they
        share there is none, so no pair is left out, and edits of one text aren't given once for each of their many common lists.
        """
        open_ = self.open_lists(lists).select("token", F.ceil(F.col("size") / LIST_PART).cast("int").alias("parts"))
        before = F.collect_list("token").over(Window.partitionBy("rep").orderBy("i", "token").rowsBetween(-LOOK_BACK, -1))
        rows = written(lists.join(open_.hint("merge"), "token").withColumn("before", before), "open-lists")
        x = rows.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).alias("x")
        y = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
        pairs = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & self.possible("x", "y") & ~F.arrays_overlap("x.before", "y.before"))
        return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.component").alias("c_a"), F.col("y.component").alias("c_b")).distinct()

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The components of the pairs whose sets are similar enough, counted exactly."""
        num, den = self.num, self.den
        with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("set_b")).hint("merge"), "b")
        with_a = with_b.join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("set_a")).hint("merge"), "a")
        return written(with_a.select("c_a", "c_b", "set_a", "set_b").mapInArrow(lambda it: _linked(it, num, den), "a long, b long"), "links")

    def run(self) -> DataFrame:
        words = self.words
        keys = written(self.docs.mapInArrow(lambda it: _set_keys(it, words), "doc_id long, text_id binary, n long, set_key binary"), "set-keys")
        classes = keys.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
        # numbers in the order of doc_id, as a doc_id may stand on rows of different texts
        in_order = classes.repartitionByRange(self.parts, "doc_id", "set_key").sortWithinPartitions("doc_id", "set_key")
        classes = written(in_order.withColumn("rep", F.monotonically_increasing_id()), "classes")
        lists = self.lists(classes)
        labels = None
        for pick in (self.star, self.star, self.rest):
            own = self.labelled(lists, labels)
            pairs = written(pick(own), "pairs")
            if labels is not None:
                release(own)
                if pairs.isEmpty():
                    release(pairs)
                    continue
            members = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
            wanted = classes.join(members.hint("merge"), "rep", "left_semi")
            wanted = wanted if self.few else written(wanted, "members")
            sets = written(self.of_classes(wanted).mapInArrow(lambda it: _set_rows(it, words), "rep long, elements binary"), "sets")
            found = self.links(pairs, sets)  # of whole components
            release(sets, *([] if self.few else [wanted]))
            joined = components(found)
            release(pairs, found)
            if labels is not None:
                wider = joined.select(F.col("node").alias("component"), F.col("component").alias("wider"))
                kept = labels.join(wider.hint("merge"), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
                joined = kept.unionByName(joined.join(labels.select("node").hint("merge"), "node", "left_anti"))
            labels = written(joined, "component-labels")
        release(lists)
        if self.stored is not None:
            self.stored.drop()
        heads = classes.select(F.col("rep").alias("component"), F.col("doc_id").alias("smallest"))
        moved = labels.where("node <> component").join(heads.hint("merge"), "component").select(F.col("node").alias("rep"), "smallest")
        own = classes.join(moved.hint("merge"), "rep", "left").select("set_key", F.coalesce("smallest", "doc_id").alias("component"))
        out = keys.join(own.hint("merge"), "set_key", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_id")


def text_id(text):
    """What tells a row's text from the other texts of its doc_id: its md5 (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, text_id: connected components of documents with Jaccard similarity >= num/den.

    Sets are distinct ``words``-word shingles (ASCII white space, A-Z lower-cased; a shorter text is one shingle).
    Equal sets become one class first. A class is light up to a size chosen by cost: light sets show all subsets of
    the sizes that any link among them must share; heavy ones are found by scanning the inverted lists of their rarest
    tokens, which any linked set shares. Every link that counts is checked on the full sets; pairs inside a
    component that is known already are skipped, so a group of copies costs about a pair each, not all pairs.

    Words and shingles are told apart by scrambled 64-bit hashes, so a set is exact but for their chance collisions.

    Null or empty texts have no set and stay alone; so do rows with a null doc_id (component null). Repeated rows
    give a row each; rows that share a doc_id are judged by their own text, so that a doc_id with several texts may be
    in several components. Texts equal but for white space and A-Z are one set. An empty table gives no rows. Extra
    columns are ignored. The session's bounds of Arrow batches are lowered, as ``modest_batches`` says.
    """
    modest_batches(docs.sparkSession)
    return JaccardJoin(docs, words, num, den).run()


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, num=85, den=100).drop("text_id")


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
SQL = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)"""
}
