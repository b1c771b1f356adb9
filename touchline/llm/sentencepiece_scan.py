"""SentencePiece encoding and decoding with a max-plus scan over the chunks of giant documents.

The vocabulary files at hand are of BPE type, so the lattice is scored as BPE needs it: a path of pieces is worth 0
when every two neighbours could stand side by side after merging (merging their text gives just these two pieces)
and minus infinity otherwise. One path of a text is worth 0: its BPE encoding. In this max-plus algebra a chunk is a
matrix from the pieces that may lie across its left edge to those that may lie across its right edge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import modest_batches, release, table, written
from .subwords import Units, bytes_of, parts

MARK = "▁"  # stands for a space inside pieces
WHOLE = "-1,-1,-1"  # the state of an edge that no piece lies across


class Pieces:
    """A SentencePiece BPE model: its pieces, encoding of short units, and the lattice."""

    def __init__(self, path: str, keep: int = 60_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("a BPE model that takes text as it is, with a space put before it, is asked for")
        proto.normalizer_spec.add_dummy_prefix = False  # chunks that don't start a document have no space before them
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        n = self.model.get_piece_size()
        self.ids = {}
        self.raw: list[bytes] = [b""] * n
        self.byte = [-1] * 256
        for k in range(n):
            if self.model.is_byte(k):
                self.byte[int(self.model.id_to_piece(k)[1:-1], 16)] = k
                self.raw[k] = bytes([int(self.model.id_to_piece(k)[1:-1], 16)])
            elif not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_unused(k)):
                self.ids[self.model.id_to_piece(k)] = k
                self.raw[k] = self.model.id_to_piece(k).replace(MARK, " ").encode()
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with a space after a letter aren't supported")
        self.spelled = pa.array(self.raw, pa.binary())
        self.known, self.fits = Units(keep, self._encoded), {}

    def _encoded(self, units: list[bytes]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.model.encode([u.decode() for u in units], num_threads=1)]

    def encode_column(self, column: pa.Array, begin: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that start at edges that no piece crosses, one after another, and how many each text has.

        begin: whether the texts start their documents; these have a space before them. Texts are cut into units that
        no piece lies across: a run of spaces with what follows, up to a space or newline.
        """
        column = pa.compute.replace_substring(pa.compute.fill_null(column, ""), MARK, " ")
        if begin:
            column = pa.compute.if_else(pa.compute.equal(column, ""), column, pa.compute.binary_join_element_wise(pa.scalar("", column.type), column, " "))
        raw, offsets = bytes_of(column)
        start = np.zeros(len(raw) + 1, bool)
        space, line = raw == 32, raw == 10
        start[:-1] = space | line
        start[1:-1] &= ~(space[1:] & space[:-1])
        start[1:] |= line
        start[offsets] = True
        return self.known.ids(raw, offsets, np.flatnonzero(start[:-1]))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_column(pa.array([text]), False)[0]

    # The lattice. Text here is marked text (spaces as MARK); a node is (start, stop, piece).

    def forced(self, s: str, p: int) -> bool:
        """Whether no piece can lie across position p of the marked text."""
        if p <= 0 or p >= len(s):
            return True
        return (s[p] == MARK and s[p - 1] != MARK) or s[p] not in self.ids or s[p - 1] not in self.ids

    def at(self, s: str, p: int) -> list[tuple[int, str]]:
        """Stops and pieces of the nodes that start at p; a character without a piece is one of its own."""
        found = [(p + n, s[p : p + n]) for n in range(1, min(self.longest, len(s) - p) + 1) if s[p : p + n] in self.ids]
        return found or [(p + 1, s[p])]

    def fit(self, a: str, b: str) -> bool:
        """Whether pieces a, b stay apart when their text is merged."""
        if a not in self.ids or b not in self.ids:
            return True
        had = self.fits.get((a, b))
        if had is None:
            if len(self.fits) > 100_000:
                self.fits.clear()
            had = self.model.encode((a + b).replace(MARK, " ")) == [self.ids[a], self.ids[b]]
            self.fits[a, b] = had
        return had

    def across(self, s: str, p: int) -> list[tuple[int, int, str]]:
        """Every node that starts before p and stops at p or later: the states of an edge that isn't forced."""
        return [(a, b, t) for a in range(max(0, p - self.longest), p) for b, t in self.at(s, a) if b >= p]

    def reach(self, s: str, sources: dict, stop: int) -> tuple[dict, dict]:
        """Max-plus vectors along the lattice: which sources (bits) reach each node that starts before ``stop``.

        sources: node or (p, p, None) for a forced edge at p -> bits. Returns node -> bits and node -> previous node.
        """
        by_stop: dict[int, dict] = {}
        for node, bits in sources.items():
            by_stop.setdefault(node[1], {})[node] = bits
        seen: dict = {}
        back: dict = {}
        p = min(by_stop, default=stop)
        while p < stop:
            lasts = by_stop.pop(p, None)
            if lasts:
                for b, t in self.at(s, p):
                    bits, prev = 0, None
                    for node, own in lasts.items():
                        if node[2] is None or self.fit(node[2], t):
                            bits, prev = bits | own, node
                    if bits:
                        node = (p, b, t)
                        seen[node], back[node] = bits, prev
                        by_stop.setdefault(b, {})[node] = bits
            p += 1
        return seen, back


_MADE: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _MADE:
        _MADE[path] = Pieces(path)
    return _MADE[path]


def _spots(node: tuple, edge: int, model: Pieces) -> str:
    """A state's name as both chunks at an edge know it: its reach to either side and its piece."""
    return WHOLE if node[2] is None else f"{edge - node[0]},{node[1] - edge},{model.ids.get(node[2], -2)}"


class Chunk:
    """Marked text from ``left`` characters before the chunk to some after it, and the chunk's edges in it."""

    def __init__(self, model: Pieces, text: str, a: int, b: int, first: bool, final: bool):
        self.model, self.s, self.a, self.b = model, text, a, b
        forced = model.forced
        self.entries = [(a, a, None)] if first or forced(text, a) else model.across(text, a)
        self.exits = [(b, b, None)] if final or forced(text, b) else model.across(text, b)
        stops = max(e[1] for e in self.entries)
        self.p = next((x for x in range(stops, b + 1) if (x < b or self.exits[0][2] is None) and (x == a and self.entries[0][2] is None or forced(text, x))), None)
        self.q = None if self.p is None else next(x for x in range(b, self.p - 1, -1) if x == self.p or (forced(text, x) if x < b else self.exits[0][2] is None))

    def _head(self):
        """Which entries reach the first forced edge p, and how."""
        sources = {e: 1 << k for k, e in enumerate(self.entries)}
        seen, back = self.model.reach(self.s, sources, self.p)
        ends = {n: x for n, x in (seen | sources).items() if n[1] == self.p}
        return ends, back

    def matrix(self) -> list[tuple[str, str]]:
        """The (entry, exit) pairs worth 0; all others are worth minus infinity."""
        name_in = [_spots(e, self.a, self.model) for e in self.entries]
        if self.p is not None:
            ends, _ = self._head()
            bits = 0
            for x in ends.values():
                bits |= x
            if self.exits[0][2] is None:
                outs = [WHOLE]
            else:
                seen, _ = self.model.reach(self.s, {(self.q, self.q, None): 1}, self.b)
                outs = [_spots(n, self.b, self.model) for n in self.exits if n in seen]
            return [(i, o) for k, i in enumerate(name_in) if bits >> k & 1 for o in outs]
        sources = {e: 1 << k for k, e in enumerate(self.entries)}
        seen, _ = self.model.reach(self.s, sources, self.b)
        return [(i, _spots(n, self.b, self.model)) for n in self.exits for k, i in enumerate(name_in) if (seen | sources).get(n, 0) >> k & 1]

    def _walk(self, node, back, sources) -> list[str]:
        out = []
        while node not in sources:
            out.append(node[2])
            node = back[node]
        return out[::-1]

    def _ids(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for t in texts:
            k = self.model.ids.get(t)
            out += [k] if k is not None else [self.model.byte[x] for x in t.encode()]
        return out

    def trace(self, entry: str, leave: str) -> np.ndarray:
        """ids of the pieces that start in this chunk, on the one path from entry to exit."""
        start = next(e for e in self.entries if _spots(e, self.a, self.model) == entry)
        stop = next(e for e in self.exits if _spots(e, self.b, self.model) == leave)
        if self.p is None:
            if stop == start:  # one piece lies across the whole chunk
                return np.zeros(0, "<u4")
            _, back = self.model.reach(self.s, {start: 1}, self.b)
            return np.array(self._ids(self._walk(stop, back, {start})), "<u4")
        parts = []
        if start[1] < self.p:
            seen, back = self.model.reach(self.s, {start: 1}, self.p)
            parts.append(np.array(self._ids(self._walk(next(n for n in seen if n[1] == self.p), back, {start})), "<u4"))
        parts.append(self.model.encode(self.s[self.p : self.q]))
        if stop[2] is not None:
            source = (self.q, self.q, None)
            _, back = self.model.reach(self.s, {source: 1}, self.b)
            parts.append(np.array(self._ids(self._walk(stop, back, {source})), "<u4"))
        return np.concatenate(parts)


def _chunk_of(row: dict, model: Pieces) -> Chunk:
    return Chunk(model, row["piece"], row["a"], row["b"], row["chunk"] == 0, row["final"])


def _cut(batches, chunk: int, margin: int):
    """Chunks of the giant texts, each with a margin of its neighbours' text."""
    for batch in batches:
        for doc, text in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            s = MARK + text.replace(" ", MARK)
            rows = []
            for k, a in enumerate(range(0, len(s), chunk)):
                left, b = max(0, a - margin), min(len(s), a + chunk)
                rows.append({"row_id": doc, "chunk": k, "block": k // 256, "a": a - left, "b": b - left, "final": b == len(s), "piece": s[left : b + margin]})
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, schema=_CHUNK)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_CHUNK)


_CHUNK = pa.schema([("row_id", pa.string()), ("chunk", pa.int32()), ("block", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("final", pa.bool_()), ("piece", pa.string())])
_SCHEMAS = {
    ("block", "ins", "outs"): pa.schema([("row_id", pa.string()), ("block", pa.int32()), ("ins", pa.list_(pa.string())), ("outs", pa.list_(pa.string()))]),
    ("block", "enter", "leave"): pa.schema([("row_id", pa.string()), ("block", pa.int32()), ("enter", pa.string()), ("leave", pa.string())]),
    ("chunk", "enter", "leave"): pa.schema([("row_id", pa.string()), ("chunk", pa.int32()), ("enter", pa.string()), ("leave", pa.string())]),
}
_CHUNK_DDL = "row_id string, chunk int, block int, a int, b int, final boolean, piece string"


def _matrices(batches, path: str):
    model = pieces(path)
    for batch in batches:
        rows = batch.to_pylist()
        pairs = [_chunk_of(r, model).matrix() for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("chunk"), batch.column("block"), pa.array([[i for i, _ in p] for p in pairs], pa.list_(pa.string())), pa.array([[o for _, o in p] for p in pairs], pa.list_(pa.string()))],
            names=["row_id", "chunk", "block", "ins", "outs"],
        )


def product(x: list[tuple[str, str]], y: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The max-plus product of two matrices, kept as their pairs worth 0. It is associative."""
    after: dict[str, list[str]] = {}
    for i, o in y:
        after.setdefault(i, []).append(o)
    return sorted({(i, o) for i, m in x for o in after.get(m, ())})


def resolve(steps: list[list[tuple[str, str]]], start: str, stop: str) -> list[tuple[str, str]]:
    """The state at either edge of every step on the one path from start to stop."""
    ahead = [{start}]
    for m in steps:
        ahead.append({o for i, o in m if i in ahead[-1]})
    state, out = stop, []
    for k in range(len(steps) - 1, -1, -1):
        before = next(i for i, o in steps[k] if o == state and i in ahead[k])
        out.append((before, state))
        state = before
    return out[::-1]


def _in_groups(batches, keys: tuple[str, ...], finish, names: list[str]):
    """Rows sorted by ``keys``, group by group, through ``finish``: a group's rows to rows of ``names``."""
    last, rows, out = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != last and rows:
                out += finish(rows)
                rows = []
            last = key
            rows.append(row)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_SCHEMAS[tuple(names[1:])])
            out = []
    if rows:
        out += finish(rows)
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_SCHEMAS[tuple(names[1:])])


def _pairs(row: dict) -> list[tuple[str, str]]:
    return list(zip(row["ins"], row["outs"], strict=True))


def _block_product(rows: list[dict]) -> list[tuple]:
    total = _pairs(rows[0])
    for row in rows[1:]:
        total = product(total, _pairs(row))
    return [(rows[0]["row_id"], rows[0]["block"], [i for i, _ in total], [o for _, o in total])]


def _across_blocks(rows: list[dict]) -> list[tuple]:
    return [(r["row_id"], r["block"], *s) for r, s in zip(rows, resolve([_pairs(r) for r in rows], WHOLE, WHOLE), strict=True)]


def _within_block(rows: list[dict]) -> list[tuple]:
    states = resolve([_pairs(r) for r in rows], rows[0]["enter"], rows[0]["leave"])
    return [(r["row_id"], r["chunk"], *s) for r, s in zip(rows, states, strict=True)]


def _traced(batches, path: str):
    model = pieces(path)
    for batch in batches:
        ids = [_chunk_of(r, model).trace(r["enter"], r["leave"]).tobytes() for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("chunk"), pa.array(ids, pa.binary())], names=["row_id", "chunk", "ids"])


def _whole(batches, path: str):
    """Texts of a single chunk: both edges are forced, so nothing has to be scanned."""
    model = pieces(path)
    for batch in batches:
        for part in parts(batch, size=1_000_000):
            ids, counts = model.encode_column(part.column("text"), True)
            rest = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), _blobs(ids, counts)], names=[*rest, "ids"])


def _blobs(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each text's ids as bytes."""
    at = np.append(0, np.cumsum(counts * 4)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids))])


def encode_pieces(docs: DataFrame, model: str, chunk: int = 16384, key: str = "doc_id") -> DataFrame:
    """``key`` and ids (little-endian unsigned 32-bit): the model's encoding of every text.

    Texts of more than ``chunk`` characters are cut there, wherever that falls. Each chunk yields its transfer matrix
    between the states of its edges; matrices are multiplied in blocks of 256 chunks, then block by block, and the
    states found that way let every chunk be traced back by itself. So no task holds more than some chunks of a
    giant text, and the result doesn't depend on ``chunk``. Equal giant texts are cut and traced once.

    A null or empty text has no ids. U+2581 counts as a space, as in the model. Repeated rows give a row each.
    An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    giant = F.char_length("text") > chunk
    small = rows.where(~giant).mapInArrow(lambda it: _whole(it, model), f"key {kind}, ids binary").select("key", "ids")
    margin = 64 + _longest(model)
    names = written(rows.where(giant).select("key", F.sha2("text", 256).alias("row_id"), "text"), "giant-texts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = names.groupBy("row_id").agg(F.first("text").alias("text"))
    cut = written(once.mapInArrow(lambda it: _cut(it, chunk, margin), _CHUNK_DDL).repartition(n, "row_id", "chunk"), "giant-chunks")
    spread = cut.repartition(n, "row_id", "chunk")
    edges = written(spread.mapInArrow(lambda it: _matrices(it, model), "row_id string, chunk int, block int, ins array<string>, outs array<string>"), "chunk-matrices")
    dealt = edges.repartition(n, "row_id", "block").sortWithinPartitions("row_id", "block", "chunk")
    blocks = dealt.mapInArrow(lambda it: _in_groups(it, ("row_id", "block"), _block_product, ["row_id", "block", "ins", "outs"]), "row_id string, block int, ins array<string>, outs array<string>")
    in_order = blocks.repartition(n, "row_id").sortWithinPartitions("row_id", "block")
    found = in_order.mapInArrow(lambda it: _in_groups(it, ("row_id",), _across_blocks, ["row_id", "block", "enter", "leave"]), "row_id string, block int, enter string, leave string")
    met = edges.join(found.hint("merge"), ["row_id", "block"]).repartition(n, "row_id", "block").sortWithinPartitions("row_id", "block", "chunk")
    states = met.mapInArrow(lambda it: _in_groups(it, ("row_id", "block"), _within_block, ["row_id", "chunk", "enter", "leave"]), "row_id string, chunk int, enter string, leave string")
    states = written(states, "chunk-states")
    release(edges)
    traced = cut.join(states.hint("merge"), ["row_id", "chunk"]).mapInArrow(lambda it: _traced(it, model), "row_id string, chunk int, ids binary")
    whole = traced.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    large = names.select("key", "row_id").join(whole.hint("merge"), "row_id").select("key", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
    return small.unionByName(large).withColumnRenamed("key", key)


def _longest(model: str) -> int:
    return pieces(model).longest


def _decoded(batches, path: str):
    model = pieces(path)
    for batch in batches:
        for part in parts(batch, "ids", 1_000_000):
            raw, offsets = bytes_of(part.column("ids"))
            counts = np.diff(offsets) // 4
            said, stops = bytes_of(model.spelled.take(pa.array(np.frombuffer(raw.tobytes(), "<u4"))))
            ends = stops[np.append(0, np.cumsum(counts))].tolist()
            whole = said.tobytes()
            texts = [whole[a + 1 : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]  # the first space stands for the start
            rest = [n for n in part.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], names=[*rest, "n_tokens", "text"])


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """All columns but ids, with n_tokens and the text that the ids stand for.

    Ids of control pieces stand for nothing. Null ids, like an empty list of them, are no tokens and an empty text. Bytes
    that are no UTF-8 become U+FFFD. Repeated rows give a row each. An empty table gives no rows. Columns n_tokens
    and text of the input are replaced.
    """
    encoded = encoded.drop("n_tokens", "text")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema.fields if f.name != "ids")
    return encoded.mapInArrow(lambda it: _decoded(it, model), f"{kinds}n_tokens long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(table(spark, sf_dir, "documents"), model)
    decoded = decode_pieces(encoded.withColumn("ids_crc32", F.crc32("ids")), model)
    return decoded.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
SQL: dict = {}
