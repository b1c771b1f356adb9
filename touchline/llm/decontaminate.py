"""Benchmark decontamination: pigeonhole edit matching with Myers' bit-parallel verification."""

from __future__ import annotations

import math
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import modest_batches, table, written

_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    """Lower case; runs of ASCII characters that are no letters or digits become one space. UTF-8."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_BLANK).split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length, each with its start: an occurrence with at
    most ``budget`` edits leaves at least one of them whole."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of the text, and where the first such one ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        match = masks.get(c, 0)
        cross = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(cross | plus) & full
        down = plus & cross
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full  # a match may start anywhere in the text
        plus = (down | ~((match | minus) | up)) & full
        minus = up & (match | minus)
        if score < best:
            best, at = score, j + 1
    return best, at


def _unspaced(c: str) -> bool:
    """Letters of scripts that put no spaces between words: wide ones (Chinese, Japanese), Thai, Lao, Burmese, Khmer."""
    return unicodedata.east_asian_width(c) in "WF" or "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff"


def joined(a: str, b: str) -> bool:
    """Whether two neighbouring characters are of one word, so that no item may end between them."""
    return a.isalnum() and b.isalnum() and not _unspaced(a) and not _unspaced(b)


class Matcher:
    """An automaton over the pieces of a bounded block of items; those under ``min_chars`` are one piece each."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        import ahocorasick

        self.items = []
        table_: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            budget = math.floor(rate * len(text)) if len(text) >= min_chars else 0
            for start, piece in pieces(text, budget):
                key = piece.encode().decode("latin-1")
                table_.setdefault(key, []).append((len(self.items), len(text[:start].encode()) + len(key)))
            self.items.append((item_id, text, len(text.encode()), budget, len(text) < min_chars))
        self.automaton = ahocorasick.Automaton()
        for key, value in table_.items():
            self.automaton.add_word(key, value)
        if table_:
            self.automaton.make_automaton()
        self.empty = not table_

    def find(self, doc: bytes) -> list[tuple[int, int, int, int, bool]]:
        """(item_id, distance, start, stop, short) of the best occurrence of each item within its budget, in code points."""
        if self.empty:
            return []
        windows: dict[int, set[int]] = {}
        exact: dict[int, int] = {}
        for end, owners in self.automaton.iter(doc.decode("latin-1")):
            for item, reach in owners:
                if not self.items[item][4]:
                    windows.setdefault(item, set()).add(end + 1 - reach)
                elif item not in exact and self._apart(doc, item, end + 1 - reach):
                    exact[item] = end + 1 - reach
        found = []
        for item, start in exact.items():
            base = len(doc[:start].decode())
            found.append((self.items[item][0], 0, base, base + len(self.items[item][1]), True))
        for item, starts in windows.items():
            item_id, text, size, budget, _ = self.items[item]
            slack, best, stop_at = 4 * budget + 4, None, 0
            for start in sorted(starts):
                if start + size + slack <= stop_at:
                    continue  # the last window went that far
                a, b = max(0, start - slack), min(len(doc), start + size + 2 * slack)
                stop_at = b
                window = doc[a:b].decode("utf-8", "ignore")
                distance, end = myers(text, window)
                if distance <= budget and (best is None or distance < best[0]):
                    length = myers(text[::-1], window[:end][::-1])[1]
                    base = len(doc[:a].decode("utf-8", "ignore"))
                    best = (distance, base + end - length, base + end)
            if best:
                found.append((item_id, *best, False))
        return found

    def _apart(self, doc: bytes, item: int, start: int) -> bool:
        """Whether the item stands at ``start`` in whole words."""
        _, text, size, *_ = self.items[item]
        before, after = doc[max(0, start - 4) : start].decode("utf-8", "ignore"), doc[start + size : start + size + 4].decode("utf-8", "ignore")
        return not (before and joined(before[-1], text[0])) and not (after and joined(text[-1], after[0]))


#: Automata of this worker process, by the block they stand for.
_MATCHERS: dict[str, Matcher] = {}


def _matched(batches, key: str, items, rate: float, min_chars: int):
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate, min_chars)
    find = _MATCHERS[key].find
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            rows += [(doc_id, *hit) for hit in find(normalise(text.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.bool_()) for k in range(6)], names=["doc_id", "item_id", "distance", "start", "stop", "short"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_chars: int = 16, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, distance, start, stop, short: benchmark items that occur in documents within their edit budget.

    An item's budget is floor(rate * its normalised length); distance counts code points, start and stop are
    positions in the normalised document, of the first of the best occurrences. Documents are read once for each
    block of about block_bytes of items, so what is sent to the tasks is bounded; nothing is shuffled.
    Items shorter than min_chars after normalisation have no budget and must stand in whole words, as far as their
    script parts words; their rows are marked ``short``, as such a passage may be there by chance. Items without
    letters or digits (null and empty ones too) can't be searched for; null and empty texts hold none. Null ids, of documents
    or of items, stay null. Repeated rows, of documents or of items, give a row each. Empty tables give no rows. Extra columns are ignored.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"])
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    out = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect() if blocks > 1 else items.collect()
        plain = sorted(((r["item_id"], normalise(r["text"]).decode()) for r in own), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        plain = [x for x in plain if x[1]]
        key = uuid.uuid4().hex
        found = docs.mapInArrow(lambda it, key=key, plain=plain: _matched(it, key, plain, rate, min_chars), "doc_id long, item_id long, distance long, start long, stop long, short boolean")
        if blocks > 1:  # one block after another, so that the driver holds one at a time
            found = written(found, "leaks-of-a-block")
        out = found if out is None else out.unionByName(found)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL: dict = {}
