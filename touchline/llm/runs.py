"""Words of many texts in one buffer, with one separator between any two, for operators on runs of words."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .shared import LOWER, UPPER, sliced

_MANY = re.compile(b"  +")
#: Bytes of texts taken together; a longer text is a buffer of its own.
BUFFER_BYTES = 1 << 20
#: Words looked at in one go, so that what is computed for each word stays small beside a very long text.
WORDS_AT_ONCE = 1 << 17


def folding(separators: bytes) -> bytes:
    """The byte table that lower-cases A-Z and turns every separator into a space."""
    return bytes.maketrans(UPPER.encode() + separators, LOWER.encode() + b" " * len(separators))


@dataclass
class Words:
    """The words of some texts: the buffer, where each word begins and ends, its text's place among the texts, and the
    first and last word of that text. ``rows`` are the texts' places in their batch, ``counts`` their words."""

    buffer: bytes
    begins: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rows: slice
    counts: np.ndarray

    def slices(self):
        """(from, to) of words, WORDS_AT_ONCE at most."""
        for lo in range(0, len(self.begins), WORDS_AT_ONCE):
            yield lo, min(lo + WORDS_AT_ONCE, len(self.begins))


def _together(texts: list[bytes], start: int) -> Words:
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    buffer = b" ".join([t for t in texts if t])
    gaps = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    any_ = [0] if buffer else []
    begins = np.concatenate([any_, gaps + 1]).astype(np.int64)
    ends = np.concatenate([gaps, [len(buffer)] if buffer else []]).astype(np.int64)
    stops = np.cumsum(counts)
    return Words(buffer, begins, ends, np.repeat(np.arange(len(texts)), counts), np.repeat(stops - counts, counts), np.repeat(stops - 1, counts), slice(start, start + len(texts)), counts)


def words_of(column: pa.Array, table: bytes):
    """Words objects that cover a column of texts (null: no words) in order."""
    held, total, start = [], 0, 0
    for k, raw in enumerate(column.cast(pa.binary()).to_pylist()):
        own = _MANY.sub(b" ", raw.translate(table)).strip(b" ") if raw else b""
        if held and total + len(own) > BUFFER_BYTES:
            yield _together(held, start)
            held, total, start = [], 0, k
        held.append(own)
        total += len(own)
    if held:
        yield _together(held, start)


def each(batches, table: bytes):
    """(batch slice, Words) over Arrow batches with a ``text`` column."""
    for batch in sliced(batches, 512):
        for words in words_of(batch.column("text"), table):
            yield batch.slice(words.rows.start, words.rows.stop - words.rows.start), words
