"""Encoding with a tokenizers-library vocabulary inside tasks."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

LETTER, DIGIT, OTHER, BLANK, UNASKED = range(5)
#: What may follow a lone apostrophe as one pre-token with it (a fixed value of the byte-level pre-tokenizer).
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
#: Longer units are encoded whenever they come and kept nowhere, so that the dictionaries are bounded in bytes too.
LONGEST_KEPT = 64

#: Encoders that this worker process has made, so that its tasks share what they learn.
_MADE: dict = {}


def encoder(path: str) -> Encoder:
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty), row after row, and the offsets of its rows."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    column = pa.compute.fill_null(column, "" if text else b"").cast(pa.large_string() if text else pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batch: pa.RecordBatch, column: str = "text", size: int = 3_000_000, rows: int = 8192):
    """Slices of an Arrow batch with about so many bytes in ``column``, so that a task's working set stays small."""
    _, at = bytes_of(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = min(start + rows, max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def _pieces(whole, stops: np.ndarray) -> list:
    """A string or bytes cut at ``stops``, the last of which is its end."""
    at = stops.tolist()
    return [whole[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints in Latin-1, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Units:
    """Ids of units, in two dictionaries of at most ``keep`` units that hold what was encoded lately.

    Memory is bounded; a unit that fell out is encoded again. Long units are encoded whenever they come.
    """

    def __init__(self, keep: int, encode):
        self.keep, self.encode, self.young, self.old = keep, encode, {}, {}

    def __call__(self, units: list[bytes]) -> list[bytes]:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, units))
        if None in found:
            holes = [k for k, v in enumerate(found) if v is None]
            for k, had in zip(holes, map(self.old.get, [units[k] for k in holes]), strict=True):
                found[k] = had
            fresh = [k for k in holes if found[k] is None]
            if fresh:
                for k, ids in zip(fresh, self.encode([units[k] for k in fresh]), strict=True):
                    found[k] = ids
            self.young.update((units[k], found[k]) for k in holes if len(units[k]) <= LONGEST_KEPT)
        return found

    def ids(self, raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, cut into units at ``starts``, and how many ids each text has."""
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        spelled, stops = bytes_of(units.dictionary)
        own = self(_pieces(spelled.tobytes(), stops[1:]))
        flat = np.frombuffer(b"".join(own), "<u4")
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        at = np.cumsum(size) - size
        which = units.indices.to_numpy()
        each = size[which]
        ends = np.cumsum(each)
        ids = flat[np.repeat(at[which] - ends + each, each) + np.arange(ends[-1])]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(starts, offsets)])


class Encoder:
    """Whole texts to ids. For byte-level vocabularies each distinct pre-token is encoded once by the library.

    A byte-level BPE merges nothing across pre-tokens, so the ids of a text are those of its pre-tokens in order.
    Texts are cut into these in numpy, by the kinds of characters that the library's own pre-tokenizer tells
    (``_kind``); Arrow finds the distinct ones of a slice. Any other kind of tokenizer encodes
    whole texts directly. Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = (
            spec["model"]["type"] == "BPE" and not spec.get("normalizer") and not spec["model"].get("dropout") and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space") and all(t["special"] for t in spec["added_tokens"])
        )
        self.known = Units(keep, self._encoded)
        if self.by_unit:
            self.letters = _byte_letters()
            self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, k in spec["model"]["vocab"].items():
                self.lengths[k] = len(token)  # every character of a byte-level token stands for one byte
            self.kinds = np.full(0x110000, UNASKED, np.uint8)
            self.kinds[:128] = [self._kind(chr(c)) for c in range(128)]
            # the same model behind a plain separator: it gets pre-tokens that are cut and written in letters already
            spec["pre_tokenizer"], spec["post_processor"] = {"type": "CharDelimiterSplit", "delimiter": "\n"}, None
            self.model = Tokenizer.from_str(json.dumps(spec))
            self.model.encode_special_tokens = True

    def _kind(self, c: str) -> int:
        """Letter, digit, white space or other, as the library's pre-tokenizer sees it: by what it leaves the character with."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for before, kind in (("a", LETTER), ("1", DIGIT), ("!", OTHER)):
            if len(split(before + c)) == 1:
                return kind
        return BLANK

    def _kinds(self, raw: np.ndarray) -> np.ndarray:
        """The kind of every byte's character."""
        out = self.kinds[raw]  # right for ASCII
        at = np.flatnonzero(raw >= 0xC0)
        if len(at):
            b = [raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) for k in range(4)]
            tail = [x & 0x3F for x in b]
            size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
            code = np.where(size == 2, (b[0] & 0x1F) << 6 | tail[1], np.where(size == 3, (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2], (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]))
            kind = self.kinds[code]
            if (kind == UNASKED).any():
                for c in np.unique(code[kind == UNASKED]).tolist():
                    self.kinds[c] = self._kind(chr(c))
                kind = self.kinds[code]
            out[at] = kind
            for k in (1, 2, 3):
                more = size > k
                out[at[more] + k] = kind[more]
        return out

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in texts that lie one after another, each from its offset on.

        A pre-token is a run of letters, of digits or of others, with the one space before it; the rest of a run of white
        space but its last character; that character alone; or an apostrophe with one of SUFFIXES.
        """
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64)
        kinds = self._kinds(raw)
        heads = np.zeros(n + 1, bool)  # text starts, and the end
        heads[offsets] = True
        run = np.empty(n, bool)
        run[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=run[1:])
        run |= heads[:n]
        first = np.flatnonzero(run)
        last = np.append(first[1:], n)
        kind = kinds[first]
        starts = np.zeros(n + 1, bool)
        plain = np.flatnonzero(kind != BLANK)
        at = first[plain]
        spaced = (raw[at - 1] == 32) & ~heads[at]
        starts[at - spaced] = True
        blank = np.flatnonzero(kind == BLANK)
        starts[first[blank]] = True
        inner = last[blank][~heads[last[blank]]] - 1
        for _ in range(3):  # back to where the last character begins
            inner = inner - ((raw[inner] & 0xC0) == 0x80)
        starts[inner] = True
        quote = plain[(kind[plain] == OTHER) & (last[plain] - at == 1) & (raw[at] == 39) & ~spaced]
        quote = quote[(quote + 1 < len(first))]
        quote = quote[(kind[quote + 1] == LETTER) & ~heads[last[quote]]]
        if len(quote):
            begin, stop = last[quote], last[quote + 1]
            one, two = raw[begin], raw[np.minimum(begin + 1, n - 1)]
            long = np.zeros(len(quote), np.int64)
            for suffix in SUFFIXES:
                hit = one == ord(suffix[0])
                if len(suffix) == 2:
                    hit &= (two == ord(suffix[1])) & (stop - begin >= 2)
                long[hit] = len(suffix)
            begin, stop, long = begin[long > 0], stop[long > 0], long[long > 0]
            starts[begin] = False
            starts[(begin + long)[begin + long < stop]] = True
        return np.flatnonzero(starts[:n])

    def _encoded(self, units: list[bytes]) -> list[bytes]:
        """The library's ids of pre-tokens."""
        text = b"".join(units).decode("latin-1").translate(self.letters)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        spelled = "\n".join(_pieces(text, ends))
        ids = np.array(self.model.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        stops = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        return _pieces(ids.tobytes(), stops * 4)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column (null: empty), one after another, and how many each text has."""
        if not self.by_unit:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([k for ids in found for k in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)
        raw, offsets = bytes_of(column)
        return self.known.ids(raw, offsets, self.cuts(raw, offsets))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []

    def spans(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, where each token starts and the character after its last, tokens of each text, and where each text starts and the last ends.

        Positions count the code points of the column's texts one after another. A token that begins or ends inside a
        character spans that character whole, as in the library's offsets.
        """
        if not self.by_unit:
            texts = [t or "" for t in column.to_pylist()]
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            base = np.cumsum([0, *map(len, texts)])
            counts = np.array([len(e.ids) for e in found], np.int64)
            pairs = np.array([p for e in found for p in e.offsets], np.int64).reshape(-1, 2) + np.repeat(base[:-1], counts)[:, None]
            return np.array([k for e in found for k in e.ids], "<u4"), pairs[:, 0], pairs[:, 1], counts, base
        raw, offsets = bytes_of(column)
        ids, counts = self.encode_column(column)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        heads = (raw & 0xC0) != 0x80
        if heads.all():
            return ids, starts, ends, counts, offsets
        chars = np.append(0, np.cumsum(heads))  # bytes to characters: count the bytes that begin one
        return ids, np.maximum(chars[np.minimum(starts + 1, len(raw))] - 1, 0), chars[ends], counts, chars[offsets]


def groups(texts: list[str], chars: int = 400_000):
    """Slices of texts of about so many characters, so that a task's working set stays small."""
    start = total = 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
