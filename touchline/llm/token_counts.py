"""Token counts by section: encode a document once, then give each token to the section that its span falls in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import base_columns, table
from .subwords import bytes_of, encoder, parts

#: Who gets a token that crosses a boundary: the section of its first or last character, or the one
#: that holds most of its characters (the earlier of two that hold as many).
RULES = ("first", "last", "most")


def allot(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token and whether it crosses a boundary. bounds: ascending starts of the sections."""
    lasts = np.maximum(ends - 1, starts)
    first, last = np.searchsorted(bounds, starts, "right") - 1, np.searchsorted(bounds, lasts, "right") - 1
    crosses = first != last
    if rule == "first":
        return first, crosses
    if rule == "last":
        return last, crosses
    owner = first.copy()
    for k in np.flatnonzero(crosses):  # few tokens cross, and a token spans few sections
        cuts = np.concatenate([[starts[k]], bounds[first[k] + 1 : last[k] + 1], [ends[k]]])
        owner[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return owner, crosses


def line_bounds(raw: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The code points at which lines start, in texts one after another that start at ``base``; a line's newline belongs to it."""
    chars = np.cumsum((raw & 0xC0) != 0x80)
    return np.sort(np.concatenate([base[:-1], np.setdiff1d(chars[raw == 10], base)]))


def given_bounds(sections: list, base: np.ndarray) -> np.ndarray:
    """The same for sections that each text lists, position by position."""
    own = [np.unique([0, *(s for s in listed or () if s is not None and 0 < s < b - a)]) + a for listed, a, b in zip(sections, base[:-1].tolist(), base[1:].tolist(), strict=True)]
    return np.concatenate([*own, np.zeros(0)]).astype(np.int64)


def _counted(batches, path: str, rule: str, given: bool):
    coder = encoder(path)
    for batch in batches:
        for part in parts(batch):
            _, starts, ends, _, base = coder.spans(part.column("text"))
            bounds = given_bounds(part.column("sections").to_pylist(), base) if given else line_bounds(bytes_of(part.column("text"))[0], base)
            owner, crosses = allot(starts, ends, bounds, rule)  # no token lies across texts
            # an empty text has one section, at the place where the next text starts
            first = np.searchsorted(bounds, base[:-1]) + np.arange(len(base) - 1) - np.searchsorted(base[:-1], base[:-1])
            rows = np.repeat(np.arange(len(base) - 1), np.diff(np.append(first, len(bounds))))
            counts = [np.arange(len(bounds)) - first[rows], np.diff(np.append(bounds, base[-1])), np.bincount(owner, minlength=len(bounds)), np.bincount(owner[crosses], minlength=len(bounds))]
            taken = part.select([n for n in part.schema.names if n not in ("text", "sections")]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x.astype(np.int64)) for x in counts)], names=[*taken.schema.names, "section", "n_chars", "n_tokens", "n_crossing"])


def count_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", carry: tuple[str, ...] = ("doc_id",), sections: str | None = None) -> DataFrame:
    """One row per document section: the carried columns, section (from 0), n_chars, n_tokens, n_crossing.

    ``sections`` names an array column with the character positions at which sections start (0 always is one;
    nulls, repeats, negative positions and those past the end are left out); without it, sections are lines. Tokens whose span
    crosses a section boundary are counted once, in the section that ``rule`` names, and in its n_crossing.
    Columns to carry that have a name of the result (section, n_chars, n_tokens, n_crossing) are left out. The n_tokens of a document's sections sum to the length of its encoding. A null or empty text is one
    section without characters or tokens. Repeated rows are counted each. An empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule!r}")
    names = [c for c in carry if c not in ("text", "sections", "section", "n_chars", "n_tokens", "n_crossing")]
    rows = base_columns(docs, *names, "text")
    if sections:
        rows = docs.select(*[docs[n] for n in names], docs["text"], docs[sections].cast("array<long>").alias("sections"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", section long, n_chars long, n_tokens long, n_crossing long"
    return rows.mapInArrow(lambda it: _counted(it, tokenizer, rule, bool(sections)), schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), carry=("doc_id", "source", "lang"))


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict = {}
