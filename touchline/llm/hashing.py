"""Vectorised word hashing over whole batches of texts."""

from __future__ import annotations

import numpy as np

#: White space as the word contracts define it, and A-Z to lower case, as byte tables.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: What sets the lanes of a word apart by their place, and the word's length from its bytes.
_PLACE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The bytes of a lane that belong to the word, by how many there are.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and how many words each text has.

    A word is read in lanes of eight bytes. Each lane is scrambled together with its place before the lanes are added, and
    their sum together with the word's length, so that no word's hash follows from the hashes of its parts.
    """
    raw = np.frombuffer(b" ".join(texts) + b" " * 8, np.uint8)
    if fold:
        raw = FOLD[raw]
    space = SPACE[raw]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    lengths = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]])) - begins
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), 0, (1,))  # the eight bytes from each place on
    n_lanes = (lengths + 7) >> 3
    first = np.cumsum(n_lanes) - n_lanes
    place = np.arange(int(n_lanes.sum())) - np.repeat(first, n_lanes)
    left = np.repeat(lengths, n_lanes) - 8 * place
    own = lanes[np.repeat(begins, n_lanes) + 8 * place] & _OWN[np.minimum(left, 8)]
    own = mix(mix(own + _PLACE) + place.astype(np.uint64) * _LENGTH)
    words = mix((np.add.reduceat(own, first) if len(first) else own) ^ lengths.astype(np.uint64) * _LENGTH)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return words, np.diff(np.searchsorted(begins, starts))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct n-word shingles of one text, ascending; fewer words are one shingle, none are none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        n = len(words)
    h = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        h = mix(h + words[k : len(words) - n + 1 + k] * np.uint64(2 * k + 3))
    return np.unique(h)
