"""Whom a profile looks like among the players about its height, in numpy: players that look the same are counted, not met one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def vectors(column) -> tuple[np.ndarray, list[tuple]]:
    """Each row's place among the distinct vectors, and these."""
    seen: dict[tuple, int] = {}
    return np.array([seen.setdefault(tuple(v), len(seen)) for v in column.to_pylist()], np.int64), list(seen)


def cosines(one: tuple, others: dict[int, np.ndarray], n: int) -> np.ndarray:
    """1 - cosine of a vector and ``n`` others, given by length with their places last; as ``aggregates.cosine_distance`` has it, NaN for null and infinite for NaN."""
    out = np.full(n, np.nan)
    if len(one) in others and None not in one:
        many = others[len(one)]
        dot, own, all_ = np.zeros(len(many)), 0.0, np.zeros(len(many))
        with np.errstate(all="ignore"):
            for k, v in enumerate(one):
                dot, own, all_ = dot + many[:, k] * v, own + v * v, all_ + many[:, k] * many[:, k]
            norm = np.sqrt(all_) * np.sqrt(own)
            told = 1.0 - dot / norm
        some = ~(norm <= 0)
        out[many[:, -1].astype(np.int64)[some]] = np.where(np.isnan(told), np.inf, told)[some]
    return out


def by_length(some: list[tuple]) -> dict[int, np.ndarray]:
    out: dict[int, list] = {}
    for k, v in enumerate(some):
        if None not in v:
            out.setdefault(len(v), []).append((*v, k))
    return {n: np.array(rows, float) for n, rows in out.items()}


def within(heights: np.ndarray, at: np.ndarray, d: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The run (first, last + 1) of sorted distinct heights that are under ``margin`` farther from ``at`` than ``d``."""
    slack = 1e-9 * (1.0 + np.abs(at) + d + margin)
    first, last = np.searchsorted(heights, at - d - margin - slack, "left"), np.searchsorted(heights, at + d + margin + slack, "right")
    for _ in range(len(heights)):  # those about the edges, one by one
        off = first < last
        off[off] = ~(np.abs(at[off] - heights[first[off]]) - d[off] < margin)
        if not off.any():
            break
        first[off] += 1
    for _ in range(len(heights)):
        off = first < last
        off[off] = ~(np.abs(at[off] - heights[last[off] - 1]) - d[off] < margin)
        if not off.any():
            break
        last[off] -= 1
    return first, last


def most_alike(asked: pa.Table, players: pa.Table, margin: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``asked`` (at, d, fingerprint) and of ``players`` (player_id, resid, fingerprint): who looks like whom, by ``least`` more than the next one does.

    Players of one look that stand in a profile's margin only count as one, or as several that can't be told apart. So the work grows with profiles times
    looks, and memory with profiles and players.
    """
    at, d = (asked.column(c).to_numpy() for c in ("at", "d"))
    own, kinds = vectors(asked.column("fingerprint"))
    lengths = by_length(kinds)
    resid, ids = players.column("resid").to_numpy(), players.column("player_id").to_pylist()
    look, looks = vectors(players.column("fingerprint"))
    one, two = np.full(len(at), np.inf), np.full(len(at), np.inf)
    n, near = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    order = np.lexsort((resid, look))
    order = order[np.isfinite(resid[order])]
    edges = np.searchsorted(look[order], np.arange(len(looks) + 1))
    for k, vector in enumerate(looks):
        some, told = order[edges[k] : edges[k + 1]], cosines(vector, lengths, len(kinds))[own]
        rows = np.flatnonzero(~np.isnan(told))
        if not len(some) or not len(rows):
            continue
        heights, start = np.unique(resid[some], return_index=True)
        first, last = within(heights, at[rows], d[rows], margin)
        ends = np.append(start, len(some))
        met = first < last
        rows, first, last = rows[met], first[met], last[met]
        count, x = ends[last] - ends[first], told[rows]
        better = (x < one[rows]) | (n[rows] == 0)
        two[rows] = np.where(better, np.where(count > 1, x, one[rows]), np.minimum(two[rows], x))
        near[rows[better]] = some[ends[first[better]]]
        one[rows[better]] = x[better]
        n[rows] += count
    sure = n > 1
    with np.errstate(invalid="ignore"):
        sure &= ~(two - one < least)
    for i in np.flatnonzero(sure & np.isinf(one)):  # no number tells them apart, so the smallest name is taken
        alike = [k for k in order if abs(at[i] - resid[k]) - d[i] < margin and cosines(looks[look[k]], lengths, len(kinds))[own[i]] == np.inf]
        near[i] = min(alike, key=lambda k: ids[k])
    found = np.flatnonzero(sure)
    return found, near[found]
