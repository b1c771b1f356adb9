"""Boxes of one frame met in numpy: only those whose centres are near enough are compared, in chunks of bounded size."""

from __future__ import annotations

import numpy as np

#: Pairs that are compared at once.
CHUNK = 1 << 20


def centres(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2


class Bands:
    """Points sorted by bands of y and by x within a band, so that a window is a few runs of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, height: float):
        self.y0, self.height = float(y.min()), max(height, float(y.max() - y.min()) / 4096, 1e-9)
        band = np.floor((y - self.y0) / self.height).astype(np.int64)
        self.order = np.lexsort((x, band))
        self.x = x[self.order]
        self.starts = np.searchsorted(band[self.order], np.arange(int(band.max()) + 2))

    def near(self, x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray):
        """(query, point) numbers of the points in each query's window and some more, chunk by chunk."""
        n = len(self.starts) - 1
        low = np.clip(np.floor((y - ry - self.y0) / self.height), 0, n).astype(np.int64)
        high = np.clip(np.floor((y + ry - self.y0) / self.height), -1, n - 1).astype(np.int64)
        count = np.maximum(high - low + 1, 0)
        query = np.repeat(np.arange(len(x)), count)
        band = low[query] + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        by = np.argsort(band, kind="stable")
        query, band = query[by], band[by]
        edges = np.searchsorted(band, np.arange(n + 1))
        first, last = np.empty(len(query), np.int64), np.empty(len(query), np.int64)
        for k in range(n):
            a, b = edges[k], edges[k + 1]
            if a < b:
                own, at = self.x[self.starts[k] : self.starts[k + 1]], query[a:b]
                first[a:b] = self.starts[k] + np.searchsorted(own, x[at] - rx[at], "left")
                last[a:b] = self.starts[k] + np.searchsorted(own, x[at] + rx[at], "right")
        by = np.argsort(query, kind="stable")
        query, first, size = query[by], first[by], (last - first)[by]
        ends = np.cumsum(size)
        at = 0
        while at < len(query):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            some = size[at:stop]
            q = np.repeat(query[at:stop], some)
            p = np.repeat(first[at:stop], some) + np.arange(len(q)) - np.repeat(np.cumsum(some) - some, some)
            yield q, self.order[p]
            at = stop


def half_sizes(boxes: np.ndarray) -> tuple[float, float]:
    """Half of the largest width and height."""
    return float(np.abs(boxes[:, 2] - boxes[:, 0]).max()) / 2, float(np.abs(boxes[:, 3] - boxes[:, 1]).max()) / 2


def box_bands(boxes: np.ndarray, reach: float = 0.0) -> tuple[Bands, float, float]:
    """Bands of boxes' centres, and half of the largest width and height."""
    w, h = half_sizes(boxes)
    return Bands(*centres(boxes), max(reach, 2 * h)), w, h


def assigned(a: np.ndarray, b: np.ndarray, ids: np.ndarray, min_iou: float) -> np.ndarray:
    """For each box of ``a`` the place in ``b`` of the best overlap over ``min_iou``, else of the nearest centre; the smaller id of two alike.

    -1 where there is none. Boxes without finite coordinates take no part. Nearest centres are sought in windows that are doubled until
    the nearest one found is nearer than the window's edge.
    """
    out = np.full(len(a), -1, np.int64)
    own, other = np.flatnonzero(np.isfinite(a).all(axis=1)), np.flatnonzero(np.isfinite(b).all(axis=1))
    if not len(own) or not len(other):
        return out
    other = other[np.argsort(ids[other], kind="stable")]
    a, b = a[own], b[other]
    found = np.full(len(own), -1, np.int64)
    bands, w, h = box_bands(b)
    ax, ay = centres(a)
    bx, by = centres(b)

    def best(q: np.ndarray, p: np.ndarray, value: np.ndarray):
        """Each query's first point by (value, id), queries coming one after another or not."""
        order = np.lexsort((p, value, q))
        q, p, value = q[order], p[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        return q[first], p[first], value[first]

    area = lambda x: np.maximum(x[:, 2] - x[:, 0], 0.0) * np.maximum(x[:, 3] - x[:, 1], 0.0)
    area_a, area_b = area(a), area(b)
    seen = np.full(len(own), -np.inf)
    if 0.0 <= min_iou:
        reach_x, reach_y = (np.abs(a[:, 2] - a[:, 0]) / 2 + w) * (1 + 1e-9), (np.abs(a[:, 3] - a[:, 1]) / 2 + h) * (1 + 1e-9)
        for q, p in bands.near(ax, ay, reach_x, reach_y):
            wide = np.minimum(a[q, 2], b[p, 2]) - np.maximum(a[q, 0], b[p, 0])
            high = np.minimum(a[q, 3], b[p, 3]) - np.maximum(a[q, 1], b[p, 1])
            some = np.flatnonzero((wide > 0) & (high > 0))
            q, p, inter = q[some], p[some], wide[some] * high[some]
            union = area_a[q] + area_b[p] - inter
            value = np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)
            some = np.flatnonzero(value > min_iou)
            q, p, value = best(q[some], p[some], -value[some])
            better = -value > seen[q]
            seen[q[better]], found[q[better]] = -value[better], p[better]
    todo = np.flatnonzero(found < 0)
    wide, high = float(np.ptp(np.concatenate([ax, bx]))), float(np.ptp(np.concatenate([ay, by])))
    r = max(((wide + 1e-9) * (high + 1e-9) / len(b)) ** 0.5, (wide + high) / len(b), 1e-9)
    bands = Bands(bx, by, r)
    while len(todo):
        whole = r > wide + high + 1.0
        near = np.full(len(todo), np.inf)
        spot = np.full(len(todo), -1, np.int64)
        for q, p in bands.near(ax[todo], ay[todo], np.full(len(todo), r), np.full(len(todo), r)):
            dx, dy = ax[todo[q]] - bx[p], ay[todo[q]] - by[p]
            q, p, d = best(q, p, dx * dx + dy * dy)
            better = (d < near[q]) | ((d == near[q]) & (p < spot[q]))
            near[q[better]], spot[q[better]] = d[better], p[better]
        done = (near < r * r * (1 - 1e-9)) | whole
        found[todo[done]] = spot[done]
        todo, r = todo[~done], r * 2
    out[own] = np.where(found >= 0, other[found], -1)
    return out


def runs(first: np.ndarray, last: np.ndarray):
    """(query, place) of every place in first..last - 1 of each query, chunk by chunk."""
    size = np.maximum(last - first, 0)
    some = np.flatnonzero(size)
    ends, at = np.cumsum(size[some]), 0
    while at < len(some):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        q, n = some[at:stop], size[some[at:stop]]
        yield np.repeat(q, n), np.repeat(first[q] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at = stop


def count_near(x: np.ndarray, y: np.ndarray, label: np.ndarray, sure: float, reach: float, near) -> tuple[int, int]:
    """How many pairs of points are near, and how many of these share a label (codes from 0, -1 for none), without meeting most pairs.

    ``near`` tells it of pairs of places; it must hold up to the distance ``sure`` and fail beyond ``reach``. Points are sorted by bands of y and by x.
    In a band, what is certainly near a point is one run, which is only counted, and what may be is a run at either end, which is asked for pair
    by pair. With bands as narrow as the points are dense, the work grows with n to the power 1.5.
    """
    n = len(x)
    if n < 2:
        return 0, 0
    wide, high = float(np.ptp(x)), float(np.ptp(y))
    sure, reach = min(sure, wide + high + 1.0), min(reach, wide + high + 1.0)
    h = max((8.0 * (wide + 1e-9) * (high + 1e-9) / n) ** 0.5, high / 4096, reach / 4096, 1e-9)
    band = np.floor((y - y.min()) / h).astype(np.int64)
    order = np.lexsort((x, band))
    x0, y0, span, bands = float(x.min()), float(y.min()), wide + 2 * reach + 1.0, int(band.max()) + 1
    px, py, own, label = x[order] - x0, y[order] - y0, band[order], label[order]
    key = px + own * span
    slack = 1e-9 * (1.0 + span * bands + float(np.abs(x).max()) + float(np.abs(y).max()))
    kinds = np.unique(label[label >= 0])
    code = np.where(label >= 0, np.searchsorted(kinds, label), -1)
    before = np.zeros((len(kinds), n + 1), np.int64)
    for k in range(len(kinds)):
        np.cumsum(code == k, out=before[k, 1:])
    pairs = same = 0
    for step in range(min(bands - 1, int((reach + slack) / h) + 1) + 1):
        q = np.arange(int(np.searchsorted(own, bands - step)))
        at = (own[q] + step) * h
        low = np.maximum(at - py[q] - slack, 0.0)
        high_ = np.maximum(at + h - py[q], py[q] - at) + slack
        far = np.where(low <= reach, np.sqrt(np.maximum(reach * reach - low * low, 0.0)) + slack, -1.0)
        in_ = np.where(high_ <= sure, np.sqrt(np.maximum(sure * sure - high_ * high_, 0.0)) - slack, -1.0)
        base = (own[q] + step) * span
        edge = lambda r, side: np.searchsorted(key, base + np.clip(px[q] + r, -reach, wide + reach), side)  # noqa: B023, E731
        a, d = edge(-far, "left"), edge(far, "right")
        d = np.where(far < 0, a, d)
        b, c = edge(-in_, "left"), edge(in_, "right")
        b, c = np.where(in_ < 0, a, b), np.where(in_ < 0, a, c)
        if step == 0:  # each pair of a band once
            a, b, c, d = (np.maximum(v, q + 1) for v in (a, b, c, d))
        b = np.clip(b, a, np.maximum(a, d))
        c = np.clip(c, b, np.maximum(b, d))
        pairs += int((c - b).sum())
        known = q[code[q] >= 0]
        same += int((before[code[known], c[known]] - before[code[known], b[known]]).sum()) if len(known) else 0
        for first, last in ((a, b), (c, d)):
            for i, p in runs(first, last):
                met = near(order[i], order[p])
                pairs += int(np.count_nonzero(met))
                same += int(np.count_nonzero(met & (code[i] == code[p]) & (code[i] >= 0)))
    return pairs, same


def count_pairs(x: np.ndarray, y: np.ndarray, ids: np.ndarray, label: np.ndarray, sure: float, reach: float, near) -> tuple[int, int]:
    """``count_near`` of points with different ids."""
    pairs, same = count_near(x, y, label, sure, reach, near)
    by = np.argsort(ids, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], ids[by][1:] != ids[by][:-1]])) if len(ids) else np.zeros(0, np.int64)
    stop = np.repeat(np.append(start[1:], len(ids)), np.diff(np.append(start, len(ids)))) if len(ids) else start
    for i, p in runs(np.arange(len(ids)) + 1, stop):
        met = near(by[i], by[p])
        pairs -= int(np.count_nonzero(met))
        same -= int(np.count_nonzero(met & (label[by[i]] == label[by[p]]) & (label[by[i]] >= 0)))
    return pairs, same


def codes(labels) -> np.ndarray:
    """Labels of an Arrow column as numbers from 0, -1 for null."""
    found = labels.combine_chunks().dictionary_encode()
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def counted(rows, keys: tuple[str, ...], count, name: str = "obj_id"):
    """A frame's keys with its pairs, and those of one label (pyarrow in and out); ``count`` takes the table and the tracks' codes."""
    import pyarrow as pa

    pairs, same = count(rows, codes(rows.column(name)))
    return rows.select(list(keys)).slice(0, 1).append_column("pairs", pa.array([pairs], pa.int64())).append_column("same_team", pa.array([same], pa.int64()))
