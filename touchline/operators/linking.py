"""Linking detections into tracklets: greedy best-score association over an ordered scan with little state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import Bands, box_bands, centres, half_sizes

#: Pairs that are dealt before those are left out that have lost their tracklet or box.
STEP = 2048
#: Pairs of boxes up to which a frame is met at once, and the boxes that one meets first in a more crowded frame, about.
CROWD, FEW = 1 << 14, 8
#: Pairs at once, above which a crowded frame's first reach is made smaller.
MANY = 1 << 23


def gate_of(width: float, height: float) -> float:
    """The square of the distance up to which boxes may be linked that aren't over one another."""
    return (0.04 * (width**2 + height**2) ** 0.5) ** 2


def scores(a: np.ndarray, b: np.ndarray, gate2: float) -> tuple[np.ndarray, np.ndarray]:
    """Overlap plus nearness of boxes one by one, and which of them are over one another or near."""
    w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
    h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    inter = np.maximum(w, 0.0) * np.maximum(h, 0.0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a) + area(b) - inter
    overlap = np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1.0), 0.0)
    d2 = ((a[:, 0] + a[:, 2] - b[:, 0] - b[:, 2]) / 2) ** 2 + ((a[:, 1] + a[:, 3] - b[:, 1] - b[:, 3]) / 2) ** 2
    return overlap + 1.0 / (1.0 + d2 / (gate2 + 1.0)), (overlap >= 0.20) | (d2 <= gate2)


def pairs(old: np.ndarray, new: np.ndarray, gate2: float, reach: float = np.inf, above: float = -np.inf, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(old, new, score) of all pairs that are over one another or near and score more than ``above``; only boxes whose centres are near enough for that are compared.

    Told a ``reach``, only pairs whose centres are that near in x and in y are sure to be among them; None where more than ``most`` are compared.
    """
    at, to = np.flatnonzero(np.isfinite(old).all(axis=1)), np.flatnonzero(np.isfinite(new).all(axis=1))
    if not len(at) or not len(to):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, gate, found, seen = old[at], new[to], gate2**0.5, [], 0
    bands, w, h = (Bands(*centres(b), reach), *half_sizes(b)) if reach < np.inf else box_bands(b, gate)
    far = [np.minimum(np.maximum(gate, np.abs(a[:, k + 2] - a[:, k]) / 2 + half) * (1 + 1e-9) + 1e-6, reach) for k, half in ((0, w), (1, h))]
    for q, p in bands.near(*centres(a), *far):
        seen += len(q)
        if seen > most:
            return None
        score, allowed = scores(a[q], b[p], gate2)
        allowed &= score > above
        found.append((at[q[allowed]], to[p[allowed]], score[allowed]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def farthest(old: np.ndarray, new: np.ndarray, gate2: float) -> float:
    """Beyond this in x or in y no pair is over one another or near."""
    return max(gate2**0.5, *(a + b for a, b in zip(half_sizes(old), half_sizes(new), strict=True))) * (1 + 1e-9) + 1e-6


def most_beyond(reach: float, old: np.ndarray, new: np.ndarray, gate2: float) -> float:
    """No pair whose centres are farther apart than ``reach`` in x or in y scores more.

    Intervals of lengths u and v that are apart by r have at most (u + v) / 2 - r in common, of at least (u + v) / 2 + r, and boxes overlap by no larger share
    than their sides.
    """
    side = max(a + b for a, b in zip(half_sizes(old), half_sizes(new), strict=True))
    return max(side - reach, 0.0) / (side + reach) + 1.0 / (1.0 + reach * reach / (gate2 + 1.0)) + 1e-9


def best_first(old: np.ndarray, new: np.ndarray, gate2: float) -> np.ndarray:
    """For each new box the old one it goes to, or -1: best score first, each old and each new box once; of equal scores the later old, then the later new one.

    In a crowded frame not all pairs near enough are met. Pairs up to a small reach are, and those that score more than any pair beyond it can are
    dealt; the boxes left over meet again at twice the reach. So the work grows with the boxes, not with the pairs.
    """
    given = np.full(len(new), -1, np.int64)
    at, to = np.flatnonzero(np.isfinite(old).all(axis=1)), np.flatnonzero(np.isfinite(new).all(axis=1))
    reach = most = None
    while len(at) and len(to):
        a, b = old[at], new[to]
        if most is None:
            (x, y), most = centres(b), farthest(a, b, gate2)
            reach, first = max((FEW * (float(np.ptp(x)) + 1e-3) * (float(np.ptp(y)) + 1e-3) / 6 / len(b)) ** 0.5, 1e-3), True
        last = 2 * reach >= most or len(a) * len(b) <= CROWD
        found = pairs(a, b, gate2) if last else pairs(a, b, gate2, reach, most_beyond(reach, a, b, gate2), MANY if first and reach > 1e-3 else np.inf)
        if found is None:  # boxes stand closer than their mean
            reach /= 4
            continue
        first, (k, p, score) = False, found
        order = np.lexsort((p, k, score))[::-1]
        k, p = k[order], p[order]
        used, taken = np.zeros(len(at), bool), np.zeros(len(to), bool)
        while len(k):
            for i, j in zip(k[:STEP].tolist(), p[:STEP].tolist(), strict=True):
                if not used[i] and not taken[j]:
                    used[i] = taken[j] = True
                    given[to[j]] = at[i]
            k, p = k[STEP:], p[STEP:]
            left = ~used[k] & ~taken[p]
            k, p = k[left], p[left]
        if last:
            break
        at, to, reach = at[~used], to[~taken], 2 * reach
    return given


class Linker:
    """Open tracklets of one stretch of a clip, oldest first: their numbers, last frames and last boxes."""

    def __init__(self, gap: int, gate2: float):
        self.gap, self.gate2, self.made = gap, gate2, 0
        self.local, self.last, self.boxes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4))

    def resume(self, last: np.ndarray, boxes: np.ndarray) -> None:
        """Goes on from open tracklets, oldest first, which are numbered from 0; new ones are numbered after them."""
        self.local, self.last, self.boxes, self.made = np.arange(len(last)), last, boxes, len(last)

    def frame(self, frame: int, boxes: np.ndarray) -> np.ndarray:
        """The tracklet of each of a frame's boxes: best score first, each tracklet and each box once."""
        stay = frame - self.last <= self.gap
        self.local, self.last, self.boxes = self.local[stay], self.last[stay], self.boxes[stay]
        given = best_first(self.boxes, boxes, self.gate2)
        old, new = given >= 0, given < 0
        self.last[given[old]], self.boxes[given[old]] = frame, boxes[old]
        out = np.empty(len(boxes), np.int64)
        out[old] = self.local[given[old]]
        out[new] = self.made + np.arange(int(new.sum()))
        self.made += int(new.sum())
        self.local = np.concatenate([self.local, out[new]])
        self.last = np.concatenate([self.last, np.full(int(new.sum()), frame)])
        self.boxes = np.concatenate([self.boxes, boxes[new]])
        return out


def _linked(batches, gap: int, gate2: float, columns: list[str]):
    """Rows sorted by stretch and frame; a frame is linked once its last row has been seen."""
    held, key, linker = None, None, None

    def link(rows: pd.DataFrame):
        nonlocal key, linker
        spot = rows[["match_id", "clip_id", "stretch", "frame"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]).any(axis=1)]))
        boxes, local = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), []
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            if tuple(spot[a, :3]) != key:
                key, linker = tuple(spot[a, :3]), Linker(gap, gate2)
            local.append(linker.frame(int(spot[a, 3]), boxes[a:b]))
        return rows[columns].assign(local=np.concatenate(local))

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows[["match_id", "clip_id", "stretch", "frame"]] != rows[["match_id", "clip_id", "stretch", "frame"]].iloc[-1]).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # the last frame may go on in the next batch
        held = rows.iloc[cut:]
        if cut:
            yield link(rows.iloc[:cut])
    if held is not None:
        yield link(held)


def link_tracklets(detections: DataFrame, width: float, height: float, gap: int = 8, min_len: int = 8) -> DataFrame:
    """match_id, clip_id, frame, ord, stretch, local, n: the tracklet (stretch, local) of each box, if long enough.

    Boxes of the next frames go, best score first, to open tracklets whose last box overlaps or is near; a tracklet
    is open for ``gap`` frames. Where a clip has no detection for longer than that every tracklet is closed, so the clip
    is cut there and its stretches are linked in parallel. A task streams its rows and holds the open tracklets only.
    """
    gate2 = gate_of(width, height)
    frames = detections.select("match_id", "clip_id", "frame").distinct()
    w = Window.partitionBy("match_id", "clip_id").orderBy("frame")
    cut = F.when(F.col("frame") - F.lag("frame").over(w) > gap, 1).otherwise(0)
    stretches = frames.withColumn("_new", cut).withColumn("stretch", F.sum("_new").over(w)).drop("_new")
    columns = ["match_id", "clip_id", "frame", "ord", "stretch"]
    rows = detections.select("match_id", "clip_id", "frame", "ord", "x1", "y1", "x2", "y2").join(stretches, ["match_id", "clip_id", "frame"])
    n = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "match_id", "clip_id", "stretch").sortWithinPartitions("match_id", "clip_id", "stretch", "frame", "ord")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    linked = dealt.mapInPandas(lambda it: _linked(it, gap, gate2, columns), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", local long")
    size = F.count("*").over(Window.partitionBy("match_id", "clip_id", "stretch", "local"))
    return linked.withColumn("n", size).where(F.col("n") >= min_len)
