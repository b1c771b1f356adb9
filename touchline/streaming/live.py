"""Streaming twins of the track operators. Sources carry frame_ts; a frame's time is clip start + frame / fps.

What depends on the order of frames waits in state until the watermark has passed it (``ordered.InOrder``), so results don't
depend on how rows are dealt to triggers. ``idle`` bounds the state of keys that fall silent.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linking import Linker, gate_of
from .ordered import InBlocks, InOrder, in_order, on_disk

TRACK = ["match_id", "clip_id", "obj_id"]
SIDES = ["x1", "y1", "x2", "y2"]
MINUTE, HOUR = 60_000, 3_600_000
# Fixed values of the jump gate: travel in box heights a frame, the least height, frames that a far place has to persist,
# and the gap after which any place is taken.
TRAVEL, LEAST_HEIGHT, CONFIRM, RESET = 0.9, 20.0, 3, 8
#: Rows that anchor the gate wherever they are.
ANCHORS = ("manual",)


def stream_detections(spark: SparkSession, path: str, schema: str, keys=("match_id", "clip_id", "frame", "obj_id"), late: str = "10 seconds", per_trigger: int = 100, distinct: bool = True) -> DataFrame:
    """A file stream of boxes with a watermark on frame_ts, each box once. What tells boxes that come again is kept in RocksDB.

    Without ``distinct`` boxes that come again are left in, for operators that are told to take them ``once``: these hold every box until the watermark
    has passed it anyway, so no second state with a row for each box is needed.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withWatermark("frame_ts", late)
    if not distinct:
        return rows
    on_disk(spark)
    return rows.dropDuplicatesWithinWatermark(list(keys))


class _Link(InBlocks):
    key, row = ["match_id", "clip_id"], "frame long, ord long, x1 double, y1 double, x2 double, y2 double"
    out = "frame long, ord long, start long, start_ord long"
    kept = {"open": "open tracklets, oldest first", "early": "boxes of those that aren't long enough yet"}

    def __init__(self, gate2: float, gap: int, min_len: int, idle: int):
        super().__init__(idle)
        self.gate2, self.gap, self.min_len = gate2, gap, min_len

    def load(self, tables):
        """The linker, and each open tracklet's first box and length; tracklet, frame and ord of boxes that aren't given out yet."""
        linker, nothing = Linker(self.gap, self.gate2), np.zeros(0, np.int64)
        read = lambda table, *names: [table.column(c).to_numpy() if table is not None else nothing for c in names]
        if tables["open"] is not None:
            linker.resume(*read(tables["open"], "last"), np.stack(read(tables["open"], *SIDES), axis=1))
        return {"linker": linker, "open": read(tables["open"], "start", "start_ord", "n"), "early": read(tables["early"], "local", "frame", "ord")}

    def block(self, rows, held):
        linker, (start, start_ord, size), early = held["linker"], held["open"], held["early"]
        frame, ord_ = (rows.column(c).to_numpy() for c in ("frame", "ord"))
        boxes = np.stack([rows.column(c).to_numpy() for c in SIDES], axis=1)
        order = np.lexsort((ord_, frame))
        if self.once:
            order = order[np.flatnonzero((np.diff(frame[order], prepend=frame[order[0]] - 1) != 0) | (np.diff(ord_[order], prepend=ord_[order[0]] - 1) != 0))]
        frame, ord_, boxes = frame[order], ord_[order], boxes[order]
        names, made, found = linker.local, linker.made, []
        for a, b in pairwise([*np.flatnonzero(np.diff(frame, prepend=frame[0] - 1)), len(frame)]):
            found.append(linker.frame(int(frame[a]), boxes[a:b]))
        local = np.concatenate(found)
        _, first = np.unique(local[local >= made], return_index=True)
        first = np.flatnonzero(local >= made)[first]
        names, start, start_ord = (np.concatenate(x) for x in ((names, local[first]), (start, frame[first]), (start_ord, ord_[first])))
        early = [np.concatenate(x) for x in zip(early, (local, frame, ord_), strict=True)]
        size = np.concatenate([size, np.zeros(len(first), np.int64)]) + np.bincount(np.searchsorted(names, local), minlength=len(names))
        at = np.searchsorted(names, early[0])
        long, alive = size[at] >= self.min_len, np.isin(early[0], linker.local)
        stay = np.searchsorted(names, linker.local)
        held["open"], held["early"] = [start[stay], start_ord[stay], size[stay]], [x[~long & alive] for x in early]
        return pd.DataFrame({"frame": early[1][long], "ord": early[2][long], "start": start[at[long]], "start_ord": start_ord[at[long]]})

    def save(self, held):
        linker, (local, frame, ord_) = held["linker"], held["early"]
        own = dict(zip(("start", "start_ord", "n"), held["open"], strict=True)) | {"last": linker.last} | dict(zip(SIDES, linker.boxes.T, strict=True))
        early = {"local": np.searchsorted(linker.local, local), "frame": frame, "ord": ord_}
        return {"open": pa.table({k: pa.array(v) for k, v in own.items()}), "early": pa.table({k: pa.array(v) for k, v in early.items()})}


def stream_link_tracklets(detections: DataFrame, width: float, height: float, gap: int = 8, min_len: int = 8, idle: int = MINUTE, once: bool = False) -> DataFrame:
    """match_id, clip_id, frame, ord and the tracklet (start, start_ord: its first box) of every box, as ``link_tracklets`` has it.

    A frame is linked when the watermark has passed it. State of a clip: rows that wait, by blocks of time, one of which is held at once, open
    tracklets (closed ``gap`` frames after their last box), and the boxes of tracklets that aren't ``min_len`` long yet; these are given out when they
    are, and dropped with tracklets that close before. Detections: match_id, clip_id, frame, ord, x1..y2, frame_ts; idle in
    milliseconds, at least ``gap`` frames. ``once``: of rows of one frame and ord only the first that came counts.
    """
    return in_order(detections, _Link(gate_of(width, height), gap, min_len, idle), once)


def gate_steps(rows: list[tuple], gate: tuple | None) -> tuple[list[tuple], tuple | None]:
    """The jump gate over (frame, x1, y1, x2, y2, source) in order: (frame, held) of each, and the gate's state.

    State: centre and frame of the last good box, and how many far boxes have come since.
    """
    out = []
    for frame, x1, y1, x2, y2, source in rows:
        if None in (x1, y1, x2, y2):
            continue
        cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
        pending = 0
        if gate is not None and source not in ANCHORS:
            gap = frame - gate[2]
            far = ((cx - gate[0]) ** 2 + (cy - gate[1]) ** 2) ** 0.5
            if 0 < gap <= RESET and far > TRAVEL * max(y2 - y1, LEAST_HEIGHT) * gap:
                pending = gate[3] + 1
        held = 0 < pending < CONFIRM
        gate = (gate[0], gate[1], gate[2], pending) if held else (cx, cy, frame, 0)
        out.append((frame, held))
    return out, gate


class _Gate(InOrder):
    key, row, out = TRACK, "frame long, x1 double, y1 double, x2 double, y2 double, source string", "frame long, held boolean"
    kept = {"gate": "cx double, cy double, frame long, pending long"}

    def step(self, key, rows, state):
        out, gate = gate_steps([r[1:] for r in rows], state["gate"][0] if state["gate"] else None)
        state["gate"] = [gate] if gate is not None else []
        return out


def stream_jump_gate(rows: DataFrame, idle: int = HOUR, once: bool = False) -> DataFrame:
    """Track, frame and held: whether a box is too far from the last good one and hasn't persisted for three frames yet.

    A gap of over 8 frames opens the gate, and manual rows are good wherever they are. Rows without a box are left out.
    """
    return in_order(rows, _Gate(idle), once)


class _Votes(InOrder):
    key, row, out = TRACK, "frame long, number long", "number long, weight long, final boolean"
    kept = {"votes": "number long, weight long"}

    def step(self, key, rows, state):
        votes = dict(state["votes"])
        for r in rows:
            votes[r[2]] = votes.get(r[2], 0) + 1
        changed = {r[2] for r in rows}
        state["votes"] = sorted(votes.items())
        return [(n, w, False) for n, w in state["votes"] if n in changed]

    def finish(self, key, state):
        return [(n, w, True) for n, w in state["votes"]]


def stream_votes(rows: DataFrame, idle: int = HOUR, once: bool = False) -> DataFrame:
    """Running number votes of each track: number, weight and final.

    A number's weight is given out whenever it has grown, and once more with ``final`` when the track has been silent for ``idle``
    milliseconds of event time; then its votes leave the state.
    """
    number = F.when(F.col("number").rlike("^[0-9]+$"), F.col("number").try_cast("long"))
    return in_order(rows.withColumn("number", number).where("number between 1 and 23"), _Votes(idle), once)


def stream_segments(rows: DataFrame, gap: str) -> DataFrame:
    """Presence segments of each track by inactivity (append mode, after the watermark)."""
    return rows.groupBy(F.session_window("frame_ts", gap).alias("w"), *TRACK).agg(F.count("*").alias("n")).select(*TRACK, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


class _Alerts(InOrder):
    key, row, out = TRACK, "frame long, low boolean", "start long, alert long"
    kept = {"run": "length long, start long, told boolean"}

    def step(self, key, rows, state):
        length, start, told = state["run"][0] if state["run"] else (0, -1, False)
        out = []
        for _, frame, low in rows:
            length, start, told = (length + 1, start if length else frame, told) if low else (0, -1, False)
            if length >= 5 and not told:
                told = True
                out.append((start, frame))
        state["run"] = [(length, start, told)]
        return out


def stream_low_conf_alerts(rows: DataFrame, below: float = 0.4, idle: int = HOUR, once: bool = False) -> DataFrame:
    """One alert for each run of at least five rows under a confidence, when the watermark has passed the fifth. A null confidence isn't low."""
    return in_order(rows.withColumn("low", F.coalesce(F.col("conf") < below, F.lit(False))), _Alerts(idle), once)


class _Steps(InOrder):
    key, row, out = TRACK, "frame long, px double, py double", "frame long, frame_ms long, step double, speed double"
    kept = {"point": "frame long, px double, py double"}

    def __init__(self, fps: float, idle: int):
        super().__init__(idle)
        self.fps = fps

    def steps(self, rows, state):
        last = state["point"][0] if state["point"] else None
        for ms, frame, px, py in rows:
            if px is None or py is None or last is not None and frame <= last[0]:
                continue
            if last is not None:
                step = ((px - last[1]) ** 2 + (py - last[2]) ** 2) ** 0.5
                yield frame, ms, step, step / ((frame - last[0]) / self.fps)
            last = (frame, px, py)
        state["point"] = [last] if last is not None else []

    def step(self, key, rows, state):
        return list(self.steps(rows, state))


def stream_steps(points: DataFrame, fps: float = 30.0, idle: int = HOUR, once: bool = False) -> DataFrame:
    """The step (metres) and speed from the previous point of each track; frame_ms is the step's end. Rows without a point are left out."""
    return in_order(points, _Steps(fps, idle), once)


class _Distance(_Steps):
    out = "window_ms long, distance double, steps long"
    kept = {"point": "frame long, px double, py double", "windows": "start long, distance double, steps long"}

    def __init__(self, fps: float, width: int, slide: int, fastest: float, idle: int):
        super().__init__(fps, idle)
        self.width, self.slide, self.fastest = width, slide, fastest

    def step(self, key, rows, state):
        sums = {start: (distance, n) for start, distance, n in state["windows"]}
        for _, ms, step, speed in self.steps(rows, state):
            if speed <= self.fastest:
                for start in range(ms // self.slide * self.slide, ms - self.width, -self.slide):
                    distance, n = sums.get(start, (0.0, 0))
                    sums[start] = (distance + step, n + 1)
        state["windows"] = [(start, *x) for start, x in sorted(sums.items())]
        return []

    def closed(self, key, state, now):
        over = [w for w in state["windows"] if w[0] + self.width <= now]
        state["windows"] = [w for w in state["windows"] if w[0] + self.width > now]
        return over

    def due(self, state):
        return min((w[0] + self.width for w in state["windows"]), default=None)

    def finish(self, key, state):
        return state["windows"]


def stream_distance(points: DataFrame, fps: float = 30.0, width: int = 10_000, slide: int | None = None, fastest: float = 12.0, idle: int = HOUR, once: bool = False) -> DataFrame:
    """Metres run by each track in windows of ``width`` milliseconds every ``slide`` (tumbling without): window_ms, distance, steps.

    A step counts in the windows that its end lies in, unless it is faster than ``fastest``. A window is given once, when the watermark
    has passed it; windows without a step aren't given.
    """
    return in_order(points, _Distance(fps, width, slide or width, fastest, idle), once)
