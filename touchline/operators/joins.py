"""Joins within frames and to small dimension tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, dist2, iou
from .frames import assigned, count_pairs, counted
from .trajectory import FRAME, TRACK


def prefixed(boxes: DataFrame, prefix: str, keys=FRAME) -> DataFrame:
    return boxes.select(*keys, *[F.col(c).alias(prefix + c) for c in boxes.columns if c not in keys])


def pairs_in_frame(a: DataFrame, b: DataFrame, min_iou: float, gate: float) -> DataFrame:
    """Pairs (a_, b_) of boxes of a frame that overlap enough or are near enough; an equi-join on the frame."""
    near = (iou(Box("a_"), Box("b_")) >= min_iou) | (dist2(Box("a_"), Box("b_")) <= gate * gate)
    return prefixed(a, "a_").join(prefixed(b, "b_"), list(FRAME)).where(near)


def count_pairs_in_frame(boxes: DataFrame, min_iou: float, gate: float) -> DataFrame:
    """How many pairs of different tracks ``pairs_in_frame`` has in each frame of a table with itself: match_id, clip_id, frame, pairs.

    Runs of boxes that are certainly near are counted, not met (``frames.count_near``); only those about ``gate`` away, or that may overlap from
    farther, are measured. A box without finite corners is in no pair. Frames without a pair are left out.
    """

    def count(rows, ids):
        x1, y1, x2, y2 = (rows.column(c).cast("double").to_numpy() for c in ("x1", "y1", "x2", "y2"))
        x, y, area = (x1 + x2) / 2, (y1 + y2) / 2, np.maximum(x2 - x1, 0.0) * np.maximum(y2 - y1, 0.0)
        touch = float(np.hypot(np.abs(x2 - x1).max(), np.abs(y2 - y1).max())) if min_iou > 0 else np.inf

        def near(i, p):
            inter = np.maximum(np.minimum(x2[i], x2[p]) - np.maximum(x1[i], x1[p]), 0.0) * np.maximum(np.minimum(y2[i], y2[p]) - np.maximum(y1[i], y1[p]), 0.0)
            union = area[i] + area[p] - inter
            overlap = np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1.0), 0.0)
            dx, dy = x[i] - x[p], y[i] - y[p]
            return (overlap >= min_iou) | (dx * dx + dy * dy <= gate * gate)

        return count_pairs(x, y, ids, np.full(len(x), -1), gate * (1 - 1e-9), max(gate, touch) * (1 + 1e-9), near)

    finite = " and ".join([*(f"{c} is not null" for c in (*FRAME, "obj_id")), *(f"abs({c}) < double('inf')" for c in ("x1", "y1", "x2", "y2"))])
    own = boxes.where(finite).select(*FRAME, "obj_id", "x1", "y1", "x2", "y2")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:3]) + ", pairs long, same_team long"
    return own.groupBy(*FRAME).applyInArrow(lambda rows: counted(rows, FRAME, count), schema).where("pairs > 0").drop("same_team")


def _assigned(boxes: pa.Table, tracks: pa.Table, default: int, min_iou: float) -> pa.Table:
    """A frame's boxes with the tracks found for them."""
    corners = lambda t: np.column_stack([t.column(c).cast(pa.float64()).to_numpy() for c in ("x1", "y1", "x2", "y2")]).reshape(-1, 4)
    tracks = tracks.filter(pc.is_valid(tracks.column("obj_id")))
    ids = tracks.column("obj_id").to_numpy()
    at = assigned(corners(boxes), corners(tracks), ids, min_iou)
    given = np.full(len(at), default, np.int64)
    given[at >= 0] = ids[at[at >= 0]]
    return boxes.select([*FRAME, "ord"]).append_column("obj_id", pa.array(given, pa.int64()))


def assign_track_id(boxes: DataFrame, tracks: DataFrame, default: int, min_iou: float = 0.3) -> DataFrame:
    """Each box (with its ord) gets the track of best overlap, else of nearest centre, else the default.

    Boxes and tracks are grouped by frame, and a frame's boxes meet only what is near them (``frames.assigned``), so neither pairs nor
    more than one frame are ever held. A box without coordinates gets the default, a track without them is nobody's.
    """
    own = boxes.select(*FRAME, "ord", "x1", "y1", "x2", "y2")
    known = tracks.select(*FRAME, F.col("obj_id").cast("long").alias("obj_id"), "x1", "y1", "x2", "y2").where(" and ".join(f"{c} is not null" for c in FRAME))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*FRAME, "ord")) + ", obj_id long"
    return own.groupBy(*FRAME).cogroup(known.groupBy(*FRAME)).applyInArrow(lambda a, b: _assigned(a, b, default, min_iou), schema)


def nearest_box(points: DataFrame, boxes: DataFrame, within: Column | None = None) -> DataFrame:
    """For each point (id, x, y) of a frame the box of the nearest centre, and the squared distance; the smaller id of two alike."""
    box = Box()
    d = (box.cx - F.col("x")) * (box.cx - F.col("x")) + (box.cy - F.col("y")) * (box.cy - F.col("y"))
    met = points.join(boxes, list(FRAME)).withColumn("d2", d)
    found = met.groupBy(*FRAME, "id").agg(F.min_by(F.struct("obj_id", "d2"), F.struct("d2", "obj_id")).alias("best"), *([F.first(within).alias("_most")] if within is not None else []))
    if within is not None:
        found = found.where(F.col("best.d2") <= F.col("_most") * F.col("_most"))
    return found.select(*FRAME, "id", "best.obj_id", "best.d2")


def manual_snap(rois: DataFrame, boxes: DataFrame, widths: float = 1.5) -> DataFrame:
    """For each region (rx1 .. ry2) of a frame the box nearest its centre, if that is within ``widths`` of the region's width; d2 is the squared distance."""
    points = rois.select(*FRAME, F.lit(0).alias("id"), ((F.col("rx1") + F.col("rx2")) / 2).alias("x"), ((F.col("ry1") + F.col("ry2")) / 2).alias("y"), (F.lit(widths) * (F.col("rx2") - F.col("rx1"))).alias("_reach"))
    return nearest_box(points, boxes, F.col("_reach")).drop("id")


def attach_nearest_height(tracks: DataFrame, clusters: DataFrame, spread: Column, k: float = 1.5, least: float = 8.0) -> DataFrame:
    """Unnumbered tracks to the numbered cluster of their match with the nearest mean residual, if near enough.

    There are at most 23 numbers in a match, so a track meets 23 clusters at most.
    """
    met = tracks.join(clusters.select("match_id", "number", F.col("resid").alias("cluster_resid")), "match_id")
    away = F.abs(F.col("resid") - F.col("cluster_resid"))
    near = met.withColumn("_d", away).where(F.col("_d") <= F.greatest(k * spread, F.lit(least)))
    return near.groupBy(*TRACK).agg(F.min_by("number", F.struct("_d", "number")).alias("number"))


def ruled_out_seed(profiles: DataFrame, mine: int) -> DataFrame:
    """Every numbered player of a match but mine; place counts them by number."""
    place = F.row_number().over(Window.partitionBy("match_id").orderBy("number"))
    return profiles.where(F.col("number").isNotNull() & (F.col("number") != mine)).withColumn("place", place.cast("long"))


def find_by_number(players: DataFrame, history: DataFrame, wanted: DataFrame) -> DataFrame:
    """A team's player for a number: who wears it (mine first, then the latest change), else who wore it."""
    now = wanted.join(players, ["team", "number"]).groupBy("team", "number").agg(F.max_by("player_id", F.struct(F.col("is_me").cast("int"), "updated", -F.col("ord"))).alias("now"))
    once = wanted.join(history.select("team", "number", "player_id", "ord"), ["team", "number"]).groupBy("team", "number").agg(F.min_by("player_id", "ord").alias("once"))
    return wanted.join(now, ["team", "number"], "left").join(once, ["team", "number"], "left").select("team", "number", F.coalesce("now", "once").alias("player_id"))


def pair_clips(a: DataFrame, b: DataFrame, pairs: DataFrame, fps_out: float) -> DataFrame:
    """Frame pairs of two clips on a common clock. pairs: pair_id, clip_a, clip_b, fps_a, fps_b, n_a, n_b, seconds of offset.

    Frame tables a and b hold clip and frame; a pair of frames needs both.
    """
    start, stop = F.greatest(F.lit(0.0), -F.col("offset")), F.least(F.col("n_a") / F.col("fps_a"), F.col("n_b") / F.col("fps_b") - F.col("offset"))
    grid = pairs.withColumn("_s", start).withColumn("_e", stop).where("_e > _s")
    grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_e") - F.col("_s")) * fps_out).cast("int"))))
    t = F.col("_s") + F.col("k") / F.lit(fps_out)
    fa = F.bround(t * F.col("fps_a")).cast("long") + 1
    fb = F.least(F.greatest(F.bround((t + F.col("offset")) * F.col("fps_b")).cast("long") + 1, F.lit(1)), F.col("n_b"))
    grid = grid.select("pair_id", "clip_a", "clip_b", "k", fa.alias("frame_a"), fb.alias("frame_b"))
    ga = a.select(F.col("clip_id").alias("clip_a"), F.col("frame").alias("frame_a")).distinct()
    gb = b.select(F.col("clip_id").alias("clip_b"), F.col("frame").alias("frame_b")).distinct()
    return grid.join(ga.hint("merge"), ["clip_a", "frame_a"]).join(gb.hint("merge"), ["clip_b", "frame_b"]).select("pair_id", "k", "frame_a", "frame_b")


def resolve_by_priority(clips: DataFrame, override: DataFrame, per_clip: DataFrame, per_match: DataFrame) -> DataFrame:
    """The setting of each clip: an explicit override, else the clip's own, else its match's, else null."""
    out = clips.join(override.withColumnRenamed("setting", "_a"), ["match_id", "clip_id"], "left").join(per_clip.withColumnRenamed("setting", "_b"), ["match_id", "clip_id"], "left").join(per_match.withColumnRenamed("setting", "_c"), "match_id", "left")
    return out.select("match_id", "clip_id", F.coalesce("_a", "_b", "_c").alias("setting"))


def name_tracks(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Attaches player_id and display name chosen for tracks; others stay null."""
    return rows.join(names.select(*TRACK, "player_id", "display"), list(TRACK), "left")


def join_dims(boxes: DataFrame, clips: DataFrame) -> DataFrame:
    """Boxes with what is known of their clip; clips without an entry keep nulls."""
    return boxes.join(clips, ["match_id", "clip_id"], "left")


def union_clips(*tables: DataFrame) -> DataFrame:
    """Tables of several clips as one; a column that one of them lacks is null there."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def refine_boxes(old: DataFrame, new: DataFrame, clamp_to: tuple[float, float]) -> DataFrame:
    """Boxes of ``new`` where they may stand for the old ones of their track and frame, clamped; else the old ones."""
    from ..functions.geometry import clamp, plausible_refinement

    names = ("x1", "y1", "x2", "y2")
    met = old.join(new.select(*TRACK, "frame", *[F.col(c).alias("n_" + c) for c in names]), [*TRACK, "frame"], "left")
    fits = F.coalesce(plausible_refinement(Box("n_"), Box()), F.lit(False))
    taken = [F.when(fits, c).otherwise(F.col(n)).alias(n) for c, n in zip(clamp(Box("n_"), *clamp_to), names, strict=True)]
    return met.select(*[c for c in old.columns if c not in names], *taken, fits.alias("refined"))


def merge_retrack(old: DataFrame, new: DataFrame, clamp_to: tuple[float, float]) -> DataFrame:
    """Replaces or adds the rows of the new table's frames, boxes clamped, marked as from re-tracking."""
    from ..functions.geometry import clamp

    key = [*TRACK, "frame"]
    fresh = new.select(*key, *[c.alias(n) for c, n in zip(clamp(Box(), *clamp_to), ("x1", "y1", "x2", "y2"), strict=True)], "conf", F.lit("sam2").alias("source"))
    return old.join(fresh.select(*key), key, "left_anti").select(*key, "x1", "y1", "x2", "y2", "conf", "source").unionByName(fresh)
