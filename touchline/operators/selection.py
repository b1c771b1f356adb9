"""Choosing the target among a frame's boxes, and camera motion along a clip."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.scoring import unit
from .trajectory import FRAME

# Weights of nearness to the region's centre, to the prediction, and of looks.
W_CENTRE, W_PREDICTED, W_LOOKS = 0.4, 0.4, 0.2
TIEBREAK, MY_NUMBER, RECOVER = 0.15, 0.30, 0.45
# When the target is lost: weights of place and looks, and how much wider than the region is searched.
W_PLACE, W_LOOKS_LOST, SEARCH = 0.6, 0.4, 2.5


def closeness(x: Column, y: Column, size: Column) -> Column:
    box = Box()
    return F.when(x.isNull() | y.isNull(), 0.0).otherwise(unit(1.0 - F.sqrt((box.cx - x) * (box.cx - x) + (box.cy - y) * (box.cy - y)) / size))


def candidate_scores(boxes: DataFrame, rois: DataFrame) -> DataFrame:
    """Adds score: boxes meet their frame's region (rx1..ry2) and prediction (pred_x, pred_y; null: none).

    Boxes may carry looks (0..1), p (identity) and my_number (boolean); what is missing doesn't count.
    """
    have = set(boxes.columns)
    met = boxes.join(rois, list(FRAME))
    size = F.sqrt(F.pow(F.col("rx2") - F.col("rx1"), 2) + F.pow(F.col("ry2") - F.col("ry1"), 2))
    size = F.when(size <= 1e-6, 1.0).otherwise(size)
    score = W_CENTRE * closeness((F.col("rx1") + F.col("rx2")) / 2, (F.col("ry1") + F.col("ry2")) / 2, size) + W_PREDICTED * closeness(F.col("pred_x"), F.col("pred_y"), size)
    if "looks" in have:
        score = score + W_LOOKS * F.coalesce("looks", F.lit(0.0))
    if "p" in have:
        score = score + F.coalesce(TIEBREAK * (F.col("p") - 0.5) * 2.0, F.lit(0.0))
    if "my_number" in have:
        score = score + F.when(F.col("my_number"), MY_NUMBER).otherwise(0.0)
    return met.withColumn("score", score)


def select_candidate(boxes: DataFrame, rois: DataFrame, mine: str, least: float = -1.0) -> DataFrame:
    """The best box of each frame: surely tracked boxes are preferred to unsure ones, other teams' never come in."""
    pool = boxes.where(F.coalesce("team", F.lit("")).isin(mine, "unsure", ""))
    sure = (F.col("team") == mine).cast("int")
    w = Window.partitionBy(*FRAME).orderBy(F.desc("_sure"), F.desc("score"), "obj_id")
    ranked = candidate_scores(pool, rois).withColumn("_sure", F.coalesce(sure, F.lit(0))).withColumn("_k", F.row_number().over(w))
    return ranked.where((F.col("_k") == 1) & (F.col("score") >= least)).drop("_sure", "_k")


def recovery_scores(boxes: DataFrame, rois: DataFrame) -> DataFrame:
    """Adds score for a lost target: 0.6 nearness to the prediction and 0.4 looks, in the region widened about the prediction.

    Boxes outside that search area are left out. Boxes may carry looks (0..1); frames without a prediction look about
    the region's centre.
    """
    met = boxes.join(rois, list(FRAME))
    box, half_w, half_h = Box(), SEARCH * (F.col("rx2") - F.col("rx1")) / 2, SEARCH * (F.col("ry2") - F.col("ry1")) / 2
    x, y = F.coalesce("pred_x", (F.col("rx1") + F.col("rx2")) / 2), F.coalesce("pred_y", (F.col("ry1") + F.col("ry2")) / 2)
    size = 2 * F.sqrt(half_w * half_w + half_h * half_h)
    looks = F.coalesce("looks", F.lit(0.0)) if "looks" in boxes.columns else F.lit(0.0)
    near = met.where((F.abs(box.cx - x) <= half_w) & (F.abs(box.cy - y) <= half_h))
    return near.withColumn("score", W_PLACE * closeness(x, y, F.when(size <= 1e-6, 1.0).otherwise(size)) + W_LOOKS_LOST * looks)


def recovery_select(boxes: DataFrame, rois: DataFrame, mine: str, least: float = RECOVER) -> DataFrame:
    """The box that a lost target is found in again, frame by frame; none where the best scores under ``least``."""
    pool = boxes.where(F.coalesce("team", F.lit("")).isin(mine, "unsure", ""))
    w = Window.partitionBy(*FRAME).orderBy(F.desc("score"), "obj_id")
    return recovery_scores(pool, rois).withColumn("_k", F.row_number().over(w)).where((F.col("_k") == 1) & (F.col("score") >= least)).drop("_k")


def margin_term(candidates: DataFrame, rois: DataFrame) -> DataFrame:
    """How far the chosen box of each frame stands out: its nearness to the region's centre less the next best one's.

    Candidates carry ``chosen`` (boolean). 1 for a lone candidate, 0 if another is nearer, null without a region.
    """
    met = candidates.join(rois, list(FRAME), "left")
    size = F.sqrt(F.pow(F.col("rx2") - F.col("rx1"), 2) + F.pow(F.col("ry2") - F.col("ry1"), 2))
    near = closeness((F.col("rx1") + F.col("rx2")) / 2, (F.col("ry1") + F.col("ry2")) / 2, F.when(size <= 1e-6, 1.0).otherwise(size))
    near = F.when(F.col("rx1").isNotNull(), near)
    best = met.groupBy(*FRAME).agg(F.sort_array(F.collect_list(near), False).alias("all"), F.max(F.when(F.col("chosen"), near)).alias("own"), F.max(F.when(F.col("chosen"), F.col("obj_id"))).alias("obj_id"))
    second = F.when(F.col("all")[0] <= F.col("own") + 1e-9, F.col("all")[1]).otherwise(F.col("all")[0])
    margin = F.when(F.size("all") == 1, 1.0).when(F.size("all") > 1, unit(F.col("own") - second))
    return best.where("obj_id is not null").select(*FRAME, "obj_id", margin.alias("margin"))


CHAIN = "match_id long, clip_id long, frame long, healthy boolean, " + ", ".join(f"m{i}{k} double" for i in (1, 2, 3) for k in (1, 2, 3))


def _step(r, least: int) -> np.ndarray | None:
    """A row's motion, or None where it is weak."""
    step = np.array([np.nan if v is None else v for v in r.step], float).reshape(3, 3) if r.step is not None and len(r.step) == 9 else None
    return step if step is not None and np.isfinite(step).all() and r.inliers >= least else None


def _after(chain: np.ndarray, step: np.ndarray) -> np.ndarray:
    chain = step @ chain
    return chain / chain[2, 2] if abs(chain[2, 2]) > 1e-12 else chain


BLOCK = "match_id long, clip_id long, block long, step array<double>"


def _products(batches, least: int):
    """The product of each block's steps; a block's rows come one after another, in order."""
    key, chain, out = None, None, []
    for batch in batches:
        for r in batch.itertuples(index=False):
            if (r.match_id, r.clip_id, r.block) != key:
                if key is not None:
                    out.append((*key, chain.ravel().tolist()))
                key, chain = (r.match_id, r.clip_id, r.block), np.eye(3)
            step = _step(r, least)
            chain = chain if step is None else _after(chain, step)
        yield pd.DataFrame(out, columns=["match_id", "clip_id", "block", "step"])
        out = []
    if key is not None:
        yield pd.DataFrame([(*key, chain.ravel().tolist())], columns=["match_id", "clip_id", "block", "step"])


def _prefixes(batches):
    """The product of all blocks before each one of a clip."""
    key, chain = None, None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.match_id, r.clip_id) != key:
                key, chain = (r.match_id, r.clip_id), np.eye(3)
            out.append((*key, r.block, chain.ravel().tolist()))
            chain = _after(chain, np.array(r.step, float).reshape(3, 3))
        yield pd.DataFrame(out, columns=["match_id", "clip_id", "block", "step"])


def _chained(batches, least: int):
    names = [c.split()[0] for c in CHAIN.split(", ")]
    key, chain = None, np.eye(3)
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.match_id, r.clip_id, r.block) != key:
                key, chain = (r.match_id, r.clip_id, r.block), np.array(r.before, float).reshape(3, 3)
            step = _step(r, least)
            chain = chain if step is None else _after(chain, step)
            back = np.linalg.inv(chain) if abs(np.linalg.det(chain)) > 1e-12 else np.full((3, 3), np.nan)
            out.append((r.match_id, r.clip_id, r.frame, step is not None, *back.ravel().tolist()))
        yield pd.DataFrame(out, columns=names)


def camera_chain(steps: DataFrame, least: int = 25, size: int = 2000) -> DataFrame:
    """The map from each frame back to the anchor (its clip's first frame): m11..m33 and healthy.

    steps: match_id, clip_id, frame, step (nine numbers: previous frame to this one), inliers. A weak step keeps the
    map of the frame before and marks the frame. A prefix scan over blocks of ``size`` frames: each block's steps are multiplied, the
    products of the blocks before it (one small row a block) are multiplied along the clip, and each block is then followed by
    itself from there, so one long clip spreads over as many tasks as it has blocks.
    """
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ["match_id", "clip_id", "block"]
    rows = steps.select("match_id", "clip_id", "frame", "step", F.coalesce("inliers", F.lit(0)).alias("inliers")).withColumn("block", F.floor(F.col("frame") / size))
    products = rows.repartition(n, *block).sortWithinPartitions(*block, "frame").mapInPandas(lambda it: _products(it, least), BLOCK)
    before = products.repartition(n, "match_id", "clip_id").sortWithinPartitions(*block).mapInPandas(_prefixes, BLOCK).withColumnRenamed("step", "before")
    met = rows.join(before.hint("shuffle_hash"), block)  # both sides by block, the built one a row a block
    return met.repartition(n, *block).sortWithinPartitions(*block, "frame").mapInPandas(lambda it: _chained(it, least), CHAIN)
