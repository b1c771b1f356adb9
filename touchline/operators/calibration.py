"""Pitch calibration from clicked landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import inverse, project

CLIP = ("match_id", "clip_id")
MATRIX = [f"m{i}{k}" for i in (1, 2, 3) for k in (1, 2, 3)]
# Points that a homography needs, metres of error that call for another look.
LEAST_POINTS, FLAG_METRES = 4, 3.0


def landmark_correspondences(clicks: DataFrame, chain: DataFrame, named: DataFrame, least: int = LEAST_POINTS) -> DataFrame:
    """match_id, clip_id, anchor_frame, name, image_x, image_y, x, y: the clicked landmarks of each clip in its anchor frame's pixels and in metres.

    clicks: match_id, clip_id, click_id (their order), frame, name, x, y. A clip's first click sets the anchor frame, and clicks on
    that frame stand as they are. Others count if their frame comes later and is healthy in ``chain`` (of ``camera_chain``).
    The latest click of a landmark is taken; clips with fewer than ``least`` landmarks of ``named`` are left out.
    """
    first = clicks.groupBy(*CLIP).agg(F.min_by("frame", "click_id").alias("anchor_frame"))
    at = chain.select(*CLIP, "frame", "healthy", F.array(*MATRIX).alias("_to")).hint("merge")
    anchor = first.join(chain.withColumnRenamed("frame", "anchor_frame").hint("merge"), [*CLIP, "anchor_frame"], "left")
    anchor = anchor.select(*CLIP, "anchor_frame", F.array(*inverse([F.col(m) for m in MATRIX])).alias("_back"))
    told = clicks.select(*CLIP, "click_id", "frame", "name", F.col("x").alias("_x"), F.col("y").alias("_y"))
    frames = told.select(*CLIP, "frame").distinct().join(at, [*CLIP, "frame"], "left").join(anchor.hint("merge"), list(CLIP))
    met = told.join(frames.hint("shuffle_hash"), [*CLIP, "frame"])  # a row a frame meets the clicks; no clip's clicks come together
    start_x, start_y = project([F.col("_to")[k] for k in range(9)], F.col("_x"), F.col("_y"))
    anchor_x, anchor_y = project([F.col("_back")[k] for k in range(9)], start_x, start_y)
    same = F.col("frame") == F.col("anchor_frame")
    spot = F.when(same, F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))).when(F.col("healthy") & (F.col("frame") > F.col("anchor_frame")), F.struct(anchor_x.alias("x"), anchor_y.alias("y")))
    finite = F.coalesce(F.abs("_p.x") + F.abs("_p.y") < float("inf"), F.lit(False))
    good = met.withColumn("_p", spot).where(finite)
    latest = good.groupBy(*CLIP, "anchor_frame", "name").agg(F.max_by("_p", "click_id").alias("_p"))
    known = latest.join(named.select("name", "x", "y").hint("shuffle_hash"), "name")
    counted = known.withColumn("_n", F.count("*").over(Window.partitionBy(*CLIP))).where(F.col("_n") >= least)
    return counted.select(*CLIP, "anchor_frame", "name", F.col("_p.x").alias("image_x"), F.col("_p.y").alias("image_y"), "x", "y")


def reprojection_error(points: DataFrame, h, flag: float = FLAG_METRES) -> DataFrame:
    """n, error (root mean square, metres) and flagged (error over ``flag``) of each clip's correspondences under a homography."""
    px, py = project(h, F.col("image_x"), F.col("image_y"))
    square = (px - F.col("x")) * (px - F.col("x")) + (py - F.col("y")) * (py - F.col("y"))
    out = points.groupBy(*CLIP).agg(F.count("*").alias("n"), F.sqrt(F.avg(square)).alias("error"))
    return out.withColumn("flagged", F.col("error") > flag)
