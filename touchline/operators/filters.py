"""Gates and filters over boxes and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import PITCH_LENGTH, PITCH_WIDTH, strict_number
from .trajectory import FRAME, TRACK


def kept_only(boxes: DataFrame) -> DataFrame:
    """Boxes that passed the gates; all of them where no gate has run (no column, or null)."""
    return boxes.where(F.coalesce("kept", F.lit(True))) if "kept" in boxes.columns else boxes


def short_tracks(rows: DataFrame, least: int) -> DataFrame:
    """Tracks with fewer rows than ``least``."""
    return rows.groupBy(*TRACK).agg(F.count("*").alias("n")).where(F.col("n") < least)


def long_enough(rows: DataFrame, least: int) -> DataFrame:
    return rows.join(short_tracks(rows, least).select(*TRACK), list(TRACK), "left_anti")


def filter_ids(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows of the listed tracks (match_id, clip_id, obj_id): an obj_id alone means another player in every clip."""
    return rows.join(tracks.select(*TRACK).distinct(), list(TRACK), "left_semi")


def exclude(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of tracks that aren't in ``gone``."""
    return rows.join(gone.select(*TRACK).distinct(), list(TRACK), "left_anti")


def eligible_by_team(rows: DataFrame, mine: str, confident: Column) -> DataFrame:
    """Only boxes that surely are another team's go; unsure or unlabelled ones stay."""
    label = F.coalesce("team", F.lit(""))
    return rows.where(~(confident & ~label.isin(mine, "unsure", "")))


def feet_on_pitch(points: DataFrame, pad: float = 0.0) -> DataFrame:
    return points.where(F.col("px").between(-pad, PITCH_LENGTH + pad) & F.col("py").between(-pad, PITCH_WIDTH + pad))


def height_gate(rows: DataFrame, protected: Column | None = None) -> DataFrame:
    """Boxes of a fitting height residual. Rows carry residual, h_mean, h_tol, h_ready.

    A null residual stays, and so does everything before the model is ready; a frame that would be empty keeps all. Distances
    are rounded to 9 places, so a residual just as far off as is tolerated fits, however the running mean was summed.
    """
    within = F.round(F.abs(F.col("residual") - F.col("h_mean")) - F.col("h_tol"), 9) <= 0
    fits = ~F.coalesce("h_ready", F.lit(False)) | F.col("residual").isNull() | within
    if protected is not None:
        fits = fits | protected
    left = F.sum(F.coalesce(fits, F.lit(True)).cast("int")).over(Window.partitionBy(*FRAME))
    marked = rows.withColumn("_fits", F.coalesce(fits, F.lit(True))).withColumn("_left", left)
    return marked.where(F.col("_fits") | (F.col("_left") == 0)).drop("_fits", "_left")


def in_roi(boxes: DataFrame, rois: DataFrame, scale: float = 1.0) -> DataFrame:
    """Boxes whose centre lies in their frame's region (rx1..ry2), widened about its middle by ``scale``."""
    out = boxes.join(rois.select(*FRAME, "rx1", "ry1", "rx2", "ry2"), list(FRAME))
    inside = F.lit(True)
    for a, b, lo, hi in (("x1", "x2", "rx1", "rx2"), ("y1", "y2", "ry1", "ry2")):
        middle, half = (F.col(lo) + F.col(hi)) / 2, (F.col(hi) - F.col(lo)) / 2 * scale
        inside = inside & ((F.col(a) + F.col(b)) / 2).between(middle - half, middle + half)
    return out.where(inside).select(*boxes.columns)


def votes_of(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Number votes of tracks: track, number, weight; only shirt numbers 1 to 23 with a positive finite weight."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    voted = rows.select(*TRACK, strict_number(F.col("number")).alias("number"), w.alias("weight"))
    good = voted.where(F.col("number").isNotNull() & (F.col("weight") > 0) & (F.col("weight") < float("inf")))
    return good.groupBy(*TRACK, "number").agg(F.sum("weight").alias("weight"))


def decide_number(votes: DataFrame, least: float, keys=TRACK) -> DataFrame:
    """The number with most weight (the smaller of two alike) where that reaches ``least``, and its share."""
    best = F.max_by(F.struct("number", "weight"), F.struct("weight", -F.col("number")))
    out = votes.groupBy(*keys).agg(best.alias("best"), F.sum("weight").alias("total"))
    return out.where(F.col("best.weight") >= least).select(*keys, F.col("best.number").alias("number"), (F.col("best.weight") / F.col("total")).alias("number_conf"))


def exclude_other_numbers(rows: DataFrame, mine: int, least: float = 1.5, protected: Column | None = None) -> DataFrame:
    """Drops tracks that are decided on another number than mine; protected rows stay."""
    other = decide_number(votes_of(rows), least).where(F.col("number") != mine).select(*TRACK, F.lit(True).alias("_other"))
    marked = rows.join(other, list(TRACK), "left")
    stays = F.col("_other").isNull() | (protected if protected is not None else F.lit(False))
    return marked.where(stays).drop("_other")


def dominant_team(rows: DataFrame) -> DataFrame:
    """A track's most frequent label that isn't blank; of two alike the one seen first, then the smaller name."""
    counts = rows.where(F.coalesce("team", F.lit("")) != "").groupBy(*TRACK, "team").agg(F.count("*").alias("n"), F.min("frame").alias("first"))
    w = Window.partitionBy(*TRACK).orderBy(F.desc("n"), "first", "team")
    return counts.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*TRACK, F.col("team").alias("dominant"))


def visible(rows: DataFrame, hidden_team: str, ruled_out: DataFrame, protected: Column) -> DataFrame:
    """Hides a team by the tracks' dominant label, and tracks that are ruled out; protected rows stay."""
    gone = ruled_out.select(*TRACK).distinct().withColumn("_gone", F.lit(True))
    marked = rows.join(dominant_team(rows), list(TRACK), "left").join(gone, list(TRACK), "left")
    shown = (F.coalesce("dominant", F.lit("")) != hidden_team) & F.col("_gone").isNull()
    return marked.where(shown | protected).drop("dominant", "_gone")


def delete_guardrail(rows: DataFrame, doomed: DataFrame, target: int) -> DataFrame:
    """One row a clip: what share a deletion takes, whether it takes more than half or the target."""
    marked = rows.join(doomed.select(*TRACK).distinct().withColumn("_gone", F.lit(True)), list(TRACK), "left")
    gone = F.col("_gone").isNotNull()
    out = marked.groupBy("match_id", "clip_id").agg(F.count("*").alias("n_rows"), F.count_if(gone).alias("n_gone"), F.coalesce(F.bool_or(gone & (F.col("obj_id") == target)), F.lit(False)).alias("hits_target"))
    return out.withColumn("warn", F.col("hits_target") | (F.col("n_gone") > 0.5 * F.col("n_rows")))


def good_pose(points: DataFrame, least: int = 6, visible_from: float = 0.3) -> DataFrame:
    """Frames with enough visible key points."""
    return points.groupBy("clip_id", "frame").agg(F.count_if(F.col("vis") >= visible_from).alias("n_visible")).where(F.col("n_visible") >= least)
