"""The three gates of a detection: colour, height and field, and the confidence of a followed box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, expected_height, height_plausible
from ..functions.scoring import adjust_for_number, frame_confidence, height_term, tier
from .aggregates import l1

# How much nearer the tracked team must be than the next, and how near where it is the only team.
MARGIN, MAX_DISTANCE = 0.03, 0.6


def with_teams(boxes: DataFrame, teams: DataFrame) -> DataFrame:
    """Boxes with their match's teams as one array, so that boxes are never multiplied."""
    packed = teams.groupBy("match_id").agg(F.collect_list(F.struct("name", "track", "fingerprint", "slope", "intercept", "spread")).alias("teams"))
    return boxes.join(packed, "match_id", "left").withColumn("teams", F.coalesce("teams", F.array().cast(packed.schema["teams"].dataType)))


def height_ok_any_team(box: Box, tolerance: float = 3.0) -> Column:
    """Whether any tracked team's height model finds the box plausible; a team without a model vetoes nothing, no tracked team does."""
    fits = lambda t: F.coalesce(height_plausible(box.height, expected_height(t["slope"], t["intercept"], box.cy), t["spread"], tolerance), F.lit(True))
    return F.exists("teams", lambda t: t["track"] & fits(t))


def colour_gate(tracked: Column, other: Column, margin: float = MARGIN, most: float = MAX_DISTANCE) -> tuple[Column, Column]:
    """The team score and the colour verdict from the distances to the nearest tracked and other team (null: none)."""
    score = F.when(tracked.isNull(), 0.0).when(other.isNull(), -tracked).otherwise(other - tracked)
    return score, F.when(tracked.isNull(), False).when(other.isNull(), tracked <= most).otherwise(score >= margin)


def score_detections(boxes: DataFrame, teams: DataFrame, field: Column | None = None, vector: str = "features", margin: float = MARGIN, most: float = MAX_DISTANCE, tolerance: float = 3.0) -> DataFrame:
    """All boxes with team_score and kept = colour and height and field.

    boxes: match_id, x1..y2 and a feature vector. teams: match_id, name, track, fingerprint, and the height model slope,
    intercept, spread (null: none). field: whether the feet stand on the field (none: not asked). Nothing is dropped.
    """
    out = with_teams(boxes, teams)
    near = lambda want: F.array_min(F.transform(F.filter("teams", lambda t: (t["track"] == want) & t["fingerprint"].isNotNull()), lambda t: l1(F.col(vector), t["fingerprint"])))
    score, colour = colour_gate(near(True), near(False), margin, most)
    stands = F.coalesce(field, F.lit(True)) if field is not None else F.lit(True)
    return out.withColumn("team_score", score).withColumn("kept", colour & height_ok_any_team(Box(), tolerance) & stands).drop("teams")


def annotate_confidence(rows: DataFrame) -> DataFrame:
    """Adds confidence and tier to the followed boxes.

    rows: source; and, as far as they are there, residual with h_mean, h_std and h_n, appearance, margin, identity, and
    read, target, track_number, mine for numbers. A column that is missing, like a null, is neutral.
    """
    have = set(rows.columns)
    get = lambda name, kind="double": F.col(name) if name in have else F.lit(None).cast(kind)
    height = height_term(get("residual"), get("h_mean"), get("h_std"), get("h_n", "long")) if "h_mean" in have else None
    own = frame_confidence(F.col("source"), height, get("appearance"), get("margin"), get("identity"))
    sure = adjust_for_number(own, get("read", "int"), get("target", "int"), get("track_number", "int"), get("mine", "int"))
    return rows.withColumn("confidence", sure).withColumn("tier", tier(F.col("confidence")))
