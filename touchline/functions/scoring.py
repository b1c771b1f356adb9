"""Scores and confidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base confidence by the source of a box, the weights of the terms.
SOURCE_BASE = {"detection": 0.70, "csrt": 0.35, "manual": 0.90}
OTHER_BASE, MANUAL_FLOOR = 0.35, 0.85
W_BASE, W_HEIGHT, W_APPEARANCE, W_MARGIN, W_IDENTITY = 0.40, 0.20, 0.20, 0.20, 0.20
LOW_CONFIDENCE, HIGH_CONFIDENCE = 0.40, 0.70


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def neutral(term: Column | None) -> Column:
    """A term in 0..1; one that is missing is neither for nor against (least and greatest would skip the null)."""
    return F.lit(0.5) if term is None else F.when(term.isNull(), 0.5).otherwise(unit(term))


def evidence(frames: Column, clips: Column, named: Column) -> Column:
    """How much was seen of a player: frames, spread over clips, and how surely the number is known."""
    return F.round(0.45 * (1.0 - F.exp(-frames / 120.0)) + 0.20 * F.least(F.lit(1.0), clips / 3.0) + 0.35 * named, 3)


def named_term(number: Column, certainty: Column, zone_ok: Column) -> Column:
    term = 0.5 + 0.5 * certainty
    return F.when(number.isNull(), 0.0).when(F.coalesce(zone_ok, F.lit(False)), F.least(F.lit(1.0), term + 0.1)).otherwise(term)


def finite(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c.cast("double"))


def identity_features(d_tracked, d_other, height_dev, zx, zy, motion, height_share, appearance) -> Column:
    """The nine signals of a box that tell one player from others; what is missing counts as 0."""
    near, far = finite(d_tracked), finite(d_other)
    return F.array(near, far, far - near, *[finite(c) for c in (height_dev, zx, zy, motion, height_share, appearance)])


def frame_confidence(source: Column, height=None, appearance=None, margin=None, identity=None) -> Column:
    base = F.lit(OTHER_BASE)
    for name, value in SOURCE_BASE.items():
        base = F.when(source == name, value).otherwise(base)
    blend = W_BASE * base + W_HEIGHT * neutral(height) + W_APPEARANCE * neutral(appearance) + W_MARGIN * neutral(margin)
    if identity is not None:
        blend = F.when(identity.isNotNull(), (1.0 - W_IDENTITY) * blend + W_IDENTITY * unit(identity)).otherwise(blend)
    return unit(F.when(source == "manual", F.greatest(blend, F.lit(MANUAL_FLOOR))).otherwise(blend))


def height_tolerance(spread: Column) -> Column:
    return F.greatest(F.lit(18.0), 2.5 * spread)


def height_term(residual: Column, mean: Column, spread: Column, samples: Column) -> Column:
    """1 near the learned residual, down to 0 at the tolerance; null until fifteen samples are known."""
    dev, inner, tol = F.abs(residual - mean), F.greatest(F.lit(1e-6), 0.5 * spread), height_tolerance(spread)
    slope = F.when(dev <= inner, 1.0).when(dev >= tol, 0.0).otherwise(unit(1.0 - (dev - inner) / (tol - inner)))
    return F.when((samples >= 15) & residual.isNotNull(), slope)


def adjust_for_number(confidence: Column, read: Column, target: Column, track_number: Column, mine: Column) -> Column:
    """A fresh read of the target's number lifts, another one lowers; a track decided on my number lifts."""
    step = F.when(read.isNull() | target.isNull(), 0.0).when(read == target, 0.10).otherwise(-0.08)
    return unit(unit(confidence + step) + F.when(F.coalesce(track_number == mine, F.lit(False)), 0.12).otherwise(0.0))


def tier(confidence: Column) -> Column:
    return F.when(confidence < LOW_CONFIDENCE, "low").when(confidence < HIGH_CONFIDENCE, "mid").otherwise("high")


def retrack_window(frame: Column, mark: Column, fps: Column, most: Column) -> tuple[Column, Column]:
    """First frame and number of frames to track again: from the mark, or three seconds back; the end stays."""
    rate = F.when(F.coalesce(fps, F.lit(0.0)) == 0, 29.97).otherwise(fps)
    start = F.when(mark.isNotNull() & (mark >= 1) & (mark <= frame), mark).otherwise(F.greatest(F.lit(1), frame - F.bround(3.0 * rate).cast("long")))
    n, cap = frame - start + 1, F.greatest(F.lit(1), most)
    return F.when(n > cap, frame - cap + 1).otherwise(start), F.least(n, cap)
