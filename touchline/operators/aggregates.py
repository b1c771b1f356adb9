"""Folds over tracks, teams and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .filters import dominant_team, votes_of
from .trajectory import TRACK, clip_reel_stats, segments


def id_stats(rows: DataFrame, fps: float = 29.97) -> DataFrame:
    seconds = (F.max("frame") - F.min("frame") + 1) / F.lit(fps)
    return rows.groupBy(*TRACK).agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.round(seconds, 4).alias("seconds"))


def moments(rows: DataFrame, keys, value: Column) -> DataFrame:
    """n, mean and m2 (sum of squared deviations) of a value by keys; partial sums are combined by the engine."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(value)).alias("m2"))


def combine_moments(parts: DataFrame, keys) -> DataFrame:
    """Merges (n, mean, m2) triples exactly: m2 = sum m2 + sum n mean^2 - (sum n mean)^2 / sum n."""
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("mean")), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))
    return parts.groupBy(*keys).agg(n.alias("n"), (s / n).alias("mean"), F.greatest(q - s * s / n, F.lit(0.0)).alias("m2"))


def spread(n: Column, m2: Column) -> Column:
    return F.when(n > 1, F.sqrt(m2 / n)).otherwise(0.0)


def learn_height_model(samples: DataFrame, keys) -> DataFrame:
    """Least squares of height on cy by keys, with the residuals' deviation (0 counts as 1) and the range of cy.

    The residual spread follows from the same sums as the fit: var(h) - slope * cov(h, cy).
    """
    enough = F.count("*") >= 4
    resid = F.var_pop("height") - F.regr_slope("height", "cy") * F.covar_pop("height", "cy")
    std = F.sqrt(F.greatest(resid, F.lit(0.0)))
    out = samples.groupBy(*keys).agg(enough.alias("_ok"), F.regr_slope("height", "cy").alias("slope"), F.regr_intercept("height", "cy").alias("intercept"), std.alias("resid_std"), F.min("cy").alias("y_min"), F.max("cy").alias("y_max"))
    return out.where("_ok").drop("_ok").withColumn("resid_std", F.when(F.col("resid_std") < 1e-9, 1.0).otherwise(F.col("resid_std")))


def learn_fingerprint(samples: DataFrame, keys, vector: str = "features") -> DataFrame:
    """Mean of a vector column by keys, place by place."""
    places = samples.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return places.groupBy(*keys).agg(F.transform(ordered, lambda s: s["m"]).alias("fingerprint"))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), 1.0 - dot(a, b) / norm)


def team_distances(boxes: DataFrame, teams: DataFrame, vector: str = "features") -> DataFrame:
    """Adds d_tracked and d_other, the L1 distance to the nearest tracked and other team of the match (null: none).

    A match's teams become one array that is joined by match, so boxes are never multiplied.
    """
    packed = teams.groupBy("match_id").agg(F.collect_list(F.struct("name", "track", "fingerprint")).alias("teams"))
    out = boxes.join(packed, "match_id", "left")
    near = lambda want: F.array_min(F.transform(F.filter("teams", lambda t: t["track"] == want), lambda t: l1(F.col(vector), t["fingerprint"])))
    return out.withColumn("d_tracked", near(True)).withColumn("d_other", near(False))


def team_label(boxes: DataFrame, margin: float = 0.02, single_confident: bool = True, vector: str = "features") -> DataFrame:
    """Adds label: the nearest team (its name if tracked, else opp), or unsure if the second is about as near. Needs teams."""
    ranked = F.array_sort(F.transform("teams", lambda t: F.struct(l1(F.col(vector), t["fingerprint"]).alias("d"), t["name"].alias("name"), t["track"].alias("track"))))
    out = boxes.withColumn("_r", ranked)
    best = F.when(F.col("_r")[0]["track"], F.col("_r")[0]["name"]).otherwise("opp")
    sure = F.when(F.size("_r") == 1, F.lit(single_confident)).otherwise(F.col("_r")[1]["d"] - F.col("_r")[0]["d"] >= margin)
    return out.withColumn("label", F.when(F.coalesce(F.size("teams"), F.lit(0)) < 1, "unsure").when(sure, best).otherwise("unsure")).drop("_r")


def report_order(scores: DataFrame) -> DataFrame:
    """Adds place, a match's tracks in a report's order: kept ones first, then by score and length. Nulls come last."""
    order = [F.desc_nulls_last(c) for c in ("kept", "score", "n")]
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("match_id").orderBy(*order, *TRACK)).cast("long"))


def unique_ids(rows: DataFrame, keys=("match_id",)) -> DataFrame:
    """By keys: the ids of its tracks, ascending, and how many. An id is a number; of a match there are as many as it has tracks."""
    return rows.where("obj_id is not null").groupBy(*keys).agg(F.sort_array(F.collect_set("obj_id")).alias("obj_ids"), F.countDistinct("obj_id").alias("ids"))


def distinct_clips(rows: DataFrame, keys=("match_id",)) -> DataFrame:
    """By keys: the clips that they are seen in, ascending, and how many."""
    return rows.where("clip_id is not null").groupBy(*keys).agg(F.sort_array(F.collect_set("clip_id")).alias("clips"), F.countDistinct("clip_id").alias("n_clips"))


def evidence_summary(profiles: DataFrame) -> DataFrame:
    """Per match: players, those with a number, frames and appearances in clips, and the best evidence."""
    return profiles.groupBy("match_id").agg(F.count("*").alias("players"), F.count("number").alias("numbered"), F.sum("n_frames").alias("frames"), F.sum("n_clips").alias("clips"), F.max("evidence").alias("best"))


def tracklet_reads(evidence: DataFrame, votes: DataFrame) -> DataFrame:
    """Per track: frames, mean height residual and its number votes as a map, as a dump of what was read."""
    said = votes.groupBy(*TRACK).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("number", "weight")))).alias("votes"))
    return evidence.select(*TRACK, "n_frames", F.when(F.col("h_n") > 0, F.col("h_mean")).alias("resid")).join(said, list(TRACK), "left")


def aggregate_objects(rows: DataFrame, width: float, height: float) -> DataFrame:
    """Per track: frames, mean zone, dominant label, number of votes."""
    box = Box()
    base = rows.groupBy(*TRACK).agg(F.count("*").alias("n_frames"), F.avg(box.cx / width).alias("zx"), F.avg(box.cy / height).alias("zy"))
    votes = votes_of(rows).groupBy(*TRACK).agg(F.sum("weight").alias("votes"))
    return base.join(dominant_team(rows), list(TRACK), "left").join(votes, list(TRACK), "left").withColumn("votes", F.coalesce("votes", F.lit(0.0)))


def ocr_diagnostics(votes: DataFrame, top: int = 12) -> DataFrame:
    """The numbers most often best of a track, with all their weight: a report of ``top`` rows."""
    best = votes.groupBy(*TRACK).agg(F.max_by("number", F.struct("weight", -F.col("number"))).alias("number"))
    tracks = best.groupBy("number").agg(F.count("*").alias("tracks"))
    weight = votes.groupBy("number").agg(F.sum("weight").alias("weight"))
    return weight.join(tracks, "number", "left").withColumn("tracks", F.coalesce("tracks", F.lit(0))).orderBy(F.desc("weight"), "number").limit(top)


def throttle_tallest(rows: DataFrame, every: int = 5, tallest: int = 3) -> DataFrame:
    """Which boxes to read numbers from: on every fifth frame the three tallest."""
    w = Window.partitionBy("match_id", "clip_id", "frame").orderBy(F.desc(Box().height), "obj_id")
    return rows.where(F.col("frame") % every == 0).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= tallest).drop("_k")


def throttle_spaced(rows: DataFrame, most: int = 6, apart: int = 8, least_height: float = 46.0) -> DataFrame:
    """At most six reads a track, eight frames apart, of boxes tall enough: the earliest that fit, one after another."""
    step = lambda kept, f: F.when((F.size(kept) < most) & ((F.size(kept) == 0) | (f - F.coalesce(F.element_at(kept, -1), F.lit(0).cast("long")) >= apart)), F.concat(kept, F.array(f))).otherwise(kept)
    frames = rows.where(Box().height >= least_height).groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.col("frame").cast("long"))).alias("f"))
    return frames.select(*TRACK, F.explode(F.aggregate("f", F.array().cast("array<bigint>"), step)).alias("frame"))


def coverage_stats(rows: DataFrame, fps: float) -> DataFrame:
    """Per track: last frame, frames with a box, coverage, gaps inside, the longest, boxes by source."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    gaps = rows.withColumn("_gap", F.col("frame") - F.lag("frame").over(w) - 1)
    out = gaps.groupBy(*TRACK).agg(
        F.max("frame").alias("total_frames"), F.count("*").alias("tracked_frames"), F.count_if(F.col("_gap") > 0).alias("num_gaps"), F.greatest(F.coalesce(F.max("_gap"), F.lit(0)), F.lit(0)).alias("longest_gap"),
        *[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("detection", "csrt", "manual", "sam2")],
    )
    return out.withColumn("coverage_pct", F.round(100.0 * F.col("tracked_frames") / F.col("total_frames"), 2)).withColumn("longest_gap_s", F.round(F.col("longest_gap") / F.lit(fps), 2))


def export_report(rows: DataFrame, fps: float, gap: int = 5) -> DataFrame:
    """Per track: what was tracked (``coverage_stats``) and what its reel would hold (``clip_reel_stats``)."""
    reels = clip_reel_stats(segments(rows, gap), fps)
    return coverage_stats(rows, fps).join(reels, list(TRACK))


def pitch_occupancy(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """Foot points by team and grid cell."""
    return points.where("px is not null and py is not null").groupBy("match_id", "team", F.floor(F.col("px") / cell).alias("gx"), F.floor(F.col("py") / cell).alias("gy")).agg(F.count("*").alias("n"))


def colour_fractions(pixels: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Share of a box region's pixels inside each colour gate."""
    return pixels.groupBy("obj_id", "frame", "region").agg(*[F.avg(g.cast("int")).alias(n) for n, g in gates.items()])


def hsv_gates() -> dict[str, Column]:
    # Hue, saturation and value ranges of the five kit colours.
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    return {
        "white": s.between(0, 50) & v.between(140, 255),
        "black": s.between(0, 120) & v.between(0, 55),
        "red": (h.between(0, 10) | h.between(170, 179)) & s.between(90, 255) & v.between(40, 230),
        "navy": h.between(95, 130) & s.between(40, 255) & v.between(15, 165),
        "gold": h.between(16, 34) & s.between(80, 255) & v.between(90, 255),
    }


def team_signal_score(rows: DataFrame, signals: list[tuple[str, float]], veto: str, share: float, veto_median: float, least: int = 12) -> DataFrame:
    """Weighted count of signals that hold on enough frames; kept with score >= 1, a low veto median and enough frames."""
    score = sum(((F.avg((F.col(c) > 0).cast("int")) >= share).cast("int") * w for c, w in signals), F.lit(0.0))
    out = rows.groupBy(*TRACK).agg(F.count("*").alias("n"), F.round(score, 6).alias("score"), F.percentile(veto, F.lit(0.5)).alias("veto"))
    return out.withColumn("kept", (F.col("n") >= least) & (F.col("score") >= 1.0) & (F.col("veto") < veto_median))


def appearance_similarity(rows: DataFrame, key: str, order: str, vector: str = "features") -> DataFrame:
    """Cosine, clamped to 0..1, of each vector to the mean of its player's earlier ones; 0 for the first."""
    places = rows.select(key, order, F.posexplode(vector).alias("pos", "x"))
    w = Window.partitionBy(key, "pos").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = places.withColumn("m", F.avg("x").over(w))
    dot, na, nb = F.sum(F.col("x") * F.col("m")), F.sqrt(F.sum(F.col("x") * F.col("x"))), F.sqrt(F.sum(F.col("m") * F.col("m")))
    return met.groupBy(key, order).agg(F.coalesce(F.least(F.greatest(F.when(na * nb > 0, dot / (na * nb)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("similarity"))
