"""What is learned of a match's teams: looks, height, kit colours, and what could not be learned."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import learn_fingerprint, learn_height_model

# Pixels that a band needs, how many spreads it reaches, its padding and bounds for h, s and v, the samples under
# which a team is marked, and the pixels for each further cluster (up to three).
LEAST_PIXELS, TIGHT, FEW, PER_CLUSTER, MOST_CLUSTERS = 30, 1.6, 12, 200, 3
BOUNDS = {"h": (3.0, 179.0), "s": (18.0, 255.0), "v": (18.0, 255.0)}
#: Widths of the histogram's bins; a bin keeps exact sums, so only which cluster a pixel goes to is told by bin.
BIN = {"h": 2, "s": 4, "v": 4}


def background() -> Column:
    """Grass and skin, which both teams show."""
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    grass = h.between(35, 85) & s.between(40, 255) & v.between(30, 255)
    skin = h.between(0, 28) & s.between(40, 185) & v.between(60, 245)
    return grass | skin


def clear_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels without grass and skin, but for patches (obj_id, frame, region) that have no more than five others; those stay whole."""
    patch = Window.partitionBy("obj_id", "frame", "region")
    marked = pixels.where("h is not null and s is not null and v is not null").withColumn("_bg", background())
    marked = marked.withColumn("_clear", F.sum((~F.col("_bg")).cast("int")).over(patch))
    return marked.where(~F.col("_bg") | (F.col("_clear") <= 5)).drop("_bg", "_clear")


def colour_histogram(pixels: DataFrame, keys) -> DataFrame:
    """Counts and sums of h, s, v and their squares by keys and bin: at most 90 * 64 * 64 rows a group, which cover every pixel."""
    bins = [F.floor(F.col(c) / w).alias(f"{c}_bin") for c, w in BIN.items()]
    value = lambda c: F.col(c).cast("double")
    sums = [F.sum(value(c)).alias(f"{c}_1") for c in BIN] + [F.sum(value(c) * value(c)).alias(f"{c}_2") for c in BIN]
    return pixels.groupBy(*keys, *bins).agg(F.count("*").alias("n"), *sums)


def k_means(points: np.ndarray, weights: np.ndarray, k: int, seed: int = 0, starts: int = 5, rounds: int = 100) -> np.ndarray:
    """Labels of weighted points: the best of some seeded runs of Lloyd's steps, each begun with far-off points likelier."""
    rng, best, labels = np.random.RandomState(seed), np.inf, np.zeros(len(points), int)
    k = min(k, len(points))
    for _ in range(starts):
        centres = points[[rng.choice(len(points), p=weights / weights.sum())]]
        while len(centres) < k:
            far = ((points[:, None, :] - centres) ** 2).sum(-1).min(1) * weights
            if far.sum() <= 0:
                break
            centres = np.vstack([centres, points[rng.choice(len(points), p=far / far.sum())]])
        own = None
        for _ in range(rounds):
            found = ((points[:, None, :] - centres) ** 2).sum(-1).argmin(1)
            if own is not None and (found == own).all():
                break
            own = found
            for j in range(len(centres)):
                if weights[own == j].sum() > 0:
                    centres[j] = np.average(points[own == j], axis=0, weights=weights[own == j])
        spread = float((((points - centres[own]) ** 2).sum(1) * weights).sum())
        if spread < best - 1e-9:
            best, labels = spread, own
    return labels


def _dominant(table: pa.Table, keys: list[str]) -> pa.Table:
    """Mean and spread of the largest cluster of a group's colours."""
    n = table.column("n").to_numpy().astype(float)
    one, two = (np.column_stack([table.column(f"{c}_{p}").to_numpy() for c in BIN]) for p in (1, 2))
    order = np.lexsort([table.column(f"{c}_bin").to_numpy() for c in BIN])
    n, one, two = n[order], one[order], two[order]
    k = int(min(MOST_CLUSTERS, max(1, n.sum() // PER_CLUSTER)))
    labels = k_means(one / n[:, None], n, k) if k > 1 else np.zeros(len(n), int)
    sizes = np.bincount(labels, n)
    mine = labels == int(sizes.argmax())
    total = n[mine].sum()
    centre = one[mine].sum(0) / total
    spread = np.sqrt(np.maximum(two[mine].sum(0) / total - centre**2, 0.0))
    out = {key: table.column(key)[:1] for key in keys} | {"n": pa.array([int(n.sum())], pa.int64()), "share": pa.array([total / n.sum()])}
    for j, c in enumerate(BIN):
        out |= {f"{c}_mid": pa.array([centre[j]]), f"{c}_spread": pa.array([spread[j]])}
    return pa.table(out)


def colour_bands(pixels: DataFrame, keys: list[str], clusters: bool = True) -> DataFrame:
    """keys, n, share and h_lo .. v_hi: the band about a group's dominant colour; groups of under thirty pixels have none.

    Pixels: obj_id, frame, region, h, s, v and the keys. With ``clusters`` the middle and spread are the mean and deviation of the largest of
    up to three clusters (one for each 200 pixels) of the group's colour histogram, which is bounded however many pixels it covers; share is that
    cluster's. Without, they are the median and the quartiles' distance over 1.35, and share is 1.
    """
    clear = clear_pixels(pixels)
    if clusters:
        kinds = {f.name: f.dataType.simpleString() for f in clear.schema.fields}
        schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n long, share double, " + ", ".join(f"{c}_{x} double" for c in BIN for x in ("mid", "spread"))
        found = colour_histogram(clear, keys).groupBy(*keys).applyInArrow(lambda t: _dominant(t, keys), schema)
    else:
        q = lambda c, p: F.percentile(c, F.lit(p))
        aggs = [x for c in BIN for x in (q(c, 0.5).alias(f"{c}_mid"), ((q(c, 0.75) - q(c, 0.25)) / 1.35).alias(f"{c}_spread"))]
        found = clear.groupBy(*keys).agg(F.count("*").alias("n"), F.lit(1.0).alias("share"), *aggs)
    sides = []
    for c, (pad, most) in BOUNDS.items():
        half = TIGHT * F.col(f"{c}_spread") + pad
        clip = lambda x, most=most: F.least(F.greatest(x, F.lit(0.0)), F.lit(most))
        sides += [clip(F.col(f"{c}_mid") - half).alias(f"{c}_lo"), clip(F.col(f"{c}_mid") + half).alias(f"{c}_hi")]
    return found.where(F.col("n") >= LEAST_PIXELS).select(*keys, "n", "share", *sides)


def band_fraction(pixels: DataFrame, bands: DataFrame, keys: list[str], patch: list[str]) -> DataFrame:
    """patch and fraction: the share of each patch's pixels inside its group's band; patches of groups without a band are left out."""
    met = pixels.join(bands.select(*keys, *[f"{c}_{x}" for c in BIN for x in ("lo", "hi")]), keys)
    inside = F.lit(True)
    for c in BIN:
        inside = inside & F.col(c).between(F.col(f"{c}_lo"), F.col(f"{c}_hi"))
    return met.groupBy(*patch).agg(F.avg(inside.cast("double")).alias("fraction"))


def learn_team_profiles(samples: DataFrame, pixels: DataFrame, tracked: DataFrame | None = None, clusters: bool = True) -> DataFrame:
    """One row for each team of a match that has samples: n_samples, few, track, fingerprint, height model, bands, missing.

    samples: match_id, team, height, cy, features (array; null and other lengths' places are averaged where they are). pixels: match_id, team,
    obj_id, frame, region (torso or shorts), h, s, v. tracked: match_id, team of those to be followed. primary and shorts are structs of
    the band, slope to y_max the height model, and missing names what could not be learned (primary, shorts, height); few marks
    teams of under twelve samples. A team without samples has no row, whatever its pixels.
    """
    keys = ["match_id", "team"]
    n = samples.groupBy(*keys).agg(F.count("*").alias("n_samples"))
    height = learn_height_model(samples.where("height is not null and cy is not null"), keys)
    looks = learn_fingerprint(samples, keys)
    bands = colour_bands(pixels, [*keys, "region"], clusters)
    sides = [f"{c}_{x}" for c in BIN for x in ("lo", "hi")]
    wide = bands.groupBy(*keys).agg(*[F.any_value(F.when(F.col("region") == region, F.struct("n", "share", *sides)), True).alias(name) for region, name in (("torso", "primary"), ("shorts", "shorts"))])
    out = n.join(height, keys, "left").join(looks, keys, "left").join(wide, keys, "left")
    if tracked is not None:
        out = out.join(tracked.select(*keys).distinct().withColumn("_t", F.lit(True)), keys, "left").withColumn("track", F.coalesce("_t", F.lit(False))).drop("_t")
    else:
        out = out.withColumn("track", F.lit(False))
    missing = F.array_compact(F.array(F.when(F.col("primary").isNull(), "primary"), F.when(F.col("shorts").isNull(), "shorts"), F.when(F.col("slope").isNull(), "height")))
    return out.withColumn("few", F.col("n_samples") < FEW).withColumn("missing", missing)
