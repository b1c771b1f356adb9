"""An online me-or-not-me model per player, and scoring with it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Step size, decay, the samples of either kind before a model counts, and the spread under which a feature isn't scaled.
RATE, DECAY, READY, LEAST_SPREAD = 0.1, 1e-4, 8, 1e-6
MODEL = "player long, n long, n_pos long, n_neg long, mean array<double>, m2 array<double>, w array<double>, b double"


class _Online:
    def __init__(self, dims: int):
        self.n = self.n_pos = self.n_neg = 0
        self.mean, self.m2, self.w, self.b = np.zeros(dims), np.zeros(dims), np.zeros(dims), 0.0

    def learn(self, x: np.ndarray, label: int, weight: float) -> None:
        """Standardiser first, then one step of logistic regression; the bias doesn't decay."""
        self.n += 1
        gap = x - self.mean
        self.mean = self.mean + gap / self.n
        self.m2 = self.m2 + gap * (x - self.mean)
        self.n_pos, self.n_neg = self.n_pos + (label == 1), self.n_neg + (label != 1)
        spread = np.sqrt(self.m2 / self.n) if self.n > 1 else np.ones_like(x)
        z = (x - self.mean) / np.where(spread < LEAST_SPREAD, 1.0, spread)
        slip = weight * (1.0 / (1.0 + np.exp(-np.clip(self.w @ z + self.b, -30, 30))) - label)
        self.w = self.w - RATE * (slip * z + DECAY * self.w)
        self.b -= RATE * slip

    def row(self, player: int) -> tuple:
        return (player, self.n, self.n_pos, self.n_neg, self.mean.tolist(), self.m2.tolist(), self.w.tolist(), float(self.b))


def _fitted(batches, dims: int):
    player, model = None, None
    names = [c.split()[0] for c in MODEL.split(", ")]
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.player != player:
                if model is not None:
                    out.append(model.row(player))
                player, model = r.player, _Online(dims)
            x = np.array([np.nan] if r.features is None else r.features, float)
            if len(x) == dims and np.isfinite(x).all() and np.isfinite(r.weight) and r.weight > 0 and r.label == r.label:
                model.learn(x, int(r.label >= 0.5), float(r.weight))
        yield pd.DataFrame(out, columns=names)
    if model is not None:
        yield pd.DataFrame([model.row(player)], columns=names)


def identity_fit(samples: DataFrame, order: list[str], dims: int = 9) -> DataFrame:
    """One model a player from samples (player, features, label, weight) in the given order.

    Samples whose features are null, of another length or not finite are skipped, as are null, NaN, infinite, zero and negative
    weights and null labels; a player without a good sample has a model that has learned nothing. A label of 0.5 or more is for the player.
    Players are dealt over the tasks; a task streams its sorted samples and holds one model at a time.
    """
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = samples.repartition(n, "player").sortWithinPartitions("player", *order)
    return dealt.select("player", "features", F.col("label").cast("double").alias("label"), F.coalesce(F.col("weight").cast("double"), F.lit(float("nan"))).alias("weight")).mapInPandas(lambda it: _fitted(it, dims), MODEL)


def identity_score(model: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds p, the probability of being the row's player: 0.5 until the model is ready."""
    out = rows.join(model.hint("shuffle_hash"), "player", "left")  # a row a player
    z: Column = F.transform(F.arrays_zip("features", "mean", "m2", "w"), lambda t: (t["features"] - t["mean"]) / F.when(F.sqrt(t["m2"] / F.col("n")) < LEAST_SPREAD, 1.0).when(F.col("n") < 2, 1.0).otherwise(F.sqrt(t["m2"] / F.col("n"))) * t["w"])
    logit = F.aggregate(z, F.lit(0.0), lambda s, v: s + v) + F.col("b")
    ready = (F.col("n_pos") >= READY) & (F.col("n_neg") >= READY)
    return out.withColumn("p", F.when(F.coalesce(ready, F.lit(False)), 1.0 / (1.0 + F.exp(-logit))).otherwise(0.5)).select(*rows.columns, "p")


def identity_samples(boxes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Labelled boxes of each frame: the chosen one for the player, the others a little against.

    chosen: match_id, clip_id, frame, player (the chosen obj_id); other boxes weigh 0.3, and 2.0 where hard is set.
    """
    met = boxes.join(chosen, ["match_id", "clip_id", "frame"])
    mine = F.col("obj_id") == F.col("player")
    hard = F.coalesce(F.col("hard"), F.lit(False)) if "hard" in boxes.columns else F.lit(False)
    return met.withColumn("label", F.when(mine, 1).otherwise(0)).withColumn("weight", F.when(mine, 1.0).when(hard, 2.0).otherwise(0.3))
