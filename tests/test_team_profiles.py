"""Team colours: clusters against every partition, histograms that cover every pixel, and what could not be learned."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import team_profiles as learning

PIXELS = "match_id long, team string, obj_id long, frame long, region string, h int, s int, v int"


def test_clusters_against_all_partitions():
    rng = np.random.default_rng(4)
    for k in (2, 3):
        points = np.concatenate([rng.normal(c, 2.0, (3, 3)) for c in ([0, 0, 0], [40, 0, 0], [0, 60, 0])])
        weights = rng.integers(1, 9, len(points)).astype(float)

        def inertia(labels, points=points, weights=weights):
            total = 0.0
            for j in set(labels):
                own = np.array(labels) == j
                total += float((((points[own] - np.average(points[own], axis=0, weights=weights[own])) ** 2).sum(1) * weights[own]).sum())
            return total

        best = min(inertia(labels) for labels in product(range(k), repeat=len(points)))
        assert inertia(learning.k_means(points, weights, k).tolist()) == pytest.approx(best)
    assert learning.k_means(np.zeros((4, 3)), np.ones(4), 3).tolist() == [0] * 4 and len(learning.k_means(np.ones((1, 3)), np.ones(1), 3)) == 1


def made(rng, team, obj, region, middle, n, spread=3.0):
    hsv = np.clip(np.round(rng.normal(middle, spread, (n, 3))), 0, [179, 255, 255]).astype(int)
    return [(1, team, obj, k % 7, region, *map(int, row)) for k, row in enumerate(hsv)]


def test_dominant_band(spark):
    rng = np.random.default_rng(1)
    navy, white, red = [110, 150, 80], [150, 20, 230], [5, 230, 100]
    rows = made(rng, "a", 1, "torso", navy, 500) + made(rng, "a", 1, "torso", white, 120) + made(rng, "a", 1, "torso", red, 110) + made(rng, "a", 1, "torso", [60, 150, 120], 900)  # jersey, number, grass
    rows += made(rng, "b", 2, "torso", white, 150) + made(rng, "b", 2, "shorts", navy, 29) + [(1, "c", 3, 0, "torso", None, 1, 1)]
    df = spark.createDataFrame(rows, PIXELS)
    clear = learning.clear_pixels(df)
    histogram = learning.colour_histogram(clear, ["team", "region"])
    assert histogram.agg(F.sum("n")).first()[0] == clear.count() == 500 + 120 + 110 + 150 + 29
    bands = {(r.team, r.region): r for r in learning.colour_bands(df, ["team", "region"]).collect()}
    assert set(bands) == {("a", "torso"), ("b", "torso")}  # 29 pixels are too few
    one = bands["a", "torso"]
    own = np.array([r[5:] for r in rows if r[1] == "a" and abs(r[5] - 110) < 20 and 100 < r[6] < 200])
    assert one.n == 730 and one.share == pytest.approx(500 / 730)
    for j, c in enumerate("hsv"):
        pad, most = learning.BOUNDS[c]
        assert one[f"{c}_lo"] == pytest.approx(max(0.0, own[:, j].mean() - 1.6 * own[:, j].std() - pad)) and one[f"{c}_hi"] == pytest.approx(min(most, own[:, j].mean() + 1.6 * own[:, j].std() + pad))
    again = {(r.team, r.region): r for r in learning.colour_bands(df.orderBy(F.rand(3)).repartition(5), ["team", "region"]).collect()}
    assert again == bands
    part = learning.band_fraction(df, learning.colour_bands(df, ["team"]), ["team"], ["team", "obj_id"]).collect()
    assert all(0.2 < r.fraction < 1.0 for r in part) and {r.team for r in part} == {"a", "b"}


def test_profiles_say_what_is_missing(spark):
    rng = np.random.default_rng(2)
    pixels = spark.createDataFrame(made(rng, "a", 1, "torso", [110, 150, 80], 40) + made(rng, "none", 9, "torso", [110, 150, 80], 40), PIXELS)
    samples = [(1, "a", 40.0 + k, 400.0 + 10 * k, [1.0, float(k)]) for k in range(12)] + [(1, "b", None, 1.0, None), (1, "b", 5.0, 2.0, [3.0, 3.0])]
    df = spark.createDataFrame(samples, "match_id long, team string, height double, cy double, features array<double>")
    got = {r.team: r for r in learning.learn_team_profiles(df, pixels, df.where("team = 'a'")).collect()}
    assert set(got) == {"a", "b"} and got["a"].missing == ["shorts"] and got["b"].missing == ["primary", "shorts", "height"]
    assert got["a"].track and not got["b"].track and not got["a"].few and got["b"].few and got["b"].n_samples == 2
    assert got["a"].slope == pytest.approx(0.1) and got["a"].fingerprint == [1.0, 5.5] and got["b"].fingerprint == [3.0, 3.0]
    assert learning.learn_team_profiles(df.limit(0), pixels).count() == 0
