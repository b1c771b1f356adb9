"""Players from tracks: evidence folds exactly, and every track belongs to one player."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from touchline.operators import profiles

ROWS = "match_id long, clip_id long, obj_id long, frame long, x1 double, y1 double, x2 double, y2 double, residual double, number string, number_weight double, looks array<double>"


def tracks(heights, numbers, seed=1, n=12):
    """A track for each height; numbers[k] are the shirt numbers read on track k."""
    rng, rows = random.Random(seed), []
    for k, h in enumerate(heights):
        for f in range(n):
            x, y = rng.uniform(300, 900), rng.uniform(500, 900)
            read = numbers[k][f] if f < len(numbers[k]) else ""
            rows.append((1, k % 3, k, f * (1 + k % 2), x, y, x + 20, y + 50, None if h is None else h + rng.uniform(-0.5, 0.5), read, 1.0, [float(k), rng.random()]))
    return rows


def close(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_folding_tracks_equals_folding_rows(spark):
    rows = tracks([1.0, 5.0, None, 9.0, 2.0, 3.0], [["7", "7", "x", "99"], ["7", "8"], [], ["11"] * 12, ["0", "-3"], ["23"]])
    rows += [(1, 0, 9, 0, 0.0, 0.0, 1.0, 1.0, float("nan"), "7", -1.0, None), (1, 0, 9, 1, None, 0.0, 1.0, 1.0, float("inf"), "7", float("nan"), [1.0]), (1, 0, 9, 2, 0.0, 0.0, 1.0, 1.0, 4.0, None, None, [1.0, None])]
    df = spark.createDataFrame(rows, ROWS)
    parts = profiles.tracklet_evidence(df, 1920.0, 1080.0, dims=2).withColumn("n_tracks", F.lit(1)).withColumn("clips", F.array("clip_id"))
    once = profiles.merge_evidence(parts, ["match_id"], 2).first()
    halves = profiles.merge_evidence(parts.withColumn("half", F.col("obj_id") % 2), ["match_id", "half"], 2)
    twice = profiles.merge_evidence(halves, ["match_id"], 2).first()
    good = [r[8] for r in rows if r[8] is not None and abs(r[8]) < 1e300]
    for got in (once, twice):
        assert (got.n_tracks, got.n_frames, got.clips) == (7, len(rows), [0, 1, 2])
        assert got.h_n == len(good) and close(got.h_mean, statistics.fmean(good)) and close(got.h_m2, statistics.pvariance(good) * len(good))
        assert got.votes == {7: 3.0, 8: 1.0, 11: 12.0, 23: 1.0}
        looks = [r[11] for r in rows if r[11] is not None and len(r[11]) == 2 and None not in r[11]]
        assert got.fp_n == len(looks) and close(got.fp, [statistics.fmean(v[k] for v in looks) for k in (0, 1)])
    speeds = []
    for k in range(6):
        own = sorted((r for r in rows if r[2] == k), key=lambda r: r[3])
        speeds += [(((b[4] + b[6] - a[4] - a[6]) / 2) ** 2 + ((b[5] + b[7] - a[5] - a[7]) / 2) ** 2) ** 0.5 / (b[3] - a[3]) for a, b in zip(own, own[1:], strict=False)]
    speeds += [0.0] if once.sp_n == len(speeds) + 1 else []
    assert once.sp_n == len(speeds) and close(once.sp_mean, statistics.fmean(speeds))


def test_sampled_reads(spark):
    df = spark.createDataFrame(tracks([1.0], [["7"] * 12]), ROWS)
    for stride, most, want in ((1, None, 12.0), (5, None, 3.0), (5, 2, 2.0), (1, 4, 4.0)):
        got = profiles.tracklet_evidence(df, 1920.0, 1080.0, stride, most, dims=2).first()
        assert got.votes == {7: want} and got.fp_n == want and got.h_n == 12


def test_every_track_is_one_players(spark):
    """Anchors, tracks that join them by height, a pool split by gaps, and two groups that turn out to be one number."""
    heights = [0.0, 0.5, 30.0, 31.0, 60.0, 61.0, 120.0, None, 119.0, -90.0]
    numbers = [["7", "7"], [], ["9", "9"], [], ["12"], ["12"], [], [], [], ["7"]]
    df = spark.createDataFrame(tracks(heights, numbers), ROWS)
    got = profiles.build_profiles(df, 1920.0, 1080.0, k=0.1).orderBy("pid").collect()
    assert sum(r.n_tracks for r in got) == len(heights) and sum(r.n_frames for r in got) == 120
    by = {r.number: r for r in got if r.number is not None}
    assert set(by) == {7, 9, 12} and by[7].n_tracks == 2 and by[9].n_tracks == 2
    assert by[12].n_tracks == 2 and by[12].number_conf == 1.0  # neither track reaches 1.5 by itself, both together reach 2
    assert [r.pid for r in got] == sorted(r.pid for r in got) and got[0].pid == "p01"
    assert sorted(r.n_tracks for r in got if r.number is None) == [1, 1, 2]  # without height, far off, and two of one height
    assert any(r.resid is None for r in got)
    assert profiles.build_profiles(df.limit(0), 1920.0, 1080.0).count() == 0
