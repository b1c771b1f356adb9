"""Sound and camera motion: blocks against whole signals and sequential scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import align, selection


def claps(rng, n, rate, spots, noise=0.02):
    out = np.abs(rng.normal(0, noise, n))
    for at in spots:
        length = min(int(0.05 * rate), n - at)
        out[at : at + length] += np.exp(-np.arange(length) / (0.01 * rate))
    return out


def table(spark, clips):
    import pandas as pd

    return spark.createDataFrame(pd.concat([pd.DataFrame({"clip": name, "i": np.arange(len(x)), "amp": x}) for name, x in clips.items()]))


def whole(a, b):
    """The lag of the highest full correlation, by one FFT over everything."""
    a, b = ((x - x.mean()) / np.linalg.norm(x - x.mean()) for x in (a, b))
    n = 1 << (len(a) + len(b)).bit_length()
    sums = np.fft.irfft(np.conj(np.fft.rfft(a, n)) * np.fft.rfft(b, n), n)
    sums = np.concatenate([sums[-(len(a) - 1) :], sums[: len(b)]])
    return int(np.argmax(sums)) - (len(a) - 1), float(sums.max())


@pytest.mark.parametrize("size", [64, 500, 4096])
def test_all_lags_by_blocks(spark, size):
    rng = np.random.default_rng(1)
    clips = {"a": claps(rng, 900, 100, [200, 333, 640]), "b": claps(rng, 1500, 100, [950, 1083, 1390]), "c": claps(rng, 700, 100, [30, 163, 470]), "silent": np.zeros(300), "short": np.ones(20), "const": np.ones(100)}
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("a", "silent"), ("a", "short"), ("a", "const"), ("a", "missing")], "clip_a string, clip_b string")
    got = {(r.clip_a, r.clip_b): (r.lag, r.peak, r.seconds) for r in align.audio_offset(table(spark, clips), pairs, None, 100.0, size=size).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "a")}
    for (a, b), (lag, peak, seconds) in got.items():
        assert (lag, pytest.approx(peak)) == whole(clips[a], clips[b]) and seconds == lag / 100.0
    near = {r.clip_b: r.lag for r in align.audio_offset(table(spark, clips), pairs.where("clip_a = 'a'"), 200, 100.0, size=size).collect()}
    assert near["c"] == -170 and abs(near.get("b", 0)) <= 200


def test_fine_pass_over_the_full_range(spark):
    """Twenty seconds at 8 kHz: the coarse pass finds the place, the fine one the sample."""
    rng, rate = np.random.default_rng(2), 8000
    spots = [30_000, 61_111, 90_017]
    clips = {"a": claps(rng, 160_000, rate, spots), "b": claps(rng, 160_000, rate, [s + 40_321 for s in spots])}
    got = align.audio_offset(table(spark, clips), spark.createDataFrame([("a", "b"), ("b", "a")], "clip_a string, clip_b string"), None, float(rate)).collect()
    assert {(r.clip_a, r.lag) for r in got} == {("a", 40_321), ("b", -40_321)}
    for r in got:
        assert (r.lag, pytest.approx(r.peak)) == whole(clips[r.clip_a], clips[r.clip_b])


def sequential(rows, least=25):
    out, chain, key = {}, None, None
    for match, clip, frame, step, inliers in sorted(rows, key=lambda r: r[:3]):
        if (match, clip) != key:
            key, chain = (match, clip), np.eye(3)
        good = step is not None and len(step) == 9 and None not in step and np.isfinite(step).all() and (inliers or 0) >= least
        if good:
            chain = np.array(step).reshape(3, 3) @ chain
            chain = chain / chain[2, 2]
        out[match, clip, frame] = (good, np.linalg.inv(chain).ravel())
    return out


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_camera_chain_by_blocks(spark, size):
    rng, rows = np.random.default_rng(3), []
    for clip in range(3):
        for frame in range(0, 120, 1 + clip):
            step = (np.eye(3) + rng.normal(0, 0.004, (3, 3)) * [[1, 1, 300], [1, 1, 300], [1e-3, 1e-3, 1]]).ravel().tolist()
            rows.append((1, clip, frame, {5: None, 9: step[:4], 13: [float("nan")] * 9, 17: [None] * 9}.get(frame, step), int(rng.integers(10, 90)) if frame % 6 else None))
    df = spark.createDataFrame(rows, "match_id long, clip_id long, frame long, step array<double>, inliers int").orderBy(F.rand(1))
    want = sequential(rows)
    got = {(r.match_id, r.clip_id, r.frame): (r.healthy, np.array(r[4:])) for r in selection.camera_chain(df, size=size).collect()}
    assert set(got) == set(want) and sum(g[0] for g in got.values()) > 100
    for key, (healthy, back) in want.items():
        assert got[key][0] == healthy and got[key][1] == pytest.approx(back, rel=1e-6, abs=1e-8)
