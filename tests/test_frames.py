"""What meets within a frame, against all pairs."""

import numpy as np
import pytest

from touchline.operators import frames, linking


def boxes(rng, n, spread=1000.0, side=60.0, whole=False):
    x, y = rng.uniform(0, spread, n), rng.uniform(0, spread / 2, n)
    x, y = (np.floor(x), np.floor(y)) if whole else (x, y)
    w, h = (np.floor(rng.uniform(4, side, n)) for _ in range(2))
    return np.column_stack([x, y, x + w, y + h])


def plain_assigned(a, b, ids, least):
    out = []
    for p in a:
        if not np.isfinite(p).all() or not np.isfinite(b).all(axis=1).any():
            out.append(-1)
            continue
        found = []
        for k, q in enumerate(b):
            if np.isfinite(q).all():
                inter = max(min(p[2], q[2]) - max(p[0], q[0]), 0.0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0.0)
                union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - inter
                iou = inter / union if union > 0 else 0.0
                d = ((p[0] + p[2]) / 2 - (q[0] + q[2]) / 2) ** 2 + ((p[1] + p[3]) / 2 - (q[1] + q[3]) / 2) ** 2
                found.append((iou, d, ids[k], k))
        over = [f for f in found if f[0] > least]
        out.append(min(over, key=lambda f: (-f[0], f[2]))[3] if over else min(found, key=lambda f: (f[1], f[2]))[3])
    return out


@pytest.mark.parametrize("seed", range(8))
def test_assigned(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(frames, "CHUNK", 50 if seed % 2 else 1 << 20)
    a, b = boxes(rng, 60, (50, 300, 3000, 1e6)[seed % 4], whole=seed > 3), boxes(rng, int(rng.integers(1, 80)), (50, 300, 3000, 1e6)[seed % 4], whole=seed > 3)
    a[3, 1], ids = np.nan, rng.permutation(len(b)).astype(np.int64)
    if len(b) > 5:
        b[5] = b[4]
        b[2, 0] = np.nan
        a[7] = [-1e9, -1e9, 1e9, 1e9]
    assert frames.assigned(a, b, ids, 0.3).tolist() == plain_assigned(a, b, ids, 0.3)
    assert frames.assigned(a, b[:0], ids[:0], 0.3).tolist() == [-1] * 60


@pytest.mark.parametrize("seed", range(6))
def test_linked_pairs(seed, monkeypatch):
    """Pairs that a linker looks at are those of the whole matrix, and never more than a chunk at once."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(frames, "CHUNK", 64)
    a, b, gate2 = boxes(rng, 90, side=300.0 if seed % 2 else 60.0), boxes(rng, 70), linking.gate_of(1920.0, 1080.0)
    a[4, 2] = np.nan
    sizes, real = [], linking.scores
    monkeypatch.setattr(linking, "scores", lambda p, q, g: sizes.append(len(p)) or real(p, q, g))
    found = sorted(zip(*(x.tolist() for x in linking.pairs(a, b, gate2)), strict=True))
    k, j = (x.ravel() for x in np.meshgrid(np.arange(90), np.arange(70), indexing="ij"))
    score, allowed = real(a[k], b[j], gate2)
    assert found == sorted(zip(k[allowed].tolist(), j[allowed].tolist(), score[allowed].tolist(), strict=True)) and found
    assert max(sizes) <= 64 + 70


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_near_pairs_are_counted(n):
    """As all pairs have it, with ties at the limit, repeated ids and labels that are missing; and most pairs are never met."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x, y = np.floor(rng.uniform(-50, 50, n) * (seed % 3 + 1)), np.floor(rng.uniform(0, 30, n))
        x, y = (x + 1e6, y) if seed == 5 else (x, y)
        ids, label, met = rng.integers(0, max(1, n - n // 10), n), rng.integers(-1, 3, n), []
        near = lambda i, p: (met.append(len(i)), (x[i] - x[p]) ** 2 + (y[i] - y[p]) ** 2 <= 225 + (label[i] == label[p]) * 40)[1]  # noqa: B023, E731
        found = frames.count_pairs(x, y, ids, label, 15.0 * (1 - 1e-9), 17.0, near)
        i, p = np.triu_indices(n, 1)
        want = ((x[i] - x[p]) ** 2 + (y[i] - y[p]) ** 2 <= 225 + (label[i] == label[p]) * 40) & (ids[i] != ids[p])
        assert found == (want.sum(), (want & (label[i] == label[p]) & (label[i] >= 0)).sum())
        assert n < 700 or sum(met) < len(i) / 3


def test_counts_equal_the_joins(spark):
    from pyspark.sql import functions as F

    from touchline.operators import joins, trajectory

    rng, rows = np.random.default_rng(3), []
    for frame in range(3):
        for k, b in enumerate(boxes(rng, 60, 400.0, 300.0 if frame else 20.0, True).tolist()):
            rows.append((0, 1, frame, k, ["a", "b", None][k % 3], *(b if k else [None] * 4)))
    df = spark.createDataFrame(rows, "match_id long, clip_id long, frame long, obj_id long, team string, x1 double, y1 double, x2 double, y2 double")
    own = df.select("match_id", "clip_id", "frame", "obj_id", "x1", "y1", "x2", "y2")
    for least, gate in ((0.05, 30.0), (0.0, 30.0), (0.2, 200.0)):
        known = own.where("x1 is not null")
        want = joins.pairs_in_frame(known, known, least, gate).where("a_obj_id < b_obj_id").groupBy("frame").count().collect()
        assert {r.frame: r.pairs for r in joins.count_pairs_in_frame(df, least, gate).collect()} == {r["frame"]: r["count"] for r in want}
    points = df.withColumn("px", F.col("x1")).withColumn("py", F.col("y1"))
    want = trajectory.within_radius(points, 25.0).groupBy("frame").agg(F.count("*"), F.count_if("same_team")).collect()
    assert {r.frame: (r.pairs, r.same_team) for r in trajectory.count_within_radius(points, 25.0).collect()} == {r[0]: (r[1], r[2]) for r in want}
