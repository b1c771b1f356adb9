"""Literal cases with known results, invariance to partitioning, and files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import geometry as g
from touchline.functions import scoring as s
from touchline.operators import aggregates, filters, identity, linking
from touchline.operators import trajectory as t
from touchline.sources import files

KEYS = "match_id long, clip_id long, obj_id long, frame long"
BOX = KEYS + ", x1 double, y1 double, x2 double, y2 double"


def track(spark, points, obj=1, size=(20.0, 40.0)):
    rows = [(0, 0, obj, f, x - size[0] / 2, y - size[1] / 2, x + size[0] / 2, y + size[1] / 2) for f, x, y in points]
    return spark.createDataFrame(rows, BOX)


def metres(spark, points):
    return spark.createDataFrame([(0, 0, 1, f, float(x), float(y)) for f, x, y in points], KEYS + ", px double, py double")


def test_iou(spark):
    df = spark.createDataFrame([(10.0, 10.0, 30.0, 30.0, 20.0, 20.0, 40.0, 40.0)], "x1 double, y1 double, x2 double, y2 double, b_x1 double, b_y1 double, b_x2 double, b_y2 double")
    assert df.select(g.iou(g.Box(), g.Box("b_"))).first()[0] == pytest.approx(100 / 700)


def test_runner_stationary_teleport(spark):
    run = t.track_distances(metres(spark, [(k, 0.2 * k, 0) for k in range(1, 31)]), 30.0).first()
    assert (run.distance_m, run.top_speed_ms, run.n_frames) == (5.8, 6.0, 30)
    assert t.track_distances(metres(spark, [(k, 5, 5) for k in range(1, 31)])).first().distance_m == 0.0
    jump = t.track_distances(metres(spark, [(1, 0, 0), (2, 50, 0), (3, 50.2, 0)])).first()
    assert (jump.distance_m, jump.top_speed_ms) == (0.2, 6.0)


def test_jumps_found(spark):
    points = [(k, 100 + 5 * k + (600 if k in (25, 26, 60) else 0), 300) for k in range(1, 101)]
    assert [r.frame for r in t.find_jumps(track(spark, points)).where("jump").orderBy("frame").collect()] == [25, 26, 60]


def test_forward_segment(spark):
    rows = track(spark, [(k, 0, 0) for k in [*range(1, 41), *range(120, 131)]], obj=5)
    assert t.forward_segment(rows, 1).agg(F.min("frame"), F.max("frame")).first()[:] == (1, 40)
    assert t.forward_segment(rows, 100).agg(F.min("frame"), F.max("frame")).first()[:] == (120, 130)


def test_retrack_window(spark):
    df = spark.createDataFrame([(1000, 880, 10**6), (1000, None, 10**6), (1000, 1, 360), (5, None, 10**6)], "frame long, mark long, most long")
    got = [tuple(r) for r in df.select(*s.retrack_window(F.col("frame"), F.col("mark"), F.lit(30.0), F.col("most"))).collect()]
    assert got == [(880, 121), (910, 91), (641, 360), (1, 5)]


def test_homography_inverse(spark):
    h = (0.05, 0.002, -3.0, 0.001, 0.06, -2.0, 1e-4, 2e-4, 1.0)
    df = spark.createDataFrame([(100.0, 200.0), (1500.0, 900.0)], "x double, y double")
    x, y = g.project(h, F.col("x"), F.col("y"))
    back = g.project(g.inverse(h), F.col("px"), F.col("py"))
    for r in df.withColumn("px", x).withColumn("py", y).select("x", "y", back[0].alias("bx"), back[1].alias("by")).collect():
        assert r.bx == pytest.approx(r.x, abs=1e-6) and r.by == pytest.approx(r.y, abs=1e-6)


def test_landmarks(spark):
    points = {r.name: (r.x, r.y) for r in g.landmarks(spark).collect()}
    assert len(points) == 47 and points["L 22m / 5m up"] == (32.0, 65.0)


def test_height_clusters(spark):
    rows = spark.createDataFrame([(0, k, v) for k, v in enumerate([-20.0, -18.0, -21.0, 25.0, 24.0, 27.0, None])], "match_id long, obj_id long, resid double")
    got = {r.obj_id: r.cluster for r in t.cluster_by_value(rows, ["match_id"], "resid", F.lit(4.0)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: -1}


def test_whitelist_and_decision(spark):
    rows = spark.createDataFrame([(0, 0, 1, k, "73") for k in range(5)] + [(0, 0, 1, 10 + k, "3") for k in range(3)], KEYS + ", number string")
    assert filters.decide_number(filters.votes_of(rows), 2.0).first().number == 3


def detections(spark, frames, jitter=0.0):
    rows = []
    for f in frames:
        for k, (x, y) in enumerate(((100 + 2 * f + jitter, 200), (900 - 2 * f, 500))):
            rows.append((0, 0, f, k, float(x), float(y), x + 30.0, y + 60.0))
    return spark.createDataFrame(rows, "match_id long, clip_id long, frame long, ord long, x1 double, y1 double, x2 double, y2 double")


def tracklets(df):
    return sorted((r.stretch, r.local, r["count"]) for r in linking.link_tracklets(df, 1920, 1080).groupBy("stretch", "local").count().collect())


def test_linker(spark):
    assert [n for *_, n in tracklets(detections(spark, range(1, 31)))] == [30, 30]
    assert [n for *_, n in tracklets(detections(spark, [k for k in range(1, 21) if k not in (10, 11)]))] == [18, 18]
    assert len(tracklets(detections(spark, [*range(1, 15), *range(40, 55)]))) == 4


def test_linker_doesnt_depend_on_partitions(spark):
    df = detections(spark, [*range(1, 60), *range(80, 120)])
    want = tracklets(df)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert tracklets(df) == want
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert tracklets(df.orderBy(F.rand(1))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_linking_a_crowd(monkeypatch):
    """A crowded frame is dealt as by all pairs, best score first, but pairs are met in proportion to the boxes."""
    met, scores = [], linking.scores

    def counted(a, b, gate2):
        met.append(len(a))
        return scores(a, b, gate2)

    monkeypatch.setattr(linking, "scores", counted)
    rng, gate2 = np.random.default_rng(3), linking.gate_of(1920.0, 1080.0)
    at = lambda x, y, h: np.stack([x - 0.2 * h, y - 0.5 * h, x + 0.2 * h, y + 0.5 * h], 1)

    def crowd(n, kind):
        h = rng.choice([40.0, 60.0, 90.0], n)
        if kind == "grid":  # many equal scores
            return at(rng.integers(0, 60, n) * 3.0, rng.integers(0, 30, n) * 4.0, h)
        return at(rng.normal(800, 40, n), rng.normal(500, 40, n), h) if kind == "heap" else at(rng.uniform(200, 1600, n), rng.uniform(300, 900, n), h)

    for kind in ("grid", "heap", "field"):
        old = crowd(700, kind)
        new = np.concatenate([old[:500] + rng.integers(-4, 5, (500, 1)), crowd(200, kind)])
        old[3], new[5, 2] = np.nan, np.inf
        i, j = (x.ravel() for x in np.meshgrid(np.delete(np.arange(700), 3), np.delete(np.arange(700), 5), indexing="ij"))
        score, allowed = scores(old[i], new[j], gate2)
        want, used = np.full(700, -1), set()
        for _, a, b in sorted(zip(score[allowed], i[allowed], j[allowed], strict=True), reverse=True):
            if a not in used and want[b] < 0:
                want[b] = a
                used.add(a)
        assert (linking.best_first(old, new, gate2) == want).all() and len(used) > 400
    met.clear()
    old = crowd(8000, "field")
    found = linking.best_first(old, old + rng.uniform(-4, 4, (8000, 1)), gate2)
    assert (found >= 0).mean() > 0.9 and sum(met) < 60 * 8000


def test_moments_merge(spark):
    rows = spark.createDataFrame([(k % 7, float(k * k % 31)) for k in range(100)], "part long, v double")
    whole = aggregates.moments(rows, [], F.col("v")).first()
    merged = aggregates.combine_moments(aggregates.moments(rows, ["part"], F.col("v")), []).first()
    assert merged.n == whole.n and merged["mean"] == pytest.approx(whole["mean"]) and merged.m2 == pytest.approx(whole.m2)


def test_identity_separates(spark):
    rows = [(1, k, [3.0 + 0.1 * (k % 5)] * 9, 1, 1.0) for k in range(40)] + [(1, k, [-3.0 - 0.1 * (k % 5)] * 9, 0, 1.0) for k in range(40)] + [(1, 99, [float("nan")] * 9, 1, 1.0)]
    samples = spark.createDataFrame(rows, "player long, k long, features array<double>, label int, weight double")
    model = identity.identity_fit(samples, ["k", "label"])
    got = {r.label: r.p for r in identity.identity_score(model, samples.where("k < 99")).groupBy("label").agg(F.avg("p").alias("p")).collect()}
    assert got[1] > 0.7 and got[0] < 0.3 and model.first().n == 80


def test_confidence_terms(spark):
    df = spark.createDataFrame([("manual", None), ("sam2", 1.0), ("detection", 0.0)], "source string, h double")
    got = [round(r[0], 4) for r in df.select(s.frame_confidence(F.col("source"), height=F.col("h"))).collect()]
    assert got == [0.85, 0.54, 0.48]


def test_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text("frame,obj_id,x1,y1,x2,y2,team,conf,number\n1,3.0,1,2,3,4,home,0.5,7\n2,3,x,2,3,4,home,0.5,\n3,4,1,2,3,4,,bad,\n")
    got = files.read_objects(spark, str(tmp_path / "o.csv")).orderBy("frame").collect()
    assert [(r.frame, r.obj_id, r.team, r.conf, r.number) for r in got] == [(1, 3, "home", 0.5, "7"), (3, 4, "", 0.0, "")]
    rows = spark.createDataFrame([(0, 0, 2, 1, 1.005, 2.0, 3.0, 4.0, "manual", None), (0, 0, 1, 1, 1.0, 2.0, 3.0, 4.0, "csrt", 0.12345)], "match_id int, clip_id int, frame int, target_id int, x1 double, y1 double, x2 double, y2 double, source string, confidence double")
    files.write_tracks(rows, str(tmp_path / "t"))
    back = files.read_tracks(spark, str(tmp_path / "t")).orderBy("frame").collect()
    assert [(r.frame, r.confidence, r.source) for r in back] == [(1, 0.123, "csrt"), (2, 1.0, "manual")]
    for name, h in (("a", [[1, 0, 0], [0, 1, 0], [0, 0, 1]]), ("b", [[0, 0, 0], [0, 0, 0], [0, 0, 0]])):
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / f"{name}.pitch.json").write_text(json.dumps({"H": h, "anchor_frame": 3}))
    (tmp_path / "p" / "c.pitch.json").write_text("{broken")
    assert [r.anchor_frame for r in files.read_pitch(spark, str(tmp_path / "p")).collect()] == [3]
    (tmp_path / "m").mkdir()
    for name in ("ann__one.mp4", "two.MOV", "notes.txt"):
        (tmp_path / "m" / name).write_text("x")
    assert [(r.key, r.player) for r in files.clip_manifest(spark, str(tmp_path / "m")).orderBy("key").collect()] == [("ann__one", "ann"), ("two", None)]


def test_edits_and_undo(spark):
    from touchline.operators import edits

    rows = track(spark, [(k, k, 0) for k in range(1, 41)], 5).unionByName(track(spark, [(k, k, 9) for k in range(20, 30)], 7))
    (match_id, clip_id) = rows.select("match_id", "clip_id").first()
    other = rows.withColumn("clip_id", F.col("clip_id") + 1)  # the same obj_ids in another clip are other tracks
    flat = lambda df: sorted((r.obj_id, r.frame, r.y1) for r in df.where(F.col("clip_id") == clip_id).collect())
    schema = "match_id long, clip_id long, seq long, op string, obj_id long, start long, target long, x1 double, y1 double, x2 double, y2 double"

    def replay(*log):
        table = spark.createDataFrame([(match_id, clip_id, k, op, obj, start, target, *(box or (None,) * 4)) for k, (op, obj, start, target, box) in enumerate(log)], schema)
        out = edits.apply_edit_log(rows.unionByName(other), table)
        assert out.where(F.col("clip_id") != clip_id).count() == other.count() and out.columns == rows.columns
        return flat(out)

    merged = replay(("merge_forward", 5, 20, 7, None))
    assert {r[:2] for r in merged} == {(5, k) for k in range(1, 20)} | {(7, k) for k in range(20, 41)} and len(merged) == 40
    assert replay(("merge_forward", 5, 20, 7, None), ("undo", None, None, None, None), ("nuke", 7, None, None, None), ("undo", None, None, None, None)) == flat(rows)
    assert {r[0] for r in replay(("nuke", 5, None, None, None))} == {7}
    assert len(replay(("delete_forward", 5, 30, None, None))) == 29 + 10
    assert len(replay(("remove_frame", 5, 3, None, None))) == 49
    once = replay(("upsert", 5, 3, None, (1.0, -5.0, 2.0, 6.0)), ("upsert", 5, 99, None, (1.0, -6.0, 2.0, 6.0)))
    assert len(once) == 51 and (5, 3, -5.0) in once and (5, 99, -6.0) in once
    gone = spark.createDataFrame([(match_id, clip_id, 7)], "match_id long, clip_id long, obj_id long")
    assert edits.bulk_delete(rows.unionByName(other), gone).count() == 50 + 40 and edits.nuke(rows.unionByName(other), match_id, clip_id, 5).count() == 60


def test_edit_log_edges(spark):
    """bulk_delete, many frames, undo of what changed something, nulls, longs past 2**53 and columns that aren't nullable."""
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    from touchline.operators import edits

    big = 2**60 + 1
    schema = StructType([StructField(c, LongType(), c in ("obj_id", "frame")) for c in ("match_id", "clip_id", "obj_id", "frame")] + [StructField(c, DoubleType()) for c in ("x1", "y1", "x2", "y2")] + [StructField("token", LongType(), True), StructField("must", LongType(), False)])
    data = [(1, 1, o, f, 0.0, 0.0, 1.0, 2.0, big + f if f % 2 else None, 5) for o in (3, 4, 5) for f in range(6)] + [(1, 1, None, 2, 0.0, 0.0, 1.0, 2.0, big, 5), (1, 1, 3, None, 0.0, 0.0, 1.0, 2.0, None, 5)]
    rows = spark.createDataFrame(data, schema)
    log_schema = "match_id long, clip_id long, seq long, op string, obj_id long, start long, target long, x1 double, y1 double, x2 double, y2 double, obj_ids array<long>, frames array<long>"

    def replay(*log):
        table = spark.createDataFrame([(1, 1, k, op, obj, start, target, 9.0, 9.0, 10.0, 11.0, ids, frames) for k, (op, obj, start, target, ids, frames) in enumerate(log)], log_schema)
        return sorted(map(tuple, edits.apply_edit_log(rows, table).collect()), key=str)

    plain = sorted(data, key=str)
    out = replay(("upsert", 3, 9, None, None, None))
    assert [r for r in out if r[3] == 9] == [(1, 1, 3, 9, 9.0, 9.0, 10.0, 11.0, None, None)] and [r for r in out if r[3] != 9] == plain
    assert replay(("bulk_delete", None, None, None, [3, 4], None)) == [r for r in plain if r[2] not in (3, 4) or r[3] is None]
    assert replay(("bulk_delete", 5, None, None, None, None)) == [r for r in plain if r[2] != 5]
    assert replay(("remove_frames", 3, None, None, None, [0, 1, 4])) == [r for r in plain if not (r[2] == 3 and r[3] in (0, 1, 4))]
    nothing = [("merge_forward", 3, 0, None, None, None), ("nuke", None, None, None, None, None), ("delete_forward", 3, None, None, None, None), ("nuke", 77, None, None, None, None), ("undo", None, None, None, None, None)]
    assert replay(*nothing) == plain
    assert replay(("bulk_delete", None, None, None, [3, 4], None), ("nuke", 99, None, None, None, None), ("undo", None, None, None, None, None)) == plain
    with pytest.raises(Exception, match="no edit is called"):
        replay(("paint", 3, 0, None, None, None))
    assert edits.apply_edit_log(rows, spark.createDataFrame([], log_schema)).count() == len(data)


def test_identity_samples_that_teach_nothing(spark):
    """The model equals a plain loop over the good samples; null features, bad weights and null labels are skipped."""
    import math
    import random

    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    good = [(1, k, [rng.gauss(k % 2, 1), rng.gauss(0, 1), 4.0], float(k % 2), rng.choice([1.0, 0.3, 2.0])) for k in range(60)]
    bad = [(1, 100, None, 1.0, 1.0), (1, 101, [1.0], 1.0, 1.0), (1, 102, [nan, 0.0, 0.0], 1.0, 1.0), (1, 103, [1.0, None, 0.0], 1.0, 1.0)]
    bad += [(1, 104 + k, [9.0, 9.0, 9.0], 1.0, w) for k, w in enumerate([None, nan, inf, 0.0, -2.0])] + [(1, 120, [9.0, 9.0, 9.0], None, 1.0), (2, 1, None, 1.0, 1.0)]
    schema = "player long, k long, features array<double>, label double, weight double"
    n, mean, m2, w, b = 0, [0.0] * 3, [0.0] * 3, [0.0] * 3, 0.0
    for _, _, x, label, weight in good:
        n += 1
        for j in range(3):
            gap = x[j] - mean[j]
            mean[j] += gap / n
            m2[j] += gap * (x[j] - mean[j])
        spread = [math.sqrt(max(v / n, 0)) if n > 1 else 1.0 for v in m2]
        z = [(x[j] - mean[j]) / (1.0 if spread[j] < 1e-6 else spread[j]) for j in range(3)]
        slip = weight * (1 / (1 + math.exp(-sum(a * c for a, c in zip(w, z)) - b)) - label)
        w = [w[j] - 0.1 * (slip * z[j] + 1e-4 * w[j]) for j in range(3)]
        b -= 0.1 * slip
    mixed = good + bad
    rng.shuffle(mixed)
    model = {r.player: r for r in identity.identity_fit(spark.createDataFrame(sorted(mixed, key=lambda r: r[1]), schema), ["k"], dims=3).collect()}
    one, none = model[1], model[2]
    assert (one.n, one.n_pos, one.n_neg) == (60, 30, 30) and one.w == pytest.approx(w) and one.b == pytest.approx(b) and one.mean == pytest.approx(mean)
    assert (none.n, none.w, none.b) == (0, [0.0] * 3, 0.0)


def test_detections_without_gate(spark, tmp_path):
    from touchline.operators import filters
    from touchline.sources import files

    spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0, 6)], "frame int, x1 double, y1 double, x2 double, y2 double, match_id int").write.parquet(str(tmp_path / "d"))
    rows = files.read_detections(spark, str(tmp_path / "d"))
    assert rows.first().kept is None and filters.kept_only(rows).count() == 1


def test_camera_chain(spark):
    from touchline.operators import selection

    shift = lambda d: [1.0, 0.0, d, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    steps = spark.createDataFrame([(0, 0, 1, shift(0.0), 50), (0, 0, 2, shift(4.0), 50), (0, 0, 3, None, 0), (0, 0, 4, shift(2.0), 50), (0, 0, 5, shift(9.0), 3)], "match_id long, clip_id long, frame long, step array<double>, inliers int")
    got = [(r.frame, r.healthy, r.m13) for r in selection.camera_chain(steps).orderBy("frame").collect()]
    assert got == [(1, True, 0.0), (2, True, -4.0), (3, False, -4.0), (4, True, -6.0), (5, False, -6.0)]


def test_landmark_correspondences(spark):
    from touchline.operators import calibration

    named = spark.createDataFrame([(n, float(k), 2.0 * k) for k, n in enumerate("abcde")], "name string, x double, y double")
    steps = [(m, 1, f, [1.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 3 if f == 4 else 60) for m in (1, 2) for f in (1, 2, 3, 4, 5)]
    chain = selection_chain(spark, steps)
    clicks = [(1, 1, k, f, n, 100.0, 50.0) for k, (f, n) in enumerate([(2, "a"), (3, "b"), (5, "b"), (4, "c"), (1, "d"), (2, "d"), (3, "e"), (3, "elsewhere")])]
    clicks += [(2, 1, 0, 2, "a", 1.0, 1.0), (2, 1, 1, 3, "b", 1.0, 1.0), (2, 1, 2, 3, "c", float("nan"), 1.0), (2, 1, 3, 3, "d", None, 1.0)]
    table = spark.createDataFrame(clicks, "match_id long, clip_id long, click_id long, frame long, name string, x double, y double")
    found = calibration.landmark_correspondences(table, chain, named).collect()
    # the weak frame's and the earlier frame's clicks don't count, the later click of b does; match 2 has too few landmarks
    assert {(r.match_id, r.name, round(r.image_x, 6), r.y) for r in found} == {(1, "a", 100.0, 0.0), (1, "b", 96.0, 2.0), (1, "d", 100.0, 6.0), (1, "e", 98.0, 8.0)}
    assert {r.anchor_frame for r in found} == {2}
    error = calibration.reprojection_error(calibration.landmark_correspondences(table, chain, named), (0.01, 0, 0, 0, 0.01, 0, 0, 0, 1)).first()
    assert error.n == 4 and error.flagged
    assert calibration.landmark_correspondences(table.limit(0), chain, named).count() == 0


def selection_chain(spark, steps):
    from touchline.operators.selection import camera_chain

    return camera_chain(spark.createDataFrame(steps, "match_id long, clip_id long, frame long, step array<double>, inliers int"))


def test_match_report_and_me(spark):
    from touchline.operators.profiles import match_report, me_profile, merge_same_number

    numbers = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "match_id long, my_number int")
    known = spark.createDataFrame([(1, 7, 90, 2, 0.5), (1, 11, 40, 1, 0.25), (1, None, 5, 1, 0.0), (2, 9, 10, 1, 0.1)], "match_id long, number int, n_frames long, n_clips long, evidence double")
    rows = {r.match_id: r for r in match_report(known, numbers).collect()}
    assert rows[1].identified and rows[1].n_frames == 90 and [p.number for p in rows[1].ruled_out] == [11]
    assert not rows[2].identified and rows[2].n_frames is None and rows[2].n_ruled_out == 1
    assert not rows[3].identified and rows[3].role is None and rows[3].n_ruled_out == 0
    teams = spark.createDataFrame([(1, "x", False, 0), (1, "home", True, 2), (1, "away", True, 3)], "match_id long, team string, tracked boolean, ord int")
    heights = spark.createDataFrame([(1, 15, 4.0), (2, 14, 5.0)], "match_id long, n long, mean double")
    told = {r.match_id: tuple(r)[1:] for r in me_profile(numbers, teams, heights).collect()}
    assert told == {1: (7, "forward", "home", 4.0), 2: (7, "forward", None, None), 3: (None, None, None, None)}
    parts = [(1, p, n, 1, c, ["k", p], c, m, 2.0) for p, n, c, m in (("a", 7, 4, 1.0), ("b", 7, 4, 3.0), ("c", None, 2, 9.0), ("d", None, 0, None))]
    profiles = spark.createDataFrame(parts, "match_id long, pid string, number int, n_tracks long, n_frames long, clips array<string>, h_n long, h_mean double, h_m2 double")
    for side in ("zx", "zy"):
        profiles = profiles.selectExpr("*", *[f"h_{c} as {side}_{c}" for c in ("n", "mean", "m2")])
    merged = {r.pid: r for r in merge_same_number(profiles).collect()}
    assert set(merged) == {"a", "c", "d"} and merged["a"].n_tracks == 2 and list(merged["a"].clips) == ["a", "b", "k"]
    assert (merged["a"].h_n, merged["a"].h_mean, merged["a"].h_m2) == (8, 2.0, 12.0) and merged["d"].h_mean is None


def test_height_gate_at_the_tolerance(spark):
    """A residual as far off as is tolerated fits on either side of the rounding of a running mean."""
    means = [1.1, 1.1 - 2e-16, 1.1 + 4e-16, 1.1 + 1e-6]
    rows = [(0, 0, 1, k, 2.0, mean, 0.9, True) for k, mean in enumerate(means)] + [(0, 0, 1, 9, 2.0, 1.09, 0.9, True), (0, 0, 1, 10, 2.0, 2.0, 0.9, True)]
    df = spark.createDataFrame(rows, "match_id long, clip_id long, frame long, obj_id long, residual double, h_mean double, h_tol double, h_ready boolean")
    assert sorted(r.obj_id for r in filters.height_gate(df).collect()) == [0, 1, 2, 3, 10]


def test_report_order_at_half_a_place(spark, tmp_path):
    """Tracks whose mean confidence is 0.645 in any order of summing score alike, in the query as in its SQL."""
    import duckdb

    from touchline.plans import report_queries

    rows = [(k, 34 + p * 70, obj, 1 + k % 7, 0.0, "N", k) for obj in range(40) for k, p in enumerate(range(obj % 5 + 2))] + [(k, 35 + 70 * k, obj, 2, 0.0, "N", k) for obj in range(40) for k in range(obj % 5 + 2)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_shipdate long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in report_queries.ordered(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(con.execute(report_queries.SQL["t4_report_order"]).fetchall())
    assert got == want


def test_clicks_arent_gathered_by_clip(spark):
    """Clicks are shuffled by clip and frame; what is known of a clip reaches them by a row a frame."""
    from touchline.plans import season_queries

    plan = season_queries.correspondences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "click_id" in line]
    assert "rightHint=(strategy=shuffle_hash)" in plan and not joins


def test_edits_leave_unnamed_tracks_alone(spark, monkeypatch):
    """Only tracks that the log names, as what is edited or as a target, are handed to the replay."""
    from touchline.operators import edits

    def seen(rows, log, gap):
        assert set(rows.column("obj_id").to_pylist()) <= {1, 2}, "an unnamed track"
        return rows

    monkeypatch.setattr(edits, "_replayed", seen)
    rows = spark.createDataFrame([(0, 0, obj, f) for obj in (1, 2, 3) for f in range(5)], "match_id long, clip_id long, obj_id long, frame long")
    log = spark.createDataFrame([(0, 0, 1, "merge_forward", 1, 2, 2)], "match_id long, clip_id long, seq long, op string, obj_id long, start long, target long")
    assert edits.apply_edit_log(rows, log).count() == 15


def test_smoothing_in_blocks(spark, monkeypatch):
    """Blocks of frames give what all frames give, points of one frame count together, and no aggregation holds every frame that a point counts for."""
    import random

    from touchline.operators import pose

    monkeypatch.setattr(pose, "BLOCK", 8)
    rng = random.Random(2)
    rows = [(clip, f, kp, rng.random(), rng.choice([None, rng.random()]), rng.choice([None, 0.0, 0.5, 1.0])) for clip in (0, 1) for kp in (0, 3) for f in range(-20, 60) if rng.random() < 0.6 for _ in range(1 + (f == 7))]
    out = pose.smooth_pose(spark.createDataFrame(rows, "clip_id long, frame long, kp int, x double, y double, vis double"))
    want = {}
    for clip, f, kp in {r[:3] for r in rows}:
        near = [(6 - abs(r[1] - f), *r[3:5], r[5] or 0.0) for r in rows if r[0] == clip and r[2] == kp and abs(r[1] - f) <= 5]
        w = sum(d * v for d, _, _, v in near)
        mean = lambda k: (lambda own: round(sum(own) / w, 9) if own else None)([n[0] * n[3] * n[k] for n in near if n[k] is not None])  # noqa: B023, E731
        want[clip, f, kp] = (mean(1), mean(2), round(sum(n[3] for n in near) / len(near), 9)) if w > 1e-6 else (0.0, 0.0, 0.0)
    found = out.collect()
    assert len(found) == len(want) and {(r.clip_id, r.frame, r.kp): tuple(None if v is None else round(v, 9) for v in (r.x, r.y, r.vis)) for r in found} == want
    assert "Aggregate" not in out._jdf.queryExecution().sparkPlan().toString()


def test_jumps_go_in_one_shuffle(spark):
    """As plain medians have it, with boxes and tracks that are missing; no join reads the rows again."""
    import random
    from statistics import median

    from touchline.operators import trajectory

    rng = random.Random(5)
    rows = [(0, 0, k, f, *([None] * 4 if rng.random() < 0.05 else (lambda x: (x, 0.0, x + 10, 20.0))(float(f + rng.choice([0] * 9 + [500]))))) for k in (1, 2, None) for f in range(0, 90 if k != 2 else 9, 3)]
    df = spark.createDataFrame(rows, "match_id long, clip_id long, obj_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    want = []
    for k in (1, 2, None):
        own = [r for r in rows if r[2] == k]
        last = [r for r in own if r[3] > own[-1][3] - 40]
        last = own if len(last) < 5 else last
        for r in own:
            at = last.index(r) if r in last else None
            near = [(q[4] + q[6]) / 2 for q in last[max(0, at - 7) : at + 8] if q[4] is not None] if at is not None else []
            if k is None or at is None or r[4] is None or abs((r[4] + r[6]) / 2 - median(near)) <= 100:
                want.append((k, r[3]))
    out = trajectory.clean_jumps(df, 2.0)
    assert sorted((r.obj_id or 0, r.frame) for r in out.collect()) == sorted((k or 0, f) for k, f in want) and len(want) < len(rows)
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()
