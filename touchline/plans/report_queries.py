"""Queries of rosters, reports, snapping and body parts, with the SQL that checks them."""

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import joins, pose, registry_store, roster
from . import fixtures
from .box_queries import ROI, TRS, detections, rois
from .fixtures import objects, sql
from .match_queries import SQL as MATCH_SQL
from .season_queries import _obs, observations
from .trajectory_queries import CENTRE, TR

ROSTER = """SELECT team, 'p' || key AS player_id, key AS ord, key % 12 = 0 AS is_me, CASE WHEN key % 3 <> 1 OR key % 2 = 0 THEN CAST(key % 23 + 1 AS INTEGER) END AS number, CASE WHEN key % 5 = 0 THEN 'name ' || key END AS display_name,
 CASE WHEN key % 7 <> 0 THEN resid END AS resid, key % 50 + 1 AS h_n, CASE WHEN key % 5 <> 1 THEN key % 7 + 1e0 END AS look, key % 9 AS fp_n, key % 4 + 1e0 AS votes, n_frames, key % 4 + 1 AS n_clips, match_id FROM obs"""


def players(spark, sf):
    """Every track's profile as a player of its team, some without height, looks, number or name."""
    k = F.col("key")
    number = F.when((k % 3 != 1) | (k % 2 == 0), (k % 23 + 1).cast("int"))
    worn = F.struct(number.alias("number"), F.lit(1).cast("long").alias("matches"), F.col("match_id").alias("last_seen"))
    return observations(spark, sf).select(
        "team", F.concat(F.lit("p"), "key").alias("player_id"), k.alias("ord"), F.when(k % 5 == 0, F.concat(F.lit("name "), "key")).alias("display_name"), (k % 12 == 0).alias("is_me"), number.alias("number"),
        F.when(number.isNotNull(), F.array(worn)).otherwise(F.array().cast(roster.WORN)).alias("history"), F.when(k % 7 != 0, F.col("resid")).alias("resid"), (k % 50 + 1).alias("h_n"),
        F.when(k % 5 != 1, F.array(k % 7 + F.lit(1.0), F.lit(2.0))).alias("fingerprint"), (k % 9).alias("fp_n"), F.when(number.isNotNull(), F.create_map(number.cast("string"), k % 4 + F.lit(1.0))).alias("votes"), "n_frames", (k % 4 + 1).alias("n_clips"), F.lit(1).cast("long").alias("matches"), F.col("match_id").alias("last_match"),
    )


def merged(spark, sf):
    """Player k takes in player k + 3 of the same team, for every sixth."""
    rows = players(spark, sf)
    pairs = rows.where("ord % 6 = 0").select("team", F.col("player_id").alias("keep"), F.concat(F.lit("p"), F.col("ord") + 3).alias("drop"))
    out = registry_store.registry_merge(rows, pairs)
    votes = F.array_join(F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("int").cast("string"))), ",")
    worn = F.array_join(F.transform(F.sort_array(F.transform("history", lambda w: w["number"])), lambda x: x.cast("string")), ",")
    return out.select("team", "player_id", "number", F.round("resid", 6).alias("resid"), "h_n", F.round(F.col("fingerprint")[0], 6).alias("look"), "fp_n", votes.alias("votes"), worn.alias("worn"), "n_frames", "n_clips", "matches")


def ruled_out(spark, sf):
    me = observations(spark, sf).groupBy("team").agg(F.min(F.col("key") % 23 + 1).cast("int").alias("number"))
    return roster.rule_out(players(spark, sf), me).select("team", "place", "player_id", "number", F.round("resid", 6).alias("resid"), F.round("evidence", 3).alias("evidence"))


def ordered(spark, sf):
    """Scores are mean confidences to two places, halves up; means are first cleared of what the order of summing leaves."""
    mean = lambda times, places: F.round(F.avg("conf") * times, places)
    scores = detections(spark, sf).groupBy(*TR).agg((mean(1, 9) > 0.6).alias("kept"), (F.floor(mean(100, 6) + 0.5) / 100).alias("score"), F.count("*").alias("n"))
    return a.report_order(scores).select(*TR, "place")


LAYOUT = {"l_ankle": 1, "l_heel": 2, "l_meta": 3, "l_toe": 4, "l_shoulder": 5, "r_shoulder": 6, "l_hip": 1, "r_hip": 7, "thoracic": 3, "lumbar": 4}


def body(spark, sf):
    out = pose.body_segments(fixtures.pose(spark, sf), LAYOUT)
    length = F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2))
    return out.groupBy("clip_id", "part").agg(F.count("*").alias("n"), F.round(F.sum(length), 4).alias("length"), F.round(F.sum("depth"), 4).alias("depth"))


SEEN = "SELECT clip_id, frame, " + ", ".join(f"max(x) FILTER (kp = {k} AND vis >= 3e-1) AS x{k}, max(y) FILTER (kp = {k} AND vis >= 3e-1) AS y{k}, max(vis) FILTER (kp = {k} AND vis >= 3e-1) AS v{k}" for k in range(1, 8)) + " FROM pose_v GROUP BY ALL"
_seg = lambda part, p, q, when, depth=None: f"SELECT clip_id, '{part}' AS part, sqrt(({p[0]} - {q[0]}) ** 2 + ({p[1]} - {q[1]}) ** 2) AS length, {depth or f'({p[2]} + {q[2]}) / 2'} AS depth FROM seen2 WHERE {p[2]} IS NOT NULL AND {q[2]} IS NOT NULL AND {when}"
_p = lambda k: (f"x{k}", f"y{k}", f"v{k}")
_s, _h = ("sx", "sy", "sv"), ("hx", "hy", "hv")
_depth = "(coalesce(sv, 5e-1) + coalesce(hv, 5e-1)) / 2"
BODY = " UNION ALL ".join([
    _seg("l_foot", _p(1), _p(2), "v3 IS NOT NULL"), _seg("l_foot", _p(2), _p(3), "true"), _seg("l_foot", _p(3), _p(4), "true"), _seg("l_foot", _p(1), _p(4), "v3 IS NULL"), _seg("l_foot", _p(1), _p(2), "v3 IS NULL"), _seg("l_foot", _p(2), _p(4), "v3 IS NULL"),
    _seg("shoulders", _p(5), _p(6), "true"), _seg("pelvis", _p(1), _p(7), "true"),
    _seg("spine", _s, _p(3), "true", _depth), _seg("spine", _s, _p(4), "v3 IS NULL", _depth), _seg("spine", _s, _h, "v3 IS NULL AND v4 IS NULL", _depth), _seg("spine", _p(3), _p(4), "true", _depth), _seg("spine", _p(3), _h, "v4 IS NULL", _depth), _seg("spine", _p(4), _h, "true", _depth),
])
SEEN2 = "SELECT *, CASE WHEN v5 IS NOT NULL AND v6 IS NOT NULL THEN (x5 + x6) / 2 END AS sx, CASE WHEN v5 IS NOT NULL AND v6 IS NOT NULL THEN (y5 + y6) / 2 END AS sy, (v5 + v6) / 2 AS sv, CASE WHEN v1 IS NOT NULL AND v7 IS NOT NULL THEN (x1 + x7) / 2 END AS hx, CASE WHEN v1 IS NOT NULL AND v7 IS NOT NULL THEN (y1 + y7) / 2 END AS hy, (v1 + v7) / 2 AS hv FROM seen"


def remapped(spark, sf):
    mapping = spark.createDataFrame([(k, 10 * k) for k in (1, 2, 3, 5)], "kp long, slot long")
    out = pose.remap_keypoints(fixtures.pose(spark, sf), mapping, middle=(38, 4, 6))
    return out.groupBy("clip_id", "kp").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("y"), 4).alias("y"), F.round(F.sum("vis"), 4).alias("vis"))


QUERIES = {
    "c8_registry_merge": merged,
    "j5_manual_snap": lambda s, d: joins.manual_snap(rois(s, d).withColumn("rx2", F.col("rx1") + 60), objects(s, d).where("conf > 0.5")).select("match_id", "clip_id", "frame", "obj_id", F.round("d2", 4).alias("d2")),
    "j7_registry_seed": ruled_out,
    "j10_keypoint_remap": remapped,
    "j11_body_segments": body,
    "t3_list_players": lambda s, d: registry_store.list_players(players(s, d)).select("team", "place", "player_id"),
    "t4_report_order": ordered,
}

SQL = {
    "c8_registry_merge": sql("""SELECT k.team, k.player_id, coalesce(k.number, d.number) AS number, round(CASE WHEN k.resid IS NULL THEN d.resid WHEN d.resid IS NULL THEN k.resid ELSE (k.resid * k.h_n + d.resid * d.h_n) / (k.h_n + d.h_n) END, 6) AS resid,
 CASE WHEN k.resid IS NULL AND d.player_id IS NULL THEN k.h_n WHEN k.resid IS NULL THEN d.h_n WHEN d.resid IS NULL THEN k.h_n ELSE least(400, k.h_n + d.h_n) END AS h_n,
 round(CASE WHEN d.look IS NULL OR d.fp_n = 0 THEN CASE WHEN k.fp_n > 0 THEN k.look END WHEN k.look IS NULL OR k.fp_n = 0 THEN d.look ELSE k.look + (d.look - k.look) * (d.fp_n / (1e0 * (k.fp_n + d.fp_n))) END, 6) AS look,
 CASE WHEN k.look IS NOT NULL THEN k.fp_n ELSE 0 END + CASE WHEN d.look IS NOT NULL THEN d.fp_n ELSE 0 END AS fp_n,
 CASE WHEN k.number IS NULL AND d.number IS NULL THEN '' WHEN k.number IS NULL THEN d.number || ':' || CAST(d.votes AS INTEGER) WHEN d.number IS NULL THEN k.number || ':' || CAST(k.votes AS INTEGER) WHEN CAST(k.number AS VARCHAR) < CAST(d.number AS VARCHAR) THEN k.number || ':' || CAST(k.votes AS INTEGER) || ',' || d.number || ':' || CAST(d.votes AS INTEGER) ELSE d.number || ':' || CAST(d.votes AS INTEGER) || ',' || k.number || ':' || CAST(k.votes AS INTEGER) END AS votes,
 array_to_string(list_sort(list_filter([k.number, d.number], lambda x: x IS NOT NULL)), ',') AS worn, k.n_frames + coalesce(d.n_frames, 0) AS n_frames, k.n_clips + coalesce(d.n_clips, 0) AS n_clips, 1 + CASE WHEN d.player_id IS NULL THEN 0 ELSE 1 END AS matches
 FROM pl k LEFT JOIN pl d ON d.team = k.team AND k.ord % 6 = 0 AND d.ord = k.ord + 3 WHERE NOT (k.ord % 6 = 3 AND (k.team, k.ord - 3) IN (SELECT (team, ord) FROM pl))""", **_obs, pl=ROSTER),
    "j5_manual_snap": sql("SELECT match_id, clip_id, frame, arg_min(obj_id, (d2, obj_id)) AS obj_id, round(min(d2), 4) AS d2 FROM (SELECT r.match_id, r.clip_id, r.frame, c.obj_id, (c.cx - (r.rx1 + 30)) ** 2 + (c.cy - (r.ry1 + r.ry2) / 2) ** 2 AS d2 FROM roi r JOIN c USING (match_id, clip_id, frame) WHERE c.conf > 5e-1) GROUP BY match_id, clip_id, frame HAVING min(d2) <= 8100", c=CENTRE, roi=ROI),
    "j7_ruled_out_seed": f"SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY number) AS place, number, CASE WHEN number BETWEEN 1 AND 8 THEN 'forward' WHEN number BETWEEN 9 AND 15 THEN 'back' END AS role_group FROM ({MATCH_SQL['c4_build_profiles']}) WHERE number IS NOT NULL AND number <> 5",
    "j7_registry_seed": sql("""SELECT team, row_number() OVER (PARTITION BY team ORDER BY number NULLS LAST, coalesce(display_name, ''), ord) AS place, player_id, number, round(resid, 6) AS resid,
 round(45e-2 * (1 - exp(-n_frames / 120e0)) + 2e-1 * least(1, n_clips / 3e0) + 35e-2 * CASE WHEN number IS NULL THEN 0 ELSE 1 END, 3) AS evidence FROM pl LEFT JOIN (
 SELECT team, arg_min(player_id, (CASE WHEN is_me THEN 0 ELSE 1 END, -match_id, ord)) AS mine FROM pl JOIN (SELECT team, min(key % 23 + 1) AS asked FROM obs GROUP BY ALL) USING (team) WHERE number = asked GROUP BY ALL) USING (team) WHERE player_id <> coalesce(mine, '')""", **_obs, pl=ROSTER),
    "j10_keypoint_remap": sql("""SELECT clip_id, kp, count(*) AS n, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(vis), 4) AS vis FROM (SELECT clip_id, frame, kp * 10 AS kp, x, y, vis FROM pose_v WHERE kp IN (1, 2, 3, 5)
 UNION ALL SELECT a.clip_id, a.frame, 38, (a.x + b.x) / 2, (a.y + b.y) / 2, least(a.vis, b.vis) FROM pose_v a JOIN pose_v b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.kp = 4 AND b.kp = 6) GROUP BY ALL"""),
    "j11_body_segments": sql(f"SELECT clip_id, part, count(*) AS n, round(sum(length), 4) AS length, round(sum(depth), 4) AS depth FROM ({BODY}) GROUP BY ALL", seen=SEEN, seen2=SEEN2),
    "t3_list_players": sql("SELECT team, row_number() OVER (PARTITION BY team ORDER BY is_me DESC, number NULLS LAST, coalesce(display_name, ''), player_id) AS place, player_id FROM pl", **_obs, pl=ROSTER),
    "t4_report_order": sql(f"SELECT {TRS}, row_number() OVER (PARTITION BY match_id ORDER BY round(avg_conf, 9) > 6e-1 DESC, floor(round(avg_conf * 100, 6) + 5e-1) DESC, n DESC, {TRS}) AS place FROM (SELECT {TRS}, avg(conf) AS avg_conf, count(*) AS n FROM objects_v GROUP BY ALL)"),
}
