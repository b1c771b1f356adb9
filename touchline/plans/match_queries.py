"""Queries of the match-level operators, with the SQL that checks them."""

from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..operators import align, identity, joins, linking, pose, profiles
from . import fixtures
from .box_queries import DECIDED, DOMINANT, RES, TR, TRS, VOTES, detections, rois
from .fixtures import FRAME_H, FRAME_W, objects, sql
from .trajectory_queries import CENTRE, residuals

ME = "SELECT match_id, CAST(1 + match_id * 2 AS INTEGER) AS my_number, 'home' AS my_team, 'forward' AS my_group, 0e0 AS my_resid FROM (SELECT DISTINCT l_suppkey % 5 AS match_id FROM {lineitem})"


def me(spark, sf):
    return fixtures._view(spark, sf, ME)


def verdicts(spark, sf):
    return profiles.classify_tracks(residuals(spark, sf), me(spark, sf), FRAME_W, FRAME_H)


STATS = f"SELECT {TRS}, count(*) AS n_frames, avg({RES}) AS h, avg((x1 + x2) / 2 / 1920e0) AS zx, avg((y1 + y2) / 2 / 1080e0) AS zy FROM objects_v GROUP BY ALL"
VERDICTS = f"""SELECT {TRS}, CASE WHEN out THEN 'ruled-out' WHEN s >= 66e-2 THEN 'me-likely' WHEN s >= 34e-2 THEN 'possible' ELSE 'ruled-out' END AS status, CASE WHEN out THEN 0e0 ELSE round(s, 3) END AS score FROM (
 SELECT *, coalesce(dominant = 'opp', false) OR coalesce(dominant NOT IN ('unsure', '') AND lower(dominant) <> lower(my_team), false) OR coalesce(number <> my_number, false) OR (my_group = 'forward' AND (zx < 26e-2 OR zx > 74e-2) AND zy < 42e-2) AS out,
 greatest(0, least(1, 4e-1 + CASE WHEN number = my_number THEN 45e-2 ELSE 0 END + CASE WHEN dominant = my_team THEN 1e-1 ELSE 0 END + CASE WHEN my_group = 'forward' AND zx BETWEEN 3e-1 AND 7e-1 THEN 8e-2 ELSE 0 END + CASE WHEN abs(h - my_resid) <= 9 THEN 1e-1 WHEN abs(h - my_resid) > 18 THEN -2e-1 ELSE 0 END)) AS s
 FROM stats LEFT JOIN dom USING ({TRS}) LEFT JOIN (SELECT {TRS}, number FROM decided WHERE weight >= 1.5e0) USING ({TRS}) JOIN me USING (match_id) WHERE n_frames >= 8)"""
REASONS = f"""SELECT {TRS}, CASE WHEN dominant = 'opp' THEN 'opposition team' WHEN lower(dominant) <> lower(my_team) AND dominant NOT IN ('unsure', '') THEN 'opposition team (' || dominant || ')' WHEN number <> my_number THEN 'reads #' || number || ', you are #' || my_number
 WHEN my_group = 'forward' AND (zx < 26e-2 OR zx > 74e-2) AND zy < 42e-2 THEN 'plays wide & deep (back three); you''re a forward' ELSE concat_ws('; ', CASE WHEN number = my_number THEN 'reads YOUR #' || my_number END, CASE WHEN dominant = my_team THEN 'your team' WHEN coalesce(dominant, 'unsure') = 'unsure' THEN 'team unsure' END,
 CASE WHEN my_group = 'forward' AND zx BETWEEN 3e-1 AND 7e-1 THEN 'central (forward-like)' END, CASE WHEN abs(h - my_resid) <= 9 THEN 'matching height' WHEN abs(h - my_resid) > 18 THEN 'height off' END) END AS reasons
 FROM stats LEFT JOIN dom USING ({TRS}) LEFT JOIN (SELECT {TRS}, number FROM decided WHERE weight >= 1.5e0) USING ({TRS}) JOIN me USING (match_id) WHERE n_frames >= 8"""
VIEWS = {"votes": VOTES, "decided": DECIDED, "dom": DOMINANT, "stats": STATS, "me": ME, "verdicts": VERDICTS}


def tracklets(spark, sf):
    linked = linking.link_tracklets(detections(spark, sf).select("match_id", "clip_id", "frame", "ord", "x1", "y1", "x2", "y2"), FRAME_W, FRAME_H)
    return linked.groupBy("match_id", "clip_id", "stretch", "local").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.max("n").alias("n"))


def envelopes(spark, sf):
    """Order totals by customer group as two envelopes of each group, the second one 7 samples later."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").groupBy((F.col("o_custkey") % 3).alias("g"), (F.floor(F.col("o_orderkey") / 4) % 400).alias("i")).agg(F.sum("o_totalprice").alias("amp"))
    return rows.select(F.concat(F.lit("A"), "g").alias("clip"), "i", "amp").unionByName(rows.select(F.concat(F.lit("B"), "g").alias("clip"), (F.col("i") + 7).alias("i"), "amp"))


def pairs_of(spark, sf):
    clips = envelopes(spark, sf).select("clip").distinct().where("clip like 'A%'")
    return clips.select(F.col("clip").alias("clip_a"), F.replace("clip", F.lit("A"), F.lit("B")).alias("clip_b"))


ENV = """SELECT 'A' || g AS clip, i, amp FROM env0 UNION ALL SELECT 'B' || g, i + 7, amp FROM env0"""
ENV0 = "SELECT o_custkey % 3 AS g, CAST(floor(o_orderkey / 4e0) AS BIGINT) % 400 AS i, sum(o_totalprice) AS amp FROM orders GROUP BY ALL"
UNIT = "SELECT clip, i, (amp - avg(amp) OVER (PARTITION BY clip)) / sqrt(var_pop(amp) OVER (PARTITION BY clip) * count(*) OVER (PARTITION BY clip)) AS amp FROM env"


def samples(spark, sf):
    chosen = objects(spark, sf).groupBy("match_id", "clip_id").agg(F.min("obj_id").alias("player"))
    frames = objects(spark, sf).join(chosen, ["match_id", "clip_id"]).where("obj_id = player").select("match_id", "clip_id", "frame", "player")
    b = Box()
    out = identity.identity_samples(objects(spark, sf), frames)
    return out.withColumn("features", F.array(b.cx / FRAME_W, b.cy / FRAME_H, b.height / FRAME_H))


def scored(spark, sf):
    rows = samples(spark, sf)
    model = identity.identity_fit(rows, ["match_id", "clip_id", "frame", "label", "obj_id"], dims=3)
    return identity.identity_score(model, rows).groupBy("player", "label").agg(F.count("*").alias("n"), F.round(F.avg("p"), 3).alias("p"))


def paired(spark, sf):
    clips = objects(spark, sf).groupBy("clip_id").agg(F.max("frame").alias("n"))
    a, b = clips.select(F.col("clip_id").alias("clip_a"), F.col("n").alias("n_a")), clips.select(F.col("clip_id").alias("clip_b"), F.col("n").alias("n_b"))
    pairs = a.withColumn("clip_b", (F.col("clip_a") + 1) % 10).join(b, "clip_b").select(F.col("clip_a").alias("pair_id"), "clip_a", "clip_b", F.lit(30.0).alias("fps_a"), F.lit(25.0).alias("fps_b"), "n_a", "n_b", F.lit(1.5).alias("offset"))
    return joins.pair_clips(objects(spark, sf), objects(spark, sf), pairs, 10.0).groupBy("pair_id").agg(F.count("*").alias("n"), F.sum("frame_a").alias("fa"), F.sum("frame_b").alias("fb"))


BONES = [(k, k + 1) for k in range(1, 7)]

QUERIES = {
    "c2_link_tracklets": tracklets,
    "c3_classify_tracks": lambda s, d: verdicts(s, d).select(*TR, "status", "score", F.array_join("reasons", "; ").alias("reasons")),
    "g22_shortlist_summary": lambda s, d: profiles.shortlist_summary(verdicts(s, d)),
    "t1_rank_shortlist": lambda s, d: profiles.rank_shortlist(verdicts(s, d)).select(*TR, "status", "score"),
    "g15_tracklet_evidence": lambda s, d: profiles.tracklet_evidence(residuals(s, d), FRAME_W, FRAME_H).select(*TR, "n_frames", F.round("h_mean", 6).alias("h_mean"), F.round("h_m2", 3).alias("h_m2"), F.round("zx_mean", 6).alias("zx_mean"), "sp_n", F.round("sp_mean", 6).alias("sp_mean"), F.array_join(F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("int").cast("string"))), ",").alias("votes")),
    "c4_build_profiles": lambda s, d: profiles.build_profiles(residuals(s, d), FRAME_W, FRAME_H).select("match_id", "pid", "number", "n_tracks", "n_frames", "n_clips", F.round("resid", 5).alias("resid"), F.round("zx", 6).alias("zx"), F.round("speed", 5).alias("speed"), F.round("number_conf", 6).alias("number_conf"), "role", "evidence"),
    "c9_identity": scored,
    "c11_identity_samples": lambda s, d: samples(s, d).groupBy("player", "label").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("weight")),
    "c13_audio_offset": lambda s, d: align.audio_offset(envelopes(s, d), pairs_of(s, d), 20, 100.0).select("clip_a", "clip_b", "lag", F.round("peak", 6).alias("peak"), "seconds"),
    "j9_pair_clips": paired,
    "w17_smooth_pose": lambda s, d: pose.smooth_pose(fixtures.pose(s, d)).groupBy("clip_id", "kp").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("y"), 4).alias("y"), F.round(F.sum("vis"), 4).alias("vis")),
    "w18_carry_pose": lambda s, d: pose.carry_pose(fixtures.pose(s, d).groupBy("clip_id", "frame").agg((F.count_if(F.col("vis") >= 0.3) >= 2).alias("good"))).select("clip_id", "frame", "pose_frame"),
    "g23_pose_progress": lambda s, d: pose.pose_progress(fixtures.pose(s, d).groupBy("clip_id", "frame").agg((F.count_if(F.col("vis") >= 0.3) >= 2).alias("good"))).select("clip_id", F.round("progress", 6).alias("progress")),
    "j11_bone_segments": lambda s, d: pose.bone_segments(fixtures.pose(s, d), s.createDataFrame(BONES, "a int, b int")).groupBy("clip_id", "a", "b").agg(F.count("*").alias("n"), F.round(F.sum("length"), 4).alias("length"), F.round(F.avg("depth"), 6).alias("depth")),
    "j12_merge_retrack": lambda s, d: joins.merge_retrack(objects(s, d), objects(s, d).where("frame % 10 = 0").withColumn("x1", F.col("x1") - 5000), (FRAME_W, FRAME_H)).groupBy(*TR, "source").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 3).alias("x1")),
    "f12_rois": lambda s, d: rois(s, d).groupBy("match_id", "clip_id").agg(F.count("*").alias("n"), F.round(F.avg("rx1"), 4).alias("rx1")),
}

KNOWN = f"SELECT s.*, d.number AS own, sd FROM stats s LEFT JOIN (SELECT * FROM decided WHERE weight >= 1.5e0) d USING ({TRS}) JOIN (SELECT match_id, CASE WHEN count(h) >= 2 THEN coalesce(nullif(stddev_pop(h), 0), 1) ELSE 1 END AS sd FROM stats GROUP BY ALL) USING (match_id)"
SPEEDS = f"SELECT {TRS}, count(sp) AS sp_n, sum(sp) AS sp_sum FROM (SELECT {TRS}, CASE WHEN frame > lag(frame) OVER w THEN sqrt(((x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w) ** 2 + ((y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w) ** 2) / (frame - lag(frame) OVER w) END AS sp FROM objects_v WINDOW w AS (PARTITION BY {TRS} ORDER BY frame)) GROUP BY ALL"
ANCHORED = f"SELECT k.*, coalesce(own, near) AS anchor FROM known k LEFT JOIN (SELECT {TRS}, arg_min(number, (d, number)) AS near FROM (SELECT k.match_id, k.clip_id, k.obj_id, k.sd, c.number, abs(k.h - c.resid) AS d FROM known k JOIN clusters c USING (match_id) WHERE k.own IS NULL) WHERE d <= greatest(15e-1 * sd, 8e0) GROUP BY ALL) USING ({TRS})"
POOLED = f"SELECT {TRS}, sum(apart) OVER (PARTITION BY match_id ORDER BY h, obj_id) AS label FROM (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY match_id ORDER BY h, obj_id) > 15e-1 * greatest(sd, 1) THEN 1 ELSE 0 END AS apart FROM anchored WHERE anchor IS NULL)"
PLACES = "SELECT match_id, anchor, label, printf('p%02d', row_number() OVER (PARTITION BY match_id ORDER BY anchor NULLS LAST, label)) AS pid FROM (SELECT DISTINCT match_id, anchor, label FROM anchored LEFT JOIN pooled USING (match_id, clip_id, obj_id))"
PLACED = f"SELECT a.*, p.pid AS spot FROM anchored a LEFT JOIN pooled l USING ({TRS}) JOIN places p ON p.match_id = a.match_id AND p.anchor IS NOT DISTINCT FROM a.anchor AND p.label IS NOT DISTINCT FROM l.label"
TOLD = lambda keys: f"SELECT {keys}, CASE WHEN max(weight) >= 2 THEN arg_max(number, (weight, -number)) END AS number, CASE WHEN max(weight) >= 2 THEN max(weight) / sum(weight) ELSE 0 END AS number_conf FROM (SELECT {keys}, v.number, sum(weight) AS weight FROM votes v JOIN MEMBERS USING ({TRS}) GROUP BY ALL) GROUP BY ALL"
MERGED = f"SELECT d.*, min(spot) OVER (PARTITION BY d.match_id, coalesce(CAST(t.number AS VARCHAR), spot)) AS pid FROM placed d LEFT JOIN ({TOLD('match_id, spot').replace('MEMBERS', 'placed')}) t USING (match_id, spot)"
SAMPLES = """SELECT *, row_number() OVER (PARTITION BY player ORDER BY match_id, clip_id, frame, label, obj_id) AS i FROM (SELECT o.match_id, o.clip_id, o.frame, o.obj_id, p.obj_id AS player, CASE WHEN o.obj_id = p.obj_id THEN 1 ELSE 0 END AS label, CASE WHEN o.obj_id = p.obj_id THEN 1e0 ELSE 3e-1 END AS weight,
 [(o.x1 + o.x2) / 2 / 1920e0, (o.y1 + o.y2) / 2 / 1080e0, (o.y2 - o.y1) / 1080e0] AS x FROM objects_v o JOIN (SELECT match_id, clip_id, frame, obj_id FROM objects_v WHERE (match_id, clip_id, obj_id) IN (SELECT (match_id, clip_id, min(obj_id)) FROM objects_v GROUP BY match_id, clip_id)) p USING (match_id, clip_id, frame))"""
TAUGHT = """SELECT DISTINCT player, 0::BIGINT AS i, 0::BIGINT AS k, 0::BIGINT AS pos, 0::BIGINT AS neg, [0e0, 0e0, 0e0] AS mean, [0e0, 0e0, 0e0] AS m2, [0e0, 0e0, 0e0] AS w, 0e0 AS b FROM samples
 UNION ALL SELECT player, i, k, pos, neg, mean, m2, list_transform([1, 2, 3], lambda j: w[j] - 1e-1 * (slip * z[j] + 1e-4 * w[j])), b - 1e-1 * slip FROM (
  SELECT *, weight * (1 / (1 + exp(-greatest(-3e1, least(3e1, w[1] * z[1] + w[2] * z[2] + w[3] * z[3] + b)))) - label) AS slip FROM (
   SELECT *, list_transform([1, 2, 3], lambda j: (x[j] - mean[j]) / CASE WHEN k < 2 OR sqrt(m2[j] / k) < 1e-6 THEN 1e0 ELSE sqrt(m2[j] / k) END) AS z FROM (
    SELECT player, i, k, pos, neg, x, label, weight, w, b, mean, list_transform([1, 2, 3], lambda j: m2[j] + (x[j] - old[j]) * (x[j] - mean[j])) AS m2 FROM (
     SELECT t.player, s.i, t.k + 1 AS k, t.pos + s.label AS pos, t.neg + 1 - s.label AS neg, s.x, s.label, s.weight, t.w, t.b, t.m2, t.mean AS old, list_transform([1, 2, 3], lambda j: t.mean[j] + (s.x[j] - t.mean[j]) / (t.k + 1)) AS mean
     FROM taught t JOIN samples s ON s.player = t.player AND s.i = t.i + 1))))"""
POSEG = "SELECT clip_id, frame, count(*) FILTER (vis >= 3e-1) >= 2 AS good FROM pose_v GROUP BY ALL"

SQL = {
    "c3_classify_tracks": sql(f"SELECT * FROM verdicts JOIN reasons USING ({TRS})", **VIEWS, reasons=REASONS),
    "g22_shortlist_summary": sql("SELECT match_id, count(*) FILTER (status = 'me-likely') AS me_likely, count(*) FILTER (status = 'possible') AS possible, count(*) FILTER (status = 'ruled-out') AS ruled_out, count(*) AS total FROM verdicts GROUP BY ALL", **VIEWS),
    "t1_rank_shortlist": sql("SELECT * FROM verdicts ORDER BY CASE status WHEN 'me-likely' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END, score DESC", **VIEWS),
    "g15_tracklet_evidence": sql(f"SELECT {TRS}, count(*) AS n_frames, round(avg(r), 6) AS h_mean, round(var_pop(r) * count(*), 3) AS h_m2, round(avg((x1 + x2) / 2 / 1920e0), 6) AS zx_mean, any_value(sp_n) AS sp_n, round(any_value(sp_sum / nullif(sp_n, 0)), 6) AS sp_mean, any_value(coalesce(v, '')) AS votes FROM (SELECT *, {RES} AS r FROM objects_v) JOIN speeds USING ({TRS}) LEFT JOIN (SELECT {TRS}, string_agg(number || ':' || CAST(weight AS BIGINT), ',' ORDER BY number) AS v FROM votes GROUP BY ALL) USING ({TRS}) GROUP BY {TRS}", speeds=SPEEDS, votes=VOTES),
    "c4_build_profiles": sql(f"""SELECT match_id, pid, number, n_tracks, n_frames, n_clips, round(resid, 5) AS resid, round(zx, 6) AS zx, round(speed, 5) AS speed, round(coalesce(number_conf, 0), 6) AS number_conf,
 CASE number WHEN 1 THEN 'loosehead prop' WHEN 2 THEN 'hooker' WHEN 3 THEN 'tighthead prop' WHEN 4 THEN 'lock' WHEN 5 THEN 'lock' WHEN 6 THEN 'blindside flanker' WHEN 7 THEN 'openside flanker' WHEN 8 THEN 'number 8' WHEN 9 THEN 'halfback'
  WHEN 10 THEN 'first-five-eighth' WHEN 11 THEN 'left wing' WHEN 12 THEN 'inside centre' WHEN 13 THEN 'outside centre' WHEN 14 THEN 'right wing' WHEN 15 THEN 'fullback' END AS role,
 round(45e-2 * (1 - exp(-n_frames / 120e0)) + 2e-1 * least(1, n_clips / 3e0) + 35e-2 * CASE WHEN number IS NULL THEN 0 WHEN ok THEN least(1e0, 6e-1 + 5e-1 * number_conf) ELSE 5e-1 + 5e-1 * number_conf END, 3) AS evidence FROM (
 SELECT *, CASE WHEN number IN (11, 14, 15) THEN zx < 3e-1 OR zx > 7e-1 OR zy < 45e-2 WHEN number BETWEEN 1 AND 8 THEN zx BETWEEN 25e-2 AND 75e-2 END AS ok FROM (
 SELECT match_id, pid, count(*) AS n_tracks, CAST(sum(n_frames) AS BIGINT) AS n_frames, count(DISTINCT clip_id) AS n_clips, sum(h * n_frames) / sum(n_frames) AS resid, sum(zx * n_frames) / sum(n_frames) AS zx, sum(zy * n_frames) / sum(n_frames) AS zy, sum(sp_sum) / nullif(sum(sp_n), 0) AS speed FROM merged JOIN speeds USING ({TRS}) GROUP BY ALL)
 LEFT JOIN ({TOLD('match_id, pid').replace('MEMBERS', 'merged')}) USING (match_id, pid))""",
 votes=VOTES, decided=DECIDED, stats=STATS, known=KNOWN, speeds=SPEEDS, clusters="SELECT match_id, own AS number, avg(h) AS resid FROM known WHERE own IS NOT NULL GROUP BY ALL", anchored=ANCHORED, pooled=POOLED, places=PLACES, placed=PLACED, merged=MERGED),
    "c9_identity": sql("SELECT player, label, count(*) AS n, round(avg(CASE WHEN pos >= 8 AND neg >= 8 THEN 1 / (1 + exp(-(list_sum(list_transform([1, 2, 3], lambda j: w[j] * (x[j] - mean[j]) / CASE WHEN sqrt(m2[j] / k) < 1e-6 THEN 1e0 ELSE sqrt(m2[j] / k) END)) + b))) ELSE 5e-1 END), 3) AS p FROM taught JOIN (SELECT player, max(i) AS i FROM samples GROUP BY ALL) USING (player, i) JOIN (SELECT player, label, x FROM samples) USING (player) GROUP BY ALL",
     samples=SAMPLES, taught=TAUGHT).replace("WITH ", "WITH RECURSIVE ", 1),
    "c11_identity_samples": sql("SELECT player, label, count(*) AS n, round(sum(CASE WHEN label = 1 THEN 1e0 ELSE 3e-1 END), 3) AS weight FROM (SELECT p.obj_id AS player, CASE WHEN o.obj_id = p.obj_id THEN 1 ELSE 0 END AS label FROM objects_v o JOIN (SELECT match_id, clip_id, frame, obj_id FROM objects_v WHERE (match_id, clip_id, obj_id) IN (SELECT (match_id, clip_id, min(obj_id)) FROM objects_v GROUP BY match_id, clip_id)) p USING (match_id, clip_id, frame)) GROUP BY ALL"),
    "c13_audio_offset": sql("""SELECT clip_a, clip_b, CAST(arg_max(lag, (round(r, 12), -abs(lag))) AS INTEGER) AS lag, round(max(r), 6) AS peak, arg_max(lag, (round(r, 12), -abs(lag))) / 1e2 AS seconds FROM (SELECT a.clip AS clip_a, b.clip AS clip_b, b.i - a.i AS lag, sum(a.amp * b.amp) AS r FROM u a JOIN u b ON a.clip LIKE 'A%' AND b.clip = replace(a.clip, 'A', 'B') AND b.i - a.i BETWEEN -20 AND 20 GROUP BY ALL) GROUP BY ALL HAVING max(r) >= 5e-2""", env0=ENV0, env=ENV, u=UNIT),
    "j9_pair_clips": sql("""SELECT pair_id, count(*) AS n, CAST(sum(fa) AS BIGINT) AS fa, CAST(sum(fb) AS BIGINT) AS fb FROM (SELECT pair_id, clip_a, clip_b, CAST(round_even((k / 1e1) * 3e1, 0) AS BIGINT) + 1 AS fa, least(greatest(CAST(round_even((k / 1e1 + 1.5e0) * 25e0, 0) AS BIGINT) + 1, 1), n_b) AS fb FROM (
 SELECT a.clip_id AS pair_id, a.clip_id AS clip_a, b.clip_id AS clip_b, b.n AS n_b, unnest(range(0, CAST(floor(least(a.n / 3e1, b.n / 25e0 - 1.5e0) * 1e1) AS BIGINT) + 1)) AS k FROM cl a JOIN cl b ON b.clip_id = (a.clip_id + 1) % 10)) g
 WHERE EXISTS (SELECT 1 FROM fr WHERE fr.clip_id = g.clip_a AND fr.frame = g.fa) AND EXISTS (SELECT 1 FROM fr WHERE fr.clip_id = g.clip_b AND fr.frame = g.fb) GROUP BY ALL""", cl="SELECT clip_id, max(frame) AS n FROM objects_v GROUP BY ALL", fr="SELECT DISTINCT clip_id, frame FROM objects_v"),
    "w17_smooth_pose": sql("""SELECT clip_id, kp, count(*) AS n, round(sum(CASE WHEN w > 1e-6 THEN wx / w ELSE 0 END), 4) AS x, round(sum(CASE WHEN w > 1e-6 THEN wy / w ELSE 0 END), 4) AS y, round(sum(CASE WHEN w > 1e-6 THEN v ELSE 0 END), 4) AS vis FROM (
 SELECT a.clip_id, a.frame, a.kp, sum((6 - abs(a.frame - b.frame)) * b.vis) AS w, sum((6 - abs(a.frame - b.frame)) * b.vis * b.x) AS wx, sum((6 - abs(a.frame - b.frame)) * b.vis * b.y) AS wy, avg(b.vis) AS v FROM pose_v a JOIN pose_v b ON a.clip_id = b.clip_id AND a.kp = b.kp AND b.frame BETWEEN a.frame - 5 AND a.frame + 5 GROUP BY ALL) GROUP BY ALL"""),
    "w18_carry_pose": sql("SELECT clip_id, frame, CASE WHEN frame - last <= 8 THEN last END AS pose_frame FROM (SELECT *, max(CASE WHEN good THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame) AS last FROM g)", g=POSEG.replace("pose_v", f"({fixtures.POSE})")),
    "g23_pose_progress": sql("SELECT clip_id, round(avg(CASE WHEN good THEN 1e0 ELSE 0e0 END), 6) AS progress FROM g GROUP BY ALL", g=POSEG.replace("pose_v", f"({fixtures.POSE})")),
    "j11_bone_segments": sql("SELECT a.clip_id, a.kp AS a, b.kp AS b, count(*) AS n, round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 4) AS length, round(avg((a.vis + b.vis) / 2), 6) AS depth FROM pose_v a JOIN pose_v b ON a.clip_id = b.clip_id AND a.frame = b.frame AND b.kp = a.kp + 1 WHERE a.vis >= 3e-1 AND b.vis >= 3e-1 AND a.kp <= 6 GROUP BY ALL"),
    "j12_merge_retrack": sql(f"SELECT {TRS}, CASE WHEN frame % 10 = 0 THEN 'sam2' ELSE source END AS source, count(*) AS n, round(sum(CASE WHEN frame % 10 = 0 THEN 0e0 ELSE x1 END), 3) AS x1 FROM objects_v GROUP BY ALL"),
    "f12_rois": sql("SELECT match_id, clip_id, count(*) AS n, round(avg(x1 - 100), 4) AS rx1 FROM c WHERE (match_id, clip_id, obj_id) IN (SELECT (match_id, clip_id, min(obj_id)) FROM objects_v GROUP BY match_id, clip_id) GROUP BY ALL", c=CENTRE),
}
