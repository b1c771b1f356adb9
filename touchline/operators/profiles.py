"""Shortlists and player profiles from track evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, is_wide_deep, role, strict_number, zone_supports
from ..functions.scoring import evidence, named_term, unit
from ..sources.scratch import stored
from .filters import decide_number, dominant_team, votes_of
from .joins import attach_nearest_height
from .trajectory import TRACK, cluster_by_value

# The highest shirt number, the statuses in order, and the wording of the reasons.
MAX_NUMBER = 23
STATUSES = ("me-likely", "possible", "ruled-out")
OPPOSITION, NAMED_OPPOSITION, OTHER_NUMBER, NOT_A_FORWARD = "opposition team", "opposition team (%s)", "reads #%s, you are #%s", "plays wide & deep (back three); you're a forward"
MY_NUMBER, MY_TEAM, UNSURE, CENTRAL, WIDE, HEIGHT_FITS, HEIGHT_OFF = "reads YOUR #%s", "your team", "team unsure", "central (forward-like)", "wide/deep (back-like)", "matching height", "height off"


MOMENTS = ("h", "zx", "zy", "sp")


def _number_sums(weight) -> Column:
    """A map from number to summed weight, as MAX_NUMBER partial sums; ``weight`` gives what a row adds to a number."""
    sums = F.array(*[F.struct(F.lit(k).alias("number"), F.coalesce(F.sum(weight(k)), F.lit(0.0)).alias("weight")) for k in range(1, MAX_NUMBER + 1)])
    return F.map_from_entries(F.filter(sums, lambda e: e["weight"] > 0))


def tracklet_evidence(rows: DataFrame, width: float, height: float, stride: int = 1, most: int | None = None, dims: int = 0) -> DataFrame:
    """Per track all that speaks of its player, in one aggregation that ``merge_evidence`` can go on with.

    n_frames; number, mean and m2 of height residual (h), zone (zx, zy) and speed in pixels a frame (sp, where the frame advances); votes
    (map of number to weight); and, with ``dims``, fp and fp_n, the mean of the rows' ``looks`` of that length. Rows carry
    residual, and may carry number and number_weight (1 without). Numbers and looks are taken from every ``stride``-th row of a
    track and ``most`` rows at most, as reading them is dear. Null, NaN and infinite values aren't counted.
    """
    box, along = Box(), Window.partitionBy(*TRACK).orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(along)
    far = F.sqrt(F.pow(box.cx - F.lag(box.cx).over(along), 2) + F.pow(box.cy - F.lag(box.cy).over(along), 2))
    out = rows.withColumn("_h", F.col("residual")).withColumn("_zx", box.cx / width).withColumn("_zy", box.cy / height).withColumn("_sp", F.when(gap > 0, far / gap))
    taken = F.lit(True)
    if stride > 1 or most is not None:
        out = out.withColumn("_at", F.row_number().over(along) - 1)
        taken = (F.col("_at") % stride == 0) & (F.lit(most is None) | (F.floor(F.col("_at") / stride) < F.lit(most or 0)))
    folds = []
    for name in MOMENTS:
        value = F.when(~F.isnan(f"_{name}") & (F.abs(f"_{name}") < float("inf")), F.col(f"_{name}"))
        n = F.count(value)
        folds += [n.alias(f"{name}_n"), F.avg(value).alias(f"{name}_mean"), (F.coalesce(F.var_pop(value), F.lit(0.0)) * n).alias(f"{name}_m2")]
    if "number" in rows.columns:
        weight = F.col("number_weight").cast("double") if "number_weight" in rows.columns else F.lit(1.0)
        good = taken & (weight > 0) & (weight < float("inf"))
        read = strict_number(F.col("number").cast("string"))
        folds.append(_number_sums(lambda k: F.when(good & (read == k), weight)).alias("votes"))
    if dims:
        good = taken & (F.size("looks") == dims) & F.forall("looks", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        n = F.count_if(good)
        folds += [F.when(n > 0, F.array(*[F.avg(F.when(good, F.col("looks")[k])) for k in range(dims)])).alias("fp"), n.alias("fp_n")]
    return out.groupBy(*TRACK).agg(F.count("*").alias("n_frames"), *folds)


def merge_evidence(parts: DataFrame, keys: list, dims: int = 0, *more: Column) -> DataFrame:
    """Evidence of tracks, or of groups of them, folded by keys: counts and votes added, moments and looks merged exactly.

    parts: n_tracks, n_frames, clips (array) and the columns of ``tracklet_evidence``. Folding in steps gives what folding at once gives. ``more`` are further aggregates.
    """
    folds = [F.sum("n_tracks").alias("n_tracks"), F.sum("n_frames").alias("n_frames"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("clips")))).alias("clips")]
    for name in MOMENTS:
        if f"{name}_n" not in parts.columns:
            continue
        n, mean, m2 = F.col(f"{name}_n"), F.coalesce(f"{name}_mean", F.lit(0.0)), F.col(f"{name}_m2")
        total, weighted = F.sum(n), F.sum(n * mean)
        centre = weighted / F.nullif(total, F.lit(0))
        folds += [total.alias(f"{name}_n"), centre.alias(f"{name}_mean"), F.greatest(F.sum(m2 + n * mean * mean) - F.coalesce(weighted * centre, F.lit(0.0)), F.lit(0.0)).alias(f"{name}_m2")]
    if "votes" in parts.columns:
        folds.append(_number_sums(lambda k: F.col("votes")[F.lit(k)]).alias("votes"))
    if dims:
        n = F.sum("fp_n")
        folds += [F.when(n > 0, F.array(*[F.sum(F.col("fp")[k] * F.col("fp_n")) / F.nullif(n, F.lit(0)) for k in range(dims)])).alias("fp"), n.alias("fp_n")]
    return parts.groupBy(*keys).agg(*folds, *more)


def finalised(players: DataFrame, least: float = 2.0) -> DataFrame:
    """Adds number (most votes, the smaller of two alike, if they reach ``least``), its share number_conf, role, role_group, zone_ok and evidence."""
    weights = F.map_values("votes")
    best, total = F.array_max(weights), F.aggregate(weights, F.lit(0.0), lambda s, v: s + v)
    number = F.when(best >= least, F.array_min(F.map_keys(F.map_filter("votes", lambda _, w: w == best))))
    out = players.withColumn("number", number).withColumn("number_conf", F.when(F.col("number").isNotNull(), best / total).otherwise(0.0))
    named, group = role(F.col("number"))
    out = out.withColumn("role", named).withColumn("role_group", group).withColumn("zone_ok", zone_supports(F.col("number"), F.col("zx_mean"), F.col("zy_mean")))
    return out.withColumn("evidence", evidence(F.col("n_frames"), F.size("clips"), named_term(F.col("number"), F.col("number_conf"), F.col("zone_ok"))))


def classify_tracks(rows: DataFrame, me: DataFrame, width: float, height: float, min_frames: int = 8) -> DataFrame:
    """track, status, score, reasons: could a track be me? me: match_id, my_number, my_team, my_group, my_resid.

    A track of the other team, of another number, or (for a forward) out wide and deep is ruled out; the rest is scored.
    """
    stats = tracklet_evidence(rows, width, height).where(F.col("n_frames") >= min_frames)
    number = decide_number(votes_of(rows), 1.5).select(*TRACK, "number")
    t = stats.join(dominant_team(rows), list(TRACK), "left").join(number, list(TRACK), "left").join(me, "match_id")
    dom, num, zx, zy = F.col("dominant"), F.col("number"), F.col("zx_mean"), F.col("zy_mean")
    deep = is_wide_deep(zx, zy)
    other_team = F.col("my_team").isNotNull() & ~F.coalesce(dom, F.lit("")).isin("unsure", "") & (F.lower(dom) != F.lower("my_team"))
    out_reason = (
        F.when(dom == "opp", F.lit(OPPOSITION))
        .when(other_team, F.format_string(NAMED_OPPOSITION, dom))
        .when(num.isNotNull() & F.col("my_number").isNotNull() & (num != F.col("my_number")), F.format_string(OTHER_NUMBER, num.cast("string"), F.col("my_number").cast("string")))
        .when((F.col("my_group") == "forward") & deep, F.lit(NOT_A_FORWARD))
    )
    dev = F.abs(F.col("h_mean") - F.col("my_resid"))
    parts = [
        (num == F.col("my_number"), 0.45, F.format_string(MY_NUMBER, F.col("my_number").cast("string"))),
        (dom == F.col("my_team"), 0.10, F.lit(MY_TEAM)),
        (((dom == "unsure") | dom.isNull()) & ~F.coalesce(dom == F.col("my_team"), F.lit(False)), 0.0, F.lit(UNSURE)),
        ((F.col("my_group") == "forward") & zx.between(0.30, 0.70), 0.08, F.lit(CENTRAL)),
        ((F.col("my_group") == "back") & deep, 0.06, F.lit(WIDE)),
        (dev <= 9.0, 0.10, F.lit(HEIGHT_FITS)),
        (dev > 18.0, -0.20, F.lit(HEIGHT_OFF)),
    ]
    score, reasons = F.lit(0.40), []
    for holds, weight, text in parts:
        yes = F.coalesce(holds, F.lit(False))
        score = score + F.when(yes, weight).otherwise(0.0)
        reasons.append(F.when(yes, text))
    t = t.withColumn("_out", out_reason).withColumn("_s", unit(score))
    status = F.when(F.col("_out").isNotNull(), "ruled-out").when(F.col("_s") >= 0.66, "me-likely").when(F.col("_s") >= 0.34, "possible").otherwise("ruled-out")
    said = F.when(F.col("_out").isNotNull(), F.array("_out")).otherwise(F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    return t.select(*TRACK, status.alias("status"), F.when(F.col("_out").isNotNull(), 0.0).otherwise(F.round("_s", 3)).alias("score"), said.alias("reasons"))


def rank_shortlist(verdicts: DataFrame) -> DataFrame:
    order = F.when(F.col("status") == STATUSES[0], 0).when(F.col("status") == STATUSES[1], 1).otherwise(2)
    return verdicts.orderBy(order, F.desc("score"), *TRACK)


def shortlist_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("match_id").agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES], F.count("*").alias("total"))


def build_profiles(rows: DataFrame, width: float, height: float, per_track: float = 1.5, least: float = 2.0, k: float = 1.5, stride: int = 1, most: int | None = None, dims: int = 0) -> DataFrame:
    """The players of each match: match_id, pid, number, n_tracks, n_frames, clips, n_clips, resid, zx, zy, speed, number_conf, role, role_group, zone_ok, evidence, votes.

    A track whose own votes reach ``per_track`` anchors the player of its number. Others join the number whose anchors' mean height is
    nearest, if within ``k`` deviations of the match's tracks (8 pixels at least). What is left is split by gaps in height, and tracks without a
    height are one group. Every track belongs to exactly one player. Groups are numbered (p01, p02, ...): those with a number first.
    A player's number is then told by all its votes, and players of one number become one, told anew.
    """
    stats = stored(tracklet_evidence(rows, width, height, stride, most, dims), "track-evidence")  # a row a track, read five times
    own = F.when(F.array_max(F.map_values("votes")) >= per_track, F.array_min(F.map_keys(F.map_filter("votes", lambda _, w: w == F.array_max(F.map_values("votes"))))))
    known = stats.withColumn("own", own).withColumn("resid", F.col("h_mean"))
    spread = known.groupBy("match_id").agg(F.when(F.count("resid") >= 2, F.coalesce(F.nullif(F.stddev_pop("resid"), F.lit(0.0)), F.lit(1.0))).otherwise(1.0).alias("resid_std"))
    known = known.join(spread, "match_id")
    anchors = known.where("own is not null and resid is not null").groupBy("match_id", F.col("own").alias("number")).agg(F.avg("resid").alias("resid"))
    attached = attach_nearest_height(known.where("own is null").select(*TRACK, "resid", "resid_std"), anchors, F.col("resid_std"), k).select(*TRACK, F.col("number").alias("near"))
    met = known.join(attached, list(TRACK), "left").withColumn("anchor", F.coalesce("own", "near"))
    pool = cluster_by_value(met.where("anchor is null"), ["match_id"], "resid", F.col("resid_std"), k)
    members = met.where("anchor is not null").withColumn("cluster", F.lit(None).cast("long")).unionByName(pool.withColumn("cluster", F.col("cluster").cast("long")))
    parts = members.withColumn("n_tracks", F.lit(1)).withColumn("clips", F.array("clip_id"))
    groups = finalised(stored(merge_evidence(parts, ["match_id", "anchor", "cluster"], dims), "player-evidence"), least)
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.asc_nulls_last("anchor"), "cluster"))
    groups = groups.withColumn("pid", F.format_string("p%02d", place))
    out = merge_same_number(groups, least, dims)
    looks = ["fp", "fp_n"] if dims else []
    return out.select("match_id", "pid", "number", "n_tracks", "n_frames", "clips", F.size("clips").cast("long").alias("n_clips"), F.col("h_mean").alias("resid"), F.col("zx_mean").alias("zx"), F.col("zy_mean").alias("zy"), F.col("sp_mean").alias("speed"), "number_conf", "role", "role_group", "zone_ok", "evidence", "votes", *looks)


def merge_same_number(players: DataFrame, least: float | None = None, dims: int = 0) -> DataFrame:
    """Profiles of a match with one number become one; those without a number stay apart.

    players: match_id, pid, number and what ``merge_evidence`` takes. Moments, votes and looks are merged exactly; the smallest pid stays.
    Where players carry votes, the number, role and evidence are told anew (votes of ``least`` at least), which ``build_profiles`` asks for.
    """
    alone = F.when(F.col("number").isNull(), F.col("pid"))
    out = merge_evidence(players.withColumn("_alone", alone), ["match_id", "number", "_alone"], dims, F.min("pid").alias("pid")).drop("_alone")
    return out if least is None else finalised(out, least)


def me_profile(numbers: DataFrame, teams: DataFrame, heights: DataFrame, ready: int = 15) -> DataFrame:
    """match_id, my_number, my_group, my_team, my_resid: what is known of me in each match, as ``classify_tracks`` takes it.

    numbers: match_id, my_number. teams: match_id, team, tracked (boolean), ord; mine is the first tracked one.
    heights: match_id, n, mean of my height residual; told only from ``ready`` samples on. What isn't known is null.
    """
    team = teams.where("tracked").groupBy("match_id").agg(F.min_by("team", "ord").alias("my_team"))
    height = heights.where(F.col("n") >= ready).select("match_id", F.col("mean").alias("my_resid"))
    return numbers.select("match_id", "my_number").join(team, "match_id", "left").join(height, "match_id", "left").select("match_id", "my_number", role(F.col("my_number"))[1].alias("my_group"), "my_team", "my_resid")


def match_report(profiles: DataFrame, me: DataFrame) -> DataFrame:
    """One row for each match of ``me`` (match_id, my_number): my own profile, and who can be ruled out.

    profiles: match_id, number, n_frames, n_clips, evidence, a number once a match. identified is false and my figures are null
    where no profile has my number. ruled_out holds number, role and evidence of every other numbered player, by number;
    numbers go up to 23, so the list is short.
    """
    met = me.select("match_id", "my_number").join(profiles.where("number is not null"), "match_id", "left")
    mine = F.coalesce(F.col("number") == F.col("my_number"), F.lit(False))
    other = F.when(F.col("number").isNotNull() & ~mine, F.struct("number", role(F.col("number"))[0].alias("role"), "evidence"))
    own = lambda c: F.max(F.when(mine, F.col(c))).alias(c)
    out = met.groupBy("match_id", "my_number").agg(F.max(mine).alias("identified"), own("n_frames"), own("n_clips"), own("evidence"), F.array_sort(F.collect_list(other)).alias("ruled_out"))
    return out.withColumn("role", role(F.col("my_number"))[0]).withColumn("n_ruled_out", F.size("ruled_out").cast("long"))
