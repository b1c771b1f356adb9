"""Windows over tracks: motion, segments, jumps, trust. A track is (match_id, clip_id, obj_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, foot, project
from .frames import codes, count_pairs, counted

TRACK = ("match_id", "clip_id", "obj_id")
FRAME = ("match_id", "clip_id", "frame")
# Metres a second that no player runs, metres of a step that counts as movement.
MAX_SPEED, MIN_STEP = 12.0, 0.05


def along(*keys: str):
    return Window.partitionBy(*(keys or TRACK)).orderBy("frame")


def foot_points(boxes: DataFrame, h) -> DataFrame:
    """Adds px, py: pitch metres of the foot point (null where the map has none)."""
    x, y = foot(Box(), h)
    return boxes.withColumn("px", x).withColumn("py", y)


def live_foot_points(boxes: DataFrame, motion: DataFrame, h) -> DataFrame:
    """Foot points by way of the anchor frame: boxes x the frame's current-to-anchor matrix (m11..m33, healthy)."""
    box = Box()
    joined = boxes.join(motion.hint("merge"), list(FRAME), "left")
    ax, ay = project([F.col(f"m{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)], box.cx, F.greatest(box.y1, box.y2), least=1e-9)
    x, y = project(h, F.col("ax"), F.col("ay"))
    out = joined.withColumn("ax", F.when(F.col("healthy"), ax)).withColumn("ay", F.when(F.col("healthy"), ay))
    return out.withColumn("px", x).withColumn("py", y).select(*boxes.columns, "px", "py")


def step_metrics(points: DataFrame, fps: float, w: Window | None = None) -> DataFrame:
    """Adds gap, step and speed to the previous row of the track; null for its first row and where no frame passed.

    The previous row counts even where its own step was too fast, so one wrong point spoils two steps.
    """
    w = along() if w is None else w
    gap = F.col("frame") - F.lag("frame").over(w)
    dx, dy = F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)
    out = points.withColumn("gap", gap).withColumn("step", F.when(F.col("gap") > 0, F.sqrt(dx * dx + dy * dy)))
    return out.withColumn("speed", F.col("step") / (F.col("gap") / F.lit(fps)))


def _distances(fps: float, max_speed: float) -> list[Column]:
    """The aggregates of a track's steps; rows without a point have none."""
    fits = F.col("speed") <= max_speed
    moves = fits & (F.col("step") > MIN_STEP)
    n = F.count_if(F.col("px").isNotNull() & F.col("py").isNotNull())
    return [
        F.round(F.coalesce(F.sum(F.when(fits, F.col("step"))), F.lit(0.0)), 1).alias("distance_m"),
        F.round(F.coalesce(F.max(F.when(moves, F.col("speed"))), F.lit(0.0)), 2).alias("top_speed_ms"),
        F.round(F.coalesce(F.avg(F.when(moves, F.col("speed"))), F.lit(0.0)), 2).alias("avg_speed_ms"),
        n.alias("n_frames"),
        F.round(n / F.lit(fps) / 60.0, 2).alias("minutes"),
    ]


def track_distances(points: DataFrame, fps: float = 30.0, max_speed: float = MAX_SPEED) -> DataFrame:
    """Distance, top and mean speed, frames and minutes of every track; one shuffle, by track."""
    known = points.where(F.col("px").isNotNull() & F.col("py").isNotNull())
    return step_metrics(known, fps or 30.0).groupBy(*TRACK).agg(*_distances(fps or 30.0, max_speed))


def last_label(boxes: DataFrame) -> DataFrame:
    """The last team label of a track that isn't blank."""
    named = boxes.where(F.coalesce("team", F.lit("")) != "")
    return named.groupBy(*TRACK).agg(F.max_by("team", "frame").alias("team"))


def player_stats(points: DataFrame, fps: float = 30.0, min_frames: int = 15, top: int | None = 12, max_speed: float = MAX_SPEED) -> DataFrame:
    """Distances with labels, short tracks left out, the farthest runners first; ``top`` is the report's length.

    One shuffle, by track, serves the steps, the sums and the last label that isn't blank, which may stand on a row without a point.
    """
    fps = fps or 30.0
    rows = points.repartition(*TRACK).withColumn("_known", F.col("px").isNotNull() & F.col("py").isNotNull())
    steps = step_metrics(rows, fps, Window.partitionBy(*TRACK, "_known").orderBy("frame"))
    named = F.coalesce("team", F.lit("")) != ""
    label = F.max_by(F.when(named, F.col("team")), F.when(named, F.col("frame"))).alias("team")
    stats = steps.groupBy(*TRACK).agg(*_distances(fps, max_speed), label).where((F.col("n_frames") >= min_frames) & (F.col("n_frames") > 0))
    ranked = stats.orderBy(F.desc("distance_m"), *TRACK)
    return ranked.limit(top) if top else ranked


def split_segments(rows: DataFrame, gap: int) -> DataFrame:
    """Adds segment: it starts anew where more than ``gap`` frames have passed."""
    starts = F.when(F.col("frame") - F.lag("frame").over(along()) > gap, 1).otherwise(0)
    return rows.withColumn("_new", starts).withColumn("segment", F.sum("_new").over(along())).drop("_new")


def segments(rows: DataFrame, gap: int) -> DataFrame:
    return split_segments(rows, gap).groupBy(*TRACK, "segment").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def pad_and_merge(found: DataFrame, seconds: float, fps: float, last_frame: Column) -> DataFrame:
    """Segments widened at both ends, clamped to the clip, and merged where they overlap or touch."""
    pad = int(seconds * fps + 0.5) if (seconds * fps) % 1 != 0.5 else 2 * round(seconds * fps / 2)
    wide = found.select(*TRACK, F.greatest(F.lit(1), F.col("first") - pad).alias("first"), F.least(last_frame, F.col("last") + pad).alias("last"))
    w = Window.partitionBy(*TRACK).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = wide.withColumn("_new", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
    return marked.withColumn("reel", F.sum("_new").over(w)).groupBy(*TRACK, "reel").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def clip_reel_stats(reels: DataFrame, fps: float) -> DataFrame:
    frames = F.sum(F.col("last") - F.col("first") + 1)
    return reels.groupBy(*TRACK).agg(F.count("*").alias("n_segments"), frames.alias("reel_frames"), F.round(frames / F.lit(fps), 2).alias("reel_s"))


def forward_segment(rows: DataFrame, start: Column | int, gap: int = 30) -> DataFrame:
    """The rows from ``start`` up to the first gap; a start inside a gap takes the next stretch."""
    return split_segments(rows.where(F.col("frame") >= start), gap).where("segment = 0").drop("segment")


def _median_around(value: str, half: int, w: Window) -> Column:
    """The median of a value over the row and up to ``half`` rows on either side, from an array that is sorted with nulls first."""
    around = [F.lag(value, k).over(w) for k in range(half, 0, -1)] + [F.col(value)] + [F.lead(value, k).over(w) for k in range(1, half + 1)]
    held, none = F.sort_array(F.array(*around)), sum((v.isNull().cast("int") for v in around[1:]), around[0].isNull().cast("int"))
    last = none + 2 * half  # the sum of the first and the last place that aren't null
    return 0.5 * F.get(held, F.floor(last / 2).cast("int")) + 0.5 * F.get(held, F.ceil(last / 2).cast("int"))


def _jumps(rows: DataFrame, keys: tuple, half: int, min_px: float, k: float) -> DataFrame:
    box, w, whole = Box(), along(*keys), Window.partitionBy(*keys)
    side = F.greatest(F.abs(box.width), F.abs(box.height))
    out = rows.withColumn("_cx", box.cx).withColumn("_cy", box.cy).withColumn("_side", side)
    out = out.withColumn("_mx", _median_around("_cx", half, w)).withColumn("_my", _median_around("_cy", half, w))
    out = out.withColumn("_limit", F.greatest(F.lit(min_px), k * F.percentile("_side", F.lit(0.5)).over(whole)))
    far = F.sqrt(F.pow(F.col("_cx") - F.col("_mx"), 2) + F.pow(F.col("_cy") - F.col("_my"), 2))
    return out.withColumn("jump", far > F.col("_limit")).drop("_cx", "_cy", "_side", "_mx", "_my", "_limit")


def find_jumps(rows: DataFrame, half: int = 7, min_px: float = 100.0, k: float = 3.0) -> DataFrame:
    """Adds jump: the centre is farther from the median centre of the rows around it than the track's boxes allow."""
    return _jumps(rows, TRACK, half, min_px, k)


def clean_jumps(rows: DataFrame, fps: float, seconds: float = 20.0, least: int = 5) -> DataFrame:
    """Drops jumps among the last ``seconds`` of each track (of the whole track where those are fewer than ``least`` rows).

    One shuffle, by track: what is in scope is told apart by a key of the windows, and every row of a frame that has a jump goes.
    """
    whole = Window.partitionBy(*TRACK)
    recent = F.col("frame") > F.max("frame").over(whole) - int(seconds * fps)
    scoped = rows.withColumn("_in", recent).withColumn("_n", F.sum(F.col("_in").cast("int")).over(whole))
    scoped = scoped.withColumn("_in", F.coalesce(F.col("_in") | (F.col("_n") < least), F.lit(False)))
    found = _jumps(scoped, (*TRACK, "_in"), 7, 100.0, 3.0)
    here = F.max("jump").over(along(*TRACK, "_in").rangeBetween(Window.currentRow, Window.currentRow))
    known = F.expr(" and ".join(f"{c} is not null" for c in (*TRACK, "frame")))
    return found.withColumn("_gone", known & F.col("_in") & F.coalesce(here, F.lit(False))).where(~F.col("_gone")).select(*rows.columns)


def jump_flag(rows: DataFrame, heights: float = 0.9, reset: int = 8) -> DataFrame:
    """Adds too_far: the box is farther from the previous row's than its height allows for the frames between."""
    box = Box()
    out = rows.withColumn("_cx", box.cx).withColumn("_cy", box.cy)
    gap = F.col("frame") - F.lag("frame").over(along())
    far = F.sqrt(F.pow(F.col("_cx") - F.lag("_cx").over(along()), 2) + F.pow(F.col("_cy") - F.lag("_cy").over(along()), 2))
    too_far = (gap > 0) & (gap <= reset) & (far > heights * F.greatest(box.height, F.lit(20.0)) * gap)
    return out.withColumn("too_far", F.coalesce(too_far, F.lit(False))).drop("_cx", "_cy")


def predict_centre(rows: DataFrame, memory: int = 8) -> DataFrame:
    """Adds pred_x, pred_y: the centre extrapolated from the oldest and newest of the last rows; null with fewer than two."""
    box, w = Box(), along().rowsBetween(-memory, -1)
    out = rows.withColumn("_cx", box.cx).withColumn("_cy", box.cy)
    frames = F.last("frame").over(w) - F.first("frame").over(w)
    ahead = F.col("frame") - F.last("frame").over(w)
    enough = F.count("*").over(w) >= 2
    for name, c in (("pred_x", "_cx"), ("pred_y", "_cy")):
        first, last = F.first(c).over(w), F.last(c).over(w)
        out = out.withColumn(name, F.when(enough, F.when(frames > 0, last + (last - first) / frames * ahead).otherwise(last)))
    return out.drop("_cx", "_cy")


def running_height_stats(rows: DataFrame, value: str = "residual") -> DataFrame:
    """Adds what was known before each row of a value: count, mean, population deviation, readiness and tolerance."""
    w = along().rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    n, spread = F.count(good).over(w), F.coalesce(F.stddev_pop(good).over(w), F.lit(0.0))
    out = rows.withColumn("h_n", n).withColumn("h_mean", F.avg(good).over(w)).withColumn("h_std", spread)
    return out.withColumn("h_ready", F.col("h_n") >= 15).withColumn("h_tol", F.greatest(F.lit(18.0), 2.5 * F.col("h_std")))


def cluster_by_value(rows: DataFrame, keys: list[str], value: str, spread: Column, k: float = 1.5) -> DataFrame:
    """Adds cluster: values in order, a new cluster where two neighbours are too far apart; -1 where there is none."""
    w = Window.partitionBy(*keys, F.col(value).isNull()).orderBy(value, "obj_id")
    new = F.when(F.col(value) - F.lag(value).over(w) > k * F.greatest(spread, F.lit(1.0)), 1).otherwise(0)
    out = rows.withColumn("_new", new)
    return out.withColumn("cluster", F.when(F.col(value).isNull(), -1).otherwise(F.sum("_new").over(w))).drop("_new")


def low_conf_runs(rows: DataFrame, below: float = 0.40, least: int = 5, value: str = "conf") -> DataFrame:
    """Runs of consecutive rows under a confidence, of at least ``least`` rows: track, first, last, n."""
    low = F.col(value) < below
    new = F.when(low & ~F.coalesce(F.lag(value).over(along()) < below, F.lit(False)), 1).otherwise(0)
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(along())).where(low)
    out = runs.groupBy(*TRACK, "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select(*TRACK, "first", "last", "n")


def chain_trust(frames: DataFrame, anchor: Column | int) -> DataFrame:
    """Adds trusted: the unbroken stretch of frames that starts at the anchor (frames: distinct by clip)."""
    w = Window.partitionBy("match_id", "clip_id").orderBy("frame")
    after = frames.where(F.col("frame") >= anchor)
    island = F.col("frame") - F.row_number().over(w) == anchor - 1
    return after.withColumn("trusted", island)


def within_radius(points: DataFrame, metres: float = 1.0) -> DataFrame:
    """Pairs of tracks of a frame whose feet are at most so far apart, each once.

    Points are keyed by a grid cell of that size; the other side looks into its own cell and half of those around it, as every pair of
    neighbouring cells is met from one side.
    """
    cell = lambda c: F.floor(F.col(c) / metres)
    a = points.where("px is not null and py is not null").select(*FRAME, "obj_id", "team", "px", "py", cell("px").alias("gx"), cell("py").alias("gy"))
    b = a.select(*FRAME, F.col("obj_id").alias("other"), F.col("team").alias("other_team"), F.col("px").alias("qx"), F.col("py").alias("qy"), "gx", "gy")
    half = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    b = b.withColumn("d", F.explode(half)).withColumn("gx", F.col("gx") + F.col("d.x")).withColumn("gy", F.col("gy") + F.col("d.y"))
    b = b.withColumn("own", (F.col("d.x") == 0) & (F.col("d.y") == 0)).drop("d")
    near = F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2) <= metres * metres + 1e-9
    once = (F.col("obj_id") < F.col("other")) | (~F.col("own") & (F.col("obj_id") != F.col("other")))
    met = a.join(b.hint("merge"), [*FRAME, "gx", "gy"]).where(once & near)
    return met.select(*FRAME, F.least("obj_id", "other").alias("obj_id"), F.greatest("obj_id", "other").alias("other"), (F.col("team") == F.col("other_team")).alias("same_team"))


def count_within_radius(points: DataFrame, metres: float = 1.0) -> DataFrame:
    """How many pairs ``within_radius`` has in each frame, and how many of one known team: match_id, clip_id, frame, pairs, same_team.

    Pairs grow with the square of a crowd. So a frame's points are sorted, and runs of them that are certainly near are counted, not met
    (``frames.count_near``); only those about ``metres`` away are measured. Frames without a pair are left out.
    """
    most = metres * metres + 1e-9

    def count(rows, ids):
        x, y = (rows.column(c).to_numpy() for c in ("px", "py"))
        near = lambda i, p: (x[i] - x[p]) ** 2 + (y[i] - y[p]) ** 2 <= most
        return count_pairs(x, y, ids, codes(rows.column("team")), metres * (1 - 1e-9), most**0.5 * (1 + 1e-9), near)

    known = points.where(" and ".join(f"{c} is not null" for c in (*FRAME, "obj_id"))).where("abs(px) < double('inf') and abs(py) < double('inf')")
    own = known.select(*FRAME, "obj_id", "team", "px", "py")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:3]) + ", pairs long, same_team long"
    return own.groupBy(*FRAME).applyInArrow(lambda rows: counted(rows, FRAME, count), schema).where("pairs > 0")


def offside(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Who is beyond the reference player's pitch x in a frame; reference: match_id, clip_id, ref_id."""
    line = points.join(reference, ["match_id", "clip_id"]).where("obj_id = ref_id").select(*FRAME, F.col("px").alias("line_x"), "ref_id")
    return points.join(line.hint("merge"), list(FRAME)).where("obj_id <> ref_id").select(*FRAME, "obj_id", "line_x", (F.col("px") > F.col("line_x")).alias("beyond"))
