"""Pose key points: smoothing, holding, remapping, limbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Frames of a key point that are smoothed together.
BLOCK = 4096


def smooth_pose(points: DataFrame, half: int = 5) -> DataFrame:
    """Mean of each key point over the frames around, weighted by nearness and visibility; vis is the plain mean.

    A key point's frames are cut into blocks, and points near an edge also go to the next block, so a task sorts rows and holds one block, whatever
    the table's size. A weight that falls by one a frame is a sum of windows, each a frame wider. Points without a frame are left out.
    """
    block = lambda d: F.floor((F.col("frame") + d) / F.lit(BLOCK))
    vis = F.coalesce("vis", F.lit(0.0))
    dealt = points.select("clip_id", "frame", "kp", vis.alias("vis"), (vis * F.col("x")).alias("vx"), (vis * F.col("y")).alias("vy"), F.explode(F.sequence(block(-half), block(half))).alias("_block"))
    w = Window.partitionBy("clip_id", "kp", "_block").orderBy("frame")
    first = ~F.lag("frame").over(w).eqNullSafe(F.col("frame"))

    def weighted(c):
        sums = [F.sum(c).over(w.rangeBetween(-r, r)) for r in range(half + 1)]
        total = sums[half]
        for own in sums[:half]:
            total = total + F.coalesce(own, F.lit(0.0))
        return total

    out = dealt.select("clip_id", "frame", "kp", "_block", first.alias("_first"), weighted("vis").alias("w"), weighted("vx").alias("wx"), weighted("vy").alias("wy"), F.avg("vis").over(w.rangeBetween(-half, half)).alias("v"))
    out, seen = out.where(F.col("_first") & (F.col("_block") == block(0))), F.col("w") > 1e-6
    return out.select("clip_id", "frame", "kp", F.when(seen, F.col("wx") / F.col("w")).otherwise(0.0).alias("x"), F.when(seen, F.col("wy") / F.col("w")).otherwise(0.0).alias("y"), F.when(seen, F.col("v")).otherwise(0.0).alias("vis"))


def carry_pose(frames: DataFrame, hold: int = 8) -> DataFrame:
    """Adds pose_frame: the last frame with a good pose, if it isn't older than ``hold`` frames. frames: clip_id, frame, good."""
    w = Window.partitionBy("clip_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("good"), F.col("frame")), ignorenulls=True).over(w)
    return frames.withColumn("_last", last).withColumn("pose_frame", F.when(F.col("frame") - F.col("_last") <= hold, F.col("_last"))).drop("_last")


def remap_keypoints(points: DataFrame, mapping: DataFrame, middle: tuple[int, int, int] | None = None) -> DataFrame:
    """Key points renamed by a mapping (kp, slot); ``middle`` = (slot, a, b) adds the midpoint of two, with the lower score."""
    out = points.join(mapping, "kp").select("clip_id", "frame", F.col("slot").alias("kp"), "x", "y", "vis")
    if middle:
        slot, a, b = middle
        both = points.where(F.col("kp").isin(a, b)).groupBy("clip_id", "frame").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("vis").alias("vis"))
        out = out.unionByName(both.where("n = 2").select("clip_id", "frame", F.lit(slot).alias("kp"), "x", "y", "vis"))
    return out


def bone_segments(points: DataFrame, bones: DataFrame, visible: float = 0.3) -> DataFrame:
    """Limbs of a frame with both ends visible, with the mean visibility. bones: a, b."""
    good = points.where(F.col("vis") >= visible)
    ends = lambda p: good.select("clip_id", "frame", F.col("kp").alias(p), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"), F.col("vis").alias(f"{p}_vis"))
    out = ends("a").join(bones, "a").join(ends("b"), ["clip_id", "frame", "b"])
    return out.select("clip_id", "frame", "a", "b", F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2)).alias("length"), ((F.col("a_vis") + F.col("b_vis")) / 2).alias("depth"))


def body_segments(points: DataFrame, slots: dict[str, int], visible: float = 0.3) -> DataFrame:
    """clip_id, frame, part, ord, x1, y1, x2, y2, depth: feet, shoulders, pelvis and spine, by what can be seen of them.

    slots names the key points: l_ and r_ of ankle, heel, meta, toe, shoulder, clavicle and hip, and c7, thoracic, lumbar, sacrum; absent
    ones are never seen. A foot is ankle-heel-meta-toe, or without meta ankle-toe, ankle-heel and heel-toe. Shoulders are a chain over what is
    seen of clavicles and c7; the pelvis bends at the sacrum if it is seen. The spine goes from c7 (else the shoulders' middle) by
    thoracic and lumbar to the sacrum (else the hips' middle); what isn't seen drops out, and one point is no spine. depth is the mean
    visibility of a segment's ends, the spine's that of shoulders and hips (0.5 for a pair that isn't seen). A frame's key points are a few dozen.
    """
    seen = points.where(F.col("vis") >= visible).groupBy("clip_id", "frame", "kp").agg(F.max_by(F.struct("x", "y", "vis"), "vis").alias("p"))
    frames = seen.groupBy("clip_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("kp", "p"))).alias("m"))
    kind = "struct<x:double,y:double,vis:double>"
    at = lambda name: F.col("m")[F.lit(slots[name])] if name in slots else F.lit(None).cast(kind)
    middle = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"), ((a["vis"] + b["vis"]) / 2).alias("vis")))
    segment = lambda part, a, b, depth=None: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.lit(part).alias("part"), a.alias("a"), b.alias("b"), ((a["vis"] + b["vis"]) / 2 if depth is None else depth).alias("depth")))

    def chain(part, places, depth=None):
        kept = F.filter(F.array(*places), lambda p: p.isNotNull())
        return F.transform(F.sequence(F.lit(0), F.size(kept) - 2), lambda k: segment(part, F.get(kept, k), F.get(kept, k + 1), depth)), F.size(kept)

    none = F.array().cast(f"array<struct<part:string,a:{kind},b:{kind},depth:double>>")
    parts = []
    for side in ("l", "r"):
        ankle, heel, meta, toe = (at(f"{side}_{n}") for n in ("ankle", "heel", "meta", "toe"))
        long_ = F.array(segment(f"{side}_foot", ankle, heel), segment(f"{side}_foot", heel, meta), segment(f"{side}_foot", meta, toe))
        parts.append(F.when(meta.isNotNull(), long_).otherwise(F.array(segment(f"{side}_foot", ankle, toe), segment(f"{side}_foot", ankle, heel), segment(f"{side}_foot", heel, toe))))
    shoulders, hips = middle(at("l_shoulder"), at("r_shoulder")), middle(at("l_hip"), at("r_hip"))
    line, _ = chain("shoulders", [at(n) for n in ("l_shoulder", "l_clavicle", "c7", "r_clavicle", "r_shoulder")])
    parts.append(F.when(shoulders.isNotNull(), line).otherwise(none))
    bent = F.array(segment("pelvis", at("l_hip"), at("sacrum")), segment("pelvis", at("sacrum"), at("r_hip")))
    parts.append(F.when(hips.isNull(), none).when(at("sacrum").isNotNull(), bent).otherwise(F.array(segment("pelvis", at("l_hip"), at("r_hip")))))
    depth = (F.coalesce(shoulders["vis"], F.lit(0.5)) + F.coalesce(hips["vis"], F.lit(0.5))) / 2
    spine, n = chain("spine", [F.coalesce(at("c7"), shoulders), at("thoracic"), at("lumbar"), F.coalesce(at("sacrum"), hips)], depth)
    parts.append(F.when(n >= 2, spine).otherwise(none))
    found = frames.select("clip_id", "frame", F.posexplode(F.filter(F.concat(*parts), lambda s: s.isNotNull())).alias("ord", "s"))
    return found.select("clip_id", "frame", "s.part", "ord", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"), "s.depth")


def pose_progress(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip_id").agg(F.avg(F.col("good").cast("int")).alias("progress"))
