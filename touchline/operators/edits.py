"""Edits of target tracks, one by one or as a replayed log. A track is (match_id, clip_id, obj_id)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .filters import exclude
from .trajectory import TRACK, forward_segment

KEY = [*TRACK, "frame"]
CLIP = ["match_id", "clip_id"]
OPS = ("nuke", "bulk_delete", "remove_frame", "remove_frames", "delete_forward", "merge_forward", "upsert", "undo")


def bulk_delete(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Drops the listed tracks."""
    return exclude(rows, tracks)


def remove_frames(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Drops the listed (track, frame) rows."""
    return rows.join(gone.select(*KEY).distinct(), KEY, "left_anti")


def delete_forward(rows: DataFrame, tracks: DataFrame, gap: int = 30) -> DataFrame:
    """Drops the stretch of each listed track that begins at its ``start``."""
    own = rows.join(tracks.select(*TRACK, "start"), list(TRACK))
    return remove_frames(rows, forward_segment(own, F.col("start"), gap))


def upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    return remove_frames(rows, new).unionByName(new.select(*rows.columns))


def nuke(rows: DataFrame, match_id: int, clip_id: int, obj_id: int) -> DataFrame:
    return rows.where(~((F.col("match_id") == match_id) & (F.col("clip_id") == clip_id) & (F.col("obj_id") == obj_id)))


class _Clip:
    """The rows of a clip by track: each track's row numbers in the order of frames, and what each edit changed."""

    def __init__(self, obj: np.ndarray, frame: np.ndarray, rows: np.ndarray):
        self.obj, self.frame, self.new, self.undo = list(obj), list(frame), {}, []
        order = rows[np.lexsort((frame[rows], obj[rows]))]
        cuts = np.flatnonzero(np.diff(obj[order])) + 1
        self.tracks = {int(obj[own[0]]): own for own in np.split(order, cuts) if len(own)}

    def of(self, obj_id: int) -> np.ndarray:
        return self.tracks.get(obj_id, np.zeros(0, np.int64))

    def frames(self, rows: np.ndarray) -> np.ndarray:
        return np.array([self.frame[k] for k in rows], np.int64)

    def stretch(self, obj_id: int, start: int, gap: int) -> np.ndarray:
        """The rows of a track from ``start`` up to its first gap."""
        own = self.of(obj_id)
        own = own[int(np.searchsorted(self.frames(own), start)) :]
        gaps = np.flatnonzero(np.diff(self.frames(own)) > gap)
        return own[: int(gaps[0]) + 1] if len(gaps) else own

    def put(self, changes: dict[int, np.ndarray]) -> None:
        """Gives tracks their new rows. Only what changes something can be undone."""
        before = {k: self.of(k) for k in changes}
        if all(len(before[k]) == len(v) and (before[k] == v).all() for k, v in changes.items()):
            return
        self.undo.append(before)
        self.tracks |= changes

    def apply(self, c: dict, gap: int) -> None:
        obj_id, start = c["obj_id"], c["start"]
        if c["op"] == "undo":
            if self.undo:
                self.tracks |= self.undo.pop()
        elif c["op"] == "bulk_delete":
            self.put({k: np.zeros(0, np.int64) for k in {obj_id, *(c.get("obj_ids") or [])} - {None}})
        elif c["op"] not in OPS:
            raise ValueError(f"no edit is called {c['op']!r}")
        elif obj_id is None:
            return
        elif c["op"] == "nuke":
            self.put({obj_id: np.zeros(0, np.int64)})
        elif c["op"] in ("remove_frame", "remove_frames"):
            own = self.of(obj_id)
            self.put({obj_id: own[~np.isin(self.frames(own), [f for f in (start, *(c.get("frames") or [])) if f is not None])]})
        elif start is None:
            return
        elif c["op"] == "upsert":
            own = self.of(obj_id)
            own = own[self.frames(own) != start]
            self.new[len(self.frame)] = [c[k] for k in ("x1", "y1", "x2", "y2")]
            at = int(np.searchsorted(self.frames(own), start))
            self.frame.append(start)
            self.obj.append(obj_id)
            self.put({obj_id: np.insert(own, at, len(self.frame) - 1)})
        else:
            moved = self.stretch(obj_id, start, gap)
            rest = self.of(obj_id)[~np.isin(self.of(obj_id), moved)]
            if c["op"] == "delete_forward":
                self.put({obj_id: rest})
            elif c["target"] is not None and c["target"] != obj_id:
                own = self.of(c["target"])
                own = np.concatenate([own[~np.isin(self.frames(own), self.frames(moved))], moved])
                self.put({obj_id: rest, c["target"]: own[np.argsort(self.frames(own), kind="stable")]})


def _replayed(rows: pa.Table, log: pa.Table, gap: int) -> pa.Table:
    loose = pc.or_(pc.is_null(rows.column("obj_id")), pc.is_null(rows.column("frame"))).to_numpy()
    numbers = [pc.fill_null(rows.column(c), 0).to_numpy() for c in ("obj_id", "frame")]
    clip = _Clip(*numbers, np.flatnonzero(~loose))
    for command in log.sort_by("seq").to_pylist():
        clip.apply(command, gap)
    kept = [(k, obj_id) for obj_id, own in clip.tracks.items() for k in own.tolist()]
    old, new = [x for x in kept if x[0] < len(loose)], [x for x in kept if x[0] >= len(loose)]
    still = np.flatnonzero(loose)
    out = rows.take(pa.array(np.concatenate([still, np.array([k for k, _ in old], np.int64)]).astype(np.int64)))
    ids = pa.concat_arrays([rows.column("obj_id").take(pa.array(still)).combine_chunks().cast(rows.schema.field("obj_id").type), pa.array([o for _, o in old], rows.schema.field("obj_id").type)])
    out = out.set_column(out.schema.get_field_index("obj_id"), "obj_id", ids)
    if not new:
        return out
    box = dict(zip(("x1", "y1", "x2", "y2"), zip(*(clip.new[k] for k, _ in new), strict=True), strict=True))
    same = {c: log.column(c)[0].as_py() for c in CLIP}
    given = box | {"obj_id": [o for _, o in new], "frame": [clip.frame[k] for k, _ in new]}
    columns = [pa.array(given[f.name] if f.name in given else [same.get(f.name)] * len(new), f.type) for f in rows.schema]
    return pa.concat_tables([out, pa.table(columns, names=rows.schema.names)])


def apply_edit_log(rows: DataFrame, log: DataFrame, gap: int = 30) -> DataFrame:
    """Replays a log of edits: match_id, clip_id, seq, op, obj_id, start, target, and x1..y2 for upserts.

    op is nuke, bulk_delete (obj_id and the column obj_ids, if the log has it), remove_frame (start), remove_frames (start and the
    column frames), delete_forward, merge_forward, upsert, or undo, which takes back the last one of its clip that changed something and
    stands. An edit that lacks its track, start or target changes nothing. Rows without a track or a frame stay as they are; further
    columns of upserted rows are null, so the result's columns are nullable. All other values stay exactly as they were.

    Clips are edited apart from one another, each in one pass over arrays, however long the log; tracks that the log
    doesn't name aren't touched. A clip's named tracks have to fit in a task.
    """
    told = [F.array(F.col(c).cast("long")) for c in ("obj_id", "target") if c in log.columns]
    told += [F.coalesce(F.col("obj_ids").cast("array<long>"), F.array().cast("array<long>"))] if "obj_ids" in log.columns else []
    named = log.select(*CLIP, F.explode(F.concat(*told)).alias("obj_id")).where("obj_id is not null").distinct().hint("shuffle_hash")
    schema, columns = StructType([StructField(f.name, f.dataType, True) for f in rows.schema.fields]), rows.columns
    mine = rows.join(named, list(TRACK), "left_semi").groupBy(*CLIP).cogroup(log.groupBy(*CLIP)).applyInArrow(lambda r, e: _replayed(r, e, gap).select(columns), schema)
    return rows.join(named, list(TRACK), "left_anti").unionByName(mine)
