"""Streams over several triggers and rows out of order equal their batch twins, and leave no state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import linking
from touchline.operators import trajectory as t
from touchline.streaming import live

START = datetime.datetime(2024, 1, 1)
BOX = "match_id long, clip_id long, obj_id long, frame long, ord long, x1 double, y1 double, x2 double, y2 double, source string, conf double, number string, px double, py double, frame_ts timestamp"


def boxes(seed=4, frames=240, tracks=6):
    """Players that wander, jump away for one to five frames and fall silent, in two clips."""
    rng, rows = random.Random(seed), []
    for clip in (0, 1):
        at = [[rng.uniform(100, 1800), rng.uniform(100, 900)] for _ in range(tracks)]
        away = [0] * tracks
        for frame in range(frames):
            seen = [k for k in range(tracks) if rng.random() < 0.93 and not (k == 2 and 80 < frame < 100)]
            for place, k in enumerate(seen):
                at[k] = [v + rng.uniform(-6, 6) for v in at[k]]
                away[k] = away[k] - 1 if away[k] > 0 else rng.choice([0] * 40 + [1, 2, 3, 5])
                x, y = at[k][0] + 400 * (away[k] > 0), at[k][1]
                source = "manual" if rng.random() < 0.02 else "detection"
                rows.append((0, clip, k, frame, place, x - 10, y - 25, x + 10, y + 25, source, 0.2 if frame % 23 < 7 else 0.9, rng.choice(["7", "9", "99", ""]), frame * 0.05 + k, y / 100, START + datetime.timedelta(milliseconds=frame * 1000 // 30)))
    return rows


def fed(spark, folder, rows, seed, files=5, span=60):
    """The rows as a stream of one file a trigger; a row may come some ``span`` frames late. The last file only moves the watermark."""
    rng = random.Random(seed)
    dealt = {}
    for r in rows:
        dealt.setdefault(min(files - 1, (r[3] + rng.randrange(span)) * files // 300), []).append(r)
    for k in sorted(dealt):
        rng.shuffle(dealt[k])
        spark.createDataFrame(dealt[k], BOX).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(*[None] * 14, START + datetime.timedelta(hours=3))], BOX).coalesce(1).write.mode("append").parquet(folder)
    return live.stream_detections(spark, folder, BOX, late="4 seconds", per_trigger=1).where("match_id is not null")


def run(spark, stream, folder):
    query = stream.writeStream.format("parquet").option("path", folder + "-out").option("checkpointLocation", folder + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress.batchId >= 5  # several triggers
    return spark.read.schema(stream.schema).parquet(folder + "-out")


def left(spark, folder, *names):
    """Rows that a stream's state still holds."""
    read = lambda name: spark.read.format("statestore").option("path", folder + "-state").option("operatorId", 0).option("stateVarName", name).load().count()
    return {name: read(name) for name in names}


@pytest.mark.parametrize("seed", [1, 2])
def test_linking(spark, tmp_path, seed):
    rows, folder = boxes(), str(tmp_path / "link")
    found = run(spark, live.stream_link_tracklets(fed(spark, folder, rows, seed), 1920.0, 1080.0), folder)
    batch = linking.link_tracklets(spark.createDataFrame(rows, BOX).select("match_id", "clip_id", "frame", "ord", "x1", "y1", "x2", "y2"), 1920.0, 1080.0)
    groups = lambda df, *names: sorted(sorted(map(tuple, r[0])) for r in df.groupBy("clip_id", *names).agg(F.collect_list(F.struct("frame", "ord"))).select("collect_list(struct(frame, ord))").collect())
    want = groups(batch, "stretch", "local")
    assert groups(found, "start", "start_ord") == want and len(want) > 10
    first = found.groupBy("clip_id", "start", "start_ord").agg(F.min(F.struct("frame", "ord")).alias("f")).collect()
    assert all(tuple(r.f) == (r.start, r.start_ord) for r in first)
    assert left(spark, folder, "waiting", "open", "early", "last") == {"waiting": 0, "open": 0, "early": 0, "last": 0}


def test_linking_again(spark, tmp_path):
    """Boxes that come again, in the trigger or in a later one, count once."""
    rows, folder = boxes(), str(tmp_path / "twice")
    fed(spark, folder, rows + rows[::3], 5)
    stream = live.stream_detections(spark, folder, BOX, late="4 seconds", per_trigger=1, distinct=False)
    stream = stream.where(F.when(F.col("frame_ts").isNotNull(), F.col("match_id")).isNotNull())
    found = run(spark, live.stream_link_tracklets(stream, 1920.0, 1080.0, once=True), folder)
    batch = linking.link_tracklets(spark.createDataFrame(rows, BOX), 1920.0, 1080.0)
    assert sorted(map(tuple, found.groupBy("clip_id", "start", "start_ord").count().select("clip_id", "count").collect())) == sorted(map(tuple, batch.groupBy("clip_id", "stretch", "local").count().select("clip_id", "count").collect()))
    assert left(spark, folder, "waiting", "open", "early", "last", "packs") == {"waiting": 0, "open": 0, "early": 0, "last": 0, "packs": 0}


class Kept(dict):
    """A state variable of a handle that keeps it in memory."""

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def getValue(self, key):
        return super().get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Listed(list):
    def get(self):
        return iter(self)

    def put(self, values):
        self[:] = values

    def appendValue(self, value):
        self.append(value)


class Handle:
    def __init__(self):
        self.kept = {}

    def getValueState(self, name, schema):
        return self.kept.setdefault(name, Kept())

    def getMapState(self, name, key, schema):
        return self.kept.setdefault(name, Kept())

    def getListState(self, name, schema):
        return self.kept.setdefault(name, Listed())

    def registerTimer(self, at):
        self.timer = at


def test_linking_holds_one_block():
    """A clip's waiting rows are kept and taken in blocks of a quarter of a second, however many of them wait."""
    from types import SimpleNamespace

    import pandas as pd

    taken = []

    class Link(live._Link):
        once = False

        def block(self, rows, held):
            taken.append(len(rows))
            return super().block(rows, held)

    link, handle, key = Link(linking.gate_of(1920.0, 1080.0), 8, 8, live.MINUTE), Handle(), (0, 0)
    link.init(handle)
    rows = pd.DataFrame([(r[3] * 1000 // 30, *r[3:9]) for r in boxes() if r[1] == 0], columns=["ms", "frame", "ord", "x1", "y1", "x2", "y2"]).sample(frac=1.0, random_state=1)
    list(link.handleInputRows(key, iter([rows[:500], rows[500:]]), None))
    assert max(len(v[0]) for v in handle.kept["waiting"].values()) < 6000
    told = [list(link.handleExpiredTimer(key, SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None)) for now in (4017, 9_000_000)]
    assert sum(taken) == len(rows) and max(taken) <= 8 * 6 and not any(handle.kept.values())
    assert told[0] and max(t["frame"].max() for t in told[0]) == 120
    assert len({(r.frame, r.ord) for t in sum(told, []) for r in t.itertuples()}) == sum(len(t) for t in sum(told, [])) > 1000


def test_gate_state_is_small():
    """A waiting row takes much less than its 100 bytes in state, and what comes out is the same."""
    from types import SimpleNamespace

    import pandas as pd

    gate, handle = live._Gate(live.HOUR), Handle()
    gate.inner = "match_id long, clip_id long, obj_id long"
    gate.init(handle)
    names = ["match_id", "clip_id", "obj_id", "ms", "frame", "x1", "y1", "x2", "y2", "source"]
    rows = boxes(seed=8)
    pdf = pd.DataFrame([(*r[:3], r[3] * 1000 // 30, r[3], *r[5:10]) for r in rows], columns=names).sample(frac=1.0, random_state=2)
    list(gate.handleInputRows((0,), iter([pdf]), None))
    assert sum(len(v[1]) for v in handle.kept["waiting"]) < 40 * len(rows)
    found = pd.concat(gate.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 60_000), None))
    assert {(r.clip_id, r.obj_id, r.frame): r.held for r in found.itertuples()} == replay(rows)


def test_files_hold_no_derived_columns(spark, small_tasks):
    from touchline.plans import stream_queries

    path, _ = stream_queries._files(spark, "/root/testdata/sf0.001")
    for folder in (small_tasks[0], path):
        assert not {"px", "py", "team"} & set(spark.read.parquet(folder).columns)
    kept = spark.conf.get("spark.sql.streaming.minBatchesToRetain")
    with stream_queries._dealt(spark, 1):
        assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "2"
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == kept


def replay(rows):
    """The jump gate as plainly as can be."""
    out, good = {}, {}
    for r in sorted(rows, key=lambda r: r[3]):
        key, frame, cx, cy, height = r[1:3], r[3], (r[5] + r[7]) / 2, (r[6] + r[8]) / 2, r[8] - r[6]
        state = good.setdefault(key, {"at": None, "pending": 0})
        held = False
        if r[9] == "manual":
            state["pending"] = 0
        elif state["at"] is not None:
            x, y, f = state["at"]
            if 0 < frame - f <= 8 and ((cx - x) ** 2 + (cy - y) ** 2) ** 0.5 > 0.9 * max(height, 20.0) * (frame - f):
                state["pending"] += 1
                held = state["pending"] < 3
        if not held:
            state["pending"], state["at"] = 0, (cx, cy, frame)
        out[(*key, frame)] = held
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jump_gate(spark, tmp_path, seed):
    rows, folder = boxes(seed=8), str(tmp_path / "gate")
    found = run(spark, live.stream_jump_gate(fed(spark, folder, rows, seed)), folder)
    want = replay(rows)
    assert {(r.clip_id, r.obj_id, r.frame): r.held for r in found.collect()} == want
    assert 10 < sum(want.values()) < len(want) / 2
    assert left(spark, folder, "waiting", "gate", "last") == {"waiting": 0, "gate": 0, "last": 0}


def test_gate_under_any_cut():
    rows = [(r[3], *r[5:10]) for r in boxes(seed=8) if r[1:3] == (0, 0)] + [(9999, None, 1.0, 2.0, 3.0, "x")]
    whole, _ = live.gate_steps(rows, None)
    rng = random.Random(1)
    for _ in range(20):
        cuts, gate, out = sorted(rng.sample(range(len(rows)), 4)), None, []
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            more, gate = live.gate_steps(rows[a:b], gate)
            out += more
        assert out == whole and (9999, False) not in out


def test_alerts_steps_votes_and_windows(spark, tmp_path):
    rows = boxes(seed=5)
    df = spark.createDataFrame(rows, BOX)
    track = lambda r: (r.clip_id, r.obj_id)
    folder = str(tmp_path / "alerts")
    alerts = run(spark, live.stream_low_conf_alerts(fed(spark, folder, rows, 1)), folder)
    want = t.low_conf_runs(df, 0.4, 5).collect()
    assert sorted((*track(r), r.start) for r in alerts.collect()) == sorted((*track(r), r["first"]) for r in want) and want
    assert left(spark, folder, "waiting", "run") == {"waiting": 0, "run": 0}

    folder = str(tmp_path / "steps")
    steps = run(spark, live.stream_steps(fed(spark, folder, rows, 2), fps=25.0), folder)
    batch = t.step_metrics(df, 25.0).where("step is not null")
    rounded = lambda d: sorted((*track(r), r.frame, round(r.step, 9), round(r.speed, 9)) for r in d.collect())
    assert rounded(steps) == rounded(batch)

    folder = str(tmp_path / "windows")
    windows = run(spark, live.stream_distance(fed(spark, folder, rows, 3), width=2000, slide=1000), folder)
    ms = {r[3]: int(r[14].timestamp() * 1000) for r in rows}
    sums = {}
    for r in t.step_metrics(df, 30.0).where("speed <= 12").collect():
        for start in (ms[r.frame] // 1000 * 1000, ms[r.frame] // 1000 * 1000 - 1000):
            d, n = sums.get((*track(r), start), (0.0, 0))
            sums[(*track(r), start)] = (d + r.step, n + 1)
    offset = {r.window_ms % 1000 for r in windows.collect()}
    assert offset == {0}
    assert {(*track(r), r.window_ms): (round(r.distance, 6), r.steps) for r in windows.collect()} == {k: (round(d, 6), n) for k, (d, n) in sums.items()}
    assert left(spark, folder, "waiting", "windows", "point") == {"waiting": 0, "windows": 0, "point": 0}

    folder = str(tmp_path / "votes")
    votes = run(spark, live.stream_votes(fed(spark, folder, rows, 4)), folder)
    counts = df.where("number in ('7', '9')").groupBy("clip_id", "obj_id", F.col("number").cast("long").alias("number")).count().collect()
    assert sorted((*track(r), r.number, r.weight) for r in votes.where("final").collect()) == sorted(tuple(r) for r in counts)
    assert votes.where("not final").count() > len(counts)


def test_every_trigger_has_all_its_files(spark, monkeypatch):
    """However many files a band is dealt to, each has rows, so a trigger takes one band's files and no others."""
    import pyarrow.parquet as pq
    from pathlib import Path

    from touchline.plans import stream_queries

    stream_queries._files.cache_clear()
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 300)
    path, parts = stream_queries._files(spark, "/root/testdata/sf0.001")
    stream_queries._files.cache_clear()
    found = sorted(Path(path).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert parts > 2 and len(found) % parts == 1
    read = [pq.read_table(p) for p in found[:-1]]
    assert max(t.num_rows for t in read) < 600
    bands = [read[k : k + parts] for k in range(0, len(read), parts)]
    assert len(bands) >= 4


@pytest.fixture
def small_tasks(spark, monkeypatch):
    """The stream queries with files and tasks of 100 rows, and the folders that they make, in order."""
    from touchline.plans import stream_queries

    made, folder = [], stream_queries._folder
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100)
    monkeypatch.setattr(stream_queries, "_folder", lambda s: made.append(folder(s)) or made[-1])
    stream_queries._files.cache_clear()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield made
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stream_queries._files.cache_clear()


def state_partitions(spark, made):
    return {r[0] for r in spark.read.format("state-metadata").load(made[-1]).select("numPartitions").collect()}


def by_sql(name, folder="/root/testdata/sf0.001"):
    import duckdb

    from touchline.plans import stream_queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return sorted(con.execute(stream_queries.SQL[name]).fetchall())


def test_detections_in_small_tasks(spark, small_tasks):
    """What a task reads doesn't grow with the table: neither where the files are prepared nor behind the stream's shuffle."""
    import pyarrow.parquet as pq
    from pathlib import Path

    from touchline.plans import stream_queries

    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = stream_queries.QUERIES["x1_stream_detections"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == by_sql("x1_stream_detections")
    prepared = [pq.read_metadata(p).num_rows for p in Path(small_tasks[0]).glob("*.parquet")]
    assert sum(prepared) > 5000 and max(prepared) < 200
    _, parts = stream_queries._files(spark, "/root/testdata/sf0.001")
    assert state_partitions(spark, small_tasks) == {parts} and parts > int(before)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_detections_keep_no_rows_on_the_heap(spark, small_tasks):
    """What tells boxes that come again is kept in RocksDB, in memory that all partitions share, whatever the session had."""
    from pathlib import Path

    from touchline.plans import stream_queries
    from touchline.streaming import ordered

    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset(ordered.BOUNDED)
    found = stream_queries.QUERIES["x1_stream_detections"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == by_sql("x1_stream_detections")
    state = Path(small_tasks[-1]) / "state"
    assert list(state.rglob("*.zip")) and not list(state.rglob("*.delta"))
    assert spark.conf.get(ordered.BOUNDED) == "true"
    written = spark.read.parquet(small_tasks[-2]).columns
    assert sorted(written) == ["clip_id", "frame", "frame_ts", "match_id", "obj_id"]


def test_segments_in_small_tasks(spark, small_tasks):
    from touchline.plans import stream_queries

    found = stream_queries.QUERIES["x6_stream_segments"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == by_sql("x6_stream_segments")
    assert state_partitions(spark, small_tasks) == {stream_queries._files(spark, "/root/testdata/sf0.001")[1]}


def test_votes_in_small_tasks(spark, small_tasks):
    from touchline.plans import stream_queries

    found = stream_queries.QUERIES["x4_stream_votes"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == by_sql("x4_stream_votes")
    assert state_partitions(spark, small_tasks) == {stream_queries._files(spark, "/root/testdata/sf0.001")[1]}


def test_rows_that_come_again(spark, tmp_path, monkeypatch):
    """Repeats, in the trigger or in a later one, count once without a state of their own, and many clips share few buckets of state."""
    from touchline.streaming import ordered

    monkeypatch.setattr(ordered, "BUCKETS", 4)
    rows, folder = [(r[0], r[1] + 2 * (r[2] % 3), *r[2:]) for r in boxes(seed=8)], str(tmp_path / "again")
    fed(spark, folder, rows + rows[::3] + rows[::7], 3)
    stream = live.stream_detections(spark, folder, BOX, late="4 seconds", per_trigger=1, distinct=False)
    query = live.stream_jump_gate(stream.where(F.when(F.col("frame_ts").isNotNull(), F.col("match_id")).isNotNull()), once=True).writeStream.format("parquet").option("path", folder + "-out").option("checkpointLocation", folder + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    most = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert len(most) >= 5 and len(query.recentProgress[0]["stateOperators"]) == 1
    found = [((r.clip_id, r.obj_id, r.frame), r.held) for r in spark.read.parquet(folder + "-out").collect()]
    assert len(found) == len(rows) and dict(found) == replay(rows)
    keys = spark.read.format("statestore").option("path", folder + "-state").option("operatorId", 0).option("stateVarName", "waiting").option("batchId", 0).load().count()
    assert 0 < keys <= 4
