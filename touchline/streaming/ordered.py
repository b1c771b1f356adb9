"""Keyed state over event time: rows wait in state until the watermark has passed their frame, and are then taken in order."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"

#: Buckets that a stream's keys are dealt to, however many keys and clips there are.
BUCKETS = 512
#: Waiting rows of one value of the store, about.
PACK_ROWS = 100_000
#: Time that waiting rows are kept together for, where they are kept by blocks.
BLOCK_MS = 250
KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


class InOrder(StatefulProcessor):
    """One key's rows in the order of their frames, whatever order and triggers they came in.

    ``row`` and ``out`` are schemas (out after the key's columns), ``kept`` the list states by name. ``step`` gets rows that no row still to
    come can precede. Event-time timers drive it: one at the earliest waiting row, one where ``due`` says, and one ``idle``
    milliseconds after the last row, when ``finish`` is called and the key's state goes.

    Where ``dealt`` is set, Spark's state is keyed by a bucket of keys (by hash), and holds each key's lists side by side, so that the store is called,
    and rows pass between Spark and Python, once a bucket. Waiting rows and lists are kept as Arrow batches.

    With ``once``, of a key's rows of one frame only the first that came counts. As a frame has one time, all of them wait until the
    watermark has passed it and later ones are too late, so nothing is remembered for this.
    """

    key: list[str]
    row: str
    out: str
    kept: dict[str, str]
    #: Whether keys are dealt to buckets, and the schema of what a bucket tells apart.
    dealt = True
    inner = ""
    once = False

    def __init__(self, idle: int):
        self.idle = idle

    def step(self, key: tuple, rows: list[tuple], state: dict[str, list[tuple]]) -> list[tuple]:
        raise NotImplementedError

    def closed(self, key: tuple, state: dict[str, list[tuple]], now: int) -> list[tuple]:
        """What the watermark (milliseconds) makes final beyond the rows themselves."""
        return []

    def due(self, state: dict[str, list[tuple]]) -> int | None:
        return None

    def finish(self, key: tuple, state: dict[str, list[tuple]]) -> list[tuple]:
        return []

    def init(self, handle) -> None:
        self.handle = handle
        own = f"{self.inner}, " if self.inner else ""
        self.inside = len(names(self.inner)) if self.inner else 0
        self.columns = [*(names(self.inner) if self.inner else []), "ms", *names(self.row)]
        self.waiting = handle.getListState("waiting", "first long, rows binary")
        self.lists = {name: handle.getListState(name, "rows binary") for name in [*self.kept, "last"]}
        self.kinds = {name: dict(c.split() for c in (own + schema).split(", ")) for name, schema in {**self.kept, "last": "ms long"}.items()}
        self.done: dict[tuple, int] = {}

    def handleInputRows(self, key, rows, timerValues):
        first, held, n = None, [], 0
        for pdf in rows:
            # Rows of a key stand together in their order, which packs better; those of one frame stay as they came.
            own = pdf[self.columns].sort_values(self.columns[: self.inside + 1], kind="stable", ignore_index=True)
            held.append(pa.RecordBatch.from_pandas(own, preserve_index=False))
            n += len(pdf)
            if n >= PACK_ROWS:
                first, held, n = self._wait(held, first), [], 0
        if held:
            first = self._wait(held, first)
        self.done.pop(tuple(key), None)
        self.handle.registerTimer(first)
        return iter(())

    def _wait(self, held: list[pa.RecordBatch], first: int | None) -> int:
        table = pa.concat_tables([pa.Table.from_batches([b]) for b in held], promote_options="permissive")
        least = pc.min(table.column("ms")).as_py()
        self.waiting.appendValue((least, _packed(table)))
        return least if first is None else min(first, least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, n = timerValues.getCurrentWatermarkInMs(), self.inside
        if self.done.get(tuple(key)) == now:  # another of the key's timers, and nothing has come since
            return
        self.done[tuple(key)] = now
        held = list(self.waiting.get())
        first = min((r[0] for r in held), default=None)
        ready: dict[tuple, list[tuple]] = {}
        waits, rest = set(), None
        if first is not None and first <= now:
            table = pa.concat_tables([_unpacked(r[1]) for r in held], promote_options="permissive")
            early = pc.less_equal(table.column("ms"), now)
            taken, left = table.filter(early), table.filter(pc.invert(early)).combine_chunks()
            ready = _by_key(zip(*(c.to_pylist() for c in taken.columns), strict=True), n)
            if len(left):
                rest = pc.min(left.column("ms")).as_py()
                waits = set(zip(*(left.column(k).to_pylist() for k in range(n)), strict=True)) if n else {()}
                self.waiting.put([(rest, _packed(left))])
            else:
                self.waiting.clear()
        elif first is not None:
            rest = first
            waits = {r for h in held for r in (zip(*(_unpacked(h[1]).column(k).to_pylist() for k in range(n)), strict=True) if n else [()])}
        had = {name: list(own.get()) for name, own in self.lists.items()}
        lists = {name: _by_key([r for h in rows for r in zip(*(c.to_pylist() for c in _unpacked(h[0]).columns), strict=True)], n) for name, rows in had.items()}
        last = {sub: rows[0][0] for sub, rows in lists.pop("last").items()}
        out, timers = [], set() if rest is None else {rest}
        for sub in sorted({*ready, *last, *(k for own in lists.values() for k in own)}, key=_nulls_first):
            whole, state = self.whole(key, sub), {name: own.pop(sub, []) for name, own in lists.items()}
            rows = ready.get(sub)
            if rows and self.once:
                rows = list({r[1]: r for r in reversed(rows)}.values())
            told = []
            if rows:
                told += self.step(whole, sorted(rows, key=self.place), state)
                last[sub] = max(r[0] for r in rows)
            told += self.closed(whole, state, now)
            gone = sub not in waits and sub in last and last[sub] + self.idle <= now
            if gone:
                told += self.finish(whole, state)
                del last[sub]
            else:
                for name, own in lists.items():
                    if state[name]:
                        own[sub] = state[name]
                due = self.due(state)
                timers |= {t for t in (due, last[sub] + self.idle if sub in last and sub not in waits else None) if t is not None}
            out += [(*whole, *r) for r in told]
        lists["last"] = {sub: [(ms,)] for sub, ms in last.items()}
        for name, own in self.lists.items():
            rows = [(*sub, *r) for sub, held in lists[name].items() for r in held]
            if rows:
                columns = zip(self.kinds[name].values(), zip(*rows, strict=True), strict=True)
                own.put([(_packed(pa.table([pa.array(list(values), KINDS.get(kind)) for kind, values in columns], names=list(self.kinds[name]))),)])
            elif had[name]:
                own.clear()
        later = [t for t in timers if t > now]
        if later:
            self.handle.registerTimer(min(later))
        if out:
            yield pd.DataFrame(out, columns=[*self.key, *names(self.out)])

    def whole(self, key: tuple, sub: tuple) -> tuple:
        """A key's own columns, from its bucket and what follows."""
        return sub if self.inside else tuple(key)

    @staticmethod
    def place(row: tuple):
        """Rows are sorted by what follows the time: the frame, and what tells a frame's rows apart."""
        return row[1:3]

    def close(self) -> None:
        pass


class InBlocks(InOrder):
    """As ``InOrder``, for keys with too many rows to be held at once: waiting rows are kept by blocks of time, and blocks are taken one after another.

    ``load`` makes of the kept tables (None where there is none) what ``block`` works on, which gets a block's rows that no row still to come can
    precede and gives a table; ``save`` gives the tables to keep. Memory holds one block, the kept tables and a pack of rows that come in.
    """

    dealt = False

    def load(self, tables: dict[str, pa.Table | None]):
        raise NotImplementedError

    def block(self, rows: pa.Table, held) -> pd.DataFrame:
        raise NotImplementedError

    def save(self, held) -> dict[str, pa.Table]:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.schema = pa.schema([("ms", pa.int64()), *[(name, KINDS[kind]) for name, kind in (c.split() for c in self.row.split(", "))]])
        self.waiting = handle.getMapState("waiting", "block long, pack long", "rows binary")
        self.packs, self.last = handle.getValueState("packs", "n long"), handle.getValueState("last", "ms long")
        self.tables = {name: handle.getValueState(name, "rows binary") for name in self.kept}
        self.done: dict[tuple, int] = {}

    def handleInputRows(self, key, rows, timerValues):
        pack, first, held, n = (self.packs.get() or (0,))[0], None, [], 0

        def wait():
            nonlocal pack, first, held, n
            table = pa.Table.from_batches(held)
            table = table.take(np.argsort(table.column("ms").to_numpy(), kind="stable"))
            block = table.column("ms").to_numpy() // BLOCK_MS
            for a, b in itertools.pairwise([*np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(block)]):
                self.waiting.updateValue((int(block[a]), pack), (_packed(table.slice(a, b - a).combine_chunks()),))
            least = pc.min(table.column("ms")).as_py()
            pack, first, held, n = pack + 1, least if first is None else min(first, least), [], 0

        for pdf in rows:
            held.append(pa.RecordBatch.from_pandas(pdf[self.schema.names], self.schema, preserve_index=False))
            n += len(pdf)
            if n >= PACK_ROWS:
                wait()
        if held:
            wait()
        self.packs.update((pack,))
        self.done.pop(tuple(key), None)
        self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        if self.done.get(tuple(key)) == now:  # another of the key's timers, and nothing has come since
            return
        self.done[tuple(key)] = now
        blocks, rest = _by_key(self.waiting.keys(), 1), None
        last = (self.last.get() or (None,))[0]
        had = {name: own.get() for name, own in self.tables.items()}
        held = self.load({name: _unpacked(value[0]) if value else None for name, value in had.items()})
        for (at,), packs in sorted(blocks.items()):
            if at * BLOCK_MS > now:
                rest = at * BLOCK_MS
                break
            keys = [(at, pack) for (pack,) in sorted(packs)]
            table = pa.concat_tables([_unpacked(self.waiting.getValue(k)[0]) for k in keys])
            early = pc.less_equal(table.column("ms"), now)
            taken, left = table.filter(early), table.filter(pc.invert(early)).combine_chunks()
            if len(taken):
                for k in keys:
                    self.waiting.removeKey(k)
                if len(left):
                    self.waiting.updateValue(keys[0], (_packed(left),))
                most = pc.max(taken.column("ms")).as_py()
                last = most if last is None else max(last, most)
                out = self.block(taken, held)
                if len(out):
                    for place, (name, value) in enumerate(zip(self.key, key, strict=True)):
                        out.insert(place, name, value)
                    yield out
            if len(left):
                rest = pc.min(left.column("ms")).as_py()
                break
        if rest is None:
            self.packs.clear()
        if rest is None and last is not None and last + self.idle <= now:
            for own in (self.last, *self.tables.values()):
                own.clear()
            return
        for name, table in self.save(held).items():
            if len(table):
                self.tables[name].update((_packed(table),))
            elif had[name]:
                self.tables[name].clear()
        if last is not None:
            self.last.update((last,))
        self.handle.registerTimer(rest if rest is not None else last + self.idle)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def _nulls_first(key: tuple):
    return tuple((v is not None, v) for v in key)


def _by_key(rows, n: int) -> dict[tuple, list[tuple]]:
    out: dict[tuple, list[tuple]] = {}
    for r in rows:
        out.setdefault(r[:n], []).append(r[n:])
    return out


def on_disk(spark: SparkSession) -> None:
    """Streams keep their state in RocksDB, which timers need and whose rows aren't held on the heap; this sets the session so.

    All of an executor's stores share one bound of memory, unless the session says otherwise, so it doesn't grow with the partitions.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    if spark.conf.get(BOUNDED, None) is None:
        spark.conf.set(BOUNDED, "true")


def in_order(rows: DataFrame, processor: InOrder, once: bool = False) -> DataFrame:
    """A stream of ``frame_ts`` and the processor's columns through the processor, in append mode.

    Rows that come later than the stream's watermark allows are dropped by Spark, all others are taken in the order of frames.
    A key that was silent for the processor's ``idle`` begins anew. ``once``: rows of a key's frame that come again count once.
    """
    on_disk(rows.sparkSession)
    processor.once = once
    own = rows.withColumn("ms", F.unix_millis("frame_ts")).select(*processor.key, "frame_ts", "ms", *names(processor.row))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in processor.key) + ", " + processor.out
    if not processor.dealt:
        return own.groupBy(*processor.key).transformWithStateInPandas(processor, schema, "append", "eventTime")
    processor.inner = ", ".join(f"{c} {kinds[c]}" for c in processor.key)
    dealt = own.withColumn("_bucket", F.pmod(F.xxhash64(*processor.key), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")
