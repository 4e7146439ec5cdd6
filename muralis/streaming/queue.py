"""The offline queue of a device as a stream operator: reports wait while the link is down, and are sent again.

A device's rows are handled in the order of event time, once the watermark has passed them, so batches may be cut in any
way and rows may come out of order within the watermark's delay.  A report is tried when it's put.  If the link is down
it waits; the queue is tried again when the link works, which any sent report shows, and in between by timers, after
``first_us`` and then after twice the time each, ``retries`` times.  A report that the service refuses is dropped,
since sending it again would change nothing.  A report put again under its ``client_uuid`` replaces the one that waits;
one that was sent already is sent again, and the service, which knows the id, takes it once (``durable.commit``).

The work is done in two steps.  ``Ahead`` holds the rows of an hour and a share of the devices until the watermark has
passed them.  A report whose link works leaves nothing waiting behind it, so what lies between a device's first and its
last such report of an hour is settled there, and only the rest goes on: a busy device, most of whose reports are sent at
once, is many hours, not one task.  ``Waiting`` carries outages from hour to hour, for a share of the devices at a time.
Its state is the waiting reports with their attempts, as an Arrow table; a device whose link works has none.

Defined cases: rows without a device share the queue of null; a row without time is never passed by the watermark and is
dropped; rows of one time are handled by id, those without id first; a link that isn't known to work doesn't, and a
report that isn't known to be valid is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE = 60_000_000
HOUR = 60 * MINUTE
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = "device string, client_uuid string, put_us long, attempt int, at_us long, state string"
#: Shares of the devices: of an hour's rows, and of the outages.
HOUR_SHARES, SHARES = 4, 256
_ROW = pa.schema([("device", pa.string()), ("share", pa.int32()), ("at_us", pa.int64()), ("id", pa.int64()), ("client_uuid", pa.string()), ("link", pa.bool_()), ("valid", pa.bool_())])
_OUTAGE = pa.schema([("device", pa.string()), ("since_us", pa.int64()), ("tried", pa.int32()), ("client_uuid", pa.string()), ("put_us", pa.int64()), ("id", pa.int64()), ("valid", pa.bool_()), ("attempts", pa.int32())])
#: What goes from step to step: rows, whose ``state`` is null, and entries of the log, under shares below 0.
_STEP = "share int, at timestamp, device string, client_uuid string, put_us long, id long, link boolean, valid boolean, attempt int, at_us long, state string"
_LOG = [c.split()[0] for c in LOG.split(", ")]
_STEP_COLUMNS = [c.split()[0] for c in _STEP.split(", ")]
_HANDLED = ["device", "client_uuid", "at_us", "id", "link", "valid"]


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _ms(us: int) -> int:
    return -(-us // 1000)


class Queue:
    """What waits at a device, by id: time put, number, valid, attempts; and when the outage began, and retries so far."""

    __slots__ = ("since", "tried", "waiting")

    def __init__(self, since: int | None = None, tried: int = 0):
        self.since, self.tried, self.waiting = since, tried, {}

    def put(self, device: str | None, uuid: str, at: int, number: int, link: bool, valid: bool, out: list[tuple]) -> None:
        if not link:
            self.since = at if self.since is None else self.since
            self.waiting[uuid] = (at, number, valid, 1)
            out.append((device, uuid, at, 1, at, "failed"))
            return
        if self.waiting:
            self.waiting.pop(uuid, None)
            out += [(device, u, put, n + 1, at, "sent" if good else "refused") for u, (put, _, good, n) in self.waiting.items()]
            self.waiting.clear()
            self.since, self.tried = None, 0
        out.append((device, uuid, at, 1, at, "sent" if valid else "refused"))

    def retry_until(self, device: str | None, until: int, first_us: int, retries: int, out: list[tuple]) -> None:
        while (when := self.next(first_us, retries)) is not None and when <= until:
            for u, (put, number, good, n) in self.waiting.items():
                self.waiting[u] = (put, number, good, n + 1)
                out.append((device, u, put, n + 1, when, "failed"))
            self.tried += 1

    def next(self, first_us: int, retries: int) -> int | None:
        """When the queue is tried next: 1, 3, 7, ... times ``first_us`` after the outage began."""
        return self.since + first_us * ((2 << self.tried) - 1) if self.since is not None and self.tried < retries else None


def _replay(rows: Iterable[tuple], queues: dict[str | None, Queue], first_us: int, retries: int, out: list[tuple]) -> None:
    """Handle ``rows`` in their order, ``(device, client_uuid, at_us, id, link, valid)`` each; queues that are empty after
    it aren't kept."""
    for device, uuid, at, number, link, valid in rows:
        queue = queues.get(device)
        if queue is None:
            queue = Queue()
            if not link:
                queues[device] = queue
        else:
            queue.retry_until(device, at, first_us, retries, out)
        queue.put(device, uuid, at, number, link, valid, out)
        if link:
            queues.pop(device, None)


def _goes_on(device: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Which rows, in the order of ``device`` and time, don't lie between their device's first ``link`` and its last."""
    first = np.flatnonzero(np.r_[True, device[1:] != device[:-1]])
    size, works = np.diff(np.r_[first, len(device)]), link.astype("int64")
    total = np.cumsum(works)
    so_far = total - np.repeat(total[first] - works[first], size)
    return (so_far == works) | ((so_far == np.repeat(np.add.reduceat(works, first), size)) & ~link)


class Ahead(StatefulProcessor):
    def __init__(self, first_us: int, retries: int):
        self.first_us, self.retries = first_us, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tables = [pa.Table.from_pandas(r, schema=_ROW, preserve_index=False) for r in rows if len(r)]
        self.ahead.appendList([(_packed(t),) for t in tables])
        self.handle.registerTimer(_ms(min(pa.compute.min(t["at_us"]).as_py() for t in tables)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ahead.exists():
            return
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pa.concat_tables([_unpacked(r[0]) for r in self.ahead.get()])
        passed = pa.compute.less_equal(rows["at_us"], limit)
        due, later = rows.filter(passed), rows.filter(pa.compute.invert(passed))
        if not len(due):
            return
        if len(later):
            self.ahead.put([(_packed(later),)])
            self.handle.registerTimer(_ms(pa.compute.min(later["at_us"]).as_py()))
        else:
            self.ahead.clear()
        yield self._settled(due.combine_chunks(), -1 - (key[0] * HOUR_SHARES + key[1]) % SHARES)

    def _settled(self, rows: pa.Table, share: int) -> pd.DataFrame:
        device = rows["device"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((rows["id"].to_numpy(), rows["at_us"].to_numpy(), device))
        rows = rows.take(order)
        on = _goes_on(device[order], rows["link"].to_numpy())
        out: list[tuple] = []
        _replay(zip(*(c.to_pylist() for c in rows.filter(~on).select(_HANDLED).columns), strict=True), {}, self.first_us, self.retries, out)
        log, on = pd.DataFrame(out, columns=_LOG).assign(share=share, id=0, link=False, valid=False), rows.filter(on)
        more = {"put_us": on["at_us"].to_numpy(), "attempt": np.zeros(len(on), dtype="int32"), "state": np.full(len(on), None)}

        def both(name: str) -> np.ndarray:
            new = more[name] if name in more else on[name].to_numpy()
            return np.concatenate([log[name].to_numpy().astype(new.dtype), new])

        frame = pd.DataFrame({c: both(c) for c in _STEP_COLUMNS if c != "at"})
        return frame.assign(at=pd.Series(frame.at_us.to_numpy().astype("datetime64[us]")).dt.tz_localize("UTC"))[_STEP_COLUMNS]


class Waiting(StatefulProcessor):
    def __init__(self, first_us: int, retries: int):
        self.first_us, self.retries = first_us, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.outages = handle.getValueState("outages", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # settled already
            return (r[_LOG] for r in rows)
        rows = pd.concat(list(rows)).sort_values(["at_us", "id"])
        return self._handled(zip(*(rows[c].tolist() for c in _HANDLED), strict=True), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._handled((), timerValues)

    def _handled(self, rows: Iterable[tuple], timerValues) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        queues = self._load()
        had, out = bool(queues), []
        _replay(rows, queues, self.first_us, self.retries, out)
        for device, queue in queues.items():
            queue.retry_until(device, limit, self.first_us, self.retries, out)
        if out:
            if queues:
                self._store(queues)
            elif had:
                self.outages.clear()
            ahead = [when for q in queues.values() if (when := q.next(self.first_us, self.retries)) is not None]
            if ahead:
                self.handle.registerTimer(_ms(min(ahead)))
            yield pd.DataFrame(out, columns=_LOG)

    def _load(self) -> dict[str | None, Queue]:
        queues: dict[str | None, Queue] = {}
        value = self.outages.get()
        if value is not None:
            for device, since, tried, uuid, *report in zip(*_unpacked(value[0]).to_pydict().values(), strict=True):
                queues.setdefault(device, Queue(since, tried)).waiting[uuid] = tuple(report)
        return queues

    def _store(self, queues: dict[str | None, Queue]) -> None:
        rows = ((device, q.since, q.tried, uuid, *report) for device, q in queues.items() for uuid, report in q.waiting.items())
        self.outages.update((_packed(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUTAGE, strict=True)], schema=_OUTAGE)),))


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; its files lie in the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def offline_queue(stream: DataFrame, delay: str = "0 seconds", first_us: int = 10 * MINUTE, retries: int = 12) -> DataFrame:
    """The log of all attempts ``(device, client_uuid, put_us, attempt, at_us, state)``, state being ``failed``,
    ``sent`` or ``refused``, of ``stream(device, at timestamp, id, client_uuid, link, valid)``: a report each, whether the
    link worked when it was put, and whether the service will take it."""
    at_us, known = F.unix_micros("at"), F.xxhash64("device")
    rows = stream.withWatermark("at", delay).filter("at IS NOT NULL").select(
        F.floor(at_us / F.lit(HOUR)).alias("hour"), F.pmod(known, F.lit(HOUR_SHARES)).alias("part"), "at", at_us.alias("at_us"), "device", F.pmod(known, F.lit(SHARES)).cast("int").alias("share"),
        F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "client_uuid", F.coalesce("link", F.lit(False)).alias("link"), F.coalesce("valid", F.lit(False)).alias("valid"))
    settled = rows.groupBy("hour", "part").transformWithStateInPandas(Ahead(first_us, retries), _STEP, "append", "eventTime", eventTimeColumnName="at")
    return settled.groupBy("share").transformWithStateInPandas(Waiting(first_us, retries), LOG, "append", "eventTime")
