"""Report streams: idempotent ingest and flooding per device."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

HOUR = 3_600_000_000


def ingest(stream: DataFrame, target: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append a stream of reports to the Parquet table ``target``, each ``client_uuid`` once, ever: a batch drops
    what the table holds already, so resent reports and replayed batches change nothing.  Late reports are kept;
    lateness is a rule's concern, not the stream's.  ``decide`` may add columns to each batch."""
    from muralis.operators.admin import idempotent

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        stored = spark.read.parquet(target).select("client_uuid") if there else batch.select("client_uuid").limit(0)
        fresh = idempotent(batch, stored, "received_us")
        (decide(fresh) if decide else fresh).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _flood(limit: int, ties: bool):
    def run(key, batches, state):
        """State: the arrival times of the device's last hour.  A report that comes late, in a later batch, counts those
        before it that are still known, and is counted by those that come after it."""
        rows = pd.concat(list(batches)).sort_values(["received_us", "id"])
        now = rows.received_us.to_numpy(dtype="int64")
        times = np.sort(np.concatenate([np.array(state.get[0] if state.exists else [], dtype="int64"), now]))
        prior = np.searchsorted(times, now, "right") - np.searchsorted(times, now - HOUR, "left") - 1
        if not ties:  # less those of the same moment that come after
            prior -= np.searchsorted(now, now, "right") - 1 - np.arange(len(now))
        state.update((times[np.searchsorted(times, times[-1] - HOUR, "left") :].tolist(),))
        yield pd.DataFrame({"id": rows.id, "device": key[0], "prior": prior, "flooding": prior >= limit})

    return run


def flood(stream: DataFrame, limit: int = 6, ties: bool = False) -> DataFrame:
    """``(id, device, prior, flooding)`` of each report of a stream, in arrival order of each device; with ``ties``, reports
    of the same moment that come in one batch count each other."""
    return stream.groupBy("device").applyInPandasWithState(_flood(limit, ties), "id long, device string, prior long, flooding boolean", "times array<long>", "append", "NoTimeout")
