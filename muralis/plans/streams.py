"""Streaming queries over the carried reports, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from muralis.plans.registry import query
from muralis.plans.verification import FLOOD
from muralis.scratch import fresh_dir
from muralis.sources import carrier
from muralis.sources.carrier import sql
from muralis.streaming import durable, queue
from muralis.streaming import reports as streaming


def arrive(rows, order, path, read, parts):
    """``rows`` come to the folder ``path`` in ``parts``, by ``order``; after each part the stream that ``read`` starts
    runs to the end of what is there, so that each part is a batch, and the stream goes on from its checkpoint."""
    cut = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *cut], [*cut, None], strict=True):
        part = rows if low is None else rows.filter(F.col(order) > low)
        (part if high is None else part.filter(F.col(order) <= high)).write.mode("append").parquet(path)
        read(rows.sparkSession.readStream.schema(rows.schema).parquet(path)).awaitTermination()


def appended(out, path):
    return out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def resent(spark, d):
    """Reports of which some are sent again under the id of one that came before."""
    return carrier.reports(spark, d).withColumn("client_uuid", F.concat(F.lit("u"), (F.col("id") % 6000).cast("string")))


RESENT = "SELECT 'u' || (id % 6000) AS client_uuid, arg_min(id, (received_us, id)) AS id FROM reports GROUP BY 1"


@query("stream_ingest", sql(RESENT))
def stream_ingest(spark, d):
    """Resent reports as a stream into a durable store, with their decisions."""
    path = fresh_dir(spark, "stream")
    rows = resent(spark, d)
    store = durable.Store(spark, f"{path}/store")
    arrive(rows, "received_us", f"{path}/in", lambda stream: durable.ingest(stream, store, f"{path}/checkpoint"), 2)
    return store.table("reports").join(store.decisions().select("id"), "id").select("client_uuid", "id")


@query("stream_dedupe", sql(RESENT))
def stream_dedupe(spark, d):
    path = fresh_dir(spark, "dedupe")
    rows = resent(spark, d).select("client_uuid", "id", "received_us")
    arrive(rows, "received_us", f"{path}/in", lambda stream: appended(durable.first_reports(stream), path), 3)
    return spark.read.parquet(f"{path}/out").select("client_uuid", "id")


@query("ingest")
def ingest(spark, d):
    """All reports in three batches, each decided on against what is stored; the second one comes twice."""
    rows = carrier.reports(spark, d)
    a, b = rows.approxQuantile("received_us", [0.4, 0.8], 0.01)
    store = durable.Store(spark, fresh_dir(spark, "store"))
    us = F.col("received_us")
    for number, part in ((0, us <= a), (1, (us > a) & (us <= b)), (1, us > a), (2, us > b)):
        store.commit(number, rows.filter(part))
    return store.decisions().withColumn("codes", F.array_join("codes", ","))


@query("stream_flood", sql(f"WITH {FLOOD} SELECT id, device, prior, prior >= 6 AS flooding FROM floods JOIN reports USING (id)"))
def stream_flood(spark, d):
    path = fresh_dir(spark, "flood")
    rows = carrier.reports(spark, d).select("id", "device", "received_us")
    arrive(rows, "received_us", f"{path}/in", lambda stream: appended(streaming.flood(stream, ties=True), path), 3)
    return spark.read.parquet(f"{path}/out")


@query("stream_late_data", carrier.sql("SELECT id, (captured_us - received_us)/60000000e0 > 10 AS future, (received_us - captured_us)/86400000000e0 > 30 AS stale FROM reports"))
def stream_late_data(spark, d):
    from muralis.config import RULES

    rules = RULES.own()
    return carrier.reports(spark, d).select("id", rules["FUTURE_TIMESTAMP"].alias("future"), rules["STALE_PHOTO"].alias("stale"))


def queued(spark, d):
    """Reports with ``link``: an error event is a report put while the service can't be reached; each report of a third
    stands under the id of the two before it; one in 29 will be refused."""
    r = carrier.reports(spark, d)
    uuid = F.concat(F.lit("u"), F.expr("id div 3").cast("string"))
    return r.select("device", F.timestamp_micros("received_us").alias("at"), "id", uuid.alias("client_uuid"), (F.col("event_type") != "error").alias("link"), (F.col("id") % 29 != 0).alias("valid"), "received_us")


#: A report waits from its first attempt until the device's link works, or until it is put again; in between the queue is
#: tried 1, 3, 7, ... times ten minutes after the outage began.  Only what the last watermark has passed is reported.
QUEUE_SQL = """WITH last AS (SELECT max(received_us) // 1000 * 1000 - 3600000000 AS w FROM reports),
puts AS (SELECT device, id, 'u' || (id // 3) AS uuid, received_us AS us, event_type <> 'error' AS link, id % 29 <> 0 AS valid FROM reports, last WHERE received_us <= w),
eras AS (SELECT *, sum(link::INT) OVER (PARTITION BY device ORDER BY us, id) - link::INT AS era,
  min(CASE WHEN link THEN us END) OVER (PARTITION BY device ORDER BY us, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sent_us,
  lead(us) OVER (PARTITION BY device, uuid ORDER BY us, id) AS again_us, lead(id) OVER (PARTITION BY device, uuid ORDER BY us, id) AS again_id FROM puts),
ends AS (SELECT e.*, min(CASE WHEN link THEN NULL ELSE us END) OVER (PARTITION BY device, era) AS since,
  (SELECT min(o.id) FROM puts o WHERE o.device = e.device AND o.us = e.sent_us AND o.link) AS sent_id FROM eras e),
waits AS (SELECT *, again_us IS NOT NULL AND (again_us, again_id) <= (coalesce(sent_us, 9223372036854775807), coalesce(sent_id, 0)) AND NOT link AS replaced FROM ends),
tries AS (SELECT device, uuid, us AS put_us, id, us AS at_us, 'failed' AS state, 0 AS k FROM waits WHERE NOT link
  UNION ALL SELECT device, uuid, us, id, since + 600000000 * ((1::BIGINT << k) - 1), 'failed', k FROM waits, last, generate_series(1, 12) AS s(k)
    WHERE NOT link AND since + 600000000 * ((1::BIGINT << k) - 1) > us AND (since + 600000000 * ((1::BIGINT << k) - 1) + 999) // 1000 * 1000 <= w AND since + 600000000 * ((1::BIGINT << k) - 1) <= CASE WHEN replaced THEN again_us ELSE coalesce(sent_us, 9223372036854775807) END
  UNION ALL SELECT device, uuid, us, id, sent_us, CASE WHEN valid THEN 'sent' ELSE 'refused' END, 99 FROM waits WHERE sent_us IS NOT NULL AND NOT replaced)
SELECT device, uuid AS client_uuid, put_us, row_number() OVER (PARTITION BY device, id ORDER BY k)::INT AS attempt, at_us, state FROM tries"""


@query("stream_offline_queue", sql(QUEUE_SQL))
def stream_offline_queue(spark, d):
    path = fresh_dir(spark, "queue")
    rows = queued(spark, d)
    queue.use_rocksdb(spark)
    arrive(rows, "received_us", f"{path}/in", lambda stream: appended(queue.offline_queue(stream, "1 hour"), path), 3)
    return spark.read.parquet(f"{path}/out")
