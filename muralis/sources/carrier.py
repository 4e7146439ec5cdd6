"""Reports carried on the ``events`` table: a deterministic stream of crack reports for tests and benches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muralis.functions import geo, hashing

#: Bits by which re-shot photos differ, 0, 3, 7, 10, 13 and 16 of 64 (fixed values).
MASKS = ("0", "421", "108421084", "1084210842108", "8421084210842108", "5555555500000000")
MINUTE, DAY = 60_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a report; times are microseconds since 1970, ``fp`` the 64-bit fingerprint."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("received_us"))
    k = F.col("event_id")
    wall = F.when(k % 3 == 0, F.expr("event_id div 8")).otherwise((k * 31) % 500)
    e = e.withColumn("wall", wall)
    w = F.col("wall")
    shift = F.when(k % 61 == 0, F.lit(120 / 111320.0)).when(k % 67 == 0, F.lit(1000 / 111320.0)).otherwise(F.lit(0.0))
    late = F.when(k % 47 == 0, F.lit(-40 * DAY)).when(k % 53 == 0, F.lit(20 * MINUTE)).otherwise(-((k * 53) % 90) * MINUTE)
    base = hashing.fingerprint(F.substring(F.md5(w.cast("string").cast("binary")), 1, 16))
    mask = F.element_at(F.array(*[hashing.fingerprint(F.lit(m)) for m in MASKS]), ((k * 11) % 6 + 1).cast("int"))
    has_crack = F.col("event_type") != "error"
    width = F.when(has_crack, F.col("value") / 50.0)
    half = 0.1 + 0.15 * width
    return e.select(
        (k + 1).alias("id"), F.format_string("uuid-%08d", k).alias("client_uuid"), "wall", "event_type",
        F.when(k % 200 < 25, F.lit("dev-flood")).otherwise(F.concat(F.lit("dev-"), F.col("user_id").cast("string"))).alias("device"),
        "received_us", (F.col("received_us") + late).alias("captured_us"),
        (F.lit(37.5665) + ((w * 7919) % 3001 - 1500) / F.lit(111320.0) + ((k * 613) % 31 - 15) / F.lit(111320.0) + shift).alias("lat"),
        (F.lit(126.978) + ((w * 104729) % 3001 - 1500) / F.lit(88250.0) + ((k * 617) % 31 - 15) / F.lit(88250.0)).alias("lon"),
        (3.0 + (k * 17) % 60).alias("accuracy_m"), (((k * 29) % 100) / F.lit(100.0)).alias("blur_score"), (k % 10 != 0).alias("patch_found"),
        F.when(k % 9 == 0, "poor").when(k % 9 < 3, "fair").otherwise("good").alias("quality"),
        has_crack.cast("int").alias("n_cracks"), width.alias("width"), F.greatest(F.lit(0.0), width - half).alias("ci_low"), (width + half).alias("ci_high"),
        base.bitwiseXOR(mask).alias("fp"))


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reports`` with a stored review outcome: state, site, duplicate parent, score - for read-side queries."""
    r = reports(spark, sf_dir)
    k = F.col("id")
    state = F.when(k % 17 == 0, "merged").when(k % 11 == 0, "rejected").when(k % 13 == 0, "closed").when(k % 5 == 0, "accepted").when(F.col("blur_score") > 0.9, "held").otherwise("pending")
    return r.withColumn("state", state).withColumns({
        "site_id": F.when(F.col("state").isin("held", "rejected"), F.lit(None)).otherwise(F.col("wall") + 1),
        "duplicate_of": F.when(F.col("state") == "merged", k - 1),
        "score": F.when(F.col("state").isin("held", "rejected"), 0.3).otherwise(0.9)})


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of ``reviewed``: at the coordinates of their first report."""
    first = F.min_by(F.struct("lat", "lon", "captured_us"), "id")
    s = reviewed(spark, sf_dir).filter("site_id is not null").groupBy("site_id").agg(first.alias("f"))
    return s.select("site_id", "f.lat", "f.lon", geo.geohash(F.col("f.lat"), F.col("f.lon")).alias("geohash"), F.col("f.captured_us").alias("first_seen_us"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review actions carried on ``orders``: ``(action_id, report_id, action, at_us)``, in ``action_id`` order; they
    spread over all reports."""
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "events").count()
    names = F.array(*map(F.lit, ("accept", "reject", "close", "hold", "reopen")))
    return o.select(
        F.col("o_orderkey").alias("action_id"), (F.col("o_orderkey") * 7 % n + 1).alias("report_id"),
        F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("action"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at_us"))


# The same tables in DuckDB's dialect.
REPORTS_SQL = """
base AS (SELECT event_id AS k, user_id, event_type, value, epoch_us(ts) AS received_us,
  CASE WHEN event_id % 3 = 0 THEN event_id // 8 ELSE (event_id*31) % 500 END AS wall FROM events),
masked AS (SELECT *, list_extract([0::UBIGINT, '0x421'::UBIGINT, '0x108421084'::UBIGINT, '0x1084210842108'::UBIGINT, '0x8421084210842108'::UBIGINT, '0x5555555500000000'::UBIGINT], ((k*11)%6+1)::INT) AS mask FROM base),
reports AS (SELECT k+1 AS id, printf('uuid-%08d', k) AS client_uuid, wall, event_type,
  CASE WHEN k % 200 < 25 THEN 'dev-flood' ELSE 'dev-' || user_id END AS device, received_us,
  received_us + CASE WHEN k % 47 = 0 THEN -40*86400000000 WHEN k % 53 = 0 THEN 20*60000000 ELSE -((k*53)%90)*60000000 END AS captured_us,
  37.5665e0 + ((wall*7919)%3001 - 1500)/111320e0 + ((k*613)%31 - 15)/111320e0 + CASE WHEN k % 61 = 0 THEN 120/111320e0 WHEN k % 67 = 0 THEN 1000/111320e0 ELSE 0e0 END AS lat,
  126.978e0 + ((wall*104729)%3001 - 1500)/88250e0 + ((k*617)%31 - 15)/88250e0 AS lon,
  3e0 + (k*17)%60 AS accuracy_m, ((k*29)%100)/100e0 AS blur_score, k % 10 <> 0 AS patch_found,
  CASE WHEN k % 9 = 0 THEN 'poor' WHEN k % 9 < 3 THEN 'fair' ELSE 'good' END AS quality,
  CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS n_cracks,
  CASE WHEN event_type <> 'error' THEN value/50e0 END AS width,
  CASE WHEN event_type <> 'error' THEN greatest(0e0, value/50e0 - (0.1e0 + 0.15e0*(value/50e0))) END AS ci_low,
  CASE WHEN event_type <> 'error' THEN value/50e0 + (0.1e0 + 0.15e0*(value/50e0)) END AS ci_high,
  xor(('0x' || substr(md5(wall::VARCHAR), 1, 16))::UBIGINT, mask) AS fp FROM masked),
states AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'merged' WHEN id % 11 = 0 THEN 'rejected' WHEN id % 13 = 0 THEN 'closed' WHEN id % 5 = 0 THEN 'accepted' WHEN blur_score > 0.9e0 THEN 'held' ELSE 'pending' END AS state FROM reports),
reviewed AS (SELECT *, CASE WHEN state IN ('held','rejected') THEN NULL ELSE wall + 1 END AS site_id, CASE WHEN state = 'merged' THEN id - 1 END AS duplicate_of,
  CASE WHEN state IN ('held','rejected') THEN 0.3e0 ELSE 0.9e0 END AS score FROM states),
sites AS (SELECT site_id, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon, arg_min(captured_us, id) AS first_seen_us FROM reviewed WHERE site_id IS NOT NULL GROUP BY site_id),
actions AS (SELECT o_orderkey AS action_id, o_orderkey * 7 % (SELECT count(*) FROM events) + 1 AS report_id, list_extract(['accept','reject','close','hold','reopen'], (o_orderkey % 5 + 1)::INT) AS action, epoch_us(o_orderdate) AS at_us FROM orders)
"""
HAVERSINE_SQL = "(2*6371000e0*asin(sqrt(pow(sin((radians({b}.lat)-radians({a}.lat))/2),2) + cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2))))"


def sql(body: str) -> str:
    """``body`` over the carried tables."""
    return f"WITH {REPORTS_SQL.strip()}\n{body}" if not body.lstrip().upper().startswith("WITH ") else f"WITH {REPORTS_SQL.strip()},\n{body.lstrip()[5:]}"
