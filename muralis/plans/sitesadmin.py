"""Sites, review, statistics, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from muralis.operators import admin, ordering, sitelog, verify
from muralis.plans.registry import query
from muralis.plans.verification import STATIC
from muralis.sources import carrier
from muralis.sources.carrier import sql

HIST = "WITH hist AS (SELECT site_id, id, captured_us, state, width, ci_low, ci_high FROM reviewed WHERE state IN ('pending','accepted','closed') AND site_id IS NOT NULL)"
SUMMARY = HIST + """, ends AS (SELECT site_id, count(*) AS report_count, count(width) AS n,
  arg_min(captured_us, (captured_us, id)) FILTER (width IS NOT NULL) AS fus, arg_min(width, (captured_us, id)) FILTER (width IS NOT NULL) AS fw, arg_min(ci_high, (captured_us, id)) FILTER (width IS NOT NULL) AS fh,
  arg_max(captured_us, (captured_us, id)) FILTER (width IS NOT NULL) AS lus, arg_max(width, (captured_us, id)) FILTER (width IS NOT NULL) AS lw, arg_max(ci_low, (captured_us, id)) FILTER (width IS NOT NULL) AS ll, arg_max(ci_high, (captured_us, id)) FILTER (width IS NOT NULL) AS lh
  FROM hist GROUP BY site_id),
summary AS (SELECT *, CASE WHEN n < 2 THEN 'unknown' WHEN ll > fh THEN 'widening' ELSE 'stable' END AS trend, CASE WHEN n >= 2 THEN greatest(1, ((lus - fus) // 86400000000)) END AS days FROM ends),
guided AS (SELECT *, CASE WHEN n = 0 THEN '판정 보류' WHEN trend = 'widening' OR lh >= 0.3e0 THEN '전문가 점검 권장' ELSE '관찰 필요' END AS guidance FROM summary)
"""  # fmt: skip


def hist(spark, d):
    return sitelog.history(carrier.reviewed(spark, d))


def summary(spark, d):
    return sitelog.summary(hist(spark, d))


@query("site_trend", sql(SUMMARY + "SELECT site_id, report_count, lw AS latest_width, trend, days, guidance FROM guided"))
def site_trend(spark, d):
    return summary(spark, d).select("site_id", "report_count", "latest_width", "trend", "days", "guidance")


@query("trend_days", sql(SUMMARY + "SELECT site_id, days FROM guided WHERE n >= 2"))
def trend_days(spark, d):
    return summary(spark, d).filter("trend <> 'unknown'").select("site_id", "days")


@query("trend_text", sql(SUMMARY + "SELECT site_id, n < 2 OR trend = 'stable' AS plain, length(days::VARCHAR || '일 사이') AS head FROM guided WHERE n >= 2"))
def trend_text(spark, d):
    t = F.col("trend_detail")
    return summary(spark, d).filter("trend <> 'unknown'").select("site_id", t.contains("변화가 없습니다").alias("plain"), F.length(F.regexp_extract(t, "^[0-9]+일 사이", 0)).cast("long").alias("head"))


@query("site_guidance", sql(SUMMARY + "SELECT guidance, count(*) AS n FROM guided GROUP BY guidance"))
def site_guidance(spark, d):
    return summary(spark, d).groupBy("guidance").agg(F.count("*").alias("n"))


@query("site_history", sql(HIST + "SELECT * FROM hist"))
def site_history(spark, d):
    return hist(spark, d)


@query("win_history", sql(HIST + "SELECT site_id, string_agg(id::VARCHAR, ',' ORDER BY captured_us, id) AS ids FROM hist GROUP BY site_id"))
def win_history(spark, d):
    rows = hist(spark, d).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("captured_us", "id"))).alias("p"))
    return rows.select("site_id", F.array_join(F.transform("p", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("win_first_last", sql(SUMMARY + "SELECT site_id, fw AS first_width, fh AS first_high, ll AS last_low FROM guided WHERE n >= 2"))
def win_first_last(spark, d):
    return summary(spark, d).filter("trend <> 'unknown'").select("site_id", "first_width", "first_high", "last_low")


@query("win_latest_nonnull", sql(SUMMARY + "SELECT site_id, lw AS latest_width FROM guided WHERE lw IS NOT NULL"))
def win_latest_nonnull(spark, d):
    return summary(spark, d).filter("latest_width is not null").select("site_id", "latest_width")


@query("site_summary_list", sql(SUMMARY + "SELECT site_id, lat, lon, report_count, trend, guidance FROM guided JOIN sites USING (site_id) WHERE lat BETWEEN 37.56e0 AND 37.57e0"))
def site_summary_list(spark, d):
    boxed = carrier.sites(spark, d).filter(F.col("lat").between(37.56, 37.57)).select("site_id", "lat", "lon")
    return boxed.join(summary(spark, d), "site_id").select("site_id", "lat", "lon", "report_count", "trend", "guidance")


@query("map_bounds", sql("SELECT min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM sites"))
def map_bounds(spark, d):
    return carrier.sites(spark, d).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@query("agg_max_by_observation", sql("SELECT id AS report_id, width, ci_low, ci_high FROM reports WHERE width IS NOT NULL"))
def agg_max_by_observation(spark, d):
    return sitelog.widest(sitelog.observations(carrier.reports(spark, d)))


@query("observations_explode", sql("SELECT id AS report_id, id*16 AS obs_id, width FROM reports WHERE width IS NOT NULL UNION ALL SELECT id, id*16+1, width/2 FROM reports WHERE width IS NOT NULL"))
def observations_explode(spark, d):
    return sitelog.observations(carrier.reports(spark, d)).select("report_id", "obs_id", "width")


@query("max_width", sql("SELECT id, width AS max_width_mm FROM reports"))
def max_width(spark, d):
    cracks = F.filter(F.array(F.col("width") / 2, F.col("width")), lambda x: x.isNotNull())
    return carrier.reports(spark, d).select("id", F.array_max(cracks).alias("max_width_mm"))


@query("site_create", sql("SELECT id AS created_by, lat, lon, row_number() OVER (ORDER BY id) AS site_id FROM reviewed WHERE state = 'pending'"))
def site_create(spark, d):
    r = carrier.reviewed(spark, d).withColumn("site_id", F.lit(None).cast("long"))
    return ordering.global_rank(admin.new_sites(r).select("created_by", "lat", "lon"), ["created_by"], "site_id")


@query("idempotent_insert", sql("SELECT 'u' || (id % 4000) AS client_uuid, min(id) AS id FROM reports WHERE id % 4000 >= 1000 GROUP BY 1"))
def idempotent_insert(spark, d):
    r = carrier.reports(spark, d).select(F.concat(F.lit("u"), (F.col("id") % 4000).cast("string")).alias("client_uuid"), "id")
    stored = spark.range(1000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("client_uuid"))
    return admin.idempotent(r, stored, "id")


LAST = "WITH l AS (SELECT report_id, arg_max(action, (at_us, action_id)) AS last FROM actions GROUP BY report_id), t AS (SELECT r.id, CASE last WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'close' THEN 'closed' WHEN 'hold' THEN 'held' WHEN 'reopen' THEN 'pending' ELSE state END AS state, last, site_id FROM reviewed r LEFT JOIN l ON l.report_id = r.id) "


@query("state_transition", sql(LAST + "SELECT id, state, last IS NOT NULL AND state IN ('accepted','pending') AND site_id IS NULL AS new_site FROM t"))
def state_transition(spark, d):
    return admin.transition(carrier.reviewed(spark, d), carrier.actions(spark, d)).select("id", "state", "new_site")


@query("site_merge", sql("SELECT CASE WHEN site_id = 2 THEN 1 ELSE site_id END AS site_id, count(*) AS n FROM reviewed WHERE site_id IS NOT NULL GROUP BY 1"))
def site_merge(spark, d):
    after, _, _ = admin.merge_sites(carrier.reviewed(spark, d), carrier.sites(spark, d), 1, 2)
    return after.filter("site_id is not null").groupBy("site_id").agg(F.count("*").alias("n"))


@query("audit_append", sql("SELECT * FROM (SELECT action_id, report_id, action, NULL AS reason, 'reviewer ' || report_id AS actor FROM actions UNION ALL SELECT (SELECT max(action_id) FROM actions) + row_number() OVER (ORDER BY id), id, 'merge_site', '지점 2 → 1', 'reviewer ' || id FROM reviewed WHERE site_id = 2)"))
def audit_append(spark, d):
    _, _, moved = admin.merge_sites(carrier.reviewed(spark, d), carrier.sites(spark, d), 1, 2)
    log = carrier.actions(spark, d).withColumns({"reason": F.lit(None).cast("string"), "actor": F.concat(F.lit("reviewer "), F.col("report_id"))})
    entries = moved.withColumns({"at_us": F.lit(0).cast("long"), "actor": F.concat(F.lit("reviewer "), F.col("report_id"))})
    return admin.audit(log, entries).select("action_id", "report_id", "action", "reason", "actor")


@query("agg_count_by_state", sql("SELECT state, count(*) AS n FROM reviewed GROUP BY state"))
def agg_count_by_state(spark, d):
    return admin.counts_map(carrier.reviewed(spark, d), "state").select(F.explode("counts").alias("state", "n"))


@query("agg_reason_counts", sql(STATIC + "SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM decided) GROUP BY code"))
def agg_reason_counts(spark, d):
    codes = verify.with_codes(carrier.reports(spark, d), ties=True)
    return codes.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("stats_full", sql("""WITH x AS (SELECT r.*, id IN (SELECT report_id FROM actions) AS seen, score < 0.5e0 AND duplicate_of IS NULL AS low, score >= 0.5e0 AND duplicate_of IS NULL AS high FROM reviewed r)
SELECT count(*) AS total, count(*) FILTER (low)/count(*)::DOUBLE AS auto_held_rate, count(duplicate_of)/count(*)::DOUBLE AS duplicate_rate, count(*) FILTER (seen) AS reviewed,
count(*) FILTER (seen AND state='rejected')/nullif(count(*) FILTER (seen),0)::DOUBLE AS false_report_rate, count(*) FILTER (seen AND low AND state='rejected')/nullif(count(*) FILTER (seen AND low),0)::DOUBLE AS held_precision,
count(*) FILTER (seen AND high AND state='rejected')/nullif(count(*) FILTER (seen AND high),0)::DOUBLE AS pending_leak FROM x"""))
def stats_full(spark, d):
    return admin.stats(carrier.reviewed(spark, d), carrier.actions(spark, d))


@query("agg_distinct_devices", sql("SELECT wall, count(DISTINCT device) AS devices FROM reports GROUP BY wall"))
def agg_distinct_devices(spark, d):
    return carrier.reports(spark, d).groupBy("wall").agg(F.count_distinct("device").alias("devices"))
