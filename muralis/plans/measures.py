"""Width summaries and evaluation metrics on carried tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from muralis.functions import width
from muralis.operators import metrics, selection
from muralis.plans.joins import SIGNS, signs
from muralis.plans.registry import query
from muralis.sources import carrier
from muralis.sources.carrier import sql

SAMPLES = """WITH s AS (SELECT l_orderkey, list(l_quantity/5 ORDER BY l_quantity) AS xs, 4e0 + l_orderkey % 9 AS ppm, (l_orderkey % 25)/100e0 AS rel FROM lineitem GROUP BY l_orderkey),
p AS (SELECT *, quantile_cont_list(xs) AS q FROM s) """.replace(
    "quantile_cont_list(xs)", "[list_aggregate(xs, 'quantile_cont', 0.9), list_aggregate(xs, 'quantile_cont', 0.5), list_aggregate(xs, 'quantile_cont', 0.75), list_aggregate(xs, 'quantile_cont', 0.25)]"
)
SUMMARY = SAMPLES + """, d AS (SELECT *, q[1] AS rep, greatest(0.5e0, (q[3] - q[4])/2) AS delta FROM p),
w AS (SELECT *, (rep + delta)/(ppm*greatest(1e-6::DOUBLE, 1 - rel)) AS hi FROM d)
SELECT l_orderkey, round(rep/ppm, 9) AS width_mm, round(greatest(0e0, (rep - delta)/(ppm*(1 + rel))), 9) AS ci_low, round(hi, 9) AS ci_high, rep < 1.5e0 AS below_limit,
CASE WHEN rel > 0.15e0 THEN '판정 보류' WHEN hi >= 0.3e0 THEN '전문가 점검 권장' ELSE '관찰 필요' END AS guidance FROM w"""  # fmt: skip


def samples(spark, d):
    k = F.col("l_orderkey")
    g = carrier.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") / 5).alias("xs"))
    return g.withColumns({"ppm": 4.0 + k % 9, "rel": (k % 25) / F.lit(100.0)})


@query("summarize_width", SUMMARY)
def summarize_width(spark, d):
    out = samples(spark, d).select("l_orderkey", width.summarize(F.col("xs"), F.col("ppm"), F.col("rel")).alias("w"))
    return out.select("l_orderkey", *[F.round(f"w.{c}", 9).alias(c) for c in ("width_mm", "ci_low", "ci_high")], "w.below_limit", "w.guidance")


@query("percentile_arr", SAMPLES + "SELECT l_orderkey, round(list_aggregate(xs, 'quantile_cont', 0.9), 9) AS p90 FROM s")
def percentile_arr(spark, d):
    return samples(spark, d).select("l_orderkey", F.round(width.percentile_sorted(F.sort_array("xs"), 0.9), 9).alias("p90"))


@query("agg_percentile_linear", "SELECT l_suppkey, round(quantile_cont(l_quantity, 0.9), 9) AS p90 FROM lineitem GROUP BY l_suppkey")
def agg_percentile_linear(spark, d):
    return selection.exact_quantiles(carrier.table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 0.9).select("l_suppkey", F.round("quantile", 9).alias("p90"))


@query("scale_from_card", "SELECT p_partkey, abs((p_partkey%13 - 6)/100e0)/4 + abs((p_partkey%7 - 3)/50e0)/2 AS rel FROM part")
def scale_from_card(spark, d):
    k = F.col("p_partkey")
    return carrier.table(spark, d, "part").select("p_partkey", width.scale_from_card((k % 13 - 6) / F.lit(100.0), (k % 7 - 3) / F.lit(50.0)).alias("rel"))


@query("hybrid_width", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity/5 < 4 THEN l_quantity/6 ELSE l_quantity/5 END AS px FROM lineitem")
def hybrid_width(spark, d):
    q = F.col("l_quantity")
    return carrier.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", width.hybrid(q / 5, q / 6).alias("px"))


@query("win_prefix_topk", "WITH t AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.7) AS p70 FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS depth FROM lineitem JOIN t USING (l_suppkey) WHERE l_quantity >= p70 GROUP BY l_suppkey")
def win_prefix_topk(spark, d):
    rows = carrier.table(spark, d, "lineitem")
    p70 = rows.groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.7).alias("p70"))
    return rows.join(p70, "l_suppkey").filter("l_quantity >= p70").groupBy("l_suppkey").agg(F.round(F.percentile("l_extendedprice", 0.5), 6).alias("depth"))


CONF = """WITH c AS (SELECT l_returnflag AS source, l_suppkey, (l_quantity*3)::BIGINT % 40 AS tp, l_suppkey % 11 AS fp, l_partkey % 13 AS fn, (l_quantity*3)::BIGINT % 40 AS tol_p_hit, (l_quantity*3)::BIGINT % 40 + l_suppkey % 5 AS tol_p_all, (l_quantity*3)::BIGINT % 40 AS tol_r_hit, (l_quantity*3)::BIGINT % 40 + l_partkey % 3 AS tol_r_all, l_linestatus = 'F' AS negative FROM lineitem)
"""  # fmt: skip
SUMS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tol_p_hit)::BIGINT AS tol_p_hit, sum(tol_p_all)::BIGINT AS tol_p_all, sum(tol_r_hit)::BIGINT AS tol_r_hit, sum(tol_r_all)::BIGINT AS tol_r_all"


def confusion_rows(spark, d):
    tp = (F.col("l_quantity") * 3).cast("long") % 40
    return carrier.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("source"), "l_suppkey", tp.alias("tp"), (F.col("l_suppkey") % 11).alias("fp"), (F.col("l_partkey") % 13).alias("fn"), tp.alias("tol_p_hit"),
        (tp + F.col("l_suppkey") % 5).alias("tol_p_all"), tp.alias("tol_r_hit"), (tp + F.col("l_partkey") % 3).alias("tol_r_all"), (F.col("l_linestatus") == "F").alias("negative"))


@query("agg_confusion", CONF + f"SELECT source, {SUMS} FROM c GROUP BY source")
def agg_confusion(spark, d):
    return metrics.confusion(confusion_rows(spark, d), ["source"])


R = lambda a, b: f"coalesce(({a})::DOUBLE/nullif({b}, 0), 1e0)"
RATIOS = f"SELECT *, {R('tp', 'tp+fp+fn')} AS iou, {R('tp', 'tp+fp')} AS p, {R('tp', 'tp+fn')} AS r, {R('tol_p_hit', 'tol_p_all')} AS tp_, {R('tol_r_hit', 'tol_r_all')} AS tr FROM s"


@query("agg_ratios", CONF + f", s AS (SELECT l_suppkey, {SUMS} FROM c GROUP BY l_suppkey), q AS ({RATIOS}) SELECT l_suppkey, round(iou, 9) AS iou, round(coalesce(2*p*r/nullif(p+r, 0), 0), 9) AS f1, round(coalesce(2*tp_*tr/nullif(tp_+tr, 0), 0), 9) AS tol_f1 FROM q")
def agg_ratios(spark, d):
    out = metrics.ratios(metrics.confusion(confusion_rows(spark, d), ["l_suppkey"]))
    return out.select("l_suppkey", *[F.round(c, 9).alias(c) for c in ("iou", "f1", "tol_f1")])


@query("agg_by_source", CONF + f", u AS (SELECT * FROM c UNION ALL SELECT * REPLACE ('wall' AS source) FROM c WHERE source IN ('A','N')), s AS (SELECT source, {SUMS}, count(*) FILTER (negative AND fp > 0)/nullif(count(*) FILTER (negative), 0)::DOUBLE AS fa FROM u GROUP BY source), q AS ({RATIOS}) SELECT source, round(iou, 9) AS iou, round(fa, 9) AS false_alarm FROM q")
def agg_by_source(spark, d):
    rows = confusion_rows(spark, d)
    # the union group is a second label of the same row, exploded before one aggregate
    labels = F.array_compact(F.array("source", F.when(F.col("source").isin("A", "N"), "wall")))
    rows = rows.withColumn("source", F.explode(labels))
    alarms = rows.groupBy("source").agg(F.try_divide(F.count_if(F.col("negative") & (F.col("fp") > 0)).cast("double"), F.count_if("negative")).alias("fa"))
    return metrics.ratios(metrics.confusion(rows, ["source"])).join(alarms, "source").select("source", F.round("iou", 9).alias("iou"), F.round("fa", 9).alias("false_alarm"))


@query("agg_median_time", "SELECT l_returnflag, median(l_extendedprice) AS ms FROM lineitem GROUP BY l_returnflag")
def agg_median_time(spark, d):
    return selection.exact_quantiles(carrier.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5).select("l_returnflag", F.col("quantile").alias("ms"))


ERR = "SELECT *, l_quantity/25 AS truth, CASE WHEN l_quantity/25 <= 0.3e0 THEN 'thin' WHEN l_quantity/25 <= 1 THEN 'medium' ELSE 'wide' END AS bin FROM lineitem"


@query("agg_error_stats", f"WITH e AS ({ERR}) SELECT bin, l_linenumber AS method, count(*) AS n, round(avg(abs(truth*(1+l_discount) - truth)), 9) AS mae, round(avg(truth*(1+l_discount) - truth), 9) AS bias, round(quantile_cont(abs(truth*(1+l_discount) - truth), 0.9), 9) AS p90, round(avg(abs(truth*(1+l_discount) - truth)/truth), 9) AS relative FROM e GROUP BY bin, l_linenumber")
def agg_error_stats(spark, d):
    t = F.col("l_quantity") / 25
    rows = carrier.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("method"), t.alias("truth"), (t * (1 + F.col("l_discount"))).alias("estimate"), metrics.width_bin(t).alias("bin"))
    out = metrics.error_stats(rows, ["bin", "method"], "truth", "estimate")
    return out.select("bin", "method", "n", *[F.round(c, 9).alias(c) for c in ("mae", "bias", "p90", "relative")])


@query("eval_width", f"WITH e AS ({ERR}) SELECT bin, count(*) AS n, round(avg(truth*l_tax), 9) AS mae FROM e GROUP BY bin")
def eval_width(spark, d):
    t = F.col("l_quantity") / 25
    rows = carrier.table(spark, d, "lineitem").select(t.alias("truth"), (t + t * F.col("l_tax")).alias("estimate"), metrics.width_bin(t).alias("bin"))
    return metrics.error_stats(rows, ["bin"], "truth", "estimate").select("bin", "n", F.round("mae", 9).alias("mae"))


PAIRS = f"WITH v AS ({SIGNS}), p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, bit_count(xor(a.fp, b.fp))::INT AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id) "


def histogram(spark, d):
    return selection.distance_histogram(signs(spark, d), "label", "fp")


@query("agg_threshold_curve", PAIRS + "SELECT label, t::INT AS threshold, avg((distance <= t)::INT) AS share FROM p, (SELECT unnest(range(4, 25, 2)) AS t) GROUP BY label, t")
def agg_threshold_curve(spark, d):
    return selection.shares_within(histogram(spark, d), "label", list(range(4, 25, 2)))


@query("agg_histogram65", PAIRS + ", g AS (SELECT DISTINCT label FROM p), h AS (SELECT unnest(range(65)) AS k), c AS (SELECT label, distance, count(*) AS n FROM p GROUP BY label, distance) SELECT g.label, k::INT AS distance, coalesce(n, 0) AS n FROM g CROSS JOIN h LEFT JOIN c ON c.label = g.label AND c.distance = k")
def agg_histogram65(spark, d):
    found = histogram(spark, d).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("distance", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda k: F.struct(k.alias("distance"), F.coalesce(F.try_element_at("m", k), F.lit(0)).alias("n")))
    return found.select("label", F.inline(dense))


@query("eval_phash", PAIRS + "SELECT label, count(*) AS n, quantile_cont(distance, 0.5) AS p50, quantile_cont(distance, 0.9) AS p90, quantile_cont(distance, 0.01) AS p1 FROM p GROUP BY label")
def eval_phash(spark, d):
    return selection.histogram_quantiles(histogram(spark, d), "label", {"p50": 0.5, "p90": 0.9, "p1": 0.01})


@query("agg_threshold_sweep", """WITH t AS (SELECT unnest(range(2000)) * 250e0 AS threshold)
SELECT threshold, count(o_orderkey) AS n, count(o_orderkey) FILTER (o_orderstatus = 'F')::DOUBLE AS alarms FROM t LEFT JOIN orders ON o_totalprice >= threshold GROUP BY threshold""")
def agg_threshold_sweep(spark, d):
    rows = carrier.table(spark, d, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("alarms"))
    return selection.threshold_sweep(rows, "o_totalprice", ["alarms"], [250.0 * i for i in range(2000)])


@query("agg_grid_search", """WITH g AS (SELECT lo, hi, row_number() OVER (ORDER BY lo, hi) AS config FROM (SELECT unnest([1e0,2e0,3e0]) AS lo), (SELECT unnest([2e0,3e0,4e0]) AS hi) WHERE lo < hi),
s AS (SELECT config, avg(CASE WHEN o_totalprice/100000 BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END) AS f1, avg(CASE WHEN o_orderstatus = 'F' AND o_totalprice/100000 > lo THEN 1e0 ELSE 0e0 END) AS fa FROM orders, g GROUP BY config),
m AS (SELECT *, CASE WHEN fa <= 0.1e0 THEN 0.1e0 WHEN fa <= 0.3e0 THEN 0.3e0 WHEN fa <= 1 THEN 1e0 END AS lim FROM s)
SELECT lim AS "limit", arg_max(config, (f1, -config)) AS config, round(max(f1), 9) AS f1 FROM m WHERE lim = (SELECT min(lim) FROM m) GROUP BY lim""")  # fmt: skip
def agg_grid_search(spark, d):
    grid = [(a, b) for a in (1.0, 2.0, 3.0) for b in (2.0, 3.0, 4.0) if a < b]
    rows = carrier.table(spark, d, "orders").select((F.col("o_totalprice") / 100000).alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("negative"))
    # one sweep gives all thresholds, from which each configuration is put together; above a value is from the next one on
    above = {t: math.nextafter(t, math.inf) for ab in grid for t in ab}
    sweep = selection.threshold_sweep(rows, "x", ["negative"], [-math.inf, *above, *above.values()])
    at = lambda t, c: F.element_at(F.col("m"), F.lit(float(t)))[c]
    one = sweep.agg(F.map_from_entries(F.collect_list(F.struct("threshold", F.struct("n", "negative")))).alias("m"))
    whole = at(-math.inf, "n")
    cells = [F.struct(F.lit(i + 1).alias("config"), ((at(lo, "n") - at(above[hi], "n")) / whole).alias("f1"), (at(above[lo], "negative") / whole).alias("false_alarm")) for i, (lo, hi) in enumerate(grid)]
    scores = one.select(F.inline(F.array(*cells)))
    return metrics.grid_search(scores, [0.1, 0.3, 1.0]).select("limit", F.col("config").cast("long").alias("config"), F.round("f1", 9).alias("f1"))


SIM = "WITH k AS (SELECT *, CASE WHEN id % 19 = 0 THEN 'prank_convincing' WHEN id % 23 = 0 THEN 'flood' WHEN id % 29 = 0 THEN 'viral' ELSE CASE event_type WHEN 'click' THEN 'first' WHEN 'error' THEN 'prank_junk' WHEN 'purchase' THEN 'followup' WHEN 'signup' THEN 'double_tap' ELSE 'corroborate' END END AS kind FROM reviewed) "


def sim_rows(spark, d):
    kinds = {"click": "first", "error": "prank_junk", "purchase": "followup", "signup": "double_tap", "view": "corroborate"}
    by_type = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    k = F.col("id")
    return carrier.reviewed(spark, d).withColumn("kind", F.when(k % 19 == 0, "prank_convincing").when(k % 23 == 0, "flood").when(k % 29 == 0, "viral").otherwise(by_type))


@query("agg_sim_by_kind", sql(SIM + "SELECT kind, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("accepted", "closed", "held", "merged", "pending", "rejected")) + " FROM k GROUP BY kind"))
def agg_sim_by_kind(spark, d):
    states = ["accepted", "closed", "held", "merged", "pending", "rejected"]
    return sim_rows(spark, d).groupBy("kind").pivot("state", states).agg(F.count(F.lit(1))).fillna(0, states)


MODE = "m AS (SELECT wall, arg_max(site_id, (n, -first)) AS main_site FROM (SELECT wall, site_id, count(*) AS n, min(id) AS first FROM k WHERE kind IN ('first','followup','corroborate') AND site_id IS NOT NULL GROUP BY wall, site_id) GROUP BY wall)"


@query("agg_mode", sql(SIM + f", {MODE} SELECT wall, main_site FROM m"))
def agg_mode(spark, d):
    from muralis.operators.simulation import main_sites

    return main_sites(sim_rows(spark, d))


@query("agg_sim_rates", sql(SIM + f""", {MODE}, j AS (SELECT k.*, p.wall = k.wall AND p.kind IN ('first','double_tap','viral') AND k.kind IN ('first','double_tap','viral') AS same FROM k LEFT JOIN k p ON p.id = k.duplicate_of),
x AS (SELECT j.*, main_site, kind IN ('first','followup','corroborate') AS legit, coalesce(same, false) AND state = 'merged' AS caught FROM j LEFT JOIN m USING (wall))
SELECT count(*) FILTER (kind IN ('prank_junk','flood') AND state = 'held')/nullif(count(*) FILTER (kind IN ('prank_junk','flood')), 0)::DOUBLE AS bad_held,
count(*) FILTER (kind IN ('prank_junk','flood') AND state IN ('held','merged'))/nullif(count(*) FILTER (kind IN ('prank_junk','flood')), 0)::DOUBLE AS bad_filtered,
count(*) FILTER (kind = 'prank_convincing' AND state = 'held')/nullif(count(*) FILTER (kind = 'prank_convincing'), 0)::DOUBLE AS convincing_held,
(SELECT count(*) FROM (SELECT site_id FROM k WHERE kind IN ('first','followup','corroborate') AND site_id IS NOT NULL GROUP BY site_id HAVING count(DISTINCT wall) > 1)) AS mixed,
count(*) FILTER (caught)/nullif(count(*) FILTER (kind IN ('double_tap','viral')), 0)::DOUBLE AS dup_merged, count(*) FILTER (legit AND state = 'held')/nullif(count(*) FILTER (legit), 0)::DOUBLE AS wrongly_held,
count(*) FILTER (legit AND state = 'merged' AND NOT caught)/nullif(count(*) FILTER (legit), 0)::DOUBLE AS wrongly_merged,
count(*) FILTER (kind IN ('followup','corroborate') AND state = 'pending' AND site_id = main_site)/nullif(count(*) FILTER (kind IN ('followup','corroborate') AND state = 'pending'), 0)::DOUBLE AS link_rate FROM x"""))
def agg_sim_rates(spark, d):
    from muralis.operators.simulation import rates

    return rates(sim_rows(spark, d))


@query("agg_seed_mean", "SELECT l_linenumber AS sigma, round(avg(l_tax), 9) AS mean FROM lineitem GROUP BY l_linenumber")
def agg_seed_mean(spark, d):
    return carrier.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("sigma")).agg(F.round(F.avg("l_tax"), 9).alias("mean"))


@query("local_scale", "SELECT p_partkey, round(sqrt(dx*dy), 9) AS px_per_mm, round(abs(dx-dy)/greatest(dx, dy), 9) AS anisotropy FROM (SELECT p_partkey, 2 + p_partkey % 10/10e0 AS dx, 2.5e0 + p_partkey % 7/10e0 AS dy FROM part)")
def local_scale(spark, d):
    from muralis.functions.plane import local_scale as scale

    k = F.col("p_partkey")
    h = [2 + (k % 10) / F.lit(10.0), F.lit(0.0), F.lit(5.0), F.lit(0.0), 2.5 + (k % 7) / F.lit(10.0), F.lit(7.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    px, an = scale(h, F.lit(100.0), F.lit(80.0))
    return carrier.table(spark, d, "part").select("p_partkey", F.round(px, 9).alias("px_per_mm"), F.round(an, 9).alias("anisotropy"))


@query("sink_json_results", CONF + f", s AS (SELECT source, {SUMS} FROM c GROUP BY source), q AS ({RATIOS}) SELECT source, tp, fp, fn, round(iou, 9) AS iou FROM q")
def sink_json_results(spark, d):
    """Results as JSON lines in the shared folder, read back under their schema."""
    from muralis.scratch import fresh_dir

    out = metrics.ratios(metrics.confusion(confusion_rows(spark, d), ["source"])).select("source", "tp", "fp", "fn", F.round("iou", 9).alias("iou"))
    path = fresh_dir(spark, "results")
    out.write.json(path)
    return spark.read.schema(out.schema).json(path)
