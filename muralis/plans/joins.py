"""Joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from muralis.functions import geo
from muralis.operators import blocks, pairs, sitelog
from muralis.plans.registry import query
from muralis.sources import carrier
from muralis.sources.carrier import sql

BOXED = """WITH boxed AS (SELECT a.id AS i, b.id AS j, a.accuracy_m, a.device AS idev, b.device AS jdev, a.captured_us AS ius, b.captured_us AS jus,
  bit_count(xor(a.fp, b.fp))::INT AS h, """ + carrier.HAVERSINE_SQL.format(a="a", b="b") + """ AS metres FROM reports a JOIN reports b ON a.id > b.id
  AND b.lat BETWEEN a.lat - 500/111320e0 AND a.lat + 500/111320e0
  AND b.lon BETWEEN a.lon - (500/111320e0)/greatest(0.2e0, cos(radians(a.lat))) AND a.lon + (500/111320e0)/greatest(0.2e0, cos(radians(a.lat))))
"""  # fmt: skip


def in_scene(x, y, p):
    return p.metres <= blocks.radius(x["accuracy_m"][p.a])


def in_ring(x, y, p):
    return (p.metres > 50) & (p.metres <= 500)


def near(p):
    return p.metres <= 50


def repeated(x, y, p):
    hours = np.abs(x["captured_us"][p.a] - y["captured_us"][p.b]) / 3.6e9
    same = x["device_key"][p.a] == y["device_key"][p.b]
    return (p.metres <= 50) & ((same & (hours <= 24)) | ((p.h <= 8) & (hours <= 2)))


@query("join_geo_radius", sql(BOXED + "SELECT i, j, round(metres, 5) AS metres FROM boxed WHERE metres <= least(50e0, greatest(15e0, accuracy_m))"))
def join_geo_radius(spark, d):
    # the radius is 50 m at most, so a finer grid has the same answer
    return blocks.close_pairs(carrier.reports(spark, d), 60.0, in_scene, spot=near, of=("id", "accuracy_m")).select("i", "j", F.round("metres", 5).alias("metres"))


@query("join_near50", sql(BOXED + "SELECT i, count(*) AS n, max(j) AS last FROM boxed WHERE metres <= 50 GROUP BY i"))
def join_near50(spark, d):
    return blocks.close_counts(carrier.reports(spark, d), 60.0, 50.0)


@query("join_elsewhere", sql(BOXED + "SELECT i, j, h, round(metres, 5) AS metres FROM boxed WHERE metres > 50 AND metres <= 500 AND h <= 12"))
def join_elsewhere(spark, d):
    found = blocks.close_pairs(carrier.reports(spark, d), 500.0, in_ring, bits=12, spot=lambda p: in_ring(None, None, p), of=("id",))
    return found.select("i", "j", "h", F.round("metres", 5).alias("metres"))


@query("join_hamming_scene", sql(BOXED + "SELECT i, j, h FROM boxed WHERE metres <= least(50e0, greatest(15e0, accuracy_m)) AND h <= 18"))
def join_hamming_scene(spark, d):
    return blocks.close_pairs(carrier.reports(spark, d), 60.0, in_scene, bits=18, spot=near, of=("id", "accuracy_m")).select("i", "j", "h")


@query("join_hamming_reuse", sql("SELECT a.id AS i, count(*) AS n_far FROM reports a JOIN reports b ON a.id > b.id AND bit_count(xor(a.fp, b.fp)) <= 8 AND " + carrier.HAVERSINE_SQL.format(a="a", b="b") + " > 200 GROUP BY a.id"))
def join_hamming_reuse(spark, d):
    return pairs.reused_far(carrier.reports(spark, d))


@query("join_theta_time", sql(BOXED + "SELECT i, j, abs(ius - jus)/3600000000e0 AS hours FROM boxed WHERE metres <= 50 AND ((idev = jdev AND h <= 18 AND abs(ius - jus)/3600000000e0 <= 24) OR (h <= 8 AND abs(ius - jus)/3600000000e0 <= 2))"))
def join_theta_time(spark, d):
    return blocks.close_pairs(carrier.reports(spark, d), 60.0, repeated, bits=18, spot=near, hours=24.0).select("i", "j", "hours")


@query("join_site_reports_obs", sql("SELECT s.site_id, r.id, r.width FROM sites s LEFT JOIN reviewed r ON r.site_id = s.site_id"))
def join_site_reports_obs(spark, d):
    r = carrier.reviewed(spark, d)
    best = sitelog.widest(sitelog.observations(r)).select(F.col("report_id").alias("id"), "width")
    return carrier.sites(spark, d).select("site_id").join(r.select("site_id", "id").join(best, "id", "left"), "site_id", "left").select("site_id", "id", "width")


@query("semi_reviewed", sql("SELECT count(*) AS n FROM reports WHERE id IN (SELECT report_id FROM actions)"))
def semi_reviewed(spark, d):
    done = carrier.actions(spark, d).select(F.col("report_id").alias("id"))
    return carrier.reports(spark, d).join(done, "id", "left_semi").agg(F.count("*").alias("n"))


@query("anti_self_device", sql("SELECT a.id, count(DISTINCT b.device) AS others FROM reviewed a JOIN reviewed b ON a.wall = b.wall AND b.state = 'accepted' AND b.device <> a.device GROUP BY a.id"))
def anti_self_device(spark, d):
    """A wall's devices are counted, not listed: a report's others are all of its wall's, less its own if it is one."""
    r = carrier.reviewed(spark, d).filter("device is not null")
    devices = r.filter("state = 'accepted'").select("wall", "device").distinct()
    n = devices.groupBy("wall").agg(F.count("*").alias("n"))
    own = devices.withColumn("own", F.lit(1))
    others = F.col("n") - F.coalesce("own", F.lit(0))
    return r.select("id", "wall", "device").join(own, ["wall", "device"], "left").join(n, "wall").select("id", others.alias("others")).filter("others > 0")


POINTS = "SELECT label, vec_id, round(embedding[1]*20, 3)::DOUBLE AS x, round(embedding[2]*20, 3)::DOUBLE AS y FROM embeddings"


@query("join_nearest_point", f"WITH p AS ({POINTS}) SELECT label, s, arg_min(t, (d2, t)) AS t, round(sqrt(min(d2)), 3) AS d FROM (SELECT a.label, a.vec_id AS s, b.vec_id AS t, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM p a JOIN p b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) WHERE d2 <= 4 GROUP BY label, s")
def join_nearest_point(spark, d):
    # in single precision, as the embedding is; a whole number would make the product a double
    at = lambda i: F.round(F.element_at("embedding", i) * F.lit(20).cast("float"), 3).cast("double")
    e = carrier.table(spark, d, "embeddings")
    s = e.filter("vec_id % 2 = 0").select("label", F.col("vec_id").alias("s"), at(1).alias("x"), at(2).alias("y"))
    t = e.filter("vec_id % 2 = 1").select("label", F.col("vec_id").alias("t"), at(1).alias("tx"), at(2).alias("ty"))
    return pairs.nearest_point(s, t, "label", 2.0).select("label", "s", "t", F.round("d", 3).alias("d"))


SIGNS = "SELECT vec_id, label, list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1::UBIGINT ELSE 0::UBIGINT END), lambda a, b: (a % 9223372036854775808::UBIGINT) * 2::UBIGINT + b) AS fp FROM embeddings"


def signs(spark, d):
    return carrier.table(spark, d, "embeddings").select("vec_id", "label", pairs.fingerprint_of_vector(F.col("embedding")).alias("fp"))


@query("join_allpairs_within_group", f"WITH v AS ({SIGNS}) SELECT a.label, a.vec_id AS i, b.vec_id AS j, bit_count(xor(a.fp, b.fp))::INT AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id")
def join_allpairs_within_group(spark, d):
    return pairs.same_group_pairs(signs(spark, d), "label", "vec_id", "fp")


@query("hamming_band_join", f"WITH v AS (SELECT DISTINCT fp FROM reports) SELECT lower(lpad(to_hex(a.fp), 16, '0')) AS x, lower(lpad(to_hex(b.fp), 16, '0')) AS y, bit_count(xor(a.fp, b.fp))::INT AS h FROM v a JOIN v b ON lower(lpad(to_hex(a.fp), 16, '0')) < lower(lpad(to_hex(b.fp), 16, '0')) AND bit_count(xor(a.fp, b.fp)) <= 8".replace("WITH v", "WITH " + carrier.REPORTS_SQL.strip() + ", v"))
def hamming_band_join(spark, d):
    from muralis.plans.scans import hex16

    p = pairs.hamming_pairs(carrier.reports(spark, d).select("fp").distinct())
    x, y = hex16("a"), hex16("b")
    return p.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "h")


@query("join_event_outcome", sql("SELECT a.id, a.state, b.wall = a.wall AS same_wall FROM reviewed a LEFT JOIN reviewed b ON b.id = a.duplicate_of"))
def join_event_outcome(spark, d):
    r = carrier.reviewed(spark, d)
    parent = r.select(F.col("id").alias("pid"), F.col("wall").alias("pwall"))
    return pairs.with_parent(r, parent).select("id", "state", (F.col("pwall") == F.col("wall")).alias("same_wall"))


@query("join_golden", "SELECT p_partkey, abs(p_retailprice - round(p_retailprice)) <= 0.25e0 AS close FROM part")
def join_golden(spark, d):
    p = carrier.table(spark, d, "part").select("p_partkey", F.array("p_retailprice").alias("got"), F.array(F.round("p_retailprice")).alias("want"))
    return p.select("p_partkey", F.forall(F.zip_with("got", "want", lambda a, b: F.abs(a - b) <= 0.25), lambda ok: ok).alias("close"))


@query("scene_distance", sql("SELECT id, round(" + carrier.HAVERSINE_SQL.format(a="reports", b="s") + ", 6) AS metres FROM reports JOIN (SELECT site_id, lat, lon FROM sites) s ON s.site_id = wall + 1"))
def scene_distance(spark, d):
    s = carrier.sites(spark, d).select("site_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    r = carrier.reports(spark, d).withColumn("site_id", F.col("wall") + 1)
    return r.join(s, "site_id").select("id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")), 6).alias("metres"))
