"""Scans, lookups, projections, filters, scalar functions, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from muralis import config, schema
from muralis.functions import geo, hashing
from muralis.operators import layout, sitelog
from muralis.plans.registry import query
from muralis.scratch import fresh_dir
from muralis.sources import carrier, dataset_index
from muralis.sources.carrier import sql

BOX = (37.5600, 37.5700, 126.9700, 126.9850)
PREFIXES = [("src1", "one"), ("src", "many"), ("x", "none")]
HEX = "lower(lpad(to_hex(fp), 16, '0'))"


def hex16(c):
    return F.lpad(F.lower(F.hex(c)), 16, "0")


@query("scan_reports", sql(f"SELECT id, lat, lon, {HEX} AS fp FROM reports"))
def scan_reports(spark, d):
    return carrier.reports(spark, d).select("id", "lat", "lon", hex16("fp").alias("fp"))


@query("scan_box", sql("SELECT id, lat, lon FROM reviewed WHERE lat BETWEEN 37.56e0 AND 37.57e0 AND lon BETWEEN 126.97e0 AND 126.985e0 AND state <> 'rejected'"))
def scan_box(spark, d):
    return carrier.reviewed(spark, d).filter(F.col("lat").between(*BOX[:2]) & F.col("lon").between(*BOX[2:]) & (F.col("state") != "rejected")).select("id", "lat", "lon")


@query("scan_sites_box", sql("SELECT site_id, lat, lon FROM sites WHERE lat BETWEEN 37.56e0 AND 37.57e0 AND lon BETWEEN -180 AND 180"))
def scan_sites_box(spark, d):
    return carrier.sites(spark, d).filter(F.col("lat").between(*BOX[:2]) & F.col("lon").between(-180, 180)).select("site_id", "lat", "lon")


@query("scan_box_clustered", sql("SELECT id, lat, lon FROM reviewed WHERE lat BETWEEN 37.56e0 AND 37.57e0 AND lon BETWEEN 126.97e0 AND 126.985e0 AND state <> 'rejected'"))
def scan_box_clustered(spark, d):
    """The box of ``scan_box`` from reports that are laid out along a curve."""
    path = fresh_dir(spark, "clustered")
    layout.write_clustered(carrier.reviewed(spark, d).select("id", "lat", "lon", "state"), path)
    return layout.read_box(spark, path, *BOX).filter("state <> 'rejected'").select("id", "lat", "lon")


@query("lookup_pk", sql("SELECT id, device, width FROM reports WHERE id = 77"))
def lookup_pk(spark, d):
    return carrier.reports(spark, d).filter(F.col("id") == 77).select("id", "device", "width")


@query("lookup_uuid", sql("SELECT id, client_uuid FROM reports WHERE client_uuid = 'uuid-00000041'"))
def lookup_uuid(spark, d):
    return carrier.reports(spark, d).filter(F.col("client_uuid") == "uuid-00000041").select("id", "client_uuid")


@query("src_json_payload", sql("""SELECT id, round(lat, 9) AS lat, n_cracks, id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0 AS valid,
  CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS n_violations FROM (SELECT *, CASE WHEN id % 7 = 0 THEN 95e0 ELSE lat END AS lat2 FROM reports) WHERE id % 7 <> 0
  UNION ALL SELECT id, 95e0, n_cracks, false, 1 + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END FROM reports WHERE id % 7 = 0"""))
def src_json_payload(spark, d):
    r, k = carrier.reports(spark, d), F.col("id")
    crack = F.struct(F.col("width").alias("width_mm"), F.array("ci_low", "ci_high").alias("width_ci_mm"), F.lit(10.0).alias("length_mm"), F.lit(30.0).alias("orientation_deg"), F.array(F.array(F.lit(0.1), F.lit(0.2))).alias("polyline"), F.lit(0.7).alias("confidence"))
    payload = F.to_json(F.struct(
        F.lit(1).alias("schema_version"), "client_uuid", F.lit("2024-01-01T00:00:00Z").alias("captured_at"), F.lit("ignored").alias("unknown_field"),
        F.struct(F.when(k % 7 == 0, 95.0).otherwise(F.col("lat")).alias("lat"), "lon", "accuracy_m", F.lit("wydm9qy8").alias("geohash")).alias("location"),
        F.struct("patch_found", F.when(k % 11 == 0, "bad").otherwise(F.col("quality")).alias("quality")).alias("calibration"),
        F.struct(F.lit("classic@1").alias("engine"), F.filter(F.array(F.when(F.col("n_cracks") == 1, crack)), lambda x: x.isNotNull()).alias("cracks")).alias("detection"),
        F.struct("blur_score").alias("image_meta"), F.when(k % 13 == 0, "xyz").otherwise(hex16("fp")).alias("phash")))
    out = schema.decode(r.select("id", payload.alias("payload")))
    return out.select("id", F.round("report.location.lat", 9).alias("lat"), F.size("report.detection.cracks").alias("n_cracks"), "valid", F.size("violations").alias("n_violations"))


@query("src_dataset_index", "SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'one' WHEN source LIKE 'src%' THEN 'many' ELSE 'other' END AS kind FROM documents WHERE source NOT IN ('src3', 'src4') AND doc_id IN (SELECT doc_id FROM labels)")
def src_dataset_index(spark, d):
    docs = carrier.table(spark, d, "documents").filter(~F.col("source").isin("src3", "src4"))
    return docs.join(carrier.table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", dataset_index.prefix_classify(F.col("source"), PREFIXES).alias("kind"))


MOD100 = "(list_reduce(list_prepend(0, list_transform(string_split({h}, ''), lambda c: instr('0123456789abcdef', c)::INT - 1)), lambda a, x: (a*16 + x) % 100))"
KEYED = "SELECT doc_id, source || '_' || doc_id AS key, " + MOD100.format(h="sha1(source || '_' || doc_id)") + " AS h FROM documents"


@query("split_by_hash", f"SELECT doc_id, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' ELSE 'test' END AS split FROM ({KEYED})")
def split_by_hash(spark, d):
    key = dataset_index.filename_key(F.concat_ws("_", "source", "doc_id", F.lit("7")), 1)
    return carrier.table(spark, d, "documents").select("doc_id", dataset_index.split_by_hash(key).alias("split"))


@query("sha1_mod100", f"SELECT doc_id, h::INT AS h FROM ({KEYED})")
def sha1_mod100(spark, d):
    return carrier.table(spark, d, "documents").select("doc_id", hashing.sha1_mod100(F.concat_ws("_", "source", "doc_id")).alias("h"))


@query("filename_key", "SELECT doc_id, source || '_' || lang AS key FROM documents")
def filename_key(spark, d):
    return carrier.table(spark, d, "documents").select("doc_id", dataset_index.filename_key(F.concat_ws("_", "source", "lang", "doc_id", F.lit("0")), 2).alias("key"))


@query("prefix_classify", "SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'one' WHEN source LIKE 'src%' THEN 'many' ELSE 'other' END AS kind FROM documents")
def prefix_classify(spark, d):
    return carrier.table(spark, d, "documents").select("doc_id", dataset_index.prefix_classify(F.col("source"), PREFIXES).alias("kind"))


@query("src_excluded_count", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src3','src4') GROUP BY source")
def src_excluded_count(spark, d):
    return carrier.table(spark, d, "documents").filter(F.col("source").isin("src3", "src4")).groupBy("source").agg(F.count("*").alias("n"))


@query("filter_state", sql("SELECT id, state FROM reviewed WHERE state = 'held'"))
def filter_state(spark, d):
    return carrier.reviewed(spark, d).filter(F.col("state") == "held").select("id", "state")


@query("filter_visible", sql("SELECT id, state FROM reviewed WHERE state IN ('pending','accepted','closed')"))
def filter_visible(spark, d):
    return carrier.reviewed(spark, d).filter(F.col("state").isin(*config.VISIBLE)).select("id", "state")


@query("filter_nonempty_sites", sql("SELECT site_id, count(*) AS report_count FROM reviewed WHERE state IN ('pending','accepted','closed') AND site_id IS NOT NULL GROUP BY site_id HAVING count(*) > 0"))
def filter_nonempty_sites(spark, d):
    return carrier.reviewed(spark, d).filter(F.col("state").isin(*config.VISIBLE) & F.col("site_id").isNotNull()).groupBy("site_id").agg(F.count("*").alias("report_count"))


@query("project_admin_row", sql("SELECT id, state, score, substr(device, 1, 8) AS device, strftime(make_timestamp(captured_us), '%Y-%m-%dT%H:%M:%S') AS captured_at FROM reviewed"))
def project_admin_row(spark, d):
    return sitelog.admin_rows(carrier.reviewed(spark, d))


@query("null_if_empty_rate", sql("SELECT state, CASE WHEN count(*) FILTER (id % 2 = 0 AND state <> 'held') > 0 THEN (count(*) FILTER (id % 4 = 0 AND state <> 'held'))::DOUBLE / (count(*) FILTER (id % 2 = 0 AND state <> 'held')) END AS rate FROM reviewed GROUP BY state"))
def null_if_empty_rate(spark, d):
    live = F.col("state") != "held"
    n, m = F.count_if((F.col("id") % 4 == 0) & live), F.count_if((F.col("id") % 2 == 0) & live)
    return carrier.reviewed(spark, d).groupBy("state").agg(F.try_divide(n.cast("double"), m).alias("rate"))


@query("quality_bucket", "SELECT p_partkey, CASE WHEN p_partkey % 90 / 10e0 <= 3 THEN 'good' WHEN p_partkey % 90 / 10e0 <= 6 THEN 'fair' ELSE 'poor' END AS quality FROM part")
def quality_bucket(spark, d):
    from muralis.operators.calibration import quality_of

    return carrier.table(spark, d, "part").select("p_partkey", quality_of((F.col("p_partkey") % 90) / F.lit(10.0)).alias("quality"))


@query("width_bins", sql("SELECT id, CASE WHEN width > 0 AND width <= 0.3e0 THEN 'thin' WHEN width > 0.3e0 AND width <= 1 THEN 'medium' WHEN width > 1 AND width <= 99 THEN 'wide' END AS bin FROM reports"))
def width_bins(spark, d):
    from muralis.operators.metrics import width_bin

    return carrier.reports(spark, d).select("id", width_bin(F.col("width")).alias("bin"))


@query("exists_any", sql("SELECT id, coalesce(width * 12 > 50, false) AS implausible FROM reports"))
def exists_any(spark, d):
    cracks = F.filter(F.array(F.col("width"), F.col("width") * 12), lambda x: x.isNotNull())
    return carrier.reports(spark, d).select("id", F.exists(cracks, lambda x: x > config.RULES.limits("IMPLAUSIBLE_WIDTH")[0]).alias("implausible"))


@query("finite_filter", sql("SELECT id, CASE WHEN width IS NULL THEN 0 ELSE 2 END AS n FROM reports"))
def finite_filter(spark, d):
    xs = F.array(F.col("width"), F.lit(float("nan")), F.col("width") + 1, F.lit(float("inf")), F.lit(None).cast("double"))
    return carrier.reports(spark, d).select("id", F.size(sitelog.finite_top(xs, 16)).alias("n"))


@query("clamp", sql("SELECT id, greatest(0e0, least(1e0, blur_score * 2 - 0.5e0)) AS x FROM reports"))
def clamp(spark, d):
    return carrier.reports(spark, d).select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("blur_score") * 2 - 0.5)).alias("x"))


@query("note_truncate", "SELECT doc_id, substr(text, 1, 500) AS note FROM documents")
def note_truncate(spark, d):
    return carrier.table(spark, d, "documents").select("doc_id", F.substring("text", 1, 500).alias("note"))


@query("topk_recent", sql("SELECT id, state, score, substr(device, 1, 8) AS device, strftime(make_timestamp(captured_us), '%Y-%m-%dT%H:%M:%S') AS captured_at FROM reviewed ORDER BY received_us DESC, id DESC LIMIT 200"))
def topk_recent(spark, d):
    return sitelog.recent(carrier.reviewed(spark, d))


@query("topk_reasons", sql("SELECT event_type AS code, count(*) AS n FROM reports GROUP BY event_type ORDER BY n DESC, code LIMIT 8"))
def topk_reasons(spark, d):
    return carrier.reports(spark, d).groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(8)


@query("topk_cracks", "SELECT l_orderkey, array_to_string(list_slice(list_sort(list(l_quantity::INT), 'DESC'), 1, 16), ',') AS top FROM lineitem GROUP BY l_orderkey")
def topk_cracks(spark, d):
    return carrier.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.slice(F.sort_array(F.collect_list(F.col("l_quantity").cast("int")), asc=False), 1, 16), ",").alias("top"))


@query("sort_events", sql("SELECT id, received_us, row_number() OVER (ORDER BY received_us, id) AS place FROM reports"))
def sort_events(spark, d):
    from muralis.operators.ordering import global_rank

    return global_rank(carrier.reports(spark, d).select("id", "received_us"), ["received_us", "id"], "place")


@query("set_difference", sql("SELECT wall, count(DISTINCT device) FILTER (device <> 'dev-flood') AS others FROM reports GROUP BY wall"))
def set_difference(spark, d):
    g = carrier.reports(spark, d).groupBy("wall").agg(F.collect_set("device").alias("s"))
    return g.select("wall", F.size(F.array_except("s", F.array(F.lit("dev-flood")))).cast("long").alias("others"))


@query("set_union_lists", sql("SELECT id, state FROM reviewed WHERE state = 'held' UNION ALL SELECT id, state FROM reviewed WHERE state = 'closed'"))
def set_union_lists(spark, d):
    r = carrier.reviewed(spark, d).select("id", "state")
    return r.filter("state = 'held'").unionByName(r.filter("state = 'closed'"))


@query("set_membership", sql("SELECT id FROM reports WHERE id IN (SELECT report_id FROM actions)"))
def set_membership(spark, d):
    return carrier.reports(spark, d).select("id").join(carrier.actions(spark, d).select(F.col("report_id").alias("id")), "id", "left_semi")


@query("cartesian_grid", "SELECT lo, hi, s FROM (SELECT unnest([0.1e0,0.2e0,0.3e0]) AS lo), (SELECT unnest([0.2e0,0.3e0,0.5e0]) AS hi), (SELECT unnest([16,32]) AS s) WHERE lo < hi")
def cartesian_grid(spark, d):
    from muralis.operators.metrics import parameter_grid

    return parameter_grid(spark, {"lo": [0.1, 0.2, 0.3], "hi": [0.2, 0.3, 0.5], "s": [16, 32]}).filter("lo < hi")


@query("haversine_m", sql("SELECT r.id, round(" + carrier.HAVERSINE_SQL.format(a="r", b="c") + ", 6) AS metres FROM reports r, (SELECT 37.5665e0 AS lat, 126.978e0 AS lon) c"))
def haversine_m(spark, d):
    return carrier.reports(spark, d).select("id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(37.5665), F.lit(126.978)), 6).alias("metres"))


@query("hamming_hex", sql(f"SELECT id, CASE WHEN id % 5 = 0 THEN 64 ELSE bit_count(xor(fp, 11400714819323198485::UBIGINT))::INT END AS h FROM reports"))
def hamming_hex(spark, d):
    other = F.when(F.col("id") % 5 == 0, "9e3779b97f4a7c15ff").otherwise("9e3779b97f4a7c15")
    return carrier.reports(spark, d).select("id", hashing.hamming_hex(hex16("fp"), other).alias("h"))


GEOHASH_SQL = "SELECT id, list_reduce(list_transform(range(8), lambda c: substr('0123456789bcdefghjkmnpqrstuvwxyz', (" + " + ".join(
    f"((CASE WHEN (5*c+{b}) % 2 = 0 THEN (x >> (19 - (5*c+{b})//2)::INT) ELSE (y >> (19 - (5*c+{b})//2)::INT) END) & 1) * {16 >> b}" for b in range(5)) + " + 1)::INT, 1)), lambda a, z: a || z) AS geohash FROM (SELECT id, floor((lon+180)/360*1048576)::BIGINT AS x, floor((lat+90)/180*1048576)::BIGINT AS y FROM reports)"


@query("geohash_encode", sql(GEOHASH_SQL))
def geohash_encode(spark, d):
    return carrier.reports(spark, d).select("id", geo.geohash(F.col("lat"), F.col("lon")).alias("geohash"))


@query("offset_m", sql("SELECT id, round(lat + 10/111320e0, 9) AS lat, round(lon + 20/(111320e0*cos(radians(lat))), 9) AS lon FROM reports"))
def offset_m(spark, d):
    lat, lon = geo.offset_m(F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(10.0))
    return carrier.reports(spark, d).select("id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("flip_bits", sql("SELECT id, (id % 21)::INT AS h, (id % 21) > 0 AS changed FROM reports"))
def flip_bits(spark, d):
    flipped = hashing.flip_bits(F.col("fp"), F.col("id") % 21, F.col("id"))
    return carrier.reports(spark, d).withColumn("to", flipped).select("id", hashing.hamming(F.col("fp"), F.col("to")).alias("h"), (F.col("fp") != F.col("to")).alias("changed"))


@query("dt_hours", sql("SELECT id, abs(captured_us - received_us) / 3600000000e0 AS hours, (received_us - captured_us) / 86400000000e0 AS days, (captured_us - received_us) / 60000000e0 AS skew_min FROM reports"))
def dt_hours(spark, d):
    late = F.col("received_us") - F.col("captured_us")
    return carrier.reports(spark, d).select("id", (F.abs(late) / F.lit(3.6e9)).alias("hours"), (late / F.lit(8.64e10)).alias("days"), (-late / F.lit(6e7)).alias("skew_min"))


@query("to_utc", "SELECT event_id, epoch_us(ts) AS us FROM events")
def to_utc(spark, d):
    return carrier.table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("orientation_deg", sql("SELECT id, round((degrees(atan2(accuracy_m - 30, blur_score - 0.5e0)) + 180) % 180, 6) % 180 AS deg FROM reports"))
def orientation_deg(spark, d):
    return carrier.reports(spark, d).select("id", (F.round(sitelog.orientation(F.col("blur_score") - 0.5, F.col("accuracy_m") - 30), 6) % 180).alias("deg"))


@query("length_mm", sql("SELECT id, CASE WHEN patch_found THEN accuracy_m * 10 / 3.5e0 ELSE 0e0 END AS length_mm, CASE WHEN patch_found THEN 0.7e0 ELSE 0.3e0 END AS confidence FROM reports"))
def length_mm(spark, d):
    found = F.col("patch_found")
    return carrier.reports(spark, d).select("id", F.when(found, F.col("accuracy_m") * 10 / 3.5).otherwise(0.0).alias("length_mm"), F.when(found, 0.7).otherwise(0.3).alias("confidence"))


@query("json_reason_append", sql("SELECT id, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN id % 3 = 0 THEN 'FLOODING_RETRO' ELSE 'GPS_IMPRECISE' END AS last FROM reports"))
def json_reason_append(spark, d):
    reason = lambda code, delta: F.struct(F.lit(code).alias("code"), F.lit(delta).alias("delta"), F.lit("").alias("detail"))
    r = F.array(reason("GPS_IMPRECISE", -0.15))
    r = F.when(F.col("id") % 3 == 0, F.array_append(r, reason("FLOODING_RETRO", 0.0))).otherwise(r)
    return carrier.reports(spark, d).select("id", r.alias("r")).select("id", F.size("r").alias("n"), F.element_at("r", -1)["code"].alias("last"))
