"""Steps whose work, memory or results went wrong on larger tables."""

import random

import duckdb
import pytest

from muralis.functions import hashing
from muralis.operators import blocks, pairs, verify
from muralis.plans import joins
from muralis.streaming import reports as streaming


@pytest.fixture
def plain(spark):
    """Shuffles as planned: one partition of four for each key, nothing sent out."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def largest_part(df):
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_bands_meet_pairs_of_eight_bits_once_and_few_others(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    for p in list(prints):
        flips = sum(1 << k for k in rng.sample(range(63), rng.randrange(1, 11)))
        prints.append(p ^ flips)
    fps = spark.createDataFrame([(p,) for p in sorted(set(prints))], "fp long")
    got = sorted((r.a, r.b, r.h) for r in pairs.hamming_pairs(fps).collect())
    rows = [r.fp for r in fps.collect()]
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == sorted((a, b, far(a, b)) for a in rows for b in rows if a < b and far(a, b) <= 8) and len(got) > 150
    rows = spark.createDataFrame([(rng.getrandbits(64) - (1 << 63),) for _ in range(2000)], "fp long")
    assert max(r["count"] for r in hashing.bands(rows).groupBy("band", "bits").count().collect()) < 10


def test_spatial_probe_is_never_sent_out(spark, tmp_path):
    spark.createDataFrame([(i, 37.5, 127.0) for i in range(50)], "i long, lat double, lon double").write.parquet(str(tmp_path / "p"))
    new = spark.read.parquet(str(tmp_path / "p"))
    plan = pairs.geo_pairs(new, new.toDF("j", "jlat", "jlon"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [_pr" in plan


def test_nearest_point_in_single_precision(spark):
    from muralis.plans import registry

    folder = "/root/testdata/sf0.1"  # a distance there is next to a half of the last digit
    got = sorted(tuple(r) for r in joins.join_nearest_point(spark, folder).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got == sorted(db.execute(registry.oracle_sql()["join_nearest_point"]).fetchall())


def test_flood_counts_rows_of_the_same_moment(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"d{i % 2}", rng.randrange(30) * 400_000_000) for i in range(1, 160)]
    want = {i: sum(e == d and t - verify.HOUR <= u <= t for _, e, u in rows) - 1 for i, d, t in rows}
    df = spark.createDataFrame(rows, "id long, device string, received_us long")
    assert {r.id: r.prior for r in verify.flood_counts(df, ties=True).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for ties in (True, False):
        out = streaming.flood(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ties=ties)
        path = str(tmp_path / f"out{ties}")
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "c").trigger(availableNow=True).start().awaitTermination()
        assert {r.id: r.prior for r in spark.read.parquet(path).collect()} == {r.id: r.prior for r in verify.flood_counts(df, ties=ties).collect()}


def test_rows_without_parent_are_spread(spark, plain):
    rows = spark.range(1, 2001).selectExpr("id", "case when id % 20 = 0 then id - 1 end as duplicate_of")
    found = pairs.with_parent(rows, rows.selectExpr("id as pid", "id * 2 as twice"))
    assert largest_part(found) < 0.4
    assert {r.id: r.twice for r in found.collect()} == {i: 2 * (i - 1) if i % 20 == 0 else None for i in range(1, 2001)}


def test_pairs_of_one_group_are_many_keys(spark, plain):
    rows = spark.range(300).selectExpr("7 as label", "id as vec_id", "id * 77777 as fp")
    found = pairs.same_group_pairs(rows, "label", "vec_id", "fp", block=25)
    assert largest_part(found) < 0.6
    assert sorted((r.i, r.j, r.distance) for r in found.collect()) == [(i, j, ((i * 77777) ^ (j * 77777)).bit_count()) for i in range(300) for j in range(i + 1, 300)]


def test_devices_of_a_wall_are_counted_not_listed(spark):
    plan = joins.anti_self_device(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_percentiles_to_the_last_bit(spark):
    from pyspark.sql import functions as F

    from muralis.functions import width

    rng = random.Random(4)
    lists = [(sorted(rng.randrange(1, 51) / 5 for _ in range(rng.randrange(1, 9))),) for _ in range(3000)]
    df = spark.createDataFrame(lists, "xs array<double>")
    db = duckdb.connect()
    db.execute("CREATE TABLE t (xs DOUBLE[])")
    db.executemany("INSERT INTO t VALUES (?)", lists)
    for q in (0.9, 0.5, 0.75, 0.25):
        got = sorted(tuple(r) for r in df.select("xs", width.percentile_sorted(F.col("xs"), q)).collect())
        assert got == sorted(db.execute(f"SELECT xs, list_aggregate(xs, 'quantile_cont', {q}) FROM t").fetchall())


def test_a_stored_batch_sends_nothing_out(spark, tmp_path, monkeypatch):
    """Files are many times smaller than their rows, so small ones were sent out through the driver."""
    from muralis.operators import components
    from muralis.sources import carrier
    from muralis.streaming import durable

    plans = []

    def noted(df, label, kept=verify.written):
        plans.append((label, df._jdf.queryExecution().sparkPlan().toString()))
        return kept(df, label)

    for module in (verify, pairs, components):
        monkeypatch.setattr(module, "written", noted)
    store = durable.Store(spark, str(tmp_path / "store"))
    rows = carrier.reports(spark, "/root/testdata/sf0.001")
    store.commit(0, rows.filter("id <= 600"))
    store.commit(1, rows.filter("id > 600"))
    assert {"coded", "pairs", "events", "decisions"} <= {label for label, _ in plans}
    # one row for each device
    sent = [label for label, plan in plans if "BroadcastHashJoin" in plan.replace("BroadcastHashJoin [_pr", "").replace("BroadcastHashJoin [_r", "").replace("BroadcastHashJoin [coalesce(device", "")]
    assert not sent


def test_links_of_one_place_are_no_rows(spark, monkeypatch):
    """A place's pairs were written, and listed for each report."""
    sizes = {}

    def noted(df, label, kept=verify.written):
        out = kept(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(verify, "written", noted)
    rows = spark.range(1, 301).selectExpr(
        "id", "'d' || id % 7 as device", "id * 400000000 as received_us", "id * 400000000 as captured_us", "37.5 as lat", "127.0 as lon", "8.0D as accuracy_m", "0.2D as blur_score", "true as patch_found",
        "'good' as quality", "1 as n_cracks", "0.8D as width", "if(id = 200, null, 7L) as fp").selectExpr("*", "double(lat) as y", "double(lon) as x").drop("lat", "lon").withColumnsRenamed({"y": "lat", "x": "lon"})
    found = {r.id: r for r in verify.decide(rows).collect()}
    assert sizes["pairs"] <= 600 and len(found) == 300
    assert found[1].state == "pending" and found[200].duplicate_of is None
    assert all(r.duplicate_of == 1 for i, r in found.items() if i not in (1, 200))


def test_close_pairs_are_never_joined(spark):
    """They were rows of a join; fingerprints differ in the sign bit too."""
    rng = random.Random(6)
    near = lambda a: a + rng.choice([0, 2e-4, 1e-3])
    rows = [(i, near(37.5), near(127.0), rng.choice([5.0, 40.0, None]), rng.choice([-7, 7]) ^ rng.choice([0, 1 << 40]), rng.choice(["a", "b", None]), i * 10**9) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, accuracy_m double, fp long, device string, captured_us long")
    found = blocks.close_pairs(df, 60.0, joins.in_scene, bits=18, block=30)
    assert "Join [_pr" not in found._jdf.queryExecution().sparkPlan().toString()
    old = pairs.geo_pairs(df.withColumnRenamed("id", "i"), df.selectExpr("id as j", "lat as jlat", "lon as jlon", "fp as jfp"), metres=60.0)
    want = old.filter("metres <= least(50D, greatest(15D, accuracy_m)) and bit_count(fp ^ jfp) <= 18").selectExpr("i", "j", "bit_count(fp ^ jfp) as h")
    pairs_of = sorted((r.i, r.j, r.h) for r in want.collect())
    assert sorted((r.i, r.j, r.h) for r in found.collect()) == pairs_of and len(pairs_of) > 500


def test_busy_device_is_many_tasks(spark, tmp_path, plain):
    """Each task of a batch writes a file: the log of one device, whose link mostly works, must not be one file."""
    from pyspark.sql import functions as F

    from muralis.streaming import queue
    from tests.test_durable import MIN, QUEUE, brute_queue

    rng = random.Random(5)
    rows = [("busy", i * MIN + 77, i, f"u{i // 3}", rng.random() < 0.8, rng.random() < 0.9) for i in range(2880)]
    df = spark.createDataFrame(rows, QUEUE.replace("timestamp", "long")).withColumn("at", F.timestamp_micros("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    queue.use_rocksdb(spark)
    log = queue.offline_queue(spark.readStream.schema(QUEUE).parquet(f"{tmp_path}/in"), "30 minutes")
    log.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_queue(rows, rows[-1][1] // 1000 * 1000 - 30 * MIN)
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 0.6 * sum(sizes)


def test_queue_of_rows_with_nulls(spark, tmp_path):
    from pyspark.sql import functions as F

    from muralis.streaming import queue
    from tests.test_durable import MIN, QUEUE

    rows = [("a", MIN, None, "u1", None, True), ("a", MIN, 4, "u2", True, None), ("a", None, 5, "u3", True, True), (None, 2 * MIN, 6, None, True, True), ("a", 90 * MIN, 7, "u4", True, True)]
    df = spark.createDataFrame(rows, QUEUE.replace("timestamp", "long")).withColumn("at", F.timestamp_micros("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    queue.use_rocksdb(spark)
    log = queue.offline_queue(spark.readStream.schema(QUEUE).parquet(f"{tmp_path}/in"), "30 minutes")
    log.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = [("a", "u1", MIN, 1, MIN, "failed"), ("a", "u1", MIN, 2, MIN, "sent"), ("a", "u2", MIN, 1, MIN, "refused"), (None, None, 2 * MIN, 1, 2 * MIN, "sent")]
    assert sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr) == sorted(want, key=repr)


def test_decisions_compare_a_spot_once(spark, monkeypatch):
    """Each report of a place was compared with all earlier ones, by the square of the place's reports."""
    sizes = {}

    def noted(df, label, kept=verify.written):
        out = kept(df, label)
        sizes[label] = out.count()
        return out

    for module in (verify, blocks):
        monkeypatch.setattr(module, "written", noted, raising=False)
    rows = spark.range(1, 401).selectExpr(
        "id", "'d' || id % 7 as device", "id * 400000000 as received_us", "id * 400000000 as captured_us", "37.5D + (id % 2) * 1e-5D as lat", "127.0D as lon", "8.0D as accuracy_m", "0.2D as blur_score", "true as patch_found",
        "'good' as quality", "1 as n_cracks", "0.8D as width", "if(id % 2 = 0, 7L, -7L) as fp")
    found = verify.decide(rows)
    assert found.count() == 400 and sizes["spots"] == 2 and sizes["pairs"] <= 2
    assert {r.state for r in found.collect()} == {"pending", "merged"}


def near_rows(spark, n, seed):
    """Reports of few spots, some of them of the same place, and a pole's."""
    rng = random.Random(seed)
    spots = [(37.5 + rng.choice([0, 2e-4, 1e-3, 4e-3]), 127.0 + rng.choice([0, 3e-4, 2e-3]), rng.choice([-7, 7, None]) if k % 5 == 0 else rng.choice([-7, 7]) ^ rng.choice([0, 1 << 40, 7 << 20])) for k in range(40)]
    rows = [(i, *rng.choice(spots), rng.choice([5.0, 40.0, None]), rng.choice(["a", "b", None]), i * 10**9) for i in rng.sample(range(1, 3_000_000), n)]
    return spark.createDataFrame(rows, "id long, lat double, lon double, fp long, accuracy_m double, device string, captured_us long")


def boxed(df, metres):
    old = pairs.geo_pairs(df.withColumnRenamed("id", "i"), df.selectExpr("id as j", "lat as jlat", "lon as jlon", "fp as jfp"), metres=metres)
    return old.selectExpr("*", "bit_count(fp ^ jfp) as h")


def test_nearest_earlier_of_spots(spark):
    df = near_rows(spark, 500, 8)
    got = blocks.nearest_before(df, 500.0, joins.in_ring, 12, block=16)
    want = boxed(df, 500.0).filter("metres > 50 and metres <= 500 and h <= 12").groupBy("i").agg({"*": "count"})
    first = boxed(df, 500.0).filter("metres > 50 and metres <= 500 and h <= 12").selectExpr("i", "struct(round(metres, 6) as m, j) as m").groupBy("i").agg({"m": "min"}).toDF("i", "m").selectExpr("i", "m.j", "m.m")
    assert sorted((r.i, r.j, round(r.metres, 6)) for r in got.collect()) == sorted((r.i, r.j, r.m) for r in first.collect()) and want.count() > 300


def test_first_by_rank_of_spots(spark):
    df = near_rows(spark, 500, 9)
    got = blocks.first_by_rank(df, 60.0, joins.in_scene, 18, block=16)
    kept = boxed(df, 60.0).filter("metres <= least(50D, greatest(15D, accuracy_m)) and h <= 18")
    first = kept.selectExpr("i", "struct(h, round(metres, 6) as m, j) as m").groupBy("i").agg({"m": "min"}).toDF("i", "m").selectExpr("i", "m.j", "m.h")
    assert sorted((r.i, r.j, r.h) for r in got.collect()) == sorted((r.i, r.j, r.h) for r in first.collect()) and first.count() > 300


def test_counts_and_pairs_of_spots(spark):
    df = near_rows(spark, 300, 10)
    got = blocks.close_counts(df, 60.0, 50.0, block=16)
    all_near = boxed(df, 60.0).filter("metres <= 50")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in all_near.selectExpr("i", "j").groupBy("i").agg({"*": "count", "j": "max"}).toDF("i", "n", "last").collect())
    listed = blocks.close_pairs(df, 500.0, joins.in_ring, bits=12, block=16)
    want = boxed(df, 500.0).filter("metres > 50 and metres <= 500 and h <= 12")
    pairs_of = sorted((r.i, r.j, r.h) for r in want.collect())
    assert sorted((r.i, r.j, r.h) for r in listed.collect()) == pairs_of and len(pairs_of) > 1000


def test_pairs_within_hours_of_spots(spark):
    """A place's reports of all times were paired, and those of other days left out afterwards."""
    df = near_rows(spark, 300, 11).selectExpr("id", "lat", "lon", "fp", "accuracy_m", "device", "if(id % 17 = 0, null, id % 9 * 30000000000 + id * 1000) as captured_us")
    got = blocks.close_pairs(df, 60.0, joins.repeated, bits=18, spot=joins.near, hours=24.0, block=16)
    few = got.select("i", "j").collect()
    old = blocks.close_pairs(df, 60.0, joins.repeated, bits=18, block=16)
    assert sorted((r.i, r.j) for r in few) == sorted((r.i, r.j) for r in old.select("i", "j").collect()) and len(few) > 100
    rows = df.select("id", "device", "captured_us", "lat", "lon", "fp").collect()
    at = {r.id: r for r in rows}
    assert all(abs(at[r.i].captured_us - at[r.j].captured_us) <= 24 * 3.6e9 for r in few)
