"""Column functions and kernels against published or brute-force values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from muralis import schema
from muralis.functions import geo, hashing, width
from muralis.kernels import filters, geometry, profile
from muralis.operators import pairs
from muralis.operators.components import components
from muralis.sources import synthetic
from muralis.streaming import reports as streaming


def test_geohash(spark):
    df = spark.createDataFrame([(57.64911, 10.40744)], "lat double, lon double")
    assert df.select(geo.geohash(F.col("lat"), F.col("lon"), 11)).first()[0] == "u4pruydqqvj"


def test_hamming_hex(spark):
    df = spark.createDataFrame([("f" * 16, "0" * 16), ("f" * 16, "f" * 20), ("0" * 31 + "3", "0" * 32)], "a string, b string")
    assert [r[0] for r in df.select(hashing.hamming_hex(F.col("a"), F.col("b"))).collect()] == [64, 64, 2]


def test_band_join_equals_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    fps = {b for b in base} | {b ^ sum(1 << k for k in rng.sample(range(62), rng.randint(1, 11))) for b in base for _ in range(6)}
    got = {(r.a, r.b) for r in pairs.hamming_pairs(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 8}
    assert got == want


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    label = list(range(500))
    for a, b in edges:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: label[v] for e in edges for v in e}


def test_width_summary(spark):
    def one(xs, ppm, rel):
        df = spark.createDataFrame([(xs, ppm, rel)], "xs array<double>, ppm double, rel double")
        return df.select(width.summarize(F.col("xs"), F.col("ppm"), F.col("rel")).alias("w")).select("w.*").first()

    assert one([], 10.0, 0.0).guidance == "판정 보류" and one([], 10.0, 0.0).width_mm is None
    assert one([3.0, float("nan"), -1.0], None, 0.0).guidance == "판정 보류"
    w = one([4.0] * 5, 10.0, 0.0)
    assert (w.width_mm, w.ci_low, w.ci_high, w.guidance) == (0.4, 0.35, 0.45, "전문가 점검 권장")
    assert one([1.0] * 5, 10.0, 0.0).below_limit and one([4.0] * 5, 10.0, 0.2).guidance == "판정 보류"


def test_payload_validation(spark):
    good = '{"schema_version":1,"client_uuid":"u","captured_at":"2024-01-01T00:00:00Z","location":{"lat":1,"lon":2,"accuracy_m":3,"geohash":"wydm9qy8"},"calibration":{"patch_found":true,"quality":"good"},"detection":{"engine":"e","cracks":[]},"image_meta":{"blur_score":0.2},"phash":"9f3c1a7b52d6e084","extra":1}'
    rows = [(good,), (good.replace('"lat":1', '"lat":91'),), ("nonsense",), (None,)]
    got = schema.decode(spark.createDataFrame(rows, "payload string")).collect()
    assert [r.valid for r in got] == [True, False, False, False] and got[1].violations == ["lat"]


def test_flood_stream_equals_window(spark, tmp_path):
    rows = [(i, f"d{i % 3}", i * 400_000_000) for i in range(1, 120)]
    df = spark.createDataFrame(rows, "id long, device string, received_us long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streaming.flood(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    from muralis.operators.verify import flood_counts

    got = {r.id: r.prior for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.prior for r in flood_counts(df).collect()}


def test_ingest_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i % 7}", i) for i in range(30)], "client_uuid string, received_us long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second run is a replay with a fresh checkpoint
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        streaming.ingest(stream, str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination()
    assert sorted(r.received_us for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(7))


def test_components_of_masks():
    rng = np.random.default_rng(0)
    mask = rng.random((40, 50)) < 0.4
    label, stats = filters.components(mask)
    seen, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if seen[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        seen[y, x] = n
        while todo:
            a, b = todo.pop()
            for c in range(max(0, a - 1), min(40, a + 2)):
                for d in range(max(0, b - 1), min(50, b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = n
                        todo.append((c, d))
    assert len(stats) == n and len({(a, b) for a, b in zip(label[mask], seen[mask], strict=True)}) == n
    assert stats[:, 0].sum() == mask.sum()


def test_distance_transform():
    mask = np.random.default_rng(1).random((20, 30)) < 0.9
    back = np.argwhere(~mask)
    want = [min(np.hypot(*(back - p).T)) for p in np.argwhere(mask)]
    assert np.allclose(filters.distance_transform(mask)[mask], want)


def test_thinning_keeps_connection_and_thins():
    mask = np.zeros((60, 60), bool)
    mask[20:30, 5:55] = True
    thin = filters.thin(mask)
    assert thin.sum() < 70 and len(filters.components(thin)[1]) == 1 and not (thin & ~mask).any()


def test_card_is_found_within_one_per_cent():
    h = np.array([[4.6, 0.4, 60], [0.4, -4.6, 340], [0, 0, 1.0]])
    card = geometry.detect_card(geometry.render_card((420, 600), h))
    at = np.array([300.0, 200.0])
    assert card and abs(geometry.local_scale(card["h"], at)[0] / geometry.local_scale(h, at)[0] - 1) < 0.01
    assert geometry.detect_card(np.full((200, 200, 3), 0.6)) is None


def test_hash_and_widths():
    gray, mask = synthetic.wall(3, 1, 128, 5.0)
    assert len(filters.phash64(gray)) == 16 and filters.phash64(gray) == filters.phash64(gray * 0.9)
    widths = [s[6] for s in profile.measure_widths(filters.flatten(gray, 20.0), mask)]
    assert len(widths) > 10 and abs(np.median(widths) - 5) < 1.5
    assert filters.detect_classic(gray).any()


@pytest.mark.parametrize("sigma", [1.0, 2.5])
def test_blur_keeps_constants(sigma):
    assert np.allclose(filters.blur(np.full((30, 40), 0.3), sigma), 0.3)


def test_retakes_of_a_wall():
    from muralis.kernels import retake

    gray, _ = synthetic.wall(3, 1, 128, 5.0)
    assert np.allclose(retake.moved(gray, 0.0, 1.0, (0, 0)), gray)
    assert np.allclose(retake.moved(gray, 0.0, 1.0, (5, -3))[:-3, 5:], gray[3:, :-5])
    turned = retake.moved(retake.moved(gray, 4.0, 1.05, (0, 0)), -4.0, 1 / 1.05, (0, 0))
    assert np.abs(turned - gray)[20:-20, 20:-20].mean() < 0.02
    assert retake.centre_crop(gray).shape == (110, 110)
    bits = lambda x: bin(int(filters.phash64(retake.centre_crop(x)), 16) ^ int(filters.phash64(retake.centre_crop(gray)), 16)).count("1")
    rng = np.random.default_rng(2)
    assert max(bits(retake.reshoot(gray, rng, geometric=False)) for _ in range(10)) <= 8
