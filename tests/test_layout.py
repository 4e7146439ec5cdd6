"""Rows along a space-filling curve: equal rows for any box, and fewer files for smaller boxes."""

import random

from pyspark.sql import functions as F

from muralis.operators import layout


def test_boxes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice([37.5, 37.51, -90.0, 90.0, rng.uniform(-90, 90)]) if i % 3 else 37.5 + rng.random() / 50, rng.uniform(-180, 180) if i % 2 else 127 + rng.random() / 50) for i in range(4000)]
    rows += [(-1, None, 5.0), (-2, float("nan"), 5.0), (-3, 37.5, 127.0), (-4, 37.5, 127.0), (-5, 90.0, 180.0), (-6, -90.0, -180.0)]
    layout.write_clustered(spark.createDataFrame(rows, "id long, lat double, lon double"), str(tmp_path / "t"), files=32)
    opened = {}
    for box in [(37.5, 37.51, 127.0, 127.01), (37.5, 37.5, 127.0, 127.0), (-90, 90, -180, 180), (-10, 10, -10, 10), (80, 90, 170, 180), (5, 4, 0, 1), (37.50001, 37.50002, 127.001, 127.0011)]:
        got = sorted(r.id for r in layout.read_box(spark, str(tmp_path / "t"), *box).collect())
        assert got == sorted(i for i, a, b in rows if a is not None and box[0] <= a <= box[1] and box[2] <= b <= box[3]), box
        ranges = layout.box_ranges(*box)
        assert len(ranges) <= 64 and all(a <= b for a, b in ranges)
        opened[box] = len(layout.files_of_box(spark, str(tmp_path / "t"), ranges))
    assert opened[(-90, 90, -180, 180)] >= 30 and opened[(5, 4, 0, 1)] == 0
    assert opened[(37.50001, 37.50002, 127.001, 127.0011)] <= 3 and opened[(-10, 10, -10, 10)] <= 12


def test_key_is_the_interleaved_grid(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    for r in df.withColumn("z", layout.curve_key(F.col("lat"), F.col("lon"))).collect():
        y, x = int((r.lat + 90) / 180 * 2**layout.BITS), int((r.lon + 180) / 360 * 2**layout.BITS)
        assert r.z == sum((y >> k & 1) << (2 * k + 1) | (x >> k & 1) << (2 * k) for k in range(layout.BITS))
