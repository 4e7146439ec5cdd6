"""Spatial and photo joins against all pairs in plain Python: crowds, poles, the date line, one photo everywhere."""

import math
import random

import pytest

from muralis.operators import pairs


def metres(p, q):
    a, b = math.radians(p[1]), math.radians(q[1])
    x = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(x))


def crowd(rng, n):
    """Positions around a few places, some of them at the date line and far north; and a dense one on a cell's corner."""
    places = [(37.5, 127.0), (-12.3, 179.9995), (-12.3, -179.9995), (70.0, 20.0), (0.0, 0.0), (37.5, 127.004)]
    out = []
    for i in range(1, n + 1):
        lat, lon = rng.choice(places)
        spread = rng.choice([1e-5, 1e-3, 4e-3])
        out.append((i, lat + rng.uniform(-spread, spread), (lon + rng.uniform(-spread, spread) + 180) % 360 - 180))
    return out


@pytest.mark.parametrize("dense", [1, 30, 10**9])
@pytest.mark.parametrize("within", [60.0, 500.0])
def test_box_join_of_any_density(spark, dense, within):
    rows = [r for r in crowd(random.Random(3), 320) if abs(r[2]) < 179]
    new = spark.createDataFrame(rows, "i long, lat double, lon double")
    old = new.toDF("j", "jlat", "jlon")
    got = sorted((r.i, r.j) for r in pairs.geo_pairs(new, old, metres=within, dense=dense).select("i", "j").collect())
    want = []
    for i, lat, lon in rows:
        dlat = within / 111320.0
        dlon = dlat / max(0.2, math.cos(math.radians(lat)))
        want += [(i, j) for j, a, b in rows if j < i and lat - dlat <= a <= lat + dlat and lon - dlon <= b <= lon + dlon]
    assert got == sorted(want) and len(want) > 1000


@pytest.mark.parametrize("photos", [1, 25])
def test_far_reuse_without_pairs(spark, photos):
    rng = random.Random(photos)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(photos)]
    prints += [p ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for p in prints]
    rows = [(*r, rng.choice(prints)) for r in crowd(rng, 400)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, fp long")
    want = {}
    for i, lat, lon, fp in rows:
        n = sum(1 for j, a, b, f in rows if j < i and ((f ^ fp) & (2**64 - 1)).bit_count() <= 8 and metres((i, lat, lon), (j, a, b)) > 200)
        if n:
            want[i] = n
    assert {r.i: r.n_far for r in pairs.reused_far(df).collect()} == want
    new = df.filter("id > 300")  # against stored ones
    assert {r.i: r.n_far for r in pairs.reused_far(new, known=df).collect()} == {i: n for i, n in want.items() if i > 300}


def test_earlier_counts_over_chunks(spark):
    rng = random.Random(5)
    new = [(i, rng.choice("ab")) for i in range(200)]
    old = [(j, rng.choice("xyz")) for j in range(200)]
    links = [("a", "x"), ("a", "y"), ("b", "z")]
    got = {r.i: r.n for r in pairs.earlier_counts(spark.createDataFrame(new, "i long, a string"), spark.createDataFrame(old, "j long, b string"), spark.createDataFrame(links, "a string, b string"), chunk=7).collect()}
    want = {i: sum(j < i and (a, b) in links for j, b in old) for i, a in new}
    assert got == {i: n for i, n in want.items() if n}
