"""CIEDE2000 against an implementation of its own with complex numbers, and against published differences."""

import cmath
import math
import random

import pytest
from pyspark.sql import functions as F

from muralis.functions import color

#: Published test pairs of the formula: L, a, b of both colours and their difference (fixed values).
PUBLISHED = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615), (50.0, 2.8361, -74.0200, 50.0, 0.0, -82.7485, 3.4412),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0), (50.0, -1.1848, -84.8006, 50.0, 0.0, -82.7485, 1.0), (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792), (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195), (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065), (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]


def difference(l1, a1, b1, l2, a2, b2):
    damp = lambda c: math.sqrt(c**7 / (c**7 + 25.0**7))
    stretch = 1 + (1 - damp((math.hypot(a1, b1) + math.hypot(a2, b2)) / 2)) / 2
    x, y = complex(stretch * a1, b1), complex(stretch * a2, b2)
    c, dl, dc = (abs(x) + abs(y)) / 2, l2 - l1, abs(y) - abs(x)
    grey = x == 0 or y == 0
    turn = 0.0 if grey else cmath.phase(y * x.conjugate())  # in (-pi, pi]
    h1, h2 = cmath.phase(x) % (2 * math.pi), cmath.phase(y) % (2 * math.pi)
    mean = h1 + h2 if grey else (h1 + h2) / 2 if abs(h1 - h2) <= math.pi else ((h1 + h2) / 2 + math.pi) % (2 * math.pi)
    waves = ((1, -30, -0.17), (2, 0, 0.24), (3, 6, 0.32), (4, -63, -0.20))
    t = 1 + sum(k * math.cos(n * mean + math.radians(shift)) for n, shift, k in waves)
    mid = ((l1 + l2) / 2 - 50) ** 2
    sl, sc, sh = 1 + 0.015 * mid / math.sqrt(20 + mid), 1 + 0.045 * c, 1 + 0.015 * c * t
    dh = 2 * math.sqrt(abs(x) * abs(y)) * math.sin(turn / 2)
    swing = -2 * damp(c) * math.sin(math.radians(60 * math.exp(-(((math.degrees(mean) - 275) / 25) ** 2))))
    return math.sqrt((dl / sl) ** 2 + (dc / sc) ** 2 + (dh / sh) ** 2 + swing * dc / sc * dh / sh)


def computed(spark, rows):
    names = ["l1", "a1", "b1", "l2", "a2", "b2"]
    df = spark.createDataFrame([(i, *map(float, r[:6])) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} double" for n in names))
    out = color.with_delta_e(df, tuple(F.col(n) for n in names[:3]), tuple(F.col(n) for n in names[3:]))
    return [r.delta_e for r in out.orderBy("i").collect()]


def test_published_pairs(spark):
    assert computed(spark, PUBLISHED) == pytest.approx([r[6] for r in PUBLISHED], abs=5e-5)


def test_random_pairs(spark):
    rng = random.Random(6)
    rows = [tuple(rng.uniform(0, 100) if k % 3 == 0 else rng.uniform(-90, 90) for k in range(6)) for _ in range(400)]
    rows += [(50, 0, 0, 60, 0, 0), (50, 0, 0, 50, 30, -20), (20, 5, 5, 20, 5, 5)]
    assert computed(spark, rows) == pytest.approx([difference(*r) for r in rows], abs=1e-8)
