"""Quantiles, distance histograms and sweeps against plain numpy."""

import random

import numpy as np
import pytest

from muralis.operators import selection


@pytest.mark.parametrize("limit", [3, 40, 100_000])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_quantiles_of_groups(spark, limit, q):
    rng = random.Random(2)
    groups = {
        "ties": [5.0] * 300 + [7.0] * 200, "skewed": [10.0 ** rng.randint(-30, 30) for _ in range(400)], "one": [3.5], "few": [1.0, 2.0], None: [rng.random() for _ in range(257)],
        "two": [-1.0] * 150 + [1.0] * 150, "same": [0.0] * 200, "sorted": [float(i) for i in range(500)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("nulls", None), ("few", None)]
    rng.shuffle(rows)
    got = {r.g: (r.n, r.quantile) for r in selection.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", q, limit).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g][0] == len(xs) and got[g][1] == pytest.approx(np.quantile(xs, q), rel=1e-12)


def test_quantile_of_a_whole_table(spark):
    df = spark.range(10_000).selectExpr("cast(id * 7919 % 10007 as double) as v")
    row = selection.exact_quantiles(df, [], "v", 0.25, 50).first()
    assert row.n == 10_000 and row.quantile == pytest.approx(np.quantile([i * 7919 % 10007 for i in range(10_000)], 0.25))
    assert selection.exact_quantiles(df.limit(0), [], "v", 0.25).collect() == []


@pytest.mark.parametrize("block", [7, 2048])
def test_histogram_of_pairs(spark, block):
    rng = random.Random(3)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    rows = [(g, rng.choice(base) ^ rng.getrandbits(3)) for g in ("a", "b", None) for _ in range(90)] + [("alone", 5), ("a", None)]
    got = {(r.g, r.distance): r.n for r in selection.distance_histogram(spark.createDataFrame(rows, "g string, fp long"), "g", "fp", block).collect()}
    want = {}
    for g in ("a", "b", None):
        own = [f for k, f in rows if k == g and f is not None]
        for i in range(len(own)):
            for j in range(i):
                d = ((own[i] ^ own[j]) & (2**64 - 1)).bit_count()
                want[g, d] = want.get((g, d), 0) + 1
    assert got == want


def test_sweep_of_thresholds(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.1, 0.25, 0.5, rng.random()]), float(rng.randint(0, 5))) for _ in range(500)] + [(None, 9.0), (float("nan"), 9.0)]
    ts = [0.0, 0.1, 0.25, 0.5, 0.9, 2.0, *[i / 5000 for i in range(5000)]]
    got = {r.threshold: (r.n, r.hits) for r in selection.threshold_sweep(spark.createDataFrame(rows, "s double, hits double"), "s", ["hits"], ts).collect()}
    own = [r for r in rows if r[0] is not None and r[0] == r[0]]
    assert len(got) == len(set(ts))
    for t in rng.sample(ts, 200) + ts[:6]:
        met = [h for s, h in own if s >= t]
        assert got[t] == (len(met), sum(met))
