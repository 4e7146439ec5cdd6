"""Exact quantiles, distance histograms and threshold sweeps whose memory doesn't grow with a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralis.scratch import written

#: Splitting points that a refinement takes from a sketch.
_STEPS = 256


def exact_quantiles(rows: DataFrame, by: list[str], value: str, q: float, limit: int = 100_000) -> DataFrame:
    """``(*by, n, quantile)``: linear interpolation between the two values around place ``q * (n - 1)``, as exact
    percentiles do, for groups of any size.

    Each group has a bracket of values that holds both.  While it holds more than ``limit`` rows, a sketch of the rows
    inside splits it into 256 parts of about equal size; the parts around the wanted place are the next bracket if exact
    counts confirm it, so that a bracket shrinks to some three parts in 256 a round.  What is left, at most ``limit`` rows
    of a group or one value, is sorted.  Nulls are ignored, and groups of nulls alone are left out; null keys are a group."""
    keys = [f"_k{i}" for i in range(len(by))]
    kept = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).filter("_v is not null")

    def matched(brackets: DataFrame) -> DataFrame:
        b = brackets.select(*[F.col(k).alias(f"b{k}") for k in keys], "lo", "hi", "below", "inside", "place")
        on = [F.col(k).eqNullSafe(F.col(f"b{k}")) for k in keys]
        return kept.join(b, on) if keys else kept.crossJoin(F.broadcast(b))  # one row

    def inside() -> Column:
        return (F.col("lo").isNull() | (F.col("_v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") <= F.col("hi")))

    n = kept.groupBy(*keys).agg(F.count("*").alias("n"))
    place = (F.lit(q) * (F.col("n") - 1)).alias("place")
    nothing = F.lit(None).cast("double")
    now = written(n.select(*keys, "n", place, nothing.alias("lo"), nothing.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).filter("n > 0"), "brackets")
    done = now.filter(F.col("inside") <= limit)
    wide = now.filter(F.col("inside") > limit)
    while not wide.isEmpty():
        sketch = F.percentile_approx("_v", [i / _STEPS for i in range(_STEPS + 1)], 10_000)
        points = matched(wide).filter(inside()).groupBy(*keys, "lo", "hi", "below", "inside", "place").agg(sketch.alias("s"))
        part = F.floor((F.col("place") - F.col("below")) / F.col("inside") * _STEPS).cast("int")
        ends = points.select(*keys, "place", "below", "inside", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), F.get("s", F.greatest(part - 1, F.lit(0))).alias("lo"), F.get("s", F.least(part + 2, F.lit(_STEPS))).alias("hi"))
        ends = written(ends, "points")
        counted = matched(ends).groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("lo")).alias("under"), F.count_if(F.col("_v") <= F.col("hi")).alias("upto"))
        both = ends.join(counted.select(*[F.col(k).alias(f"c{k}") for k in keys], "under", "upto"), [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in keys]) if keys else ends.crossJoin(F.broadcast(counted))
        both = both.join(wide.select(*[F.col(k).alias(f"n{k}") for k in keys], "n"), [F.col(k).eqNullSafe(F.col(f"n{k}")) for k in keys]) if keys else both.crossJoin(F.broadcast(wide.select("n")))
        left = F.col("under") <= F.floor("place")
        right = F.col("upto") > F.least(F.ceil("place"), F.col("n") - 1)
        below, upto = F.when(left, F.col("under")).otherwise(F.col("below")), F.when(right, F.col("upto")).otherwise(F.col("below") + F.col("inside"))
        new = both.select(*keys, "n", "place", F.when(left, F.col("lo")).otherwise(F.col("lo0")).alias("lo"), F.when(right, F.col("hi")).otherwise(F.col("hi0")).alias("hi"), below.alias("below"), (upto - below).alias("inside"), (F.col("lo").eqNullSafe(F.col("lo0")) & F.col("hi").eqNullSafe(F.col("hi0"))).alias("stuck"))
        now = written(new, "brackets")
        # a bracket of one value, or one that no sketch parts any more because its ends are all that it holds
        fine = (F.col("inside") <= limit) | (F.col("lo") == F.col("hi")) | F.col("stuck")
        done = done.unionByName(now.filter(fine).drop("stuck"))
        wide = now.filter(~fine).drop("stuck")
    single = F.col("lo").isNotNull() & (F.col("lo") == F.col("hi"))
    one = done.filter(single).select(*keys, "n", F.col("lo").alias("quantile"))
    # the rest by counts of distinct values, so that ties don't fill the buffer
    rest = matched(done.filter(~single)).filter(inside()).groupBy(*keys, "below", "place", "_v").agg(F.count("*").alias("m"))
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumn("last", F.col("below") + F.sum("m").over(order) - 1).withColumn("first", F.col("last") - F.col("m") + 1)
    at = lambda p: F.max(F.when((F.col("first") <= p) & (p <= F.col("last")), F.col("_v")))
    low, high = at(F.floor("place")), at(F.ceil("place"))
    picked = rest.groupBy(*keys, "place").agg(low.alias("a"), high.alias("b"))
    share = F.col("place") - F.floor("place")
    value_at = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share)
    sizes = done.select(*[F.col(k).alias(f"s{k}") for k in keys], "n")
    found = picked.select(*keys, value_at.alias("quantile"))
    found = found.join(sizes, [F.col(k).eqNullSafe(F.col(f"s{k}")) for k in keys]) if keys else found.crossJoin(F.broadcast(sizes))
    return one.unionByName(found.select(*one.columns)).select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", "quantile")


def distance_histogram(rows: DataFrame, by: str, fp: str, block: int = 2048) -> DataFrame:
    """``(by, distance, n)``: of all unordered pairs of a group's rows, how many differ in ``distance`` bits of the
    64-bit ``fp``.  No pair becomes a row: distinct fingerprints, with their numbers of rows, are dealt to blocks, and pairs
    of blocks are counted as arrays.  Rows without fingerprint are left out; distances that don't occur have no row."""
    distinct = rows.filter(F.col(fp).isNotNull()).groupBy(F.col(by).alias("g"), F.col(fp).alias("fp")).agg(F.count("*").alias("m"))
    sizes = distinct.groupBy(F.col("g").alias("sg")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = distinct.join(sizes, F.col("g").eqNullSafe(F.col("sg"))).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    held = written(dealt.groupBy("g", "b", "blocks").agg(F.collect_list(F.struct("fp", "m")).alias("rows")), "blocks")
    left = held.select("g", "b", F.col("rows").alias("x"), F.explode(F.sequence("b", F.col("blocks") - 1)).alias("c"))
    right = held.select(F.col("g").alias("h"), F.col("b").alias("c2"), F.col("rows").alias("y"))
    met = left.join(right, F.col("g").eqNullSafe(F.col("h")) & (F.col("c") == F.col("c2"))).select("g", "x", "y", (F.col("b") == F.col("c")).alias("own"))

    def arrays(x: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        return x.field("fp").to_numpy(zero_copy_only=False).view(np.uint64), x.field("m").to_numpy(zero_copy_only=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (a, m), (b, n) = (arrays(batch.column(c)[k].values) for c in (1, 2))
                own = batch.column(3)[k].as_py()
                found = np.zeros(65, np.int64)
                for i in range(0, len(a), 256):
                    bits = np.bitwise_count(a[i : i + 256, None] ^ b[None])
                    weight = m[i : i + 256, None] * n[None]
                    found += np.bincount(bits.ravel(), weights=weight.ravel(), minlength=65).astype(np.int64)
                if own:  # both orders of each pair, and each row with itself
                    found[0] -= m.sum()
                    found //= 2
                at = np.flatnonzero(found)
                g = batch.column(0).take(pa.array(np.full(len(at), k)))
                yield pa.RecordBatch.from_arrays([g, pa.array(at.astype(np.int32)), pa.array(found[at])], ["g", "distance", "n"])

    kind = rows.schema[by].dataType.simpleString()
    spread = met.repartition("g", F.xxhash64("x"), F.xxhash64("y"))
    return spread.mapInArrow(count, f"g {kind}, distance int, n long").groupBy(F.col("g").alias(by), "distance").agg(F.sum("n").alias("n"))


def shares_within(histogram: DataFrame, by: str, thresholds: list[int]) -> DataFrame:
    """``(by, threshold, share)`` of pairs at or below each threshold, from ``histogram(by, distance, n)``."""
    whole = F.sum("n")
    cells = [F.struct(F.lit(t).alias("threshold"), (F.sum(F.when(F.col("distance") <= t, F.col("n")).otherwise(0)) / whole).alias("share")) for t in thresholds]
    return histogram.groupBy(by).agg(F.array(*cells).alias("c")).select(by, F.inline("c"))


def histogram_quantiles(histogram: DataFrame, by: str, qs: dict[str, float]) -> DataFrame:
    """``(by, n, *names)``: linear quantiles of the distances that ``histogram(by, distance, n)`` counts."""
    order = Window.partitionBy(by).orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram.withColumn("last", F.sum("n").over(order) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    h = h.withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    out = []
    for name, q in qs.items():
        place = F.lit(q) * (F.col("total") - 1)
        at = lambda p: F.max(F.when((F.col("first") <= p) & (p <= F.col("last")), F.col("distance")))
        a, b, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((a + (b - a) * share).alias(name))
    return h.groupBy(by).agg(F.max("total").alias("n"), *out)


def threshold_sweep(rows: DataFrame, score: str, sums: list[str], thresholds: list[float]) -> DataFrame:
    """``(threshold, n, *sums)``: for each threshold, the number of rows with ``score >= threshold`` and the sums of
    their columns.  Each row goes to the highest threshold that it meets, which takes a search and no column a threshold;
    the sums of these classes, as many rows as thresholds, are then summed from the top."""
    ts = np.unique(np.array(thresholds, float))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(ts, x, "right") - 1
            at[np.isnan(x)] = -1
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns[1:]], ["c", *names])

    names = [f"s{i}" for i in range(len(sums))]
    cast = rows.select(F.col(score).cast("double"), *[F.col(c).cast("double").alias(n) for c, n in zip(sums, names, strict=True)])
    held = cast.mapInArrow(classes, ", ".join(["c int", *[f"{n} double" for n in names]])).filter("c >= 0").groupBy("c").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names])
    every = rows.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(ts)], "c int, threshold double")
    down = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)  # a row a threshold
    full = every.join(held, "c", "left")
    return full.select("threshold", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("n"), *[F.coalesce(F.sum(n).over(down), F.lit(0.0)).alias(c) for n, c in zip(names, sums, strict=True)])
