"""Crack widths with intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from muralis.config import EXPERT, EXPERT_MM, FLOOR_PX, HOLD, MAX_SCALE_UNCERTAINTY, MEASURABLE_PX, OBSERVE, REPRESENTATIVE


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as a sum of two of 26 bits."""
    t = x * F.lit(134217729.0)
    high = t - (t - x)
    return high, x - high


def product_sum(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` with one rounding: the product's and the sum's own errors are added at the end."""
    (a1, a0), (b1, b0) = _halves(a), _halves(b)
    p, s = a * b, a * b + c
    lost = ((a1 * b1 - p) + a1 * b0 + a0 * b1) + a0 * b0
    rest = s - p
    return F.nanvl(s + (((p - (s - rest)) + (c - rest)) + lost), s)


def percentile_sorted(xs: Column, q: float) -> Column:
    """Linear percentile of a sorted array; null if empty.  Both neighbours are weighed and summed with one rounding, as
    DuckDB does, so that a comparison with a limit comes out alike."""
    at = F.greatest(F.size(xs) - 1, F.lit(0)) * F.lit(q)
    low = F.floor(at).cast("int")
    # one element, so that its fields are computed once
    ends = F.array(F.struct(F.get(xs, low).cast("double").alias("a"), F.get(xs, F.ceil(at).cast("int")).cast("double").alias("b"), (at - low).alias("w")))
    mixed = F.transform(ends, lambda e: F.when(e["w"] == 0, e["a"]).otherwise(product_sum(e["a"], 1 - e["w"], e["b"] * e["w"])))
    return F.when(F.size(xs) > 0, F.get(mixed, F.lit(0)))


def scale_from_card(corner_error: Column, anisotropy: Column) -> Column:
    """Relative uncertainty of the pixel scale."""
    return F.abs(corner_error) / 4 + F.abs(anisotropy) / 2


def summarize(samples: Column, px_per_mm: Column, rel: Column) -> Column:
    """Struct of representative and median width in mm, interval, whether below the measurable limit, and guidance.
    Widths are null where nothing can be said."""
    xs = F.sort_array(F.filter(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (x < float("inf")) & (x > 0)))
    rep, med = percentile_sorted(xs, REPRESENTATIVE), percentile_sorted(xs, 0.5)
    delta = F.greatest(F.lit(FLOOR_PX), (percentile_sorted(xs, 0.75) - percentile_sorted(xs, 0.25)) / 2)
    known = (F.size(xs) > 0) & px_per_mm.isNotNull()
    low = F.greatest(F.lit(0.0), (rep - delta) / (px_per_mm * (1 + rel)))
    high = (rep + delta) / (px_per_mm * F.greatest(F.lit(1e-6), 1 - rel))
    guidance = F.when(~known, HOLD).when(rel > MAX_SCALE_UNCERTAINTY, HOLD).when(high >= EXPERT_MM, EXPERT).otherwise(OBSERVE)
    return F.struct(
        F.when(known, rep / px_per_mm).alias("width_mm"), F.when(known, med / px_per_mm).alias("median_mm"), F.when(known, low).alias("ci_low"),
        F.when(known, high).alias("ci_high"), (known & (rep < MEASURABLE_PX)).alias("below_limit"), guidance.alias("guidance"))


def hybrid(fwhm: Column, area: Column, switch: float = 4.0) -> Column:
    """The area estimate for narrow cracks, else the full width at half depth."""
    return F.when(fwhm < switch, area).otherwise(fwhm)
