"""Colour calibration from reference swatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis import config
from muralis.functions import color


def quality_of(residual: Column) -> Column:
    return F.when(residual <= config.QUALITY_GOOD, "good").when(residual <= config.QUALITY_FAIR, "fair").otherwise("poor")


def swatch_rows(spark) -> DataFrame:
    """``(swatch, tr, tg, tb, neutral, x_mm, y_mm)``: target colours in 0..1 and places on the card."""
    c, rows = config.CARD, []
    for i, (name, rgb) in enumerate(config.SWATCHES.items()):
        x, y = c["x0"] + i % c["cols"] * (c["swatch"] + c["gap"]), c["y0"] + (c["rows"] - 1 - i // c["cols"]) * (c["swatch"] + c["gap"])
        rows.append((name, *(v / 255 for v in rgb), name in config.NEUTRALS, float(x), float(y)))
    return spark.createDataFrame(rows, "swatch string, tr double, tg double, tb double, neutral boolean, x_mm double, y_mm double")


def fit(observed: DataFrame, by: list[str]) -> DataFrame:
    """Gain and offset of each channel by least squares over the neutral swatches of each group, with the residual
    colour difference and quality; groups with fewer than two neutral swatches give no row.
    ``observed(by..., swatch, neutral, r, g, b, tr, tg, tb)``."""
    lin = observed.filter("neutral").select(*by, *[color.to_linear(F.col(c)).alias(f"o{c}") for c in "rgb"], *[color.to_linear(F.col(f"t{c}")).alias(f"x{c}") for c in "rgb"])
    fits = lin.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.greatest(F.regr_slope(f"o{c}", f"x{c}"), F.lit(1e-4)).alias(f"gain_{c}") for c in "rgb"],
        *[F.regr_intercept(f"o{c}", f"x{c}").alias(f"offset_{c}") for c in "rgb"]).filter("n >= 2")
    # the sides are tiny per group and share its key
    each = lin.join(fits, by)
    names = [f"{n}{c}" for n in ("gain_", "offset_") for c in "rgb"]
    gain, offset = (tuple(F.col(c) for c in names[k : k + 3]) for k in (0, 3))
    back = lambda v: tuple((c - o) / g for c, g, o in zip(v, gain, offset, strict=True))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    each = color.steps(each, tuple(F.col(f"o{c}") for c in "rgb"), [back, color.each(clip), color.linear_to_xyz, color.xyz_to_lab], ("l1", "a1", "z1"))
    each = color.steps(each, tuple(F.col(f"x{c}") for c in "rgb"), [color.linear_to_xyz, color.xyz_to_lab], ("l2", "a2", "z2"))
    each = color.with_delta_e(each, (F.col("l1"), F.col("a1"), F.col("z1")), (F.col("l2"), F.col("a2"), F.col("z2")))
    residual = each.groupBy(*by).agg(F.avg("delta_e").alias("residual"))
    return fits.join(residual, by).withColumn("quality", quality_of(F.col("residual"))).drop("n")
