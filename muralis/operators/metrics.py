"""Evaluation: confusion counts, ratios, width errors, thresholds, grid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tol_p_hit", "tol_p_all", "tol_r_hit", "tol_r_all")


def width_bin(mm: Column) -> Column:
    """Left-open width classes up to 0.3, 1 and 99 mm."""
    return F.when((mm > 0) & (mm <= 0.3), "thin").when((mm > 0.3) & (mm <= 1), "medium").when((mm > 1) & (mm <= 99), "wide")


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the seven counts: a commutative monoid, so partial sums travel."""
    return rows.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(1.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def ratios(counts: DataFrame) -> DataFrame:
    """IoU, precision, recall and F1, plain and tolerant; an empty denominator gives 1, an empty F1 gives 0."""
    c = F.col
    out = counts.withColumns({
        "iou": _ratio(c("tp"), c("tp") + c("fp") + c("fn")), "precision": _ratio(c("tp"), c("tp") + c("fp")), "recall": _ratio(c("tp"), c("tp") + c("fn")),
        "tol_precision": _ratio(c("tol_p_hit"), c("tol_p_all")), "tol_recall": _ratio(c("tol_r_hit"), c("tol_r_all"))})
    return out.withColumns({"f1": _f1(c("precision"), c("recall")), "tol_f1": _f1(c("tol_precision"), c("tol_recall"))})


def error_stats(rows: DataFrame, by: list[str], truth: str, estimate: str) -> DataFrame:
    """MAE, bias, 90th percentile of the absolute error and relative MAE."""
    e = F.col(estimate) - F.col(truth)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.percentile(F.abs(e), 0.9).alias("p90"), F.avg(F.abs(e) / F.col(truth)).alias("relative"))


def threshold_curve(pairs: DataFrame, by: list[str], low: int = 4, high: int = 24, step: int = 2) -> DataFrame:
    """Share of each kind of pair at or below each threshold: one pass, a column for each threshold, then rows."""
    ts = list(range(low, high + 1, step))
    wide = pairs.groupBy(*by).agg(*[F.avg((F.col("distance") <= t).cast("double")).alias(f"t{t}") for t in ts])
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("share")) for t in ts])).alias("x")).select(*by, "x.*")


def histogram65(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Dense counts of distances 0 to 64."""
    counts = pairs.groupBy(*by, "distance").agg(F.count("*").alias("n"))
    found = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("distance").cast("int"), "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda k: F.struct(k.alias("distance"), F.coalesce(F.try_element_at("m", k), F.lit(0)).alias("n")))
    return found.select(*by, F.inline(dense))


def parameter_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """All combinations of a few parameter values: the values are the caller's literals, so the product is tiny."""
    frames = [spark.createDataFrame([(v,) for v in vs], [name]) for name, vs in values.items()]
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)
    return out.select(*[F.col(n).cast("int") if isinstance(values[n][0], int) else F.col(n) for n in values])


def grid_search(scores: DataFrame, limits: list[float]) -> DataFrame:
    """Of ``scores(config, f1, false_alarm)``, the best F1 within the first limit that any configuration meets."""
    met = scores.withColumn("limit", F.get(F.filter(F.array(*map(F.lit, limits)), lambda x: x >= F.col("false_alarm")), F.lit(0))).filter("limit is not null")
    best = met.groupBy("limit").agg(F.max_by(F.struct("config", "f1", "false_alarm"), F.struct("f1", -F.col("config"))).alias("b"))
    return best.orderBy("limit").limit(1).select("limit", "b.*")
