"""Sites: history, trend, guidance; rows of the admin list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.config import EXPERT, EXPERT_MM, HOLD, OBSERVE, VISIBLE


def finite_top(xs: Column, k: int) -> Column:
    """Finite values, the first ``k``."""
    return F.slice(F.filter(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), 1, k)


def orientation(dx: Column, dy: Column) -> Column:
    """Direction of a segment in degrees, 0 up to 180."""
    return (F.degrees(F.atan2(dy, dx)) + 180) % 180


def admin_rows(reports: DataFrame) -> DataFrame:
    at = F.date_format(F.timestamp_micros("captured_us"), "yyyy-MM-dd'T'HH:mm:ss")
    return reports.select("id", "state", "score", F.substring("device", 1, 8).alias("device"), at.alias("captured_at"))


def recent(reports: DataFrame, state: str | None = None, limit: int = 200) -> DataFrame:
    """The latest reports, 1000 at most (a top-k report)."""
    rows = reports if state is None else reports.filter(F.col("state") == state)
    return admin_rows(rows.orderBy(F.desc("received_us"), F.desc("id")).limit(min(limit, 1000)))


def widest(observations: DataFrame) -> DataFrame:
    """The widest observation of each report, the first one on a tie: ``(report_id, width, ci_low, ci_high)``."""
    best = F.max_by(F.struct("width", "ci_low", "ci_high"), F.struct("width", -F.col("obs_id")))
    return observations.groupBy("report_id").agg(best.alias("o")).select("report_id", "o.*")


def observations(reports: DataFrame) -> DataFrame:
    """A row for each crack of ``reports(id, width, ci_low, ci_high)``."""
    crack = F.struct(F.col("width"), F.col("ci_low"), F.col("ci_high"))
    cracks = F.when(F.col("width").isNotNull(), F.array(crack, F.struct((F.col("width") / 2).alias("width"), (F.col("ci_low") / 2).alias("ci_low"), (F.col("ci_high") / 2).alias("ci_high"))))
    rows = reports.select(F.col("id").alias("report_id"), F.posexplode(cracks).alias("pos", "c"))
    return rows.select("report_id", (F.col("report_id") * 16 + F.col("pos")).alias("obs_id"), "c.*")


def history(reports: DataFrame) -> DataFrame:
    """Visible reports of sites with their widest observation; order them by ``(site_id, captured_us, id)``."""
    rows = reports.filter(F.col("state").isin(*VISIBLE) & F.col("site_id").isNotNull())
    best = widest(observations(rows)).withColumnRenamed("report_id", "id")
    return rows.select("site_id", "id", "captured_us", "state").join(best, "id", "left")


def summary(hist: DataFrame) -> DataFrame:
    """One row a site: number of reports, latest width, trend with its days, guidance.  One shuffle by site."""
    measured, at = F.col("width").isNotNull(), F.struct("captured_us", "id")
    point = F.struct("captured_us", "width", "ci_low", "ci_high")
    g = hist.groupBy("site_id").agg(
        F.count("*").alias("report_count"), F.count_if(measured).alias("n"),
        F.min_by(F.when(measured, point), F.when(measured, at)).alias("first"), F.max_by(F.when(measured, point), F.when(measured, at)).alias("last"))
    days = F.greatest(F.lit(1), F.floor((F.col("last.captured_us") - F.col("first.captured_us")) / F.lit(86_400_000_000)))
    trend = F.when(F.col("n") < 2, "unknown").when(F.col("last.ci_low") > F.col("first.ci_high"), "widening").otherwise("stable")
    g = g.withColumn("trend", trend).withColumn("days", F.when(F.col("n") >= 2, days))
    guidance = F.when(F.col("n") == 0, HOLD).when((F.col("trend") == "widening") | (F.col("last.ci_high") >= EXPERT_MM), EXPERT).otherwise(OBSERVE)
    text = F.when(F.col("n") < 2, "비교할 이전 기록이 없습니다").when(
        F.col("trend") == "widening", F.concat(F.col("days").cast("string"), F.lit("일 사이 "), F.expr("format_number(first.width, '0.00')"), F.lit(" → "), F.expr("format_number(last.width, '0.00')"), F.lit("mm. 오차 범위가 겹치지 않을 만큼 넓어졌습니다"))
    ).otherwise(F.concat(F.col("days").cast("string"), F.lit("일 사이 오차 범위 안에서 변화가 없습니다")))
    return g.select("site_id", "report_count", F.col("last.width").alias("latest_width"), "trend", "days", guidance.alias("guidance"), text.alias("trend_detail"), F.col("first.width").alias("first_width"), F.col("first.ci_high").alias("first_high"), F.col("last.ci_low").alias("last_low"))
