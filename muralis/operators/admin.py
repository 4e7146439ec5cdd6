"""Review: transitions, merges, statistics, ingest projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralis.config import TRANSITIONS
from muralis.operators.ordering import global_rank


def next_state(action: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TRANSITIONS.items() for x in kv]), action)


def valid_actions(actions: DataFrame) -> DataFrame:
    """Known actions with a reason of 2 to 500 characters."""
    return actions.filter(F.col("action").isin(*TRANSITIONS) & F.length("reason").between(2, 500))


def transition(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """``reports(id, state, site_id)`` after each report's last action, by ``(at_us, action_id)``; any state may
    change to any.  ``new_site`` marks reports whose last action made them visible without a site."""
    last = actions.groupBy(F.col("report_id").alias("id")).agg(F.max_by("action", F.struct("at_us", "action_id")).alias("last"))
    rows = reports.join(last, "id", "left").withColumn("state", F.coalesce(next_state(F.col("last")), "state"))
    new = F.col("last").isNotNull() & F.col("state").isin("accepted", "pending") & F.col("site_id").isNull()
    return rows.withColumn("new_site", new).drop("last")


def audit(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The action log with further entries; numbers continue from the log's last."""
    top = log.agg(F.coalesce(F.max("action_id"), F.lit(0)).alias("top")).first().top
    numbered = global_rank(entries, ["report_id"], "action_id", start=top + 1)
    return log.unionByName(numbered.select(*log.columns))


def merge_sites(reports: DataFrame, sites: DataFrame, keep: int, drop: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports, sites and audit entries after site ``drop`` went into ``keep``; ValueError if either is missing."""
    if keep == drop or sites.filter(F.col("site_id").isin(keep, drop)).count() != 2:
        raise ValueError("the sites to merge must be two that exist")
    moved = reports.filter(F.col("site_id") == drop).select(F.col("id").alias("report_id"), F.lit("merge_site").alias("action"), F.lit(f"지점 {drop} → {keep}").alias("reason"))
    after = reports.withColumn("site_id", F.when(F.col("site_id") == drop, F.lit(keep)).otherwise(F.col("site_id")))
    return after, sites.filter(F.col("site_id") != drop), moved


def stats(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """One row of review statistics, by one conditional aggregate over reports flagged as reviewed."""
    done = actions.select(F.col("report_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    c, low = F.col, (F.col("score") < 0.5) & F.col("duplicate_of").isNull()
    high = (c("score") >= 0.5) & c("duplicate_of").isNull()
    seen, bad = c("_seen").isNotNull(), c("state") == "rejected"
    share = lambda a, b: F.try_divide(F.count_if(a & b).cast("double"), F.count_if(b))
    n = F.greatest(F.count("*"), F.lit(1))
    return reports.join(done, "id", "left").agg(
        F.count("*").alias("total"), (F.count_if(low) / n).alias("auto_held_rate"), (F.count_if(c("duplicate_of").isNotNull()) / n).alias("duplicate_rate"), F.count_if(seen).alias("reviewed"),
        share(bad, seen).alias("false_report_rate"), share(bad, seen & low).alias("held_precision"), share(bad, seen & high).alias("pending_leak"))


def counts_map(df: DataFrame, key: str) -> DataFrame:
    """One row with a map from value to count; counted before it is gathered."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("counts"))


def new_sites(decisions: DataFrame) -> DataFrame:
    """Sites that pending reports without a site create, at their own place and time."""
    rows = decisions.filter(F.col("site_id").isNull() & (F.col("state") == "pending"))
    return rows.select(F.col("id").alias("created_by"), "lat", "lon", F.col("captured_us").alias("first_seen_us"), F.col("captured_us").alias("last_seen_us"), F.lit("open").alias("status"))


def idempotent(incoming: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Incoming rows whose ``client_uuid`` isn't stored, the first of each."""
    first = Window.partitionBy("client_uuid").orderBy(order)
    fresh = incoming.join(stored.select("client_uuid").hint("merge"), "client_uuid", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
