"""The service's endpoints as functions over tables; each returns DataFrames, none writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.operators import admin, sitelog, verify


def post_reports(incoming: DataFrame, stored: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Decisions on incoming reports, each ``client_uuid`` once, after all stored ones."""
    fresh = admin.idempotent(incoming, stored, "received_us")
    done = verify.evaluate(stored.unionByName(fresh.select(*stored.columns)), actions)
    return done.join(fresh.select("id"), "id", "left_semi")


def get_report(reports: DataFrame, report_id: int) -> DataFrame:
    """One row, or none."""
    return reports.filter(F.col("id") == report_id)


def list_sites(reports: DataFrame, sites: DataFrame, south: float = -90, north: float = 90, west: float = -180, east: float = 180) -> DataFrame:
    """Summaries of the sites in a viewport that have a visible report."""
    boxed = sites.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return boxed.join(sitelog.summary(sitelog.history(reports)), "site_id")


def get_site(reports: DataFrame, sites: DataFrame, site_id: int) -> tuple[DataFrame, DataFrame]:
    """Summary and history of a site."""
    own = sitelog.history(reports.filter(F.col("site_id") == site_id))
    return sites.filter(F.col("site_id") == site_id).join(sitelog.summary(own), "site_id"), own.orderBy("captured_us", "id")


def list_reports(reports: DataFrame, state: str | None = None, limit: int = 200) -> DataFrame:
    return sitelog.recent(reports, state, limit)


def act(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """Reports after valid review actions."""
    return admin.transition(reports, admin.valid_actions(actions))


merge_sites, stats = admin.merge_sites, admin.stats
