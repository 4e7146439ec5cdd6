"""Scoring of a labelled report stream.  Rows: ``(id, kind, wall, state, site_id, duplicate_of)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.operators.pairs import with_parent

LEGIT, BAD, DUPLICATES = ("first", "followup", "corroborate"), ("prank_junk", "prank_reused", "wrong_building", "flood"), ("first", "double_tap", "viral")
CONVINCING = "prank_convincing"


def main_sites(rows: DataFrame) -> DataFrame:
    """The most common site of each wall among legitimate rows; on a tie the one seen first."""
    seen = rows.filter(F.col("kind").isin(*LEGIT) & F.col("site_id").isNotNull()).groupBy("wall", "site_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return seen.groupBy("wall").agg(F.max_by("site_id", F.struct("n", -F.col("first"))).alias("main_site"))


def mixed_sites(rows: DataFrame) -> DataFrame:
    """Sites that hold legitimate rows of several walls."""
    legit = rows.filter(F.col("kind").isin(*LEGIT) & F.col("site_id").isNotNull())
    return legit.groupBy("site_id").agg(F.min("wall").alias("a"), F.max("wall").alias("b")).filter("a <> b").select("site_id")


def rates(rows: DataFrame) -> DataFrame:
    """One row: shares of bad rows held, and held or merged, of convincing pranks held, duplicates merged, legitimate
    rows held or merged wrongly, follow-ups linked to their wall's main site; and the number of mixed sites."""
    mixed = mixed_sites(rows).count()
    parent = rows.select(F.col("id").alias("pid"), F.col("wall").alias("pwall"), F.col("kind").alias("pkind"))
    x = with_parent(rows, parent).join(main_sites(rows), "wall", "left")
    kind, state = F.col("kind"), F.col("state")
    same = (F.col("pwall") == F.col("wall")) & F.col("pkind").isin(*DUPLICATES) & kind.isin(*DUPLICATES)
    caught = F.coalesce(same, F.lit(False)) & (state == "merged")
    legit, later = kind.isin(*LEGIT), kind.isin("followup", "corroborate") & (state == "pending")
    share = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b))
    return x.agg(
        share(kind.isin(*BAD) & (state == "held"), kind.isin(*BAD)).alias("bad_held"), share(kind.isin(*BAD) & state.isin("held", "merged"), kind.isin(*BAD)).alias("bad_filtered"),
        share((kind == CONVINCING) & (state == "held"), kind == CONVINCING).alias("convincing_held"), F.lit(mixed).cast("long").alias("mixed"), share(caught, kind.isin("double_tap", "viral")).alias("dup_merged"), share(legit & (state == "held"), legit).alias("wrongly_held"),
        share(legit & (state == "merged") & ~caught, legit).alias("wrongly_merged"), share(later & (F.col("site_id") == F.col("main_site")), later).alias("link_rate"))
