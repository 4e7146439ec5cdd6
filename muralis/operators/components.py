"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """``(v, label)`` for the nodes of ``edges(a, b)``; the label is the least node of the component.  Rounds grow
    with the logarithm of a component's width; each is written out, none comes to the driver."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = written(labels.join(near.hint("merge"), "v").select("v", "label", F.least("label", "near").alias("new")), "step")
        jump = step.select(F.col("v").alias("new"), F.col("new").alias("root"))
        after = written(step.join(jump.hint("merge"), "new").select("v", "label", "root"), "labels")
        labels = after.select("v", F.col("root").alias("label"))
        if after.filter("label != root").isEmpty():
            return labels


def duplicate_roots(rows: DataFrame) -> DataFrame:
    """``(id, root)``: the end of each chain of ``rows(id, parent)``, by pointer jumping; no parent ends a chain."""
    now = written(rows.select("id", F.coalesce("parent", "id").alias("root")), "chain")
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("upper"))
        after = written(now.join(up, "root", "left").select("id", "root", F.coalesce("upper", "root").alias("next")), "chain")
        now = after.select("id", F.col("next").alias("root"))
        if after.filter("root != next").isEmpty():
            return now
