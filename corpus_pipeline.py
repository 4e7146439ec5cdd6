"""Five stages from raw documents to token records; each stage reads what its predecessor wrote.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``.  All but the last return the
columns of ``documents``.  Decisions come back to their rows by the row's key, a hash of id and text, so rows that
repeat an id are judged each on its own text.

Defined cases, for every stage: null and empty texts have no words, so quality rules reject them; null ids and sources are
values like others; very long texts are taken whole; of rows that share id and text one stays at near-duplicates, the
first by its other columns; an empty table passes through all stages; further columns of any name are carried along.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muralis.llm import decontam, minhash, mixing, quality, records
from muralis.llm.common import mark, release, release_since, row_key, stash, table
from muralis.llm.queries import vocabulary


_scratch = (0, 0)


def _stage(f):
    """The scratch tables of a stage go when the next one begins: by then its rows are written."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _scratch
        release_since(spark, *_scratch)
        start = mark()
        out = f(spark, docs, sf_dir)
        _scratch = (start, mark())
        return out

    return functools.wraps(f)(run_stage)


def _carried(docs: DataFrame) -> DataFrame:
    """The columns that stages judge, the row's key, and the whole row beside them, so that no name clashes."""
    return docs.select("doc_id", "text", "source", row_key("doc_id", "text").alias("key"), F.struct("*").alias("whole"))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rejected documents go."""
    return quality.quality(_carried(docs), keep_columns=["whole"]).filter("kept").select("whole.*")


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the document with the least id of each class stays; of rows that share id and text, the first by
    their other columns."""
    kept = minhash.near_duplicates(docs).filter("kept").select("rk").distinct()
    rest = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    rows = docs.select(row_key("doc_id", "text").alias("key"), rest.alias("rest"), F.struct("*").alias("whole")).join(kept, F.col("key") == F.col("rk"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("rest"))
    return rows.withColumn("nth", first).filter("nth = 1").select("whole.*")


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: contaminated documents go.  Their keys are written first; so Spark knows their size when it chooses
    between a broadcast and a shuffle of the texts."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), key=True)
    bad = stash(found.filter("contaminated").select("rk").distinct(), "contaminated")
    rows = _carried(docs)
    return rows.join(bad, rows["key"] == bad["rk"], "left_anti").select("whole.*")


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a document stands as many times as the mix takes it."""
    return mixing.resample(docs).select(*docs.columns)


@_stage
def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the documents as token records, read back from the files."""
    return records.token_records(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token records", token_records),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made, read = stage(spark, docs, sf_dir), docs
        docs = stash(made, name.replace(" ", "-"))
        release(read)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sampling, near-duplicate detection and tokens have no SQL; tests/llm/test_pipeline.py holds each stage's rows
#: against a plain Python version of it, and the mix against its totals.
ORACLE_SQL = None
