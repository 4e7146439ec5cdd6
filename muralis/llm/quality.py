"""Operator 8 - quality rules with host-level verdicts, DataFrame functions only.

Each text is measured in its own row; nothing is exploded.  Then the failures of all documents of a host are
counted, each host's failure rate is shrunk towards a beta prior fitted to all hosts (method of moments), and hosts
whose shrunk rate passes ``host_limit`` lose all their documents.  The prior keeps a host with few documents from
being judged on them alone.

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated rows are measured and
counted again; ties don't arise; an empty table gives no rows; further columns stay or go by the caller's choice, but
a column with the name of a measure or verdict gives way to it.  Very long texts are sorted window by window inside
their row: n log n, no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.llm.common import let, stash

#: Fixed patterns of the contract.
SPACE, SYMBOL, WORD_CHAR = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]", r"[^\x20\x09-\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    return let(lines, lambda xs: F.size(xs) - F.size(F.array_distinct(xs)))


def _repeat_words(words: Column, n: int = 3) -> Column:
    """Words covered by an ``n``-word window whose words occur at least twice in the array.  Hashes of the windows are
    sorted with their positions; neighbours of one hash whose words agree too keep their positions, and the union of
    the positions' spans is measured in one pass."""
    hashes = F.when(F.size(words) > n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(n)]).alias("h"), i.alias("i"))))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + i + n - F.greatest(a["end"], i)).alias("n"), (i + n).alias("end")), lambda a: a["n"])

    def alike(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (F.slice(words, x["i"] + 1, n) == F.slice(words, y["i"] + 1, n))

    def repeated(s: Column) -> Column:
        marks = F.transform(s, lambda x, j: F.when(alike(x, F.get(s, j - 1)) | alike(x, F.get(s, j + 1)), x["i"]))
        return covered(F.sort_array(F.filter(marks, lambda i: i.isNotNull())))

    return F.coalesce(let(F.sort_array(hashes), repeated), F.lit(0))


def measures_of(text: Column) -> Column:
    """A struct of the measures of a text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _dup_lines(t).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))


def host_verdicts(measures: DataFrame, host: str, host_limit: float = 0.8, min_prior: float = 2.0) -> DataFrame:
    """``(host, n, failed, rate, rejected)`` of each host.  ``rate = (failed + a) / (n + a + b)``, where the prior's
    mean is the corpus rate and its weight ``a + b`` follows from the spread of the hosts' rates beyond binomial
    noise, at least ``min_prior`` documents."""
    per = measures.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    per = stash(per, "hosts")
    # one row: totals over the hosts
    t = per.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("s")).first()
    mean = (t.f or 0) / t.n if t.n else 0.0
    weight = 1e9  # no spread beyond noise: every host has the corpus rate
    if t.k and t.k > 1 and 0 < mean < 1:
        between = (t.s - t.n * mean * mean - (t.k - 1) * mean * (1 - mean)) / max(t.n - t.n2 / t.n - (t.k - 1), 1e-9)
        if between > 0:
            weight = max(min_prior, mean * (1 - mean) / between - 1)
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return per.withColumn("rate", rate).withColumn("rejected", F.col("rate") > host_limit)


def quality(docs: DataFrame, host: str = "source", keep_columns: list[str] | None = None, host_limit: float = 0.8) -> DataFrame:
    """Rows of ``docs(text, host)`` with their measures, ``base_failed`` and ``kept``; ``keep_columns`` (else
    ``doc_id``) come along."""
    own = {*MEASURES, "base_failed", "kept"}
    cols = [c for c in (["doc_id"] if keep_columns is None else keep_columns) if c.lower() not in own]
    rows = docs.select(F.struct(*cols).alias("row") if cols else F.lit(None).alias("row"), F.col(host).alias("host"), measures_of(F.col("text")).alias("m"))
    failed = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    rows = stash(rows.withColumn("base_failed", failed), "quality")
    bad = host_verdicts(rows, "host", host_limit).filter("rejected").select(F.col("host").alias("bad"), F.lit(True).alias("out"))
    met = rows.join(bad, rows["host"].eqNullSafe(bad["bad"]), "left")
    return met.select(*(["row.*"] if cols else []), "m.*", "base_failed", (~F.col("base_failed") & F.col("out").isNull()).alias("kept"))
