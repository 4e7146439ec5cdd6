"""Operator 10 - mixing sources to target weights by balanced (cube-method) sampling.

A source's target is ``r`` times its size, ``0 <= r <= 2``.  Each of its documents is taken ``floor(r)`` times and
once more with probability ``r - floor(r)``.  Those extra copies are drawn by the cube method, balanced on two
totals within the source: tokens (``p_i * size_i``) and documents (``p_i``).  The flight phase moves the vector of
probabilities along the null space of the two constraints: the longest open document moves, and all shorter ones
move against it, until every document but two of a block is settled.  These leftovers of all blocks fly together in
the next level, and so on, until one block of the source is left.  Documents too long for the others to even out in
number as well are settled before, by tokens alone.  As the longest settle first, the last leftovers are short ones.
They are the landing problem: the constraint on documents is dropped, one of the two settles against the other
by its tokens, and the last one is drawn.  Probabilities are kept throughout, with one exception: where one document is
so large a part of its source that a draw could miss the target (by more than ``near`` of it, at the landing), the
outcome nearer to the target is taken.

Scale: a source is dealt into blocks of at most ``block`` documents by a hash of the row, so a source with a third
of all rows is only more blocks; a level shrinks the rows by ``block / 2``.  Only ids and sizes travel, never texts.
Sources are numbered and their targets found by Spark; only sums over all sources come to the driver.  Draws are
seeded by level, source and block, and rows are ordered by size and a hash of the whole row first: reruns agree.

Defined cases: a null text and one without words have size 0 and take 0; a null source is a source of its own, the
last one; documents that repeat an id are drawn as separate rows; equal rows are told apart by their rank; an empty
table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralis.llm.common import row_key, stash
from muralis.operators.ordering import global_rank

#: A word of a text (fixed pattern).
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: Iterable[float], share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources(source, source_size, n)`` with ``sid``, its number in code point order, null last, and ``target``:
    ``share`` times all sizes by weight; what a target holds above ``cap`` times its source's size is shared again,
    by weight, among the sources still below, until none is above.  A round is one row of sums."""
    cycle = [float(w) for w in weights]
    ranked = global_rank(sources.withColumn("last", F.col("source").isNull()), ["last", "source"], "sid", start=0).drop("last")
    ranked = stash(ranked.withColumn("w", F.element_at(F.array(*map(F.lit, cycle)), (F.col("sid") % len(cycle) + 1).cast("int"))), "sources")
    size = F.col("source_size")
    total = share * (ranked.agg(F.sum(size).alias("t")).first().t or 0)
    level = 0.0  # of a source below its cap, target / weight
    while total:
        full = (size > 0) & (level * F.col("w") > cap * size)
        r = ranked.agg(F.sum(F.when(full, cap * size)).alias("held"), F.sum(F.when((size > 0) & ~full, F.col("w"))).alias("open")).first()
        risen = (total - (r.held or 0.0)) / r.open if r.open else level
        if risen <= level:
            break
        level = risen
    return ranked.withColumn("target", F.when(size > 0, F.least(level * F.col("w"), cap * size)).otherwise(0.0)).drop("w")


def _step(p: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random move of ``p`` along ``u``, to where an entry reaches 0 or 1; its expectation is ``p``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
        down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
    p = np.clip(p + (up if rng.random() * (up + down) < down else -down) * u, 0.0, 1.0)
    p[p < 1e-9] = 0.0
    p[p > 1 - 1e-9] = 1.0
    return p


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight of probabilities ``p`` balanced on ``sum(p)`` and ``sum(p * size)``; ``size`` descends.  At most two
    entries of the result are fractional."""
    p = p.astype(float).copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    q, s = p[at], size[at] / max(1.0, float(size.max(initial=1)))
    while len(q) > 2:
        rest = s[1:]
        off = rest - rest.mean()
        spread = float(off @ off)
        u = np.zeros(len(q))
        if spread > 1e-18:  # the first one up by 1; the others down by 1 in all, and by its tokens in all
            u[0] = 1.0
            u[1:] = -(1 / len(rest) + (s[0] - rest.mean()) * off / spread)
        elif abs(s[0] - rest[0]) < 1e-12:
            u[0], u[1:] = 1.0, -1 / len(rest)
        else:  # the others are of one size, which can't even out the first: they move among themselves
            u[1], u[2:] = 1.0, -1 / (len(rest) - 1)
        q = _step(q, u, rng)
        done = (q <= 0) | (q >= 1)
        if not done.any():  # rounding left the last move short of its end
            k = int(np.argmin(np.minimum(q, 1 - q)))
            q[k], done[k] = np.round(q[k]), True
        p[at[done]] = q[done]
        at, q, s = at[~done], q[~done], s[~done]
    p[at] = q
    return p


def outliers(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, many: int = 12) -> np.ndarray:
    """Settle the documents longer than a share of 1 in ``many`` of all shorter open ones, longest first, each by a
    draw; the shorter ones, all of one probability, change alike so that tokens stay, as they're too few to keep
    their number as well.  Where they have room for one outcome only, or none, the outcome that keeps tokens best is
    taken instead of a draw.  ``size`` descends."""
    p = p.astype(float).copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    while len(at) > 2 and many * size[at[0]] > size[at[1:]].sum():
        k, rest = at[0], at[1:]
        gives, takes = (1 - p[k]) * size[k], p[k] * size[k]  # what the rest must lose if k is taken, gain if not
        can_lose, can_gain = p[rest] @ size[rest], (1 - p[rest]) @ size[rest]
        if gives <= can_lose and takes <= can_gain:
            taken = rng.random() < p[k]
        else:
            taken = gives - can_lose < takes - can_gain
        p[k] = float(taken)
        p[rest] = p[rest] * max(0.0, 1 - gives / can_lose) if taken else 1 - (1 - p[rest]) * max(0.0, 1 - takes / can_gain)
        at = rest[(p[rest] > 1e-9) & (p[rest] < 1 - 1e-9)]
    p[p <= 1e-9], p[p >= 1 - 1e-9] = 0.0, 1.0
    return p


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, longest: float = np.inf) -> np.ndarray:
    """Settle the last fractional entries: pairs by their tokens alone, then the one that is left by a draw, or by
    the nearer outcome if it's longer than ``longest``."""
    p = p.copy()
    while len(at := np.flatnonzero((p > 0) & (p < 1))):
        if len(at) == 1:
            p[at] = np.round(p[at]) if size[at[0]] > longest else float(rng.random() < p[at[0]])
            break
        a, b = at[:2]
        p[[a, b]] = _step(p[[a, b]], np.array([size[b], -size[a]]) / max(size[a], size[b]), rng)
    return p


def _fly(seed: int, level: int, near: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "salt"], ascending=[False, True, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, level, int(pdf["sid"].iloc[0]), int(pdf["block"].iloc[0])])
        size = pdf["size"].to_numpy(float)
        p = pdf["p"].to_numpy(float)
        p = flight(outliers(p, size, rng) if level == 0 else p, size, rng)
        if int(pdf["blocks"].iloc[0]) == 1:
            p = landing(p, size, rng, near * float(pdf["target"].iloc[0]))
        return pdf.assign(p=p).drop(columns="block")

    return run


def resample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it; rows without words go.  Equal rows share
    their copies."""
    taken = mix(docs, key=True, **options).filter("size > 0 and taken > 0").groupBy("rk").agg(F.sum(F.expr("taken div size")).alias("copies"), F.count("*").alias("alike"))
    rows = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text", "source").alias("key"), F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))).alias("rest"))
    rows = rows.join(taken, F.col("key") == F.col("rk"))
    # equal rows stand alike: the first copies // rows of each, and what is left by their order
    nth = F.when(F.col("alike") > 1, F.row_number().over(Window.partitionBy("key").orderBy("rest")) - 1).otherwise(F.lit(0))
    rows = rows.withColumn("times", F.expr("copies div alike") + (nth < F.col("copies") % F.col("alike")).cast("long"))
    return rows.filter("times > 0").select("row", F.explode(F.expr("sequence(1, cast(times as int))"))).select("row.*")


def mix(docs: DataFrame, weights: Iterable[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, block: int = 4096, near: float = 0.005, seed: int = 20, key: bool = False) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs(doc_id, text, source)``; weights
    repeat over the sources in code point order, null last.  ``key`` adds the row's key, ``rk``."""
    sized = stash(
        docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), row_key("doc_id", "text", "source").alias("rk"), word_count(F.col("text").cast("string")).alias("size"))
        .withColumns({"h": F.xxhash64(F.lit(seed), "rk"), "place": F.monotonically_increasing_id()}), "mix")
    # equal rows can't part by their hash: those that would fill a block part by their place in the table
    many = sized.groupBy(F.col("rk").alias("mk")).agg(F.count("*").alias("alike")).filter(F.col("alike") > block // 8).select("mk")
    sized = sized.join(many, F.col("rk") == F.col("mk"), "left").withColumn("salt", F.when(F.col("mk").isNotNull(), F.col("place")).otherwise(0)).drop("mk", "place")
    sources = stash(with_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, cap), "targets")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = sources.select("sid", F.col("source").alias("of"), "source_size", "target", F.floor(ratio).cast("long").alias("copies"), (ratio - F.floor(ratio)).alias("p"), F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["of"])).select("doc_id", "rk", "size", "h", "salt", "sid", "source_size", "target", "copies", "p", "blocks")
    schema = "doc_id long, rk long, size long, h long, salt long, sid long, source_size long, target double, copies long, p double, blocks long"
    certain, level = (F.col("p") == 0) | (F.col("size") == 0), 0
    done = [rows.filter(certain).withColumn("p", F.lit(0.0))]
    rows = rows.filter(~certain)
    most = plan.agg(F.max("blocks").alias("b")).first().b or 0
    while most:
        spread = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("h", "salt", F.lit(level)), F.col("blocks"))).otherwise(F.lit(0))
        flown = stash(rows.withColumn("block", spread).groupBy("sid", "block").applyInPandas(_fly(seed, level, near), schema), f"flight{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.filter(~open_))
        if most == 1:
            break
        # hashing spreads a source unevenly over its blocks, but each block leaves two rows at most
        most = -(-2 * most // block)
        rows = flown.filter(open_).withColumn("blocks", F.ceil(2 * F.col("blocks") / F.lit(block)))
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*["rk"] * key, "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("p").cast("long"))).alias("taken"))
