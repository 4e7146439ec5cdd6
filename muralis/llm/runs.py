"""Operator 12 - periodic runs of words by the runs theorem.

A run is a stretch of words that repeats with a smallest period and that neither neighbour extends.  By the runs
theorem each run has, under one of the two orders of the alphabet (one the reverse of the other), a root that is the
longest Lyndon word at its place.  So, for the words of a block of texts, each text closed by a separator of its own:

1. words become symbols, and a suffix array is made by prefix doubling;
2. the longest Lyndon word at each place ends where the inverse suffix array has its next smaller value, or, under the
   reversed order, its next greater one: separators differ, so no suffix begins another, and one array serves both;
3. a root of ``p`` words at ``i`` reaches as far as the suffixes at ``i`` and ``i + p`` agree: the least value of the
   LCP array between their ranks, by a sparse table of range minima.  A run of ``min_exponent`` periods reaches more
   than ``min_exponent - 2`` periods beyond its first root, which few roots do;
4. the texts of those are reversed and arrayed anew, and the same queries give how far each root extends to the left.

Scale: a text is one row's work and never meets another one's, so nothing is shuffled.  Arrays take some
``8 * (log2(longest repeat) + 12)`` bytes for each word of a block; a block is 1 MB of text, or one longer text.

Defined cases: null and empty texts, and texts of white space, have no words, no run and an empty collapsed text; a
very long text is a block by itself and is taken whole; of runs that tie, the one with the smallest start, then the
smallest period is the greatest; repeated rows are judged each by itself; an empty table gives no rows; further columns
of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.llm.common import blocks, small_batches, text_buffer

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
RUN = "struct<start:long,length:long,period:long>"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, with one space after each, as bytes; the n+1 bounds of the words in them; the bounds of texts in
    words."""
    closed = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    raw, at = text_buffer(closed)
    solid = ~_SPACE[raw]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    data = np.where(solid[keep], raw[keep], np.uint8(32))
    bounds = np.append(0, np.flatnonzero(data == 32) + 1)
    return data, bounds, np.searchsorted(np.flatnonzero(keep & ~solid), at)


class SuffixArray:
    """Order, ranks and LCP array of the suffixes of ``symbols``, the last of which stands nowhere else."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        head = np.append(True, symbols[order][1:] != symbols[order][:-1])
        place = np.arange(n)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, place, 0))
        levels, size = [rank.copy()], 1
        lone = head & np.append(head[1:], True)
        open_ = order[~lone]
        while len(open_):  # the open suffixes of each group are sorted by what follows their first ``size`` symbols
            group = rank[open_].astype(np.int64)
            key = group * n + rank[open_ + size]
            by = np.argsort(key, kind="stable")
            open_, key, group = open_[by], key[by], group[by]
            first = np.append(True, group[1:] != group[:-1])
            i = place[: len(open_)]
            spot = group + i - np.maximum.accumulate(np.where(first, i, 0))
            head = np.append(True, key[1:] != key[:-1])
            rank[open_] = np.maximum.accumulate(np.where(head, spot, 0))
            levels.append(rank.copy())
            size *= 2
            open_ = open_[~(head & np.append(head[1:], True))]
        self.rank = rank
        self.order = np.empty(n, np.int32)
        self.order[rank] = place
        x, y = self.order[:-1].astype(np.int64), self.order[1:].astype(np.int64)
        lcp = np.zeros(n - 1, np.int32)
        live = np.flatnonzero(levels[0][x] == levels[0][y])
        x, y, own = x[live], y[live], np.zeros(len(live), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][x] == levels[k][y]
            step = same.astype(np.int32) << k
            own += step
            x += step
            y += step
        lcp[live] = own
        self.lcp = lcp  # of the suffixes of rank r and r + 1

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``i`` and ``j`` share, ``i != j``.  The sparse table's rows are made one
        after the other, and each answers the ranges of its width."""
        a, b = self.rank[i], self.rank[j]
        low, width = np.minimum(a, b), np.abs(a - b)
        level = np.frexp(width.astype(float))[1] - 1
        out = np.zeros(len(i), np.int32)
        row = self.lcp
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                half = 1 << (k - 1)
                row = np.minimum(row[:-half], row[half:])
            q = np.flatnonzero(level == k)
            out[q] = np.minimum(row[low[q]], row[low[q] + width[q] - (1 << k)])
        return out


def next_smaller(x: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Place of the next smaller value after each one, or of the next of ``stops``, which end with the last place."""
    x = x.copy()
    x[stops] = np.iinfo(x.dtype).min
    to = np.arange(1, len(x) + 1)
    to[stops] = stops
    live = np.arange(len(x))
    for _ in range(24):  # all values between i and to[i] are greater than x[i]; so a jump over them is safe
        live = live[x[to[live]] > x[live]]
        if len(live) < 500:
            break
        to[live] = to[to[live]]
    for i in live[::-1].tolist():  # the rest from the right: what is jumped over is final, and no other one jumps over it
        v, j = x[i], i + 1
        while x[j] > v:
            j = to[j]
        to[i] = j
    return to


def find_runs(symbols: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of ``min_length`` symbols and ``min_exponent >= 3`` periods in the texts
    ``symbols[first[d]:first[d+1]]``, by start, then period."""
    none = np.zeros(0, np.int64)
    ends = first[1:] + np.arange(len(first) - 1)
    n, d = len(symbols) + len(ends), len(ends)
    if not len(symbols):
        return none, none, none
    closed = np.empty(n, np.int64)
    inner = np.ones(n, bool)
    inner[ends] = False
    closed[ends] = np.arange(d)
    closed[inner] = symbols + d
    forward = SuffixArray(closed)
    at, period = [], []
    for ranks in (forward.rank, -forward.rank):
        root = next_smaller(ranks, ends) - np.arange(n)
        i = np.flatnonzero(inner)
        i = i[closed[i] == closed[i + root[i]]]
        at.append(i)
        period.append(root[i])
    at, period = np.concatenate(at), np.concatenate(period)
    right = forward.agree(at, at + period)
    far = right > (min_exponent - 2) * period  # the first root of a run leaves less than a period before it
    at, period, right = at[far], period[far], right[far].astype(np.int64)
    if not len(at):
        return none, none, none
    # texts with such roots, back to front
    owner = np.searchsorted(ends, at)
    held = np.unique(owner)
    begin, size = (first[:-1] + np.arange(d))[held], ends[held] - (first[:-1] + np.arange(d))[held]
    stop = np.cumsum(size + 1)
    back = np.repeat(begin + size - 1 + stop - size - 1, size + 1) - np.arange(stop[-1])  # place in ``closed`` of each place there
    shut = np.zeros(stop[-1], bool)
    shut[stop - 1] = True
    mirrored = np.where(shut, 0, closed[np.maximum(back, 0)])
    mirrored[stop - 1] = np.arange(len(held))
    left = np.zeros(len(at), np.int64)
    own = np.searchsorted(held, owner)
    mirror = lambda x: (begin + size - 1 + stop - size - 1)[own] - x
    inside = at > begin[own]
    left[inside] = SuffixArray(mirrored).agree(mirror(at - 1)[inside], mirror(at + period - 1)[inside])
    length = left + period + right
    start = at - left
    good = (length >= min_length) & (length >= min_exponent * period)
    found = np.unique(np.stack([start[good] - owner[good], period[good], length[good]]), axis=1)  # a separator less for each text before
    return found[0], found[2], found[1]


def _greatest(start: list[int], length: list[int], period: list[int]) -> int:
    """Number of the run of the greatest exponent; runs come by start, then period."""
    rough = [a / b for a, b in zip(length, period, strict=True)]
    close = [i for i, r in enumerate(rough) if r >= max(rough) * (1 - 1e-9)]
    return close[0] if len(close) == 1 else max(close, key=lambda i: (Fraction(length[i], period[i]), -i))


def periodic_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs`` its key, ``n_words``, all runs of at least ``min_length`` words and ``min_exponent``
    periods, the one of the ``greatest`` exponent (null if none) and the ``collapsed`` text: words that stand in any
    run after its first period are dropped, the others joined by one space."""
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods aren't looked for")
    kind = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                data, bounds, first = words_of(block.column(1))
                values = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
                symbols = values.dictionary_encode().indices.to_numpy() if len(values) else np.zeros(0, np.int32)
                start, length, period = find_runs(symbols, first, min_length, min_exponent)
                cover = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, start + length, -1)
                keep = np.cumsum(cover)[:-1] == 0
                sizes = np.where(keep, np.diff(bounds), 0)
                ends = np.append(0, np.cumsum(sizes))[first]
                left = data[np.repeat(keep, np.diff(bounds))]
                texts = [left[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                cut = np.searchsorted(start, first)
                start -= np.repeat(first[:-1], np.diff(cut))
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kind))
                best = []
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    best.append(a + _greatest(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()) if b > a else None)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), runs), runs.take(pa.array(best, pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())],
                    [key, "n_words", "runs", "greatest", "collapsed"])

    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    with small_batches(docs.sparkSession):
        return rows.mapInArrow(find, f"{key} long, n_words long, runs array<{RUN}>, greatest {RUN}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The report on ``periodic_runs``: counts, the greatest run, and digests of runs and of the collapsed text."""

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))

    best = F.col("greatest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; by a checksum of its id, a tenth of the documents goes on, from some word, as a
    repetition of the words that stand there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    n = F.size("words").cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("words", F.when(h % 10 == 0, words))
    a = F.col("a")
    p = 1 + F.floor((n - a) / (3 + g % 8))
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", p)
    word = lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % F.col("p")).cast("int"))
    return rows.select("doc_id", F.when(a.isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), word), " ")).alias("text"))
