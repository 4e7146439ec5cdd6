"""Operator 9 - repeated passages by super-k-mer partitioning.

A window is ``k`` consecutive words; its minimiser is the least hash among its runs of ``m`` words.  Consecutive
windows with the same minimiser form a super-k-mer and travel together as one packed string, keyed by the
minimiser, so that equal windows meet in one bucket, where sorting counts them exactly (equal hashes are compared
byte by byte).

Steps, none of which collects documents:

1. minimisers are counted over the corpus; those seen once can't belong to a repeated window.  The others are marked
   in a bitmap of ``2**bits`` bits: its size is fixed, a false mark only costs traffic.  Minimisers seen ``hot``
   times or more are marked in a second one.
2. super-k-mers with a marked minimiser are packed.  Hot minimisers are split by a second minimiser, of another hash,
   so a passage in a third of all texts spreads over as many buckets as its surroundings vary, and its equal packed
   strings are combined before the shuffle.
3. buckets are sorted, windows counted, and packed strings with repeated windows report which words they cover.  The
   strings of a minimiser that alone has more than ``bucket_bytes`` are taken apart instead: each of their windows is
   a row, counted under its own 128-bit digest, so that no task holds such a bucket.
4. occurrences, keyed by a 128-bit digest of their string, join the verdicts (a skewed join that adaptive execution
   can split), and each document drops its covered words.

Defined cases: null and empty texts have no words and lose none; rows that repeat an id or a text count as separate
documents, so their windows are repeated; texts of fewer than ``k`` words keep all; periodic texts are handled as one
long super-k-mer; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.llm.common import blocks, row_key, small_batches, stash
from muralis.llm.wordarrays import Words, gather, mix, rolling

_U = np.uint64


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of ``x[i:i+w]`` for each i that has w values."""
    span, out = 1, x
    while 2 * span <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(out) - (w - span)], out[w - span :])
    return out


class SuperKmers:
    """Super-k-mers of a block: window starts ``a`` to ``b`` (with ``b``), minimiser, whether it stands at two
    places, and the text's number."""

    def __init__(self, words: Words, k: int, m: int, hot: Bitmap | None = None):
        self.words, w = words, k - m + 1
        self.a = self.b = self.doc = np.zeros(0, np.int64)
        self.mz = np.zeros(0, _U)
        self.twice = np.zeros(0, bool)
        at = words.run_starts(k)
        if not len(at):
            return
        i = np.arange(words.n - m + 1)
        grams = rolling(words.hash, i, i + m, 0xD1342543DE82EF95)
        mz = _sliding_min(grams, w)[at]
        doc = np.searchsorted(words.first, at, "right") - 1
        key = mz
        if hot is not None and (split := hot.has(mz)).any():
            j = np.arange(words.n - 2)
            other = mix(rolling(words.hash, j, j + 3, 0xD1342543DE82EF95) ^ _U(0x5851F42D4C957F2D))
            key = np.where(split, mix(mz ^ _sliding_min(other, k - 2)[at]), mz)
        new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        self.a, self.b, self.mz, self.key, self.doc = at[head], at[tail], mz[head], key[head], doc[head]
        column = np.arange(w)
        self.twice = np.zeros(len(head), bool)
        for c in range(0, len(head), 50_000):  # leftmost place in the first window, rightmost in the last
            s = slice(c, c + 50_000)
            left = self.a[s] + grams[self.a[s][:, None] + column].argmin(axis=1)
            right = self.b[s] + w - 1 - grams[self.b[s][:, None] + column[::-1]].argmin(axis=1)
            self.twice[s] = left != right


class Bitmap:
    """A set of 64-bit hashes, by their leading ``bits`` bits."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros((1 << bits) // 8, np.uint8) if data is None else data

    def has(self, x: np.ndarray) -> np.ndarray:
        at = x >> _U(64 - self.bits)
        return (self.data[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(keys: DataFrame, bits: int, parts: int = 64) -> Bitmap:
    """Each slice of the bitmap is made by one task; the driver joins the slices, whose total size is fixed."""
    slice_bits = bits - (parts - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(_U) >> _U(64 - bits)
            part = (at >> _U(slice_bits)).astype(int)
            for p in np.unique(part):
                own = (at[part == p] & _U((1 << slice_bits) - 1)).astype(np.int64)
                found.setdefault(int(p), np.zeros(1 << slice_bits, bool))[own] = True
        for p, marks in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["p", "d"])

    part = F.shiftrightunsigned("mz", 64 - (parts - 1).bit_length())
    out = Bitmap(bits)
    for p, d in keys.select("mz").repartition(parts, part).mapInArrow(run, "p int, d binary").toLocalIterator():
        out.data[p * (1 << slice_bits) // 8 : (p + 1) * (1 << slice_bits) // 8] |= np.frombuffer(d, np.uint8)
    return out


def _digests(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in packed.to_pylist()), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _hashes_tell_words(words: Words) -> bool:
    """Whether words of one hash are the same bytes, all through the block."""
    _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    alike = first[inverse]
    size = words.stop - words.start
    if not (size == size[alike]).all():
        return False
    return gather(words.comp, words.start, words.stop).equals(gather(words.comp, words.start[alike], words.stop[alike]))


def _count_windows(packed: list[bytes], n: list[int], k: int) -> list[tuple[int, list[int]]]:
    """For the distinct strings of a bucket, seen ``n`` times each: number and covered word ranges of those that
    hold a window seen twice or more."""
    words = Words(pa.array(packed, pa.large_binary()).cast(pa.large_string()))
    at, h = words.runs(k)
    owner = np.searchsorted(words.first, at, "right") - 1
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    group = np.append(0, np.cumsum(~same))
    pairs = np.flatnonzero(same)
    x, y = at[order[pairs]], at[order[pairs + 1]]
    equal = _hashes_tell_words(words)
    for j in range(k * equal):  # neighbours of one hash hold the same words
        if not (words.hash[x + j] == words.hash[y + j]).all():
            equal = False
            break
    weight = np.array(n, np.int64)[owner]
    count = np.bincount(group, weights=weight[order])[group]
    if not equal:  # different words or windows of one hash: count windows by their bytes
        exact: dict[bytes, int] = {}
        text = [words.comp[a:b].tobytes() for a, b in zip(words.start[at[order]], words.stop[at[order] + k - 1], strict=True)]
        for t, w in zip(text, weight[order], strict=True):
            exact[t] = exact.get(t, 0) + int(w)
        count = np.array([exact[t] for t in text], float)
    hit = np.zeros(len(at), bool)
    hit[order] = count >= 2
    out = []
    where = np.flatnonzero(hit)
    local = at[where] - words.first[owner[where]]
    cut = np.flatnonzero(np.append(True, (owner[where][1:] != owner[where][:-1]) | (local[1:] > local[:-1] + k)))
    for s, e in zip(cut, np.append(cut[1:], len(where)), strict=True):
        out.append((int(owner[where[s]]), [int(local[s]), int(local[e - 1]) + k]))
    merged: dict[int, list[int]] = {}
    for o, r in out:
        merged.setdefault(o, []).extend(r)
    return list(merged.items())


def repeated_spans(docs: DataFrame, k: int = 35, m: int = 8, bits: int = 27, hot: int = 2_000, bucket_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """The rows ``(doc_id, text, rk)`` of ``docs``, and ``(rk, spans)``: the word ranges that repeated windows cover in
    rows of that key, as starts and ends in turn."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key("doc_id", "text").alias("rk"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 0):
                s = SuperKmers(Words(block.column(0)), k, m)
                mz, inverse = np.unique(s.mz, return_inverse=True)
                n = np.bincount(inverse, weights=1 + s.twice, minlength=len(mz)).astype(np.int64) if len(mz) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mz.view(np.int64)), pa.array(n)], ["mz", "n"])

    counts = stash(rows.select("text").mapInArrow(count, "mz long, n long").groupBy("mz").agg(F.sum("n").alias("n")).filter("n > 1"), "minimisers")
    marked = spark.sparkContext.broadcast(_bitmap(counts, bits))
    split = spark.sparkContext.broadcast(_bitmap(counts.filter(F.col("n") >= hot), 22))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rk", "at", "key", "h1", "h2", "packed", "n", "size"]
        for batch in batches:
            for block in blocks(batch, 0):
                words = Words(block.column(0))
                s = SuperKmers(words, k, m, split.value)
                keep = marked.value.has(s.mz)
                if not keep.any():
                    continue
                a, b, key, doc = s.a[keep], s.b[keep], s.key[keep], s.doc[keep]
                packed = words.slices(a, b + k)
                h1, h2 = _digests(packed)
                # of equal strings in a block the first one travels, with their number
                _, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
                number = np.zeros(len(a), np.int64)
                number[first] = np.bincount(inverse)
                if (h2 != h2[first][inverse]).any():  # one half of the digest isn't enough: all travel
                    number[:] = 1
                sent = pa.array(number > 0)
                rk = block.column(1).to_numpy()[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rk), pa.array((a - words.first[doc]).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(h1), pa.array(h2),
                     pc.if_else(sent, packed, pa.scalar(None, pa.large_binary())).cast(pa.binary()), pa.array(number),
                     pc.binary_length(packed)], names)

    super_kmers = stash(rows.select("text", "rk").mapInArrow(pack, "rk long, at int, key long, h1 long, h2 long, packed binary, n long, size long"), "superkmers")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[bytes] = []
        digests: list[tuple[int, int]] = []
        n: list[int] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            found = _count_windows(packed, n, k) if packed else []
            return pa.RecordBatch.from_arrays([pa.array([digests[i][0] for i, _ in found], pa.int64()), pa.array([digests[i][1] for i, _ in found], pa.int64()), pa.array([r for _, r in found], pa.list_(pa.int32()))], ["h1", "h2", "spans"])

        for batch in batches:
            for key, h1, h2, p, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if digests and (h1, h2) == digests[-1] and key == last:
                    n[-1] += c
                    continue
                if size > bucket_bytes and key != last:
                    yield done()
                    packed, digests, n, size = [], [], [], 0
                packed.append(p)
                digests.append((h1, h2))
                n.append(c)
                size, last = size + len(p), key
        yield done()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 2):
                words = Words(block.column(2).cast(pa.large_binary()).cast(pa.large_string()))
                at = words.run_starts(k)
                owner = np.searchsorted(words.first, at, "right") - 1
                w1, w2 = _digests(words.slices(at, at + k))
                own = [block.column(i).to_numpy()[owner] for i in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own[:2], (at - words.first[owner]).astype(np.int32), w1, w2, own[2])], ["h1", "h2", "off", "w1", "w2", "n"])

    sent = super_kmers.filter("n > 0")
    large = stash(sent.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > bucket_bytes).select("key"), "large")
    found = None
    if not large.isEmpty():
        single = sent.join(large, "key", "left_semi").select("h1", "h2", "packed", "n")
        single = stash(single.mapInArrow(windows, "h1 long, h2 long, off int, w1 long, w2 long, n long"), "windows")
        twice = stash(single.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2"), "twice")
        starts = single.join(twice, ["w1", "w2"]).select("h1", "h2", "off").distinct().groupBy("h1", "h2").agg(F.sort_array(F.collect_list("off")).alias("o"))
        found = starts.select("h1", "h2", F.flatten(F.transform("o", lambda x: F.array(x, x + k))).alias("spans"))
        sent = sent.join(large, "key", "left_anti")
    dealt = sent.select("key", "h1", "h2", "packed", "n").repartition("key").sortWithinPartitions("key", "h1", "h2").mapInArrow(bucket, "h1 long, h2 long, spans array<int>")
    verdicts = stash(dealt if found is None else dealt.union(found), "verdicts")
    covered = super_kmers.select("rk", "at", "h1", "h2").distinct().join(verdicts, ["h1", "h2"]).select("rk", F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
    return rows, covered.groupBy("rk").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` for each row of ``docs(doc_id, text)``; ``options`` of
    ``repeated_spans``."""
    with small_batches(docs.sparkSession):
        rows, covered = repeated_spans(docs, **options)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if spans:
                    out = np.zeros(len(words) + 1, np.int64)
                    np.add.at(out, spans[0::2], 1)
                    np.add.at(out, spans[1::2], -1)
                    words = [w for w, c in zip(words, np.cumsum(out).tolist(), strict=False) if c == 0]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.join(covered, "rk", "left").select("doc_id", "text", "spans").mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept_text string")
