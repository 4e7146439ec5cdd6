"""Operator 13 - spelling variants by full neighbourhood generation.

1. Letter runs of at least ``min_length`` letters are counted by ``word_counts``: each task counts its block, so only
   distinct words of a block are shuffled.  Words that are common enough are the vocabulary.
2. Each word emits all strings that one deleted, replaced or inserted letter of the alphabet that the vocabulary uses
   makes of it, each string once: of a run of equal letters only the last is deleted, and a letter is inserted after,
   not before, equal ones.  A string's hash follows from the hashes of the word's two parts, so strings are only hashes
   until they are sent: those that no word of the vocabulary can equal, by a bitmap of the vocabulary's hashes, stay.
3. The others join the vocabulary as strings.  What the join finds is near by construction; nothing is verified.
4. A word's form is its near word of largest count, if that is ``ratio`` times its own.  Counts double at least from
   form to form, so chains have at most 63 links, and roots are found by pointer doubling in six rounds at most.

Scale: the bitmap has ``2**bits`` bits, 16 MB, at every size.  A false mark only costs a row of the join: with V words,
a share ``V / 2**bits`` of all strings.  Beyond some ten million words ``bits`` should grow; results don't depend on it.
No group is ever collected: the near words of one word are folded by an aggregate, and are no more than its strings.

Defined cases: null and empty texts have no words; a null id counts as an empty string in a row's checksum; very long
texts are taken whole; very long words are handled by their parts' hashes, in pieces of bounded size; rows that repeat
count again; ties in count go to the smallest word in code-point order; an empty table gives no rows; further columns
of any name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.llm.common import blocks, small_batches, stash, text_buffer
from muralis.llm.substring import Bitmap, _bitmap
from muralis.llm.wordarrays import mix

_U = np.uint64
_STEP = 0xD1342543DE82EF95  # odd
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # 0xC3 leads the letters U+00C0 to U+00FF in UTF-8
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ 0xEDB88320 * (_c & 1)
    _CRC[_i] = _c


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a block, starts and ends of its letter runs, and the number of each run's text."""
    closed = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    raw, at = text_buffer(closed)
    inside = _LETTER[raw]
    inside[1:] |= raw[:-1] == 0xC3
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(raw) else np.zeros(0, np.int64)
    if len(raw) and inside[0]:
        edge = np.append(0, edge)
    start, stop = edge[0::2], edge[1::2]
    return _LOWER[raw], start, stop, np.searchsorted(at, start, "right") - 1


def run_checksums(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of ``data[start:stop]``, each carried on from the crc32 ``seed`` of what stands before."""
    state = ~seed.astype(np.uint32)
    live = np.arange(len(start))
    j = 0
    while len(live):
        live = live[start[live] + j < stop[live]]
        s = state[live]
        state[live] = _CRC[(s ^ data[start[live] + j]) & 255] ^ (s >> 8)
        j += 1
    return ~state


def word_counts(docs: DataFrame, min_length: int = 5, typo: int | None = None) -> DataFrame:
    """``(word, n)`` of the maximal runs of letters ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, of ``min_length``
    letters or more.  With ``typo``, a run loses a letter where the crc32 ``h`` of ``<doc_id>:<run>`` is a multiple of
    it: the one at ``h`` modulo the run's length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1, 4 << 20):
                data, start, stop, doc = letter_runs(block.column(1))
                follow = np.append(0, np.cumsum(data & 0xC0 == 0x80))
                length = stop - start - (follow[stop] - follow[start])
                long = length >= min_length
                start, stop, doc, length = start[long], stop[long], doc[long], length[long]
                sizes = stop - start
                changed: list[bytes] = []
                if typo:
                    seed = np.array([zlib.crc32(b":", zlib.crc32(str("" if i is None else i).encode())) for i in block.column(0).to_pylist()], np.uint32)
                    h = run_checksums(data, start, stop, seed[doc])
                    hit = np.flatnonzero(h % typo == 0)
                    for i, k in zip(hit.tolist(), (h[hit] % length[hit]).tolist(), strict=True):
                        word = data[start[i] : stop[i]].tobytes().decode()
                        if len(word) > min_length:
                            changed.append((word[:k] + word[k + 1 :]).encode())
                    sizes = np.delete(sizes, hit)
                    start = np.delete(start, hit)
                offs = np.append(0, np.cumsum(sizes))
                kept = data[np.arange(offs[-1]) + np.repeat(start - offs[:-1], sizes)]
                words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(kept)])
                found = pc.value_counts(pa.concat_arrays([words, pa.array(changed, pa.large_binary())]))
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()).cast(pa.string()), found.field(1).cast(pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Neighbours:
    """Hashes of words and of the strings beside them.  A string's hash is ``sum(value(c_i) * STEP**i)`` scrambled, so
    it is the sum of two parts of a word's prefix sums, one of them shifted by a letter."""

    def __init__(self, alphabet: list[int]):
        self.alphabet = np.array(alphabet, np.uint32)
        self.value = np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | _U(1)
        self.power = np.ones(1, _U)

    def _powers(self, n: int) -> np.ndarray:
        while len(self.power) < n:
            self.power = np.append(self.power, self.power * _U(pow(_STEP, len(self.power), 1 << 64)))
        return self.power[:n]

    def sums(self, letters: np.ndarray) -> np.ndarray:
        """Prefix sums of words of one length, the rows of ``letters``; the last one is the whole word's."""
        terms = self.value[letters] * self._powers(letters.shape[1])
        return np.concatenate([np.zeros((len(letters), 1), _U), np.cumsum(terms, axis=1, dtype=_U)], axis=1)

    def hashes(self, letters: np.ndarray) -> np.ndarray:
        return mix(self.sums(letters)[:, -1])

    def strings(self, letters: np.ndarray, known: Bitmap, piece: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(number of the word, letters of the string)`` for the strings that may be in ``known``, by kind of edit
        and in pieces of some ``piece`` strings."""
        n, size = letters.shape
        sums, up = self.sums(letters), self._powers(size + 2)
        back = _U(pow(_STEP, -1, 1 << 64))
        rest = sums[:, -1:] - sums  # of the letters from each place on
        edge = np.zeros((n, 1), letters.dtype)

        after = np.concatenate([letters[:, 1:], edge], axis=1) != letters  # last of its run
        for places in np.array_split(np.arange(size), max(1, n * size // piece)):
            h = mix(sums[:, places] + rest[:, places + 1] * back)
            w, i = np.nonzero(known.has(h) & after[:, places])
            yield w, self._edited(letters, w, places[i], 1, None)

        none_before = np.concatenate([letters, edge], axis=1)
        cost = n * len(self.alphabet)
        for shift, stop in ((0, size), (1, size + 1)):  # replaced, then inserted
            tail = rest[:, 1:] if shift == 0 else rest * _U(_STEP)
            for places in np.array_split(np.arange(stop), max(1, -(-cost * stop // piece))):
                if not len(places):
                    continue
                base = sums[:, places] + tail[:, places]
                h = mix(base[:, :, None] + (self.value[self.alphabet][None, :] * up[places][:, None])[None])
                w, i, c = np.nonzero(known.has(h))
                other = self.alphabet[c]
                differs = none_before[w, places[i]] != other  # a replaced letter changes, an inserted one ends its run
                w, i, other = w[differs], places[i[differs]], other[differs]
                yield w, self._edited(letters, w, i, 1 - shift, other)

    def _edited(self, letters: np.ndarray, w: np.ndarray, at: np.ndarray, out: int, into: np.ndarray | None) -> np.ndarray:
        """The words ``w`` with ``out`` letters taken out and a letter ``into`` put in at ``at``."""
        size = letters.shape[1] - out + (into is not None)
        column = np.arange(size)[None]
        source = column + np.where(column < at[:, None], 0, out - (into is not None))
        made = letters[w[:, None], np.minimum(np.maximum(source, 0), letters.shape[1] - 1)]
        if into is not None:
            made[np.arange(len(w)), at] = into
        return made


def _letters(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and letters of the words of each length."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        for part in np.array_split(own, max(1, len(own) // 512)):
            yield part, np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), size)


def _texts(letters: np.ndarray) -> list[str]:
    whole, size = letters.astype("<u4").tobytes().decode("utf-32-le"), letters.shape[1]
    return [whole[i : i + size] for i in range(0, len(whole), size)] if size else [""] * len(letters)


def near_words(vocabulary: DataFrame, bits: int = 27) -> DataFrame:
    """``(word, n, near, near_n)`` for all pairs of words of ``vocabulary(word, n)`` that one edit parts, both ways.
    ``vocabulary`` must be written: it is read four times."""
    if not 9 <= bits <= 32:
        raise ValueError("the bitmap has 2**9 to 2**32 bits")
    spark = vocabulary.sparkSession
    alphabet = sorted(ord(r.c) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c != ''").distinct().collect())
    hood = Neighbours(alphabet)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in _letters(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(hood.hashes(letters).view(np.int64))], ["mz"])

    known = spark.sparkContext.broadcast(_bitmap(vocabulary.select("word").mapInArrow(keys, "mz long"), bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for places, letters in _letters(words):
                for w, made in hood.strings(letters, known.value):
                    if len(w):
                        own = pa.array(places[w])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(_texts(made), pa.string())], ["word", "n", "near"])

    spread = vocabulary.select("word", "n").repartition(F.col("word"))
    sent = spread.mapInArrow(emit, "word string, n long, near string")
    return sent.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``, whose chains have no cycle; a word without form is its own root.
    Each round doubles the links that a pointer spans."""
    at = stash(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = at.filter("root != word").select(F.col("word").alias("mid"), F.col("root").alias("next"))
        moved = at.join(ahead, at["root"] == ahead["mid"], "left")
        at = stash(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, typo: int | None = None, bits: int = 27) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for the words of ``docs(doc_id, text)`` of ``min_length`` letters and
    ``min_count`` occurrences or more."""
    with small_batches(docs.sparkSession, 32 << 20):
        vocabulary = stash(word_counts(docs, min_length, typo).filter(F.col("n") >= min_count), "vocabulary")
    found = near_words(vocabulary, bits).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    joined = vocabulary.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    forms = stash(joined, "forms")
    return forms.join(roots(forms), "word")
