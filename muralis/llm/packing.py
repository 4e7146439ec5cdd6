"""Operator 11 - packing documents into fixed-length sequences by sums of squares.

Texts become token ids, an end id after each; a document longer than a sequence is cut, and its full pieces are
sequences by themselves.  Every other piece is placed, one after the other, where the sum over all residual gaps of
the squared number of open bins with that gap becomes smallest, a new bin being one of the choices; of equal choices
the smallest gap is taken, the new bin last.

Scale: pieces are dealt to blocks of about ``block`` pieces by a hash, so a source, a length or a text that holds a
third of all rows is spread over all blocks; each block is packed by one task, which holds lengths, not texts.  What
blocks leave open travels on: bins whose gap is at least ``slack`` tokens are dissolved, and their pieces are packed
again in the next level, among those of all blocks.  Only ill-filled bins go on, so levels shrink, until one block
is left or a level leaves more than half of its pieces ill-filled again.  Ids never travel: a piece is known by its
document, place and length.

Reruns over the same files agree: blocks and the order in them come from a hash of the piece, and of the place of its
row in the table, by which equal rows part.

Defined cases: a null or empty text is the end id alone, one piece of one token; a null id is kept, and is an id of
its own; a very long text is cut; repeated rows are placed each by itself; a special string inside a text counts as the
library counts it; an empty table gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.llm.bpe_encode import Encoder, _Memo, byte_alphabet
from muralis.llm.common import blocks, small_batches, stash, text_buffer

_SPACE, _LETTER, _DIGIT, _OTHER, _FOREIGN = range(5)
#: Classes of ASCII bytes; 0xC3 leads the letters U+00C0 to U+00FF.
_KIND = np.full(256, _FOREIGN, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAILS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]  # after an apostrophe (fixed values)


class WordEncoder(Encoder):
    """Ids of a vocabulary with word ends, which drops white space and takes letters in lower case.

    Texts of Latin letters and ASCII are cut into pre-tokens as one array of bytes; each distinct pre-token is encoded
    once by the library's model.  Other texts, and those that hold a special string, are encoded by the library, word
    by word, each distinct one once."""

    def __init__(self, path: str, room: int = 224 << 20):
        super().__init__(path, room)
        model, stand_in = self.tokenizer.model, dict(enumerate(byte_alphabet()))
        packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]

        def by_model(token: bytes) -> bytes:
            return b"".join([packed[t.id] for t in model.tokenize(token.decode("latin-1").translate(stand_in))])

        self.tokens = _Memo(by_model, room * 3 // 4)
        self.words = _Memo(self.whole, room // 4)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n+1 bounds of texts in them; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        foreign = np.zeros(len(texts), bool)
        for special in self.specials:
            foreign |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        raw, at = text_buffer(pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())))
        kind = _KIND[raw]
        lead = np.flatnonzero(raw == 0xC3)
        second = raw[lead + 1]
        kind[lead] = kind[lead + 1] = np.where((second == 0x97) | (second == 0xB7), np.uint8(_OTHER), np.uint8(_LETTER))  # the signs U+00D7, U+00F7
        low = _LOWER[raw]
        low[lead + 1] = np.where((second < 0x9F) & (second != 0x97), second + np.uint8(32), second)
        strange = np.flatnonzero(kind == _FOREIGN)
        foreign[np.searchsorted(at, strange, "right") - 1] = True
        kind[np.repeat(foreign, np.diff(at))] = _SPACE

        solid = kind != _SPACE
        head = solid & (np.append(np.uint8(_SPACE), kind[:-1]) != kind) | (kind == _DIGIT)
        lone = np.flatnonzero(head & (low == 39) & (np.append(kind[1:], np.uint8(_SPACE)) == _LETTER))
        if len(lone):  # an apostrophe alone before letters takes some of them with it
            left = np.ones(len(lone), bool)
            padded = np.append(low, np.zeros(3, np.uint8))
            for tail in _TAILS:
                hit = left & np.logical_and.reduce([padded[lone + 1 + i] == c for i, c in enumerate(tail)])
                left &= ~hit
                after = lone[hit] + 1 + len(tail)
                head[lone[hit] + 1] = False
                head[after] |= kind[after] == _LETTER
        data, starts = low[solid], np.flatnonzero(head[solid])
        bounds = np.append(starts, len(data)).astype(np.int64)
        made = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        ids = [self.tokens[t] for t in made.dictionary.to_pylist()]
        code = made.indices.to_numpy()
        width = self.dtype.itemsize
        size = np.array([len(x) // width for x in ids], np.int64)
        begin = np.append(0, np.cumsum(size))[:-1]
        flat = np.frombuffer(b"".join(ids), self.dtype)
        n = size[code]
        ends = np.append(0, np.cumsum(n))
        out = flat[np.arange(ends[-1]) + np.repeat(begin[code] - ends[:-1], n)]
        place = ends[np.searchsorted(np.flatnonzero(head), at)]
        if not foreign.any():
            return out, place
        parts = [out[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
        for i in np.flatnonzero(foreign).tolist():
            parts[i] = np.frombuffer(self.encode(texts[i].as_py()), self.dtype)
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


_encoders: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of the documents' pieces; all but the last have ``capacity``
    tokens."""
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in names])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        enc = _encoders[tokenizer]
        for block in (b for batch in batches for b in blocks(batch, 1, 4 << 20)):
            cols: list[list[int | None]] = [[], [], [], [], []]
            flat, bounds = enc.encode_all(block.column(1))
            for doc_id, first, last in zip(block.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = np.append(flat[first:last], end_id).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    for col, x in zip(cols, (doc_id, k, a, len(part), zlib.crc32(part)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_pydict(dict(zip(names, cols, strict=True)), schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the gap of each bin.  Taking a piece of ``s`` tokens from gap ``g`` to
    ``g - s`` changes the sum by ``2 * (N[g - s] - N[g] + 1)``; gap 0 is closed and counts nothing."""
    closed_gain, never = -1, 1 << 40
    count = np.zeros(capacity + 1, np.int64)  # N[g]
    source = np.full(capacity + 1, -never)  # N[g] where a bin is open, for the choice
    open_bins: list[list[int]] = [[] for _ in range(capacity)]
    gaps: list[int] = []
    bins, offsets = [], []
    for s in lengths:
        cost = 2 * (count[: capacity - s] - source[s:capacity] + 1)  # cost[k]: from gap s + k to gap k
        if len(cost):
            cost[0] = closed_gain - 2 * source[s] + 2  # (N - 1)**2 - N**2: no bin is added at gap 0
            k = int(cost.argmin())
            best = int(cost[k])
        else:
            k, best = 0, never
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if best <= fresh:
            g = s + k
            b = open_bins[g].pop()
            count[g] -= 1
            source[g] = count[g] or -never
        else:
            g, b = capacity, len(gaps)
            gaps.append(capacity)
        bins.append(b)
        offsets.append(capacity - g)
        g -= s
        gaps[b] = g
        if g:
            open_bins[g].append(b)
            count[g] += 1
            source[g] = count[g]
    return bins, offsets, gaps


def _level(parts: DataFrame, number: int, capacity: int, block: int) -> tuple[DataFrame, int]:
    """``parts`` with ``sequence_id``, ``offset`` and ``gap``, and the number of blocks.  In a block, pieces of over a
    sixteenth of a sequence come first, in an order drawn by a hash, as sums of squares do well on pieces that come in no
    order; the shorter ones follow by length, to fill what gaps are left.  A task packs its blocks one after the other."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "twin"]
    n_blocks = max(1, -(-parts.count() // block))
    kind = parts.select(*names).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bins, offsets, gaps = sum_of_squares(rows.column("length").to_pylist(), capacity)
            base = (number << 56) | (rows.column("block")[0].as_py() << 24)
            made = [np.array(bins, np.int64) + base, np.array(offsets, np.int64), np.array(gaps, np.int64)[bins]]
            return pa.RecordBatch.from_arrays([*rows.columns[:-1], *map(pa.array, made)], [*names, "sequence_id", "offset", "gap"])

        for batch in batches:
            b = batch.column("block").to_numpy()
            cut = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)] if len(b) else []
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if held and held[-1].column("block")[0].as_py() != b[x]:
                    yield done()
                    held.clear()
                held.append(batch.slice(x, y - x))
        if held:
            yield done()

    def draw(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), "doc_id", "piece", "ids_crc32", "twin")

    dealt = parts.select(*names, F.pmod(draw(number), F.lit(n_blocks)).alias("block"))
    dealt = dealt.withColumn("turn", F.when(F.col("length") > capacity // 16, draw(-number))).withColumn("late", F.col("turn").isNull())
    dealt = dealt.repartition("block").sortWithinPartitions("block", "late", F.desc("turn"), F.desc("length"), "doc_id", "piece", "ids_crc32", "twin").select(*names, "block")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    return dealt.mapInArrow(pack, f"{columns}, sequence_id long, offset long, gap long"), n_blocks


def pack_sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, block: int = 1 << 16, slack: int = 64) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece of ``docs(doc_id, text)``."""
    if not 1 <= block <= 1 << 24:
        raise ValueError("a block has 1 to 2**24 pieces")
    with small_batches(docs.sparkSession, 16 << 20):
        made = stash(pieces(docs, tokenizer, end_id, capacity).withColumn("twin", F.monotonically_increasing_id()), "pieces")
    out = made.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("twin")).withColumn("offset", F.lit(0).cast("long")).withColumn("gap", F.lit(0).cast("long"))
    parts, held, number = made.filter(F.col("length") < capacity), None, 0
    while True:
        number += 1
        level, n_blocks = _level(parts, number, capacity, block)
        packed = stash(level, "packed")
        loose = packed.filter(F.col("gap") >= slack)
        n_loose = loose.count() if n_blocks > 1 else 0
        if n_loose == 0 or (held is not None and 2 * n_loose > held):
            return out.unionByName(packed).drop("twin", "gap")
        out, parts, held = out.unionByName(packed.filter(F.col("gap") < slack)), loose.drop("sequence_id", "offset", "gap"), n_loose
