"""Operator 2 - near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its runs of ``shingle`` words (one shorter run if it has fewer words).  Every shingle owns
Poisson processes over the discretised weights, one for each dyadic interval [0,1), [1,2), [2,4), ... of its count;
a point has an arrival, one of ``slots`` signature slots and a place in the interval, and counts if that place is
below the shingle's count.  A slot holds the earliest point that counts; two texts agree in a slot with probability
equal to their weighted Jaccard similarity.  Points are generated in order of arrival up to a bound at which nearly
all slots are filled, so a signature costs the shingles plus about ``slots * log(slots)`` points.

Steps:

1. signatures; texts of equal words collapse to one representative, so copies cost nothing from here on;
2. bands of ``rows`` slots make buckets.  A bucket proposes its leader to its members - never all pairs;
3. proposals are verified on the whole shingle multisets, and links make components (min-label propagation with
   pointer jumping, each round written out);
4. buckets that still hold several components propose again, to leaders drawn anew for each band and round, until
   a round finds links for hardly a hundredth of its pairs.  These rounds only save work: what they leave is settled by step 5;
5. buckets of at most ``small`` members compare all pairs across components; the members of larger ones go through
   an exact prefix join (``prefix_pairs``), which misses no pair of the wanted similarity.

The first leader of a bucket is its most central member, whose bands fill the largest buckets: among copies with
edits of their own that is the least edited one, to which a copy is more similar than to any other copy.

At a similarity of 0.8 the default 20 bands of 4 slots miss a pair with probability 3e-5, whatever the size of the
bucket that it shares.

Defined cases: null and empty texts, and those without words, are a class each; a very long text is a block of its own and
is taken whole; ties in arrival don't occur; rows
that repeat an id are rows of their own; an empty table gives no rows; further columns are ignored.  Verification
compares 64-bit digests of (shingle, occurrence).

Scale: nothing but the number of rows of a step comes to the driver.  What a bucket must know of itself - its size, its leader,
whether it's mixed - is counted with partial sums, then joined to its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.llm.common import blocks, release, row_key, small_batches, stash
from muralis.llm.wordarrays import Words, mix, rolling

_U = np.uint64


def shingles(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each shingle of a block."""
    n = np.diff(words.first)
    at = words.run_starts(length)
    h, doc = rolling(words.hash, at, at + length, 0xD1342543DE82EF95), np.searchsorted(words.first, at, "right") - 1
    few = np.flatnonzero((n > 0) & (n < length))
    if len(few):
        h = np.append(h, rolling(words.hash, words.first[few], words.first[few + 1], 0xD1342543DE82EF95))
        doc = np.append(doc, few)
    return h, doc


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text) with counts, by text."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[new], doc[new], np.diff(np.append(new, len(h)))


def bag_minhash(h: np.ndarray, doc: np.ndarray, count: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signatures ``(n_docs, slots)`` of weighted sets given as rows (shingle, text, count > 0)."""
    sig = np.zeros((n_docs, slots), _U)
    weight = np.bincount(doc, weights=count, minlength=n_docs)
    level = np.zeros(0, np.int64)
    elem = np.zeros(0, np.int64)
    for k in range(int(count.max(initial=0)).bit_length() + 1):  # interval k: [0,1), then [2**(k-1), 2**k)
        own = np.flatnonzero(count > (0 if k == 0 else 1 << (k - 1)))
        elem, level = np.append(elem, own), np.append(level, np.full(len(own), k))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(float)
    length = np.where(level == 0, 1.0, low)
    bound = np.where(weight > 0, slots * (np.log(slots) + 4) / np.maximum(weight, 1), 0.0)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        is_todo = np.zeros(n_docs, bool)
        is_todo[todo] = True
        e = np.flatnonzero(is_todo[doc[elem]])
        x, seed = np.zeros(len(e)), mix(h[elem[e]] ^ mix(level[e].astype(_U) + _U(77)))
        points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(e):
            seed = mix(seed + _U(0x9E3779B97F4A7C15))
            u = ((seed >> _U(11)).astype(float) + 0.5) / (1 << 53)
            x = x - np.log(u) / length[e]
            live = x < bound[doc[elem[e]]]
            e, x, seed = e[live], x[live], seed[live]
            r = mix(seed ^ _U(0xA0761D6478BD642F))
            place = low[e] + length[e] * ((r & _U(0xFFFFFFFF)).astype(float) / (1 << 32))
            ok = place < count[elem[e]]
            slot = ((r >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64)
            points.append((doc[elem[e[ok]]] * slots + slot[ok], x[ok], seed[ok]))
        where, arrival, ident = (np.concatenate([p[i] for p in points]) for i in range(3))
        order = np.argsort(-arrival, kind="stable")
        flat = np.zeros(n_docs * slots, _U)
        flat[where[order]] = ident[order] | _U(1)  # the earliest is written last
        sig[todo] = flat.reshape(n_docs, slots)[todo]
        todo = todo[(sig[todo] == 0).any(axis=1)]
        bound[todo] *= 2
    return sig


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, rk, fp, n, bands)``: the row's key, a 128-bit digest of the words, the number of shingles and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(5).integers(1, 1 << 62, rows, dtype=np.uint64) * _U(2) + _U(1)
        for batch in batches:
            for block in blocks(batch, 1):
                words = Words(block.column(1))
                h, doc, count = counted(*shingles(words, shingle))
                n = np.bincount(doc, weights=count, minlength=block.num_rows).astype(np.int64)
                sig = bag_minhash(h, doc, count, block.num_rows, bands * rows).reshape(-1, bands, rows)
                keys = mix((sig * odd).sum(axis=2, dtype=_U) ^ mix(np.arange(bands, dtype=_U)))
                data = words.comp.tobytes()
                edge = np.append(words.start, len(data))[words.first].tolist()
                fp = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(edge, edge[1:], strict=False)]
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(fp, pa.binary()), pa.array(n), lists], ["doc_id", "rk", "fp", "n", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key("doc_id", "text").alias("rk"))
    return rows_.mapInArrow(run, "doc_id long, rk long, fp binary, n long, bands array<long>")


def multisets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(fp, items)``: the 64-bit digests of (shingle, occurrence) of one text for each wanted ``fp``.

    The wanted keys grow with the input, so they are never sent out: the texts are shuffled once, at every size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                h, doc, count = counted(*shingles(Words(block.column(1)), shingle))
                first = np.append(0, np.cumsum(count)[:-1])
                nth = np.arange(count.sum()) - np.repeat(first, count)
                item = mix(np.repeat(h, count) + nth.astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)
                owner = np.repeat(doc, count)  # ascends
                offs = np.append(0, np.cumsum(np.bincount(owner, minlength=block.num_rows))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(item))], ["fp", "items"])

    texts = docs.select(row_key("doc_id", "text").alias("rep"), F.col("text").cast("string"))
    one = wanted.select("fp", "rep").join(texts.hint("merge"), "rep").dropDuplicates(["fp"])
    return one.select("fp", "text").mapInArrow(run, "fp binary, items array<long>")


def components(links: DataFrame) -> DataFrame:
    """``(v, label)`` of the nodes of the distinct ``links(a, b)``: the least node of each component.

    In each round a node takes the least label among its own, its neighbours' and its label's; the last is an edge
    like any other, so a round is one join and one grouping, written once."""
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("v"), "label"), "labels")
    while True:
        ends = labels.select(F.col("v").alias("b"), F.col("label").alias("seen"))
        seen = both.union(labels.filter("v != label")).join(ends, "b").select("a", "seen", F.lit(None).cast("binary").alias("own"))
        least = seen.union(labels.select("v", "label", "label")).groupBy("a").agg(F.min("seen").alias("label"), F.max("own").alias("before"))
        old, new = labels, stash(least.select(F.col("a").alias("v"), "label", (F.col("label") != F.col("before")).alias("moved")), "labels")
        release(old)
        labels = new.select("v", "label")
        labels.stashed_at = new.stashed_at
        if new.filter("moved").isEmpty():
            return labels


def _fits(n: str, m: str, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _slot(item: np.ndarray, bits: int) -> np.ndarray:
    return (item.view(_U) >> _U(64 - bits)).astype(np.int64)


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the list and value of each value of an Arrow column of lists."""
    sizes = lists.value_lengths().to_numpy()
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()


def item_levels(each: DataFrame, bits: int, parts: int = 64) -> np.ndarray:
    """How often the ``items`` of all rows fall into each of ``2**bits`` slots, by their leading bits: 0 never, 1 once, from
    there a step for each eighth of a power of two.  A task adds up its own rows, then each part of the slots is added up by
    one task, so no item is a row; the driver joins the parts, whose total size is fixed."""
    size = (1 << bits) // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            total = np.zeros(1 << bits, np.int64) if total is None else total
            slot, n = np.unique(_slot(_listed(batch.column(0))[1], bits), return_counts=True)
            total[slot] += n
        for p in range(parts if total is not None else 0):
            own = total[p * size : (p + 1) * size]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], ["p", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(p, np.zeros(size, np.int64))[np.frombuffer(at, np.int64)] += np.frombuffer(n, np.int64)
        for p, n in sums.items():
            level = np.where(n > 0, 1 + np.round(8 * np.log2(np.maximum(n, 1))), 0).clip(max=255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["p", "level"])

    out = np.zeros(1 << bits, np.uint8)
    found = each.select("items").mapInArrow(count, "p int, at binary, n binary").repartition(parts, "p")
    for p, level in found.mapInArrow(add, "p int, level binary").collect():
        out[p * size : (p + 1) * size] = np.frombuffer(level, np.uint8)
    return out


def prefix_pairs(docs: DataFrame, items: DataFrame, similarity: float, step: float = 1.1, bits: int = 22) -> DataFrame:
    """``(p, q)``: all pairs of ``docs(fp, n, comp)`` of different ``comp`` that can have the wanted similarity.

    Items are ordered by rarity, that of their slot of ``2**bits`` (``item_levels``), then by value: any order that all
    texts share misses no pair.  An item that is alone in its slot stands in one text.  A pair of n and m items needs
    ``similarity / (1 + similarity) * (n + m)`` common ones, so if its first common item stands i-th, then
    ``m <= reach = (n - i + 1) * (1 + similarity) / similarity - n``.
    The longer text looks an item up in the length classes (a factor of ``step`` each) from ``similarity * n`` to its
    reach, where the shorter one stands if it reaches its own length.  In each of these lists the members of the most
    common component meet only the others, never each other."""
    each = stash(docs.join(items, "fp").select("fp", "n", "comp", "items"), "itemised")
    levels = docs.sparkSession.sparkContext.broadcast(item_levels(each, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, item = _listed(batch.column(3))
            n = batch.column(1).to_numpy()
            level = levels.value[_slot(item, bits)]
            order = np.lexsort((item, level, owner))
            owner, item, level = owner[order], item[order], level[order]
            new = np.append(True, (item[1:] != item[:-1]) | (owner[1:] != owner[:-1]))[: len(item)]
            owner, item, level = owner[new], item[new], level[new]
            at = np.arange(len(item)) - np.searchsorted(owner, owner)
            shortest = np.ceil(similarity * n - 1e-6).astype(np.int64)
            keep = (at <= (n - shortest)[owner]) & (level > 1)
            owner, left = owner[keep], (n[owner] - at)[keep]  # what can be common from this item on
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), batch.column(2).take(own), pa.array(item[keep]), pa.array(left)], ["fp", "n", "comp", "item", "left"])

    shortest = F.ceil(similarity * F.col("n") - 1e-6).cast("int")
    reach = F.floor(F.col("left") * (1 + similarity) / similarity - F.col("n") + 1e-6)
    cls = lambda m: F.floor(F.log(m.cast("double")) / float(np.log(step))).cast("int")
    prefix = each.mapInArrow(run, "fp binary, n long, comp binary, item long, left long").withColumn("reach", reach)
    shorter = prefix.filter("reach >= n").select("item", cls(F.col("n")).alias("cls"), "comp", "fp", "n", "left", F.lit(False).alias("looks"))
    farthest = F.least("n", "reach")
    longer = prefix.filter(farthest >= shortest).select("item", F.explode(F.sequence(cls(shortest), cls(farthest))).alias("cls"), "comp", "fp", "n", "left", F.lit(True).alias("looks"))
    entries = stash(shorter.union(longer), "prefixes")
    release(each)
    lists = entries.groupBy("item", "cls", "comp").agg(F.count("*").alias("k"), F.bool_or("looks").alias("looked"), F.bool_or(~F.col("looks")).alias("stands"))
    lists = lists.groupBy("item", "cls").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), (F.count("*") > 1).alias("mixed"), (F.bool_or("looked") & F.bool_or("stands")).alias("meet"))
    entries = entries.join(lists.filter("mixed and meet").drop("mixed", "meet"), ["item", "cls"]).withColumn("is_main", F.col("comp") == F.col("main"))
    sides = F.when(F.col("looks") & ~F.col("is_main"), F.array(F.lit(True), F.lit(False))).when(F.col("looks"), F.array(F.lit(False))).otherwise(F.array("is_main"))
    entries = stash(entries.select("item", "cls", F.explode(sides).alias("side"), "comp", "fp", "n", "left", "looks"), "lists")
    p = entries.filter("looks").select("item", "cls", "side", F.col("fp").alias("p"), "n", "comp", "left")
    q = entries.filter("not looks").select("item", "cls", "side", F.col("fp").alias("q"), F.col("n").alias("m"), F.col("comp").alias("other"), F.col("left").alias("left_q"))
    once = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("p") < F.col("q")))
    enough = F.least("left", "left_q") >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6
    return p.join(q, ["item", "cls", "side"]).filter((F.col("comp") != F.col("other")) & once & _fits("n", "m", similarity) & enough).select("p", "q")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 4, leader_rounds: int = 4, small: int = 20) -> DataFrame:
    """``(doc_id, class_id, n_shingles, kept, rk)``: the class is named by its least id, whose row is kept; ``rk`` is
    the row's ``row_key``, for joining decisions back (equal rows share it).  ``leader_rounds`` ends the rounds of
    leaders if each still finds links; neither it nor ``small`` changes the result."""
    with small_batches(docs.sparkSession):
        return _classes(docs, shingle, similarity, bands, rows, leader_rounds, small)


def _classes(docs: DataFrame, shingle: int, similarity: float, bands: int, rows: int, leader_rounds: int, small: int) -> DataFrame:
    signed = stash(signatures(docs, shingle, bands, rows), "signatures")
    reps = stash(signed.filter("n > 0").groupBy("fp").agg(F.min(F.struct("doc_id", "rk")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands")), "representatives")
    # a struct's minimum puts null ids first; the class is then named null
    reps = reps.select("fp", F.col("r.doc_id").alias("least"), F.col("r.rk").alias("rep"), "n", "bands")
    buckets = reps.select("fp", "n", F.posexplode("bands").alias("band", "key"))
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("k")).filter("k > 1")
    members = stash(buckets.join(sizes, ["band", "key"]), "buckets")
    # how large the buckets of a text are: copies near the middle of their group have the most common bands
    central = members.groupBy("fp").agg(F.sum("k").alias("central"))
    # written, since the multisets and the first leaders both read it
    known = stash(reps.select("fp", "rep").join(central, "fp"), "known")
    items = stash(multisets(docs, known, shingle), "multisets")

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = items.select(F.col("fp").alias("a"), F.col("items").alias("x")), items.select(F.col("fp").alias("b"), F.col("items").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        return pairs.join(a, "a").join(b, "b").filter(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    scratch: list[DataFrame] = []
    passing: list[DataFrame] = []  # read in its own round only
    links, tried, comp, step = None, None, None, 0
    while True:
        if comp is None:
            now = members.withColumn("comp", F.col("fp"))
        else:
            now = members.join(comp, members["fp"] == comp["v"], "left").select(members["*"], F.coalesce("label", "fp").alias("comp"))
            mixed = now.groupBy("band", "key").agg((F.min("comp") != F.max("comp")).alias("mixed")).filter("mixed").select("band", "key")
            now = stash(now.join(mixed, ["band", "key"]), "unresolved")
            release(*passing)
            passing = [now]
            if now.isEmpty():
                break
        other = now.select("band", "key", F.col("fp").alias("q"), F.col("n").alias("m"), F.col("comp").alias("other"))
        last = step < 0
        if last:
            few = now.filter(F.col("k") <= small).withColumnRenamed("fp", "p")
            pairs = few.join(other, ["band", "key"]).filter((F.col("comp") < F.col("other")) & _fits("n", "m", similarity)).select("p", "q")
            many = stash(now.filter(F.col("k") > small).select("fp", "n", "comp").distinct(), "large")
            scratch.append(many)
            if not many.isEmpty():
                pairs = pairs.union(prefix_pairs(many, items, similarity))
        else:
            rank = F.struct(-F.col("central"), "fp") if step == 0 else F.struct(F.xxhash64("fp", "band", F.lit(step)), "fp")
            could_lead = now.join(known.select("fp", "central"), "fp") if step == 0 else now
            leader = could_lead.groupBy("band", "key").agg(F.min_by(F.struct("fp", "n", "comp"), rank).alias("l")).select("band", "key", F.col("l.fp").alias("p"), F.col("l.n").alias("n"), F.col("l.comp").alias("comp"))
            pairs = leader.join(other, ["band", "key"]).filter((F.col("comp") != F.col("other")) & _fits("n", "m", similarity))
        pairs = ordered(pairs)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stash(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = stash(verify(pairs), "verified")
        scratch += [pairs, found]
        n_found = found.count()
        if n_found or comp is None:
            links = found if links is None else links.union(found)
            comp = components(links)
        if last:
            break
        spent = n_found * 100 <= pairs.count()  # leaders hardly find anything any more
        step = -1 if spent or step + 1 >= leader_rounds else step + 1

    release(items, known, members, *scratch, *passing)
    home = reps.join(comp, reps["fp"] == comp["v"], "left").select("fp", "least", "rep", F.coalesce("label", "fp").alias("label"))
    named = home.groupBy("label").agg(F.min(F.struct("least", "rep")).alias("first"))
    classes = home.join(named, "label").select("fp", "first")
    out = signed.select("doc_id", "rk", "fp", "n").join(classes, "fp", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.least")).alias("class_id"), F.col("n").alias("n_shingles"), (alone | (F.col("rk") == F.col("first.rep"))).alias("kept"), "rk")
