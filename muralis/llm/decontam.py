"""Operator 5 - benchmark decontamination as a prefix-filtered set join, DataFrame functions only.

An item's windows are its runs of ``window`` consecutive words (one shorter run if the item has fewer).  A window's
shingles are its pairs of neighbouring words (of a window of one word, the word).  A document holds a window only if
it holds every shingle of it; so it's enough to look for one necessary shingle, the prefix of length one under an
order by rarity:

1. documents are split into words once, and the words are written;
2. the benchmark's shingles are counted in the corpus, in a map-side combined aggregate over all documents;
3. each window's anchor is its rarest shingle, at a known offset;
4. document shingles join the anchors; the shingle's position fixes where the window must start, and starts that
   leave the document are dropped (length and positional bound);
5. the words that stand there are compared with the windows' (verification: a hash finds the window, then all words
   must agree).

Windows are item-sized: bounded by the benchmark, never by a document.  Anchors of up to ``broadcast_rows`` rows of
fixed width are broadcast; then step 5 reads the words in the row that step 4 stands in, and no text is shuffled.
Beyond that the join shuffles shingles, where a frequent one is a skewed key that adaptive execution splits, and
candidates return to their documents in blocks of ``block`` words, so that no row gathers more than a block's.

Defined cases: a null or empty text has no words, a null item no windows; equal windows of several items count for
each of them; rows that repeat an id are judged each on its text; an empty table gives no rows, an empty benchmark
clean documents; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.llm.common import release, row_key, stash

#: Between words: ASCII without digits and lower-case letters (fixed pattern, after lower-casing A-Z).
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text; only A-Z change case.  ASCII texts take the quicker ``lower``."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(low, SPLIT), "")


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """``(item, words, h)``: the distinct windows of each item and the hash of their words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    runs = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("words"))
    return runs.distinct().withColumn("h", F.xxhash64("words"))


def shingles_of(words: DataFrame, pairs: bool, *keep: str) -> DataFrame:
    """``keep``, ``at`` and ``key`` of each shingle of ``words(w)``: of word pairs, or of single words."""
    each = words.select(*keep, "w", F.posexplode("w").alias("at", "word"))
    if not pairs:
        return each.withColumn("key", F.xxhash64("word"))
    return each.filter(F.col("at") + 1 < F.size("w")).withColumn("key", F.xxhash64("word", F.get("w", F.col("at") + 1)))


def anchors_of(words: DataFrame, windows: DataFrame, pairs: bool, hint) -> DataFrame:
    """``(key, off, len)``: the shingle that is rarest in ``words`` of each window, and where it stands in it."""
    placed = shingles_of(windows.select("h", F.col("words").alias("w")).distinct(), pairs, "h")
    vocabulary = stash(placed.select("key").distinct(), "shingles")
    counts = stash(shingles_of(words, pairs).select("key").join(hint(vocabulary), "key", "left_semi").groupBy("key").count(), "rarity")
    placed = placed.select("h", F.size("w").alias("len"), "at", "key").join(counts, "key", "left")
    # a window with a shingle that no document holds can't occur
    rarest = placed.groupBy("h", "len").agg(F.bool_and(F.col("count").isNotNull()).alias("seen"), F.min(F.struct("count", "key", "at")).alias("m")).filter("seen")
    found = stash(rarest.select(F.col("m.key").alias("key"), F.col("m.at").alias("off"), "len").distinct(), "anchors")
    release(vocabulary, counts)
    return found


def standing(words: DataFrame, anchors: DataFrame, pairs: bool, broadcast: bool, window: int, block: int) -> DataFrame:
    """``(rk, start, words)``: what stands where a window must, if its anchor stands in a row of ``words(rk, n, w)``."""
    start = F.col("at") - F.col("off")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n"))
    if broadcast:
        spots = shingles_of(words, pairs, "rk", "n").join(F.broadcast(anchors), "key").filter(inside)
        return spots.select("rk", start.alias("start"), F.slice("w", start + 1, F.col("len")).alias("words"))
    spots = shingles_of(words, pairs, "rk", "n").select("rk", "n", "at", "key").join(anchors, "key").filter(inside)
    of_block = spots.select("rk", start.alias("start"), "len").groupBy("rk", F.expr(f"start div {block}").alias("b")).agg(F.collect_set(F.struct("start", "len")).alias("c"))
    pieces = words.filter("n > 0").select("rk", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))).alias("b"))
    pieces = pieces.select("rk", "b", F.slice("w", (F.col("b") * block + 1).cast("int"), block + window - 1).alias("w"))
    met = pieces.join(of_block, ["rk", "b"]).select("rk", "b", "w", F.explode("c").alias("c"))
    return met.select("rk", F.col("c.start").alias("start"), F.slice("w", (F.col("c.start") - F.col("b") * block + 1).cast("int"), F.col("c.len")).alias("words"))


def _covered(spans: Column) -> Column:
    """Positions inside the union of ``(start, len)`` spans, sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct((a["n"] + F.greatest(end - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, broadcast_rows: int = 200_000, block: int = 512, key: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of each row of ``docs(doc_id, text)``,
    contaminated if hit words are one in ``share`` or more; ``key`` adds the row's ``row_key``, ``rk``."""

    def small(df: DataFrame) -> bool:
        return df.limit(broadcast_rows + 1).count() <= broadcast_rows

    windows = stash(windows_of(benchmark, window), "windows")
    words = docs.select("doc_id", row_key("doc_id", "text").alias("rk"), words_of(F.col("text")).alias("w"))
    words = stash(words.select("doc_id", "rk", F.size("w").alias("n"), "w"), "words")
    found = None
    for pairs, own in ((True, windows.filter(F.size("words") > 1)), (False, windows.filter(F.size("words") == 1))):
        if own.isEmpty():
            continue
        anchors = anchors_of(words, own, pairs, lambda df: F.broadcast(df) if small(df) else df)
        met = standing(words, anchors, pairs, small(anchors), window, block).withColumn("h", F.xxhash64("words"))
        hits = met.join(own.withColumnRenamed("words", "want"), "h").filter(F.col("words") == F.col("want"))
        hits = hits.select("rk", "start", F.size("words").alias("len"), "item")
        found = hits if found is None else found.union(hits)
    zero = F.lit(0).cast("long")
    rows = words.select(*["rk"] * key, "doc_id", F.col("n").cast("long").alias("n_words"), F.col("rk").alias("_row"))
    if found is None:
        rows = rows.withColumns({"n_hit": zero, "n_items": zero, "items_sha256": F.sha2(F.lit(""), 256)}).drop("_row")
    else:
        found = found.groupBy("rk").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
        found = found.select(F.col("rk").alias("_hit"), _covered(F.col("spans")).cast("long").alias("h"), F.size("items").cast("long").alias("k"), F.sha2(F.array_join("items", ","), 256).alias("s"))
        rows = rows.join(stash(found, "hits"), F.col("_row") == F.col("_hit"), "left").select(
            *["rk"] * key, "doc_id", "n_words", F.coalesce("h", zero).alias("n_hit"), F.coalesce("k", zero).alias("n_items"), F.coalesce("s", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
