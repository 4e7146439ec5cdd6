"""Operator 4 - personal data by bootstrapped contextual extraction, DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers in each text.  They are the seed entities.
What stands left of a seed, its last word and its last two words, induces lexical patterns; identifier-like tokens
that no base rule accepts are further instances.  Patterns and instances form a bipartite graph of distinct edges,
scored iteratively: a pattern's confidence is the smoothed mean score of its instances, an instance's score is 1 if
it's a seed, else the best confidence of its patterns.  Patterns with enough confidence and enough distinct seeds
turn their other instances into spans of kind ``other``.

Scale: texts are read once and never shuffled; only contexts and tokens of matches are.  Edges are counted before
they are joined, so a context or token that a third of all rows share is a single edge for each partner.

Defined cases: null and empty texts have no spans; repeated rows are each reported; spans of one start come in the
order e-mail, ip, card, phone, other; an empty table gives no rows; further columns are ignored.  All repetition in
the patterns is possessive or of single classes, so long texts neither backtrack nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.llm.common import let, row_key, stash

#: Base patterns (fixed by the contract), with possessive repetition and starts only where a run of the first class
#: starts or the previous match ended; both leave the leftmost non-overlapping matches as they are.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifier-like tokens that may turn out to be personal, of any length: runs of letters, digits and inner hyphens
#: with five digits or more, and groups of two to four digits with a space, dot, hyphen or brackets between them.
TOKEN = (
    r"(?<![0-9A-Za-z.+@_-])(?=(?:[A-Za-z-]*+[0-9]){5})[0-9A-Za-z]++(?:-[0-9A-Za-z]++)*+(?![@_]|\.[0-9])"
    r"|(?:\([0-9]{2,4}\)|(?<![0-9A-Za-z.+@_-])[0-9]{2,4})(?:[ .-][0-9]{2,4}(?![0-9A-Za-z@_]))++"
)
KINDS = ("email", "ip", "card", "phone")
_MARK, _OTHER = "\ue000", "\ue001"


#: Pieces that are folded at a time, an even number; a fold copies what it has gathered, so its length is bounded.
FOLD = 256
#: Code points to the left of a match in which its context lies.
LEFT = 48
_HIT = "struct<s:int,e:int,m:string,left:string>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of ``(s, e, m, left)``: code points, end exclusive, and the ``LEFT``
    code points before ``s``.  ``text`` must not hold the mark; matches are wrapped in marks, and the pieces' lengths give
    the positions.  Folds run over ``FOLD`` pieces each, from sums of those before, so that a text of very many matches
    takes hardly more than its share."""
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)

    def part(p: Column, c: Column) -> Column:
        return F.slice(p, c * FOLD + 1, F.lit(FOLD))

    def fold(p: Column, c: Column, offset: Column) -> Column:
        # matches are never empty, so the 2 * LEFT pieces before hold LEFT code points
        before = F.array_join(F.slice(p, F.greatest(c * FOLD + 1 - 2 * LEFT, F.lit(1)), F.least(c * FOLD, F.lit(2 * LEFT))), "")
        zero = F.struct(offset.alias("pos"), F.right(before, F.lit(LEFT)).alias("tail"), F.lit(False).alias("inside"), F.array().cast(f"array<{_HIT}>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            end = a["pos"] + F.length(x)
            hit = F.struct(a["pos"].alias("s"), end.alias("e"), x.alias("m"), a["tail"].alias("left"))
            tail = F.right(F.concat(a["tail"], F.right(x, F.lit(LEFT))), F.lit(LEFT))
            return F.struct(end.alias("pos"), tail.alias("tail"), (~a["inside"]).alias("inside"), F.when(a["inside"], F.array_append(a["out"], hit)).otherwise(a["out"]).alias("out"))

        return F.aggregate(part(p, c), zero, step, lambda a: a["out"])

    def folded(p: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / FOLD).cast("int"))
        sizes = F.transform(chunks, lambda c: F.aggregate(part(p, c), F.lit(0), lambda a, x: a + F.length(x)))
        start = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        return let(start, lambda at: F.flatten(F.transform(chunks, lambda c: fold(p, c, F.get(at, c)))))

    return let(pieces, folded)


def _meets(sorted_spans: Column, y: Column) -> Column:
    """Whether a token overlaps one of the spans of a kind, which stand in order and apart: a binary search for the first
    that ends behind the token's start."""
    n = F.size(sorted_spans)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))

    def halve(r: Column, _: Column) -> Column:
        mid = F.floor((r["lo"] + r["hi"]) / 2).cast("int")
        behind = F.get(sorted_spans, mid)["e"] > y["s"]
        open_ = r["lo"] < r["hi"]
        return F.struct(F.when(open_ & ~behind, mid + 1).otherwise(r["lo"]).alias("lo"), F.when(open_ & behind, mid).otherwise(r["hi"]).alias("hi"))

    first = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda r: r["lo"])
    return (n > 0) & F.coalesce(F.get(sorted_spans, first)["s"] < y["e"], F.lit(False))


_NO_MATCH = f"array<{_HIT}>"


def _when(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array().cast(_NO_MATCH))


def _digits(m: Column) -> Column:
    return F.translate(m, " ().-+", "")


def _small_parts(m: Column) -> Column:
    """Whether all numbers of an IP address are at most 255, whatever their leading zeros."""
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, F.lit("^0+(?=[0-9])"), F.lit("")))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _luhn(d: Column) -> Column:
    def worth(i: Column) -> Column:
        x = F.substring(F.reverse(d), i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _apart(tokens: Column, spans: Column) -> Column:
    """The tokens that overlap none of a kind's spans."""
    return F.filter(tokens, lambda y: ~_meets(spans, y))


def base_spans(text: Column) -> Column:
    """Struct of the four arrays of base matches of a text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.when(F.contains(t, F.lit(_MARK)), F.translate(t, _MARK, _OTHER)).otherwise(t)

    def found(t: Column) -> Column:
        digit = t.rlike("[0-9]")
        card = F.filter(_when(digit, matches(t, CARD)), lambda x: F.length(_digits(x["m"])).between(14, 19))
        return F.struct(
            _when(F.contains(t, F.lit("@")), matches(t, EMAIL)).alias("email"),
            F.filter(_when(digit & F.contains(t, F.lit(".")), matches(t, IP)), lambda x: _small_parts(x["m"])).alias("ip"),
            F.filter(card, lambda x: _luhn(_digits(x["m"]))).alias("card"),
            F.filter(_when(digit & F.contains(t, F.lit("+")), matches(t, PHONE)), lambda x: F.length(_digits(x["m"])).between(10, 15)).alias("phone"),
            _when(digit, matches(t, TOKEN)).alias("token"))

    return let(t, found)


def _contexts(before: Column) -> Column:
    """The last word and the last two words of what stands before a match, lower-cased, digits made alike."""
    left = F.lower(F.regexp_replace(before, F.lit("[0-9]"), F.lit("0")))

    def both(w: Column) -> Column:
        w = F.filter(w, lambda x: x != "")
        return let(w, lambda v: F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda k: F.size(v) >= k), lambda k: F.array_join(F.slice(v, -k, k), " ")))

    return both(F.split(left, r"\s+"))


def _span(kind: str, rank: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m"), x["left"].alias("left"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def score_patterns(edges: DataFrame, rounds: int = 3, prior: float = 2.0) -> DataFrame:
    """``(pattern, conf, seeds)`` after ``rounds`` of scoring on distinct ``edges(pattern, inst, seed)``."""
    conf = None
    for k in range(rounds):
        scored = edges if conf is None else edges.join(
            edges.join(conf, "pattern").groupBy("inst").agg(F.max("conf").alias("best")), "inst")
        score = F.when(F.col("seed"), 1.0).otherwise(F.lit(0.0) if conf is None else F.col("best"))
        conf = stash(scored.groupBy("pattern").agg((F.sum(score) / (F.count("*") + prior)).alias("conf"), F.sum(F.col("seed").cast("long")).alias("seeds")), f"patterns{k}")
    return conf


def personal_data(docs: DataFrame, min_conf: float = 0.7, min_seeds: int = 5, rounds: int = 3) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_other, spans)`` for each row of
    ``docs(doc_id, text)``."""
    found = docs.select("doc_id", row_key("doc_id", "text").alias("rk"), base_spans(F.col("text")).alias("b"))
    base = F.concat(*[F.transform(F.col(f"b.{k}"), _span(k, i)) for i, k in enumerate(KINDS)])

    def met(x: Column, seed: bool) -> Column:
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(seed).alias("seed"), x["m"].alias("inst"), _contexts(x["left"]).alias("patterns"))

    def with_context(spans: Column) -> Column:
        free = F.col("b.token")
        for k in KINDS:
            free = _apart(free, F.col(f"b.{k}"))
        return F.concat(F.transform(spans, lambda x: met(x, True)), F.transform(free, lambda x: met(x, False)))

    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in ("s", "k", "e", "kind", "m")]))

    rows = stash(found.select("doc_id", "rk", let(base, lambda spans: F.struct(bare(spans).alias("base"), with_context(spans).alias("near"))).alias("x"), *[F.size(f"b.{k}").cast("long").alias(f"n_{k}") for k in KINDS]), "pii")

    near = rows.select("rk", F.explode("x.near").alias("o")).select("rk", "o.*").withColumn("pattern", F.explode("patterns"))
    edges = stash(near.groupBy("pattern", "inst").agg(F.max("seed").alias("seed")), "edges")
    good = score_patterns(edges, rounds).filter((F.col("conf") >= min_conf) & (F.col("seeds") >= min_seeds)).select("pattern")
    more = near.filter(~F.col("seed")).join(good, "pattern", "left_semi").select("rk", "s", "e", "inst").distinct().groupBy("rk").agg(
        F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("k"), "e", F.lit("other").alias("kind"), F.col("inst").alias("m"))).alias("more"))
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string,m:string>>")
    return rows.join(more, "rk", "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_written(F.col("x.base")), 256).alias("base_sha256"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_other"), _written(F.concat(F.col("x.base"), F.coalesce("more", none))).alias("spans"))
