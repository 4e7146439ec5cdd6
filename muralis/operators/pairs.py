"""Similarity joins: points in a radius and fingerprints within a few bits, never a bare cross join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralis.config import DEGREE_M, EARTH_M, RULES, Rules
from muralis.functions import geo, hashing
from muralis.scratch import written


#: Dense cells are cut into so many parts a side.
_PARTS = 4


def cell_width(row: Column, size: float) -> Column:
    """Degrees of longitude of the cells of a row: the box at a latitude is widest at the row's edge away from the
    equator."""
    edge = F.greatest(F.abs(row + 1), F.abs(row)) * size
    return size / F.greatest(F.lit(0.2), F.cos(F.radians(edge + size)))


def _part_of(x: Column, size: Column | float) -> Column:
    """Number of a part along an axis; ``_PARTS`` of them are a cell."""
    return F.floor(x / size * _PARTS).cast("long")


def _cell(part: Column) -> Column:
    return F.floor(part / _PARTS).cast("long")


def geo_pairs(new: DataFrame, old: DataFrame, rules: Rules = RULES, metres: float | None = None, dense: int = 256) -> DataFrame:
    """Pairs of ``new(i, lat, lon, ...)`` and ``old(j, jlat, jlon, ...)`` inside the candidate box of ``metres``
    (a semantic predicate of its own) with ``i > j``, and their distance.

    The probe side stands in nine cells, the other in one.  Cells of ``dense`` rows or more are cut into 16 parts, of which
    a probe looks into those that its box touches: so where reports crowd, fewer pairs outside the box are looked at, and
    keys are sixteen times smaller.  What is skewed beyond that is a key that adaptive execution splits."""
    metres = rules.limits("SCENE_ELSEWHERE")[1] if metres is None else metres
    size = metres / DEGREE_M
    y, r = _part_of(F.col("jlat"), size), F.col("_r")
    build = old.withColumn("_y", y).withColumn("_r", _cell(F.col("_y"))).withColumn("_x", _part_of(F.col("jlon"), cell_width(r, size))).withColumn("_c", _cell(F.col("_x")))
    crowded = build.groupBy(F.col("_r").alias("_dr"), F.col("_c").alias("_dc")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= dense).select("_dr", "_dc")
    part = (F.col("_y") - F.col("_r") * _PARTS) * _PARTS + F.col("_x") - F.col("_c") * _PARTS
    build = build.join(crowded, (F.col("_r") == F.col("_dr")) & (F.col("_c") == F.col("_dc")), "left").withColumn("_part", F.when(F.col("_dr").isNull(), -1).otherwise(part).cast("int")).drop("_y", "_x", "_dr", "_dc")

    dlat, dlon = geo.box_half(F.col("lat"), metres)
    row = _cell(_part_of(F.col("lat"), size))
    around = F.flatten(F.transform(F.sequence(row - 1, row + 1), lambda q: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.struct(q.alias("_pr"), (_cell(_part_of(F.col("lon"), cell_width(q, size))) + k).alias("_pc")))))
    probe = new.select("*", F.inline(around)).join(crowded, (F.col("_pr") == F.col("_dr")) & (F.col("_pc") == F.col("_dc")), "left")
    wide = cell_width(F.col("_pr"), size)

    def touched(low: Column, high: Column, unit: Column | float, cell: Column) -> tuple[Column, Column]:
        return F.greatest(_part_of(low, unit) - cell * _PARTS, F.lit(0)), F.least(_part_of(high, unit) - cell * _PARTS, F.lit(_PARTS - 1))

    y0, y1 = touched(F.col("lat") - dlat, F.col("lat") + dlat, size, F.col("_pr"))
    x0, x1 = touched(F.col("lon") - dlon, F.col("lon") + dlon, wide, F.col("_pc"))
    parts = F.flatten(F.transform(F.sequence(y0, y1), lambda a: F.transform(F.sequence(x0, x1), lambda b: (a * _PARTS + b).cast("int"))))
    none = F.array().cast("array<int>")
    look = F.when(F.col("_dr").isNull(), F.array(F.lit(-1))).when((y0 > y1) | (x0 > x1), none).otherwise(parts)
    probe = probe.withColumn("_pp", F.explode(look)).drop("_dr", "_dc")
    inside = F.col("jlat").between(F.col("lat") - dlat, F.col("lat") + dlat) & F.col("jlon").between(F.col("lon") - dlon, F.col("lon") + dlon)
    same = (F.col("_pr") == F.col("_r")) & (F.col("_pc") == F.col("_c")) & (F.col("_pp") == F.col("_part"))
    # the probe side is many times its input, which Spark's estimate from the size of the files doesn't know: never sent out
    joined = probe.hint("merge").join(build, same & (F.col("i") > F.col("j")) & inside)
    return joined.drop("_pr", "_pc", "_pp", "_r", "_c", "_part").withColumn("metres", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("jlat"), F.col("jlon")))


def hamming_pairs(fps: DataFrame, within: int = 8) -> DataFrame:
    """Pairs ``(a, b, h)``, a < b, of distinct fingerprints within ``within`` bits, 8 at most: they differ by
    two bits at most in one of three bands, so they meet where each flips one bit of it or none: in one of some million
    places, not in one of some hundred.  ``fps(fp)`` holds distinct values; a pair is reported once, by its first such
    band, where ``a`` flips the lower bit."""
    if within > 8:
        raise ValueError("three bands with two flips find pairs within eight bits")
    banded = hashing.bands(fps.select("fp"))
    left, right = (banded.select(F.col("fp").alias(c), "band", "bits", F.col("flip").alias(f"flip_{c}")) for c in "ab")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    once = (F.col("flip_b") == 0) | ((F.col("flip_a") > 0) & (F.col("flip_a") < F.col("flip_b")))
    for i in range(len(hashing.BANDS) - 1):
        once = once & ((F.col("band") <= i) | (F.bit_count(hashing.band(diff, i)) > 2))
    close = F.bit_count(diff) <= within
    # each side is 67 times its input, which Spark's estimate doesn't know: never sent out
    return left.hint("merge").join(right, ["band", "bits"]).filter((F.col("a") < F.col("b")) & close & once).select("a", "b", F.bit_count(diff).alias("h"))


def radius(accuracy: Column, rules: Rules = RULES) -> Column:
    return F.least(F.lit(rules.links["scene"].metres), F.greatest(F.lit(rules.least_m), accuracy))


def reused_far(reports: DataFrame, rules: Rules = RULES, known: DataFrame | None = None) -> DataFrame:
    """``(i, n_far)``: for each report how many earlier ones, of these or of ``known``, show nearly the same photo farther
    away than the rule's limit.

    No pairs of far reports are made.  Those with the same or a similar fingerprint are counted by running counts over
    fingerprints; the ones of them that are near, in the cells around, are counted by a spatial join and taken off.  The
    near ones are few even for a photo that was sent a million times from everywhere, and those of one place are counted
    by distinct positions."""
    bits, least_m = rules.limits("PHOTO_REUSED_ELSEWHERE")
    known = reports if known is None else known
    distinct = known.select("fp").distinct()
    near = hamming_pairs(distinct, bits).select("a", "b")
    both = near.union(near.select("b", "a")).union(distinct.select("fp", "fp")).toDF("fp", "other")
    new = reports.select(F.col("id").alias("i"), "lat", "lon", F.col("fp").alias("a"))
    old = known.select(F.col("id").alias("j"), F.col("lat").alias("jlat"), F.col("lon").alias("jlon"), F.col("fp").alias("b"))
    similar = written(both.toDF("a", "b"), "similar")
    total = earlier_counts(new, old, similar)
    beside = _near_counts(new, old, similar, least_m)
    found = total.join(beside.withColumnRenamed("n", "near").hint("merge"), "i", "left")
    return found.select("i", (F.col("n") - F.coalesce("near", F.lit(0))).alias("n_far")).filter("n_far > 0")


def earlier_counts(new: DataFrame, old: DataFrame, links: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """``(i, n)``, n above zero: for each row of ``new(i, a)`` the rows of ``old(j, b)`` with ``j < i`` whose ``b`` its
    ``a`` is linked to by ``links(a, b)``, distinct pairs of keys.  Rows of a link are counted in windows of ``chunk``
    ids, on top of the sums of the windows before; so a key of a third of all rows is many windows, and no pairs are made."""
    place = lambda c: F.floor(F.col(c) / chunk).alias("chunk")
    asks = new.select("a", "i").join(links.hint("merge"), "a").select("a", "b", F.col("i").alias("id"), place("i"), F.lit(0).alias("one"))
    have = old.select("b", "j").join(links.hint("merge"), "b").select("a", "b", F.col("j").alias("id"), place("j"), F.lit(1).alias("one"))
    inside = Window.partitionBy("a", "b", "chunk").orderBy("id", "one").rowsBetween(Window.unboundedPreceding, 0)
    own = asks.unionByName(have).withColumn("n", F.sum("one").over(inside)).filter("one = 0")
    sizes = old.groupBy(F.col("b").alias("kb"), place("j").alias("kc")).agg(F.count("*").alias("size"))
    # each window that asks needs the sum of all before it: of its key's sizes and questions, in order
    wanted = own.select(F.col("b").alias("kb"), F.col("chunk").alias("kc")).distinct().withColumn("size", F.lit(None).cast("long"))
    before = Window.partitionBy("kb").orderBy("kc").rangeBetween(Window.unboundedPreceding, -1)
    base = sizes.unionByName(wanted).withColumn("base", F.sum("size").over(before)).groupBy("kb", "kc").agg(F.max("base").alias("base"))
    return own.join(base.hint("merge"), (F.col("b") == F.col("kb")) & (F.col("chunk") == F.col("kc"))).groupBy(F.col("id").alias("i")).agg(F.sum(F.col("n") + F.coalesce("base", F.lit(0))).alias("n")).filter("n > 0")


#: Metres of a degree on the sphere that ``haversine_m`` measures, and the slack of bounds on cells.
_METRES, _SLACK = EARTH_M * math.pi / 180, 0.005


def _near_counts(new: DataFrame, old: DataFrame, similar: DataFrame, within: float, parts: int = 8) -> DataFrame:
    """``(i, n)``: rows of ``old`` with a similar fingerprint and ``j < i`` that lie ``within`` metres.

    The plane is cut into tiles, ``parts`` in a length of ``within``.  Occupied tiles of similar fingerprints are joined
    over coarse cells.  Where any two points of two tiles are near, their rows are counted, not paired; where all
    are far they are left; only rows of tiles that straddle the distance are paired.  Covers latitudes up to 89.9."""
    size = within / _METRES  # a cell, in degrees of latitude
    tiles = size / parts

    def laid(rows: DataFrame, lat: str, lon: str, key: str) -> DataFrame:
        row = F.floor(F.col(lat) / size)
        wide = size / F.greatest(F.lit(1e-3), F.cos(F.radians(F.greatest(F.abs(row), F.abs(row + 1)) * size)))
        spot = F.struct(F.floor(F.col(lat) / tiles).alias("y"), F.floor(F.col(lon) * parts / wide).alias("x"), row.alias("row"), wide.alias("wide"))
        return rows.withColumn("tile", spot).withColumn("key", F.struct(F.col(key).alias("print"), F.col("tile.y"), F.col("tile.x")))

    n, o = laid(new, "lat", "lon", "a"), laid(old, "jlat", "jlon", "b")
    # the same longitude has two names at the date line
    wrapped = laid(old.filter(F.abs("jlon") > 179).withColumn("jlon", F.col("jlon") - 360 * F.signum("jlon")), "jlat", "jlon", "b")
    o = o.unionByName(wrapped)
    left = n.select("a", F.col("key").alias("ka"), F.col("tile").alias("ta")).distinct()
    right = o.select("b", F.col("key").alias("kb"), F.col("tile").alias("tb")).distinct()

    def columns(tile: Column, row: Column, reach: int) -> Column:
        """The coarse columns, in the widths of ``row``, that a tile may meet."""
        wide = size / F.greatest(F.lit(1e-3), F.cos(F.radians(F.greatest(F.abs(row), F.abs(row + 1)) * size)))
        west, east = tile["x"] * tile["wide"] / parts, (tile["x"] + 1) * tile["wide"] / parts
        return F.sequence(F.floor(west / wide) - reach, F.floor(east / wide) + reach)

    cell = lambda row, col: F.struct(row.alias("row"), col.alias("col"))
    rows_around = F.sequence(F.col("ta.row") - 1, F.col("ta.row") + 1)
    left = left.withColumn("cell", F.explode(F.flatten(F.transform(rows_around, lambda r: F.transform(columns(F.col("ta"), r, 1), lambda c: cell(r, c))))))
    right = right.withColumn("cell", cell(F.col("tb.row"), F.floor(F.col("tb.x") / parts)))
    met = left.join(similar.hint("merge"), "a").join(right.hint("merge"), ["b", "cell"])

    def side(t: str, axis: str, far: int) -> Column:
        return (F.col(f"{t}.{axis}") + far) * (F.lit(tiles) if axis == "y" else F.col(f"{t}.wide") / parts)

    def bounds(axis: str) -> tuple[Column, Column]:
        apart = F.greatest(side("ta", axis, 0) - side("tb", axis, 1), side("tb", axis, 0) - side("ta", axis, 1), F.lit(0.0))
        return apart, F.greatest(side("ta", axis, 1) - side("tb", axis, 0), side("tb", axis, 1) - side("ta", axis, 0))

    (y0, y1), (x0, x1) = bounds("y"), bounds("x")
    steep = [F.abs(side(t, "y", k)) for t in ("ta", "tb") for k in (0, 1)]
    widest = F.when(F.greatest(*steep) < 1, 1.0).otherwise(F.cos(F.radians(F.least(*steep))))
    narrow = F.cos(F.radians(F.least(F.greatest(*steep), F.lit(90.0))))
    least, most = (_METRES * F.sqrt(y * y + x * x * c * c) for y, x, c in ((y0, x0, narrow), (y1, x1, widest)))
    met = met.select("ka", "kb", (most * (1 + _SLACK) <= within).alias("inside"), (least * (1 - _SLACK) <= within).alias("reach")).filter("reach").distinct()
    met = written(met, "tiles")
    sure = earlier_counts(n.select(F.col("key").alias("a"), "i"), o.select(F.col("key").alias("b"), "j"), met.filter("inside").select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    edge = n.select("i", "lat", "lon", F.col("key").alias("ka")).join(met.filter(~F.col("inside")).hint("merge"), "ka").join(o.select("j", "jlat", "jlon", F.col("key").alias("kb")).hint("merge"), "kb")
    edge = edge.filter((F.col("i") > F.col("j")) & (geo.haversine_m(F.col("lat"), F.col("lon"), F.col("jlat"), F.col("jlon")) <= within))
    return sure.unionByName(edge.groupBy("i").agg(F.count("*").alias("n"))).groupBy("i").agg(F.sum("n").alias("n"))


def nearest_point(samples: DataFrame, truth: DataFrame, by: str, within: float) -> DataFrame:
    """Each sample ``(by, s, x, y)`` with its nearest truth point ``(by, t, tx, ty)`` if within ``within``: an
    equi-join on the item and on grid cells of that size."""
    cell = lambda c: F.floor(F.col(c) / within).cast("long")
    spread = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda a: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda b: F.struct((cell("x") + a).alias("cx"), (cell("y") + b).alias("cy"))))))
    probe = samples.withColumn("_c", spread).select("*", "_c.*").drop("_c")
    build = truth.withColumns({"cx": cell("tx"), "cy": cell("ty")})
    d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    best = probe.join(build, [by, "cx", "cy"]).filter(d2 <= within * within).groupBy(by, "s").agg(F.min(F.struct(d2.alias("d2"), F.col("t").alias("t"))).alias("m"))
    return best.select(by, "s", "m.t", F.sqrt("m.d2").alias("d"))


def fingerprint_of_vector(v: Column) -> Column:
    """The sign bits of 64 numbers."""
    bits = F.transform(v, lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def same_group_pairs(rows: DataFrame, group: str, key: str, fp: str, block: int = 1024) -> DataFrame:
    """Unordered pairs inside each group with their Hamming distance.  A group is dealt over blocks of some ``block`` rows,
    and each pair of blocks is a key of its own, so a task has bounded keys however large a group is."""
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    rows = rows.join(sizes, F.col(group) == F.col("_g")).select(group, F.col(key).alias("k"), F.col(fp).alias("f"), "_n", F.pmod(F.xxhash64(key), "_n").cast("int").alias("_b"))
    a = rows.select(group, F.col("k").alias("ka"), F.col("f").alias("fa"), F.col("_b").alias("_p"), F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("_q"))
    b = rows.select(group, F.col("k").alias("kb"), F.col("f").alias("fb"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_p"), F.col("_b").alias("_q"))
    met = a.hint("merge").join(b, [group, "_p", "_q"]).filter("ka < kb or (_p < _q and kb < ka)")
    return met.select(group, F.least("ka", "kb").alias("i"), F.greatest("ka", "kb").alias("j"), hashing.hamming(F.col("fa"), F.col("fb")).alias("distance"))


def with_parent(rows: DataFrame, parent: DataFrame) -> DataFrame:
    """``rows(id, duplicate_of, ...)`` with the columns of ``parent(pid, ...)`` that ``duplicate_of`` names, or nulls.  Rows
    without a parent go by their own id: under a null all of them would be in one task."""
    known = F.col("duplicate_of").isNotNull()
    return rows.join(parent, (F.coalesce("duplicate_of", "id") == F.col("pid")) & known, "left")
