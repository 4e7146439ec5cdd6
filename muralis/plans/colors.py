"""Colour science."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis import config
from muralis.functions import color
from muralis.operators import calibration
from muralis.plans.registry import query
from muralis.sources import carrier

RGB_SQL = "SELECT p_partkey, (p_partkey*37 % 256)/255e0 AS r, (p_partkey*91 % 256)/255e0 AS g, (p_partkey*53 % 256)/255e0 AS b FROM part"


def rgb(spark, d):
    k = F.col("p_partkey")
    return carrier.table(spark, d, "part").select("p_partkey", *[((k * m % 256) / F.lit(255.0)).alias(c) for m, c in ((37, "r"), (91, "g"), (53, "b"))])




def triple(names="rgb"):
    return tuple(F.col(c) for c in names)


def lin(c):
    return f"(CASE WHEN {c} <= 0.04045e0 THEN {c}/12.92e0 ELSE pow(({c}+0.055e0)/1.055e0, 2.4e0) END)"


def srgb(c):
    x = f"greatest(0e0, least(1e0, {c}))"
    return f"(CASE WHEN {x} <= 0.0031308e0 THEN {x}*12.92e0 ELSE 1.055e0*pow({x}, {1 / 2.4!r}e0) - 0.055e0 END)"


def mat(m, v):
    return tuple("(" + " + ".join(f"({k!r}e0)*{x}" if "e" not in repr(k) else f"({k!r})*{x}" for k, x in zip(row, v, strict=True)) + ")" for row in m)


def lab_steps(r, g, b, names, base):
    """Nested selects that add Lab columns ``names`` for the sRGB columns r, g, b of ``base``."""
    one = f"SELECT *, {lin(r)} AS _r, {lin(g)} AS _g, {lin(b)} AS _b FROM ({base})"
    xyz = mat(color.RGB_TO_XYZ, ("_r", "_g", "_b"))
    two = f"SELECT *, " + ", ".join(f"{x}/{w!r}e0 AS _{n}" for x, w, n in zip(xyz, color.D65, "xyz", strict=True)) + f" FROM ({one})"
    f = lambda c: f"(CASE WHEN {c} > {216 / 24389!r}e0 THEN cbrt({c}) ELSE ({24389 / 27!r}e0*{c} + 16)/116 END)"
    three = f"SELECT *, {f('_x')} AS _fx, {f('_y')} AS _fy, {f('_z')} AS _fz FROM ({two})"
    return f"SELECT * EXCLUDE (_r, _g, _b, _x, _y, _z, _fx, _fy, _fz), 116*_fy - 16 AS {names[0]}, 500*(_fx - _fy) AS {names[1]}, 200*(_fy - _fz) AS {names[2]} FROM ({three})"


def delta_steps(base):
    for step in color.DELTA_E_STEPS:
        base = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in step.items()) + f" FROM ({base})"
    return base


@query("srgb_to_linear", f"SELECT p_partkey, round({lin('r')}, 9) AS r, round({srgb('(' + lin('g') + '*1.1e0)')}, 9) AS g FROM ({RGB_SQL})")
def srgb_to_linear(spark, d):
    return rgb(spark, d).select("p_partkey", F.round(color.to_linear(F.col("r")), 9).alias("r"), F.round(color.to_srgb(color.to_linear(F.col("g")) * 1.1), 9).alias("g"))


@query("linear_to_srgb", f"SELECT p_partkey, round({srgb('(r*1.2e0 - 0.1e0)')}, 9) AS r FROM ({RGB_SQL})")
def linear_to_srgb(spark, d):
    return rgb(spark, d).select("p_partkey", F.round(color.to_srgb(F.col("r") * 1.2 - 0.1), 9).alias("r"))


@query("linear_to_xyz", "SELECT p_partkey, " + ", ".join(f"round({x}, 9) AS {n}" for x, n in zip(mat(color.RGB_TO_XYZ, "rgb"), "xyz", strict=True)) + f" FROM ({RGB_SQL})")
def linear_to_xyz(spark, d):
    return rgb(spark, d).select("p_partkey", *[F.round(v, 9).alias(n) for v, n in zip(color.linear_to_xyz(triple()), "xyz", strict=True)])


@query("xyz_to_linear", "SELECT p_partkey, " + ", ".join(f"round({x}, 9) AS o{n}" for x, n in zip(mat(color.XYZ_TO_RGB, "rgb"), "rgb", strict=True)) + f" FROM ({RGB_SQL})")
def xyz_to_linear(spark, d):
    return rgb(spark, d).select("p_partkey", *[F.round(v, 9).alias(f"o{n}") for v, n in zip(color.xyz_to_linear(triple()), "rgb", strict=True)])


LAB = lab_steps("r", "g", "b", ("q_l1", "q_a1", "q_b1"), RGB_SQL)


@query("srgb_to_lab", f"SELECT p_partkey, round(q_l1, 7) AS l, round(q_a1, 7) AS a, round(q_b1, 7) AS bb FROM ({LAB})")
def srgb_to_lab(spark, d):
    out = color.with_lab(rgb(spark, d), triple(), ("l", "a", "bb"))
    return out.select("p_partkey", *[F.round(n, 7).alias(n) for n in ("l", "a", "bb")])


@query("delta_e_2000", "SELECT p_partkey, round(delta_e, 6) AS delta_e FROM (" + delta_steps(lab_steps("g", "b", "r", ("q_l2", "q_a2", "q_b2"), LAB)) + ")")
def delta_e_2000(spark, d):
    one, two = ("x1", "y1", "z1"), ("x2", "y2", "z2")
    out = color.with_lab(color.with_lab(rgb(spark, d), triple("rgb"), one), triple("gbr"), two)
    out = color.with_delta_e(out, triple(one), triple(two))
    return out.select("p_partkey", F.round("delta_e", 6).alias("delta_e"))


@query("luma", f"SELECT p_partkey, round(0.2126e0*r + 0.7152e0*g + 0.0722e0*b, 9) AS y709, round(0.299e0*r + 0.587e0*g + 0.114e0*b, 9) AS y601 FROM ({RGB_SQL})")
def luma(spark, d):
    return rgb(spark, d).select("p_partkey", F.round(color.luma709(triple()), 9).alias("y709"), F.round(color.luma601(triple()), 9).alias("y601"))


FILM_BLUE, FILM_RED = (60 / 255, 70 / 255, 160 / 255), (180 / 255, 60 / 255, 55 / 255)
MARGIN = 3.0
GAIN, OFFSET = tuple(f"gain_{c}" for c in "rgb"), tuple(f"offset_{c}" for c in "rgb")


def lits(rgb_):
    return tuple(F.lit(float(v)) for v in rgb_)


def judged(df, rgb_, name="red"):
    """``df`` with the distances of a colour to both film colours and which is nearer."""
    names = ("_l", "_a", "_b")
    df = color.with_lab(df, rgb_, names)
    df = color.with_delta_e(df, triple(names), lits(color.lab_of(FILM_BLUE)), "d_blue")
    df = color.with_delta_e(df, triple(names), lits(color.lab_of(FILM_RED)), "d_red")
    return df.drop(*names).withColumn(name, F.col("d_red") < F.col("d_blue"))


def film_lab_sql(rgb_, names, base):
    return lab_steps(f"{rgb_[0]!r}e0", f"{rgb_[1]!r}e0", f"{rgb_[2]!r}e0", names, base)


_STEP_NAMES = ", ".join(k for s in color.DELTA_E_STEPS for k in s if k != "delta_e")
JUDGE_BLUE = f"SELECT * EXCLUDE (q_l2, q_a2, q_b2, delta_e, {_STEP_NAMES}), delta_e AS d_blue FROM (" + delta_steps(film_lab_sql(FILM_BLUE, ("q_l2", "q_a2", "q_b2"), LAB)) + ")"
JUDGE = f"SELECT p_partkey, d_blue, delta_e AS d_red FROM (" + delta_steps(film_lab_sql(FILM_RED, ("q_l2", "q_a2", "q_b2"), JUDGE_BLUE)) + ")"


@query("judge_red", f"SELECT p_partkey, d_red < d_blue AS red FROM ({JUDGE})")
def judge_red(spark, d):
    return judged(rgb(spark, d), triple()).select("p_partkey", "red")


@query("judge_sign", f"SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'hold' WHEN abs(d_red - d_blue) < 3 THEN 'hold' WHEN d_red < d_blue THEN 'red' ELSE 'blue' END AS sign FROM ({JUDGE})")
def judge_sign(spark, d):
    out = judged(rgb(spark, d), triple())
    sign = F.when(F.col("p_partkey") % 10 == 0, "hold").when(F.abs(F.col("d_red") - F.col("d_blue")) < MARGIN, "hold").when(F.col("red"), "red").otherwise("blue")
    return out.select("p_partkey", sign.alias("sign"))


SCENARIOS = (("daylight", "D65", 0.90, 1.00, 0.00), ("overcast", "D75", 0.80, 0.90, 0.01), ("fluorescent", "F2", 0.70, 0.80, 0.02), ("incandescent", "A", 0.60, 0.70, 0.02), ("dusk", "2500K", 0.50, 0.60, 0.03), ("dusk-backlight", "2500K", 0.50, 0.50, 0.08))
FILM_T = (0.0, 0.125, 0.25, 0.375, 0.625, 0.75, 0.875, 1.0)


def film_states(spark):
    """Film colours between blue and red, interpolated in Lab: ``(t, fr, fg, fb)``."""
    a, b = color.lab_of(FILM_BLUE), color.lab_of(FILM_RED)
    t = F.col("t")
    states = spark.createDataFrame([(v,) for v in FILM_T], "t double")
    return color.with_srgb_of_lab(states, tuple(x + t * (y - x) for x, y in zip(a, b, strict=True)), ("fr", "fg", "fb"))


@query("film_states")
def film_states_query(spark, d):
    return film_states(spark)


def captured(df, rgb_):
    """``df`` under each of the six lights: adds ``label, r, g, b``."""
    shots = [color.with_capture(df.withColumn("label", F.lit(label)), rgb_, light, awb, exposure, flare, ("r", "g", "b")) for label, light, awb, exposure, flare in SCENARIOS]
    return reduce(DataFrame.unionByName, shots)


def adapt_sql(v, src, dst, strength):
    number = lambda w: [sum(color.BRADFORD[r][k] * w[k] for k in range(3)) for r in range(3)]
    ratio = [(x / y) ** strength for x, y in zip(number(dst), number(src), strict=True)]
    cone = mat(color.BRADFORD, v)
    return mat(color.BRADFORD_INV, [f"({c}*{k!r}e0)" for c, k in zip(cone, ratio, strict=True)])


@query("adapt_bradford", "SELECT p_partkey, " + ", ".join(f"round({x}, 8) AS {n}" for x, n in zip(adapt_sql("rgb", color.D65, color.white("A"), 0.6), "xyz", strict=True)) + f" FROM ({RGB_SQL})")
def adapt_bradford(spark, d):
    out = color.adapt(triple(), color.D65, color.white("A"), 0.6)
    return rgb(spark, d).select("p_partkey", *[F.round(v, 8).alias(n) for v, n in zip(out, "xyz", strict=True)])


@query("capture")
def capture(spark, d):
    return captured(rgb(spark, d).select("p_partkey", *[F.col(c).alias(f"t{c}") for c in "rgb"]), triple(("tr", "tg", "tb")))


def observed(spark, d):
    """Six swatches seen by 300 virtual cameras with a linear response each."""
    cams = carrier.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cam"))
    s = F.broadcast(calibration.swatch_rows(spark))  # six rows
    rows = cams.withColumn("_one", F.lit(1)).join(s.withColumn("_one", F.lit(1)), "_one").drop("_one")
    k = F.col("cam")
    seen = [color.to_srgb(color.to_linear(F.col(f"t{c}")) * (0.5 + (k * m % 40) / F.lit(100.0)) + (k * m % 7) / F.lit(200.0)).alias(c) for c, m in (("r", 3), ("g", 5), ("b", 11))]
    return rows.select("*", *seen)


@query("fit_correction", "SELECT s_suppkey AS cam, " + ", ".join(f"round(0.5e0 + (s_suppkey*{m} % 40)/100e0, 6) AS gain_{c}, round((s_suppkey*{m} % 7)/200e0, 6) AS offset_{c}" for c, m in (("r", 3), ("g", 5), ("b", 11))) + ", 'good' AS quality FROM supplier")
def fit_correction(spark, d):
    fits = calibration.fit(observed(spark, d), ["cam"])
    return fits.select("cam", *[F.round(f"{n}_{c}", 6).alias(f"{n}_{c}") for n in ("gain", "offset") for c in "rgb"], "quality")


@query("agg_lsq_line", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_suppkey")
def agg_lsq_line(spark, d):
    return carrier.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("apply_correction", "SELECT s_suppkey AS cam, name AS swatch, round(v, 6) AS r FROM supplier, (SELECT unnest(['white','gray50','black','red','blue','gray18']) AS name, unnest([243/255e0, 122/255e0, 52/255e0, 175/255e0, 56/255e0, 85/255e0]) AS v)")
def apply_correction(spark, d):
    o = observed(spark, d)
    fits = calibration.fit(o, ["cam"])
    rows = color.with_correction(o.join(fits, "cam"), triple(), triple(GAIN), triple(OFFSET), ("x", "y", "z"))
    return rows.select("cam", "swatch", F.round("x", 6).alias("r"))


@query("color_study")
def color_study(spark, d):
    """Six lights: mean colour difference of swatches before and after correction, and false reds of the film."""
    s = calibration.swatch_rows(spark).select("swatch", "neutral", "tr", "tg", "tb")
    obs = captured(s, triple(("tr", "tg", "tb")))
    fits = calibration.fit(obs, ["label"])
    rows = obs.join(fits, "label")
    rows = color.with_lab(rows, triple(("tr", "tg", "tb")), ("tl", "ta", "tz"))
    rows = color.with_lab(rows, triple(), ("ol", "oa", "ob"))
    rows = color.with_correction(rows, triple(), triple(GAIN), triple(OFFSET), ("cr", "cg", "cb"))
    rows = color.with_lab(rows, triple(("cr", "cg", "cb")), ("cl", "ca", "cz"))
    rows = color.with_delta_e(rows, triple(("ol", "oa", "ob")), triple(("tl", "ta", "tz")), "before")
    rows = color.with_delta_e(rows, triple(("cl", "ca", "cz")), triple(("tl", "ta", "tz")), "after")
    mean = rows.groupBy("label").agg(F.avg(F.when(~F.col("neutral"), F.col("before"))).alias("before"), F.avg(F.when(~F.col("neutral"), F.col("after"))).alias("after"), F.first("quality").alias("quality"))
    film = captured(film_states(spark), triple(("fr", "fg", "fb"))).join(fits, "label")
    film = judged(film, triple(), "red_before").drop("d_blue", "d_red")
    film = color.with_correction(film, triple(), triple(GAIN), triple(OFFSET), ("cr", "cg", "cb"))
    film = judged(film, triple(("cr", "cg", "cb")), "red_after")
    truth = F.col("t") > 0.5
    signs = film.groupBy("label").agg(F.count_if(F.col("red_before") & ~truth).alias("false_red_before"), F.count_if(F.col("red_after") & ~truth).alias("false_red_after"), F.avg((F.col("red_after") == truth).cast("double")).alias("accuracy"))
    return mean.join(signs, "label")


@query("swatch_layout", "SELECT name AS swatch, x AS x_mm, y AS y_mm FROM (VALUES ('white', 25e0, 34e0), ('gray50', 39e0, 34e0), ('black', 53e0, 34e0), ('red', 25e0, 20e0), ('blue', 39e0, 20e0), ('gray18', 53e0, 20e0)) v(name, x, y)")
def swatch_layout(spark, d):
    return calibration.swatch_rows(spark).select("swatch", "x_mm", "y_mm")


@query("fiducial_centres", "SELECT x AS x_mm, y AS y_mm FROM (VALUES (6.5e0, 6.5e0), (83.5e0, 6.5e0), (6.5e0, 49.5e0), (83.5e0, 49.5e0)) v(x, y)")
def fiducial_centres(spark, d):
    c = config.CARD
    near, far_x, far_y = c["margin"] + c["fiducial"] / 2, c["w"] - c["margin"] - c["fiducial"] / 2, c["h"] - c["margin"] - c["fiducial"] / 2
    return spark.createDataFrame([(x, y) for y in (near, far_y) for x in (near, far_x)], "x_mm double, y_mm double")
