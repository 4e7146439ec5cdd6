"""Colour science as column expressions; colours are structs or triples of columns in 0..1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sRGB to XYZ under D65 and its inverse, Bradford cone response, white points (fixed values).
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
D65 = (0.95047, 1.0, 1.08883)
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
ILLUMINANTS = {"D65": (0.31272, 0.32903), "D75": (0.29902, 0.31485), "F2": (0.37208, 0.37529), "A": (0.44757, 0.40745), "2500K": (0.47701, 0.41366)}
Triple = tuple[Column, Column, Column]


def inverse3(m) -> tuple:
    """Inverse of a 3x3 matrix by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    co = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    det = a * co[0][0] + b * co[1][0] + c * co[2][0]
    return tuple(tuple(x / det for x in row) for row in co)


XYZ_TO_RGB, BRADFORD_INV = inverse3(RGB_TO_XYZ), inverse3(BRADFORD)


def _apply(m, v: Triple) -> Triple:
    return tuple(m[r][0] * v[0] + m[r][1] * v[1] + m[r][2] * v[2] for r in range(3))


def to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(c: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def linear_to_xyz(rgb: Triple) -> Triple:
    return _apply(RGB_TO_XYZ, rgb)


def xyz_to_linear(xyz: Triple) -> Triple:
    return _apply(XYZ_TO_RGB, xyz)


def xyz_to_lab(xyz: Triple) -> Triple:
    eps, kappa = 216 / 24389, 24389 / 27
    f = [F.when(v / w > eps, F.cbrt(v / w)).otherwise((kappa * (v / w) + 16) / 116) for v, w in zip(xyz, D65, strict=True)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


# Chains of these functions are built as steps of a DataFrame, each over plain columns: nested in one expression,
# every use of an intermediate would repeat its whole tree.


def steps(df: DataFrame, start: Triple, functions: list, out: tuple[str, str, str]) -> DataFrame:
    """``df`` with columns ``out``: ``start`` taken through ``functions`` from triple to triple, one after another."""
    own = df.columns
    names = ("_0", "_1", "_2")
    df = df.withColumns(dict(zip(names, start, strict=True)))
    for f in functions:
        df = df.withColumns(dict(zip(names, f(tuple(F.col(n) for n in names)), strict=True)))
    return df.select(*[c for c in own if c not in out], *[F.col(n).alias(o) for n, o in zip(names, out, strict=True)])


def each(f):
    return lambda v: tuple(f(c) for c in v)


def with_lab(df: DataFrame, rgb: Triple, out: tuple[str, str, str]) -> DataFrame:
    """sRGB to Lab."""
    return steps(df, rgb, [each(to_linear), linear_to_xyz, xyz_to_lab], out)


def with_srgb_of_lab(df: DataFrame, lab: Triple, out: tuple[str, str, str]) -> DataFrame:
    eps, kappa = 216 / 24389, 24389 / 27

    def cone(v: Triple) -> Triple:
        fy = (v[0] + 16) / 116
        return fy + v[1] / 500, fy, fy - v[2] / 200

    def xyz(f: Triple) -> Triple:
        return tuple(F.when(t * t * t > eps, t * t * t).otherwise((116 * t - 16) / kappa) * w for t, w in zip(f, D65, strict=True))

    return steps(df, lab, [cone, xyz, xyz_to_linear, each(to_srgb)], out)


def lab_of(rgb: tuple[float, float, float]) -> tuple[float, float, float]:
    """Lab of a constant colour, as plain numbers."""
    lin = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in rgb]
    ratio = [sum(m * c for m, c in zip(row, lin, strict=True)) / w for row, w in zip(RGB_TO_XYZ, D65, strict=True)]
    f = [r ** (1 / 3) if r > 216 / 24389 else (24389 / 27 * r + 16) / 116 for r in ratio]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def luma709(rgb: Triple) -> Column:
    return 0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2]


def luma601(rgb: Triple) -> Column:
    return 0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2]


#: CIEDE2000 over columns of (q_l1, q_a1, q_b1, q_l2, q_a2, q_b2) as a ladder of named steps; each step may use earlier ones.
#: The text is valid SQL in Spark and in DuckDB alike, so one definition serves both.
DELTA_E_STEPS = (
    {"q_cm": "(sqrt(q_a1*q_a1+q_b1*q_b1) + sqrt(q_a2*q_a2+q_b2*q_b2)) / 2"},
    {"q_g": "0.5e0 * (1 - sqrt(power(q_cm, 7) / (power(q_cm, 7) + 6103515625e0)))"},
    {"q_p1": "(1 + q_g) * q_a1", "q_p2": "(1 + q_g) * q_a2"},
    {"q_c1": "sqrt(q_p1*q_p1 + q_b1*q_b1)", "q_c2": "sqrt(q_p2*q_p2 + q_b2*q_b2)", "q_u1": "degrees(atan2(q_b1, q_p1))", "q_u2": "degrees(atan2(q_b2, q_p2))"},
    {"q_h1": "case when q_p1 = 0 and q_b1 = 0 then 0e0 when q_u1 < 0 then q_u1 + 360 else q_u1 end", "q_h2": "case when q_p2 = 0 and q_b2 = 0 then 0e0 when q_u2 < 0 then q_u2 + 360 else q_u2 end", "q_grey": "q_c1 * q_c2 = 0"},
    {"q_dh": "case when q_grey then 0e0 when q_h2 - q_h1 > 180 then q_h2 - q_h1 - 360 when q_h2 - q_h1 < -180 then q_h2 - q_h1 + 360 else q_h2 - q_h1 end",
     "q_hm": "case when q_grey then q_h1 + q_h2 when abs(q_h1 - q_h2) <= 180 then (q_h1 + q_h2) / 2 when q_h1 + q_h2 < 360 then (q_h1 + q_h2 + 360) / 2 else (q_h1 + q_h2 - 360) / 2 end",
     "q_lm": "(q_l1 + q_l2) / 2", "q_km": "(q_c1 + q_c2) / 2"},
    {"q_t": "1 - 0.17e0 * cos(radians(q_hm - 30)) + 0.24e0 * cos(radians(2 * q_hm)) + 0.32e0 * cos(radians(3 * q_hm + 6)) - 0.20e0 * cos(radians(4 * q_hm - 63))",
     "q_turn": "-sin(radians(60 * exp(-power((q_hm - 275) / 25, 2)))) * 2 * sqrt(power(q_km, 7) / (power(q_km, 7) + 6103515625e0))"},
    {"q_tl": "(q_l2 - q_l1) / (1 + 0.015e0 * power(q_lm - 50, 2) / sqrt(20 + power(q_lm - 50, 2)))", "q_tc": "(q_c2 - q_c1) / (1 + 0.045e0 * q_km)",
     "q_th": "2 * sqrt(q_c1 * q_c2) * sin(radians(q_dh) / 2) / (1 + 0.015e0 * q_km * q_t)"},
    {"delta_e": "sqrt(greatest(0e0, q_tl*q_tl + q_tc*q_tc + q_th*q_th + q_turn * q_tc * q_th))"},
)


def with_delta_e(df, left: Triple, right: Triple, name: str = "delta_e"):
    """``df`` with the CIEDE2000 difference of two Lab triples."""
    own = df.columns
    out = df.withColumns(dict(zip(("q_l1", "q_a1", "q_b1", "q_l2", "q_a2", "q_b2"), (*left, *right), strict=True)))
    for step in DELTA_E_STEPS:
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    return out.select(*own, F.col("delta_e").alias(name))


def adapt(xyz: Triple, src: tuple, dst: tuple, strength: float = 1.0) -> Triple:
    """Von Kries adaptation of white ``src`` to ``dst``; whites are plain numbers, so ratios are constants."""
    number = lambda w: [sum(BRADFORD[r][k] * w[k] for k in range(3)) for r in range(3)]
    ratio = [(d / s) ** strength for d, s in zip(number(dst), number(src), strict=True)]
    cone = _apply(BRADFORD, xyz)
    return _apply(BRADFORD_INV, tuple(c * r for c, r in zip(cone, ratio, strict=True)))


def white(name: str) -> tuple:
    x, y = ILLUMINANTS[name]
    return x / y, 1.0, (1 - x - y) / y


def with_capture(df: DataFrame, rgb: Triple, illuminant: str, awb: float, exposure: float, flare: float, out: tuple[str, str, str]) -> DataFrame:
    """A D65 colour as a camera sees it under another light, noise off."""
    dst = white(illuminant)
    light, balance = (lambda v: adapt(v, D65, dst)), (lambda v: adapt(v, dst, D65, awb))
    return steps(df, rgb, [each(to_linear), linear_to_xyz, light, balance, xyz_to_linear, each(lambda c: c * exposure + flare), each(to_srgb)], out)


def with_correction(df: DataFrame, rgb: Triple, gain: Triple, offset: Triple, out: tuple[str, str, str]) -> DataFrame:
    return steps(df, rgb, [each(to_linear), lambda v: tuple((c - o) / g for c, g, o in zip(v, gain, offset, strict=True)), each(to_srgb)], out)
