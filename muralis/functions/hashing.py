"""Perceptual fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(hex16: Column) -> Column:
    """Sixteen hex digits as a BIGINT of the same bits."""
    return F.conv(hex16, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two BIGINT fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of hex strings of one length, in blocks of 16 digits; 64 if the lengths differ."""
    blocks = F.sequence(F.lit(0), F.ceil(F.length(a) / 16).cast("int") - 1)
    part = lambda s, i: fingerprint(F.substring(s, i * 16 + 1, F.lit(16)))
    bits = F.aggregate(F.transform(blocks, lambda i: hamming(part(a, i), part(b, i)).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.length(a) == F.length(b), bits).otherwise(F.lit(64))


#: Three bands over 64 bits, (first bit, bits): eight flips leave a band with two of them at most.
BANDS = ((0, 21), (21, 21), (42, 22))


def band(fp: Column, i: int) -> Column:
    at, n = BANDS[i]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def bands(fps: DataFrame) -> DataFrame:
    """``fps(fp)`` with (band, flip, bits): each band as it is (flip 0), and with its bit ``flip - 1`` flipped."""
    ways = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(k + 1).alias("flip"), F.lit(at).alias("at"), F.lit((1 << n) - 1).alias("mask"), F.lit((1 << k) if k >= 0 else 0).alias("toggle")) for i, (at, n) in enumerate(BANDS) for k in range(-1, n)])
    bits = F.call_function("shiftrightunsigned", F.col("fp"), F.col("at")).bitwiseAND(F.col("mask")).bitwiseXOR(F.col("toggle"))
    return fps.select("fp", F.inline(ways)).select("fp", "band", "flip", bits.cast("int").alias("bits"))


def sha1_mod100(key: Column) -> Column:
    """The 160-bit SHA-1 of a string modulo 100, digit by digit."""
    digits = F.transform(F.split(F.sha1(key.cast("binary")), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda acc, d: (acc * 16 + d) % 100)


def flip_bits(fp: Column, n: Column, seed: Column) -> Column:
    """``fp`` with ``n`` different bits of its 64 flipped, drawn by ``seed``: those whose hashes come first."""
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.struct(F.xxhash64(seed, k).alias("h"), k.alias("k"))))
    taken = F.slice(drawn, F.lit(1), F.greatest(F.lit(0), F.least(n, F.lit(64))).cast("int"))
    return F.aggregate(taken, fp, lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["k"])))
