"""Synthetic walls and report streams: one random generator for each row, so rows don't depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def wall(seed: int, i: int, size: int = 128, width_px: float = 3.0, crack: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A grey wall in 0..1, textured and shaded, and its crack mask."""
    rng = np.random.default_rng([seed, i])
    img = np.full((size, size), rng.uniform(0.55, 0.8))
    for octave in (4, 8, 16, 32):  # fractal texture
        coarse = rng.normal(0, 0.05 / np.sqrt(octave), (octave + 1, octave + 1))
        at = np.linspace(0, octave, size)
        k, f = np.minimum(at.astype(int), octave - 1), at - np.minimum(at.astype(int), octave - 1)
        rows = coarse[k] * (1 - f)[:, None] + coarse[k + 1] * f[:, None]
        img += rows[:, k] * (1 - f) + rows[:, k + 1] * f
    for _ in range(int(rng.integers(0, 30))):  # pores
        y, x = rng.integers(2, size - 2, 2)
        img[y - 1 : y + 1, x - 1 : x + 1] -= 0.2
    img *= np.linspace(1, rng.uniform(0.6, 1), size)[None, :]  # shadow
    mask = np.zeros((size, size), bool)
    if crack:
        y = size / 2 + np.cumsum(rng.normal(0, 0.5, size)) * 0.6
        y += (size / 2 - y) * 0.1
        taper = np.clip(np.minimum(np.arange(size), size - 1 - np.arange(size)) / 8, 0.2, 1) * width_px / 2
        d = np.abs(np.arange(size)[:, None] - y[None, :])
        mask = d <= taper[None, :]
        img = img * (1 - 0.6 * np.clip(taper[None, :] + 0.5 - d, 0, 1))
    return np.clip(img + rng.normal(0, 0.005, img.shape), 0, 1), mask


def walls(spark: SparkSession, n: int, seed: int = 1000, size: int = 128, cracked: int | None = None) -> DataFrame:
    """``(item_id, size, width_px, has_crack, gray, mask)``: log-uniform widths; the first ``cracked`` walls have a
    crack, or else all but every fourth;
    ``gray`` float32 and ``mask`` uint8, row by row."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["id"]:
                px = float(np.exp(np.random.default_rng([seed, int(i), 1]).uniform(np.log(1.5), np.log(8))))
                has = bool(i % 4 != 0 if cracked is None else i < cracked)
                gray, mask = wall(seed, int(i), size, px, has)
                rows.append((i, size, px, has, gray.astype("<f4").tobytes(), mask.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["item_id", "size", "width_px", "has_crack", "gray", "mask"])

    return spark.range(n).mapInPandas(make, "item_id long, size int, width_px double, has_crack boolean, gray binary, mask binary")


KINDS = ("first", "followup", "corroborate", "double_tap", "viral", "prank_junk", "prank_reused", "wrong_building", "flood", "late")


def events(spark: SparkSession, n: int, seed: int = 0, sigma: float = 6.0, walls: int = 120) -> DataFrame:
    """A labelled report stream: ``(id, kind, wall, device, received_us, captured_us, lat, lon, accuracy_m, fp)``."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                kind, w = KINDS[int(rng.integers(len(KINDS)))], int(rng.integers(walls))
                home = np.random.default_rng([seed, 1, w])
                lat, lon, fp = 37.55 + home.random() * 0.03, 126.96 + home.random() * 0.03, int(home.integers(0, 1 << 63))
                if kind == "prank_reused":
                    lat += 0.01
                if kind == "wrong_building":
                    lat += 0.0009
                flips = {"double_tap": 2, "viral": 2, "prank_reused": 1}.get(kind, 10)
                for bit in rng.choice(63, flips, replace=False):
                    fp ^= 1 << int(bit)
                if kind == "prank_junk":
                    fp = int(rng.integers(0, 1 << 63))
                at = int(i) * 600_000_000
                rows.append((i + 1, kind, w, "dev-flood" if kind == "flood" else f"dev-{int(rng.integers(150))}", at, at - int(rng.integers(0, 3600)) * 1_000_000,
                             lat + rng.normal(0, sigma) / 111320, lon + rng.normal(0, sigma) / 88250, float(abs(rng.normal(sigma, 2)) + 3), fp))
            yield pd.DataFrame(rows, columns=["id", "kind", "wall", "device", "received_us", "captured_us", "lat", "lon", "accuracy_m", "fp"])

    return spark.range(n).mapInPandas(make, "id long, kind string, wall long, device string, received_us long, captured_us long, lat double, lon double, accuracy_m double, fp long")


def seed_if_empty(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` if ``table`` is empty, else the table."""
    return rows if table.isEmpty() else table
