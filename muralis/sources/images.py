"""Image files and raw arrays as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def rgb_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, h, w, rgb)`` of PNG and JPEG files; ``rgb`` float32 in 0..1, row by row.  Spark decodes to BGR."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, h, w, c, data in b.itertuples(index=False):
                img = np.frombuffer(data, np.uint8).reshape(h, w, c)
                img = np.repeat(img, 3, axis=2) if c == 1 else img[:, :, 2::-1]
                out.append((p, h, w, (img / np.float32(255)).astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["path", "h", "w", "rgb"])

    raw = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return raw.mapInPandas(turn, "path string, h int, w int, rgb binary")


def masks(spark: SparkSession, path: str) -> DataFrame:
    """``(path, h, w, mask)``: grey above 127 is 1."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, h, w, (np.frombuffer(d, np.uint8).reshape(h, w, c)[:, :, 0] > 127).astype(np.uint8).tobytes()) for p, h, w, c, d in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "h", "w", "mask"])

    raw = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return raw.mapInPandas(turn, "path string, h int, w int, mask binary")


def raw_arrays(spark: SparkSession, path: str, dtype: str = "<f4") -> DataFrame:
    """``(path, values)`` of files of little-endian numbers."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "values": [np.frombuffer(c, dtype).astype(float).tolist() for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(turn, "path string, values array<double>")


def number_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A text table of numbers between white space."""
    from pyspark.sql import functions as F

    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(*[parts[i].cast("double").alias(n) for i, n in enumerate(names)])
