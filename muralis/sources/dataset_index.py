"""Image data set indexing: classification by file name prefix, licence filter, hash split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.functions import hashing


def prefix_classify(name: Column, prefixes: list[tuple[str, str]], default: str = "other") -> Column:
    """The label of the first matching prefix in list order."""
    out = F.lit(default)
    for prefix, label in reversed(prefixes):
        out = F.when(F.startswith(name, F.lit(prefix)), label).otherwise(out)
    return out


def filename_key(stem: Column, drop: int) -> Column:
    """The stem without its last ``drop`` parts between underscores."""
    parts = F.split(stem, "_")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - drop, F.lit(0))), "_")


def split_by_hash(key: Column) -> Column:
    """train below 80, val below 90, else test, by SHA-1 modulo 100."""
    h = hashing.sha1_mod100(key)
    return F.when(h < 80, "train").when(h < 90, "val").otherwise("test")


def index(images: DataFrame, masks: DataFrame, prefixes: list[tuple[str, str]], banned: list[str], drop: int = 1) -> DataFrame:
    """Usable images: allowed source and a mask of the same name.  ``images(path)``, ``masks(path)``."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    named = images.withColumn("stem", stem).withColumn("source", prefix_classify(F.col("stem"), prefixes))
    have = masks.select(stem.alias("stem")).distinct()
    return named.filter(~F.col("source").isin(banned)).join(have, "stem", "left_semi").withColumn("split", split_by_hash(filename_key(F.col("stem"), drop)))
