"""Reports laid out along a space-filling curve, so that a map's viewport opens only the files that it meets.

Rows are written in the order of a Z-curve over latitude and longitude, with an index of the files' key ranges beside
them.  A box is decomposed into a bounded number of ranges of the curve, by descending the quadtree; files whose ranges
meet none of them aren't opened, inside a file row groups are skipped by the same ranges, and the exact box is checked
last.  Ranges that are given up for the bound only let more rows through to that check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Halvings of each axis; a cell of the last level is about a metre.
BITS = 24
_KEY = "_z"
#: Shifts and masks that put a zero bit after each of 32 bits (fixed values).
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _grid(x: Column, low: float, span: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((x - low) / span * (1 << BITS)))).cast("long")


def _spread(v: Column) -> Column:
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve_key(lat: Column, lon: Column) -> Column:
    """Place on the curve; null for null or NaN coordinates."""
    y, x = _grid(lat, -90.0, 180.0), _grid(lon, -180.0, 360.0)
    return F.when(~(F.isnan(lat) | F.isnan(lon)), F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x)))


def box_ranges(south: float, north: float, west: float, east: float, most: int = 64) -> list[tuple[int, int]]:
    """At most about ``most`` ranges of curve keys, both ends included, that hold all keys of the box."""
    top = (1 << BITS) - 1
    cell = lambda v, low, span: max(0, min(top, int((v - low) / span * (1 << BITS) // 1)))
    # an index more on each side, as the two floors may round apart
    y0, y1 = max(0, cell(south, -90, 180) - 1), min(top, cell(north, -90, 180) + 1)
    x0, x1 = max(0, cell(west, -180, 360) - 1), min(top, cell(east, -180, 360) + 1)
    if south > north or west > east:
        return []
    done, level = [], [(0, 0, 0, BITS)]  # key, y, x of a square, and halvings left
    while level:
        following = []
        for key, y, x, left in level:
            side = 1 << left
            if y > y1 or y + side <= y0 or x > x1 or x + side <= x0:
                continue
            inside = y0 <= y and y + side - 1 <= y1 and x0 <= x and x + side - 1 <= x1
            if inside or left == 0:
                done.append((key, key + side * side - 1))
                continue
            half, quarter = side // 2, side * side // 4
            following += [(key + k * quarter, y + (k >> 1) * half, x + (k & 1) * half, left - 1) for k in range(4)]
        if len(done) + len(following) > most:
            done += [(key, key + (1 << 2 * left) - 1) for key, y, x, left in following if not (y > y1 or y + (1 << left) <= y0 or x > x1 or x + (1 << left) <= x0)]
            break
        level = following
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def write_clustered(rows: DataFrame, path: str, lat: str = "lat", lon: str = "lon", files: int = 64) -> None:
    """``rows`` in about ``files`` files along the curve at ``path/rows``, and the files' key ranges at ``path/index``.  Rows
    of one place are dealt by a hash as well, so that a crowded place isn't one file."""
    keyed = rows.withColumn(_KEY, curve_key(F.col(lat), F.col(lon)))
    tie = F.xxhash64(*[c for c in rows.columns])
    keyed.repartitionByRange(files, _KEY, tie).sortWithinPartitions(_KEY).write.parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows")
    stored.groupBy(F.input_file_name().alias("file")).agg(F.min(_KEY).alias("low"), F.max(_KEY).alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/index")


def files_of_box(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> list[str]:
    """The files that hold keys of the ranges; as many names come to the driver as files are opened."""
    index = spark.read.parquet(f"{path}/index")
    meets = F.lit(False)
    for a, b in ranges:
        meets = meets | ((F.col("low") <= b) & (F.col("high") >= a))
    return [r.file for r in index.filter(meets).select("file").collect()]


def read_box(spark: SparkSession, path: str, south: float, north: float, west: float, east: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows of ``write_clustered`` in the box, edges included."""
    ranges = box_ranges(south, north, west, east)
    found = files_of_box(spark, path, ranges)
    whole = spark.read.parquet(f"{path}/rows")
    rows = spark.read.schema(whole.schema).parquet(*found) if found else whole.limit(0)
    keys = F.lit(False)
    for a, b in ranges:
        keys = keys | F.col(_KEY).between(a, b)
    return rows.filter(keys & F.col(lat).between(south, north) & F.col(lon).between(west, east)).drop(_KEY)
