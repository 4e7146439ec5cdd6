"""Operator 1 - token ids in length-delimited binary records.

File format.  A shard is a run of frames, each one serialised sequence::

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

with all integers little-endian; the mask rotates the checksum right by 15 bits and adds 0xa282ead8, so that a
checksum of data that holds checksums stays useful.  A payload is ``u8 id flag | i64 doc id | u8 bytes per token |
token ids``.  Beside each shard lies an index, ``u64`` offsets of all frames and of the end, by which a reader
visits frames in any order.  Shards follow one another in ascending id order.

Defined cases: a null text is an empty one, whose sequence is the end id alone; null ids come first and keep their
null; rows that repeat an id are all written, ordered by a hash of their text; an empty table gives no shard and no
rows; further columns are ignored.

Scale: rows are dealt by ranges of id, then hash of the text, then a running number, so that neither null ids nor rows
that repeat an id or are equal make one large range.  A writer holds one batch of texts and one frame.

Recovery: a task writes under a name of its own and reports it only when the file is complete; the manifest lists
just the reported files, so a lost or repeated attempt leaves at most a file that nobody reads.  Nothing but the
manifest, a row for each shard, comes to the driver.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muralis.llm.common import blocks, fresh_dir, small_batches, stash

_U32, _U64, _HEAD = struct.Struct("<I"), struct.Struct("<Q"), struct.Struct("<BqB")
FRAME_OVERHEAD = 16


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = _U64.pack(len(payload))
    return b"".join((size, _U32.pack(masked(size)), payload, _U32.pack(masked(payload))))


def unframe(data: bytes, at: int, whole: int | None = None) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next one starts; raises ValueError on damage."""
    size = data[at : at + 8]
    if len(size) < 8 or _U32.unpack_from(data, at + 8)[0] != masked(size):
        raise ValueError(f"damaged length at byte {at}")
    end = at + 12 + _U64.unpack(size)[0]
    payload = data[at + 12 : end]
    if len(data) < end + 4 or _U32.unpack_from(data, end)[0] != masked(payload):
        raise ValueError(f"damaged payload at byte {at}")
    return payload, end + 4


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(doc_id is not None, doc_id or 0, width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = _HEAD.unpack_from(payload)
    return (doc_id if has else None), np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, label: str = "records", path: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write its shards; returns the manifest ``(path, n_records, n_tokens, part)``,
    one row a shard, already computed; shards follow one another by ``part``.

    With ``path``, a folder that doesn't hold records yet, shards and manifest stay there, for ``open_shards``; the manifest
    is written last and whole, and names shards within the folder, which may be moved.  Without it they are scratch."""
    spark = docs.sparkSession
    where = fresh_dir(spark, label) if path is None else (path if "://" in path or path.startswith("file:") else f"file://{path}").rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from muralis.llm.bpe_encode import encoder

        enc = encoder(tokenizer)
        width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        files, folder = _fs(where)
        files.create_dir(folder, recursive=True)
        name = f"shard-{uuid.uuid4().hex}"
        n_tokens, at = 0, [0]
        with files.open_output_stream(f"{folder}/{name}.rec", buffer_size=1 << 20) as out:
            for block in (b for batch in itertools.chain([first], batches) for b in blocks(batch, 1)):
                for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    ids = enc.encode(text or "") + end
                    n_tokens += len(ids) // width
                    done = frame(pack(doc_id, ids, width))
                    at.append(at[-1] + len(done))
                    out.write(done)
        with files.open_output_stream(f"{folder}/{name}.idx") as out:
            out.write(np.array(at, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"path": [f"{where}/{name}" if path is None else name], "n_records": [len(at) - 1], "n_tokens": [n_tokens], "part": [TaskContext.get().partitionId()]},
            schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("part", pa.int64())]),
        )

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"))
    dealt = keyed.repartitionByRange("doc_id", "h", "i").sortWithinPartitions("doc_id", "h", "i").select("doc_id", "text")
    made = dealt.mapInArrow(write, "path string, n_records long, n_tokens long, part long")
    with small_batches(spark):
        if path is None:
            return stash(made, label)
        made.write.mode("errorifexists").parquet(f"{where}/manifest")
    return open_shards(spark, where)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the records that ``write_shards`` left at ``path``; fails if they were never completed."""
    where = (path if "://" in path or path.startswith("file:") else f"file://{path}").rstrip("/")
    rows = spark.read.parquet(f"{where}/manifest")
    return rows.withColumn("path", F.concat(F.lit(f"{where}/"), "path"))


def read_frames(path: str, shuffle_seed: int | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """``(number in the shard, doc id, ids)`` of a shard's records, in file order or, with a seed, in a
    pseudo-random order that the index makes possible."""
    files, root = _fs(path)
    with files.open_input_file(f"{root}.idx") as f:
        at = np.frombuffer(f.read(), "<u8")
    order = np.arange(len(at) - 1) if shuffle_seed is None else np.random.default_rng(shuffle_seed).permutation(len(at) - 1)
    with files.open_input_file(f"{root}.rec") as f:
        if shuffle_seed is None:
            run = 0
            while run < len(order):  # a few megabytes at a time
                stop = max(run + 1, int(np.searchsorted(at, at[run] + (8 << 20), "right")) - 1)
                data, base = f.read_at(int(at[stop] - at[run]), int(at[run])), int(at[run])
                for k in range(run, stop):
                    payload, _ = unframe(data, int(at[k]) - base)
                    yield (k, *unpack(payload))
                run = stop
            return
        for k in order:
            payload, _ = unframe(f.read_at(int(at[k + 1] - at[k]), int(at[k])), 0)
            yield (int(k), *unpack(payload))


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read the shards back: ``(doc_id, start, n_tokens, ids_crc32)``, ``start`` counting the ids of all
    documents before."""
    rows = manifest.orderBy("part").collect()
    base = itertools.accumulate((r.n_tokens for r in rows), initial=0)
    shards = spark.createDataFrame([(r.path, b) for r, b in zip(rows, base, strict=False)], "path string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        schema = pa.schema([(n, pa.int64()) for n in names])
        for batch in batches:
            for path, start in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                cols: list[list] = [[], [], [], []]
                for _, doc_id, ids in read_frames(path):
                    for col, x in zip(cols, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        col.append(x)
                    start += len(ids)
                    if len(cols[0]) == 20_000:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, cols, strict=True)), schema=schema)
                        cols = [[], [], [], []]
                if cols[0]:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, cols, strict=True)), schema=schema)

    return shards.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token records, to ``path`` if they are to stay, and return what the files hold, a row for each
    record."""
    return read_shards(docs.sparkSession, write_shards(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), tokenizer, end_id, path=path))
