"""A durable store of reports and decisions: batches are committed in order, each once, whole or not at all.

Layout under ``root``: ``data/<attempt>/<table>`` are Parquet folders, written once and never changed, and
``commits/<version>.json`` name the folders that are valid.  A commit writes its folders first and then creates the file
of the next version, which no second writer can create as well.  A lost attempt leaves folders that no version names.  A
batch whose number isn't above the last one's is known already and changes nothing.

Decisions are kept as a log: a batch writes those of its reports and of the earlier ones that it changed, and the latest
one of a report holds.  ``compact`` writes the tables anew as one folder.  Only the current version's file, a line for each
batch since then, comes to the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from muralis.config import RULES, Rules
from muralis.operators import admin, verify
from muralis.streaming.queue import use_rocksdb


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class Store:
    def __init__(self, spark: SparkSession, root: str, rules: Rules = RULES):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._context = jvm.org.apache.hadoop.fs.FileContext

    # versions

    def _fs(self, path: str):
        where = self._path(path)
        return where.getFileSystem(self._conf), where

    def _head(self) -> dict:
        fs, folder = self._fs(f"{self.root}/commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []
        if not names:
            return {"version": 0, "batch": -1, "folders": []}
        text = self.spark.read.text(f"{self.root}/commits/{names[-1]}", wholetext=True).first().value
        return json.loads(text)

    def _publish(self, head: dict) -> None:
        fs, _ = self._fs(self.root)
        draft, final = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}"), self._path(f"{self.root}/commits/{head['version']:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        kinds = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        kinds[0] = self._rename.NONE  # an existing version isn't replaced
        try:
            self._context.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), self._conf).rename(draft, final, kinds)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {head['version']} exists") from e
            raise

    # reading

    def _read(self, head: dict, table: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.root}/data/{f['name']}/{table}").withColumn("_seq", F.lit(f["seq"])) for f in head["folders"] if table in f["tables"]]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def table(self, name: str) -> DataFrame | None:
        """An appended table, as of now; None before its first row."""
        found = self._read(self._head(), name)
        return None if found is None else found.drop("_seq")

    def _decisions(self, head: dict) -> DataFrame | None:
        log = self._read(head, "decisions")
        return None if log is None else log.groupBy("id").agg(F.max_by(F.struct(*verify.DECISION), "_seq").alias("d")).select("id", "d.*")

    def decisions(self) -> DataFrame | None:
        """The decision that holds for each report: ``(id, state, score, site_key, duplicate_of, codes)``."""
        return self._decisions(self._head())

    def sites(self) -> DataFrame | None:
        """``(site_key, lat, lon, first_seen_us)``: where the report that made a site stands."""
        head = self._head()
        found = self._decisions(head)
        if found is None:
            return None
        return found.filter("site_key = id").select("site_key").join(self._read(head, "reports").hint("merge"), F.col("site_key") == F.col("id")).select("site_key", "lat", "lon", F.col("captured_us").alias("first_seen_us"))

    # writing

    def commit(self, batch: int, reports: DataFrame, actions: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, known_once: bool = False) -> bool:
        """Decide on a batch of reports, after the review ``actions`` since the last one, and store it with further
        ``tables`` of its own; False if the batch is known.  Reports whose ``client_uuid`` is stored are left out, unless
        ``known_once`` says that none is."""
        head = self._head()
        if batch <= head["batch"]:
            return False
        stored = self._read(head, "reports")
        if known_once:
            fresh = reports
        else:
            fresh = admin.idempotent(reports, reports.select("client_uuid").limit(0) if stored is None else stored.select("client_uuid"), "received_us")
        folder = {"name": f"{batch:012d}-{uuid.uuid4().hex}", "seq": head["version"] + 1, "tables": ["reports", "decisions", *(tables or {})]}
        path = f"{self.root}/data/{folder['name']}"
        fresh.write.parquet(f"{path}/reports")
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{path}/reports")
        past = None
        if stored is not None:
            past = stored.select(*verify.KNOWN).join(self._decisions(head).hint("merge"), "id")
        verify.decide(fresh, past, actions, self.rules).write.parquet(f"{path}/decisions")
        for name, rows in (tables or {}).items():
            rows.write.parquet(f"{path}/{name}")
        self._publish({"version": head["version"] + 1, "batch": batch, "folders": [*head["folders"], folder]})
        return True

    def compact(self) -> None:
        """One folder for all; rows stay as they are."""
        head = self._head()
        if not head["folders"]:
            return
        names = sorted({t for f in head["folders"] for t in f["tables"]})
        folder = {"name": f"compact-{uuid.uuid4().hex}", "seq": head["version"] + 1, "tables": names}
        for name in names:
            rows = self._decisions(head) if name == "decisions" else self._read(head, name).drop("_seq")
            rows.write.parquet(f"{self.root}/data/{folder['name']}/{name}")
        self._publish({"version": head["version"] + 1, "batch": head["batch"], "folders": [folder]})


class FirstOfItsKey(StatefulProcessor):
    """Passes the first report of a key, by ``received_us``, then ``id``, of the first batch that brings one."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        self.seen.update((True,))
        first = min(rows, key=lambda r: (r["received_us"], r["id"]))
        yield Row(**{c: first[c] for c in self.columns})


def first_reports(stream: DataFrame) -> DataFrame:
    """Each ``client_uuid`` of a stream once, ever.  Known keys are keyed state on the executors' disks, of which a
    batch reads only its own keys: its cost doesn't grow with what is stored.  Rows without a key are dropped."""
    use_rocksdb(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    schema = StructType(stream.schema.fields)
    return stream.filter("client_uuid is not null").groupBy("client_uuid").transformWithState(FirstOfItsKey(stream.columns), schema, "append", "none")


def ingest(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """A stream of reports into ``store``.  Keys are told apart by the stream's state, batches by their number; so a
    batch that is run again after a failure gives the same rows, and is stored once.  A store takes one stream, whose
    checkpoint stays with it."""

    def write(batch: DataFrame, number: int) -> None:
        store.commit(number, batch, known_once=True)

    return first_reports(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
