"""Uploads as a streaming sink with a commit protocol, and the ledger that they leave.

Executors send a micro-batch's rows and prepare one part of the ledger a task; the driver commits an epoch by one
manifest that names its parts.  A part that no manifest names doesn't count, so whatever fails before the commit, and
whatever is run again after it, a file is in the ledger once.  While a task sends, it saves its progress every so many
files; the batch's next attempt takes over what was saved and sends only the rest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

ENTRY = "file string, status string, updated_at double"
FORMAT = "weftline_upload"


def filesystem(path: str):
    """(file system, path in it) of a folder's URI or local path, as pyarrow knows it (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def retryable(error: str) -> bool:
    """Whether an error text speaks of a rate limit."""
    return "429" in error or "rate" in error.lower()


def attempt(send: Callable[[dict], bool], row: dict, retries: int = 5, wait: Callable[[float], None] = time.sleep) -> str:
    """uploaded or failed, after at most ``retries`` more tries 2, 4, 8 .. 60 seconds apart if the rate is limited."""
    for n in range(retries + 1):
        try:
            return "uploaded" if send(row) else "failed"
        except Exception as error:  # whatever the store's client raises
            if n == retries or not retryable(str(error)):
                break
            wait(min(2.0 * 2**n, 60.0))
    return "failed"


@dataclass
class Prepared(WriterCommitMessage):
    """A task's part of the ledger."""

    part: str | None = None
    n: int = 0


@dataclass
class Folder:
    """The ledger's files: parts, manifests of committed epochs, progress of the epoch under way."""

    path: str
    run: str

    def __post_init__(self) -> None:
        self.files, self.root = filesystem(self.path)

    def manifest(self, batch: int) -> str:
        return f"{self.root}/epochs/{self.run}-{batch:012d}.json"

    def progress(self, batch: int) -> str:
        return f"{self.root}/progress/{self.run}-{batch:012d}"

    def has(self, path: str) -> bool:
        from pyarrow import fs

        return self.files.get_file_info(path).type != fs.FileType.NotFound

    def write(self, path: str, data: str) -> None:
        """Whole or not at all: written beside, then moved."""
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        with self.files.open_output_stream(beside) as out:
            out.write(data.encode())
        self.files.move(beside, path)

    def saved(self, batch: int) -> dict[str, dict]:
        """What earlier attempts of the batch have sent; at most the batch's files."""
        from pyarrow import fs

        out: dict[str, dict] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.progress(batch), allow_not_found=True)):
            if info.base_name.endswith(".jsonl"):
                with self.files.open_input_stream(info.path) as source:
                    out |= {e["file"]: e for e in map(json.loads, source.read().decode().splitlines())}
        return out


@dataclass
class UploadWriter(DataSourceStreamWriter):
    path: str
    run: str
    store: str
    send: Callable[[dict, str], bool]
    save_every: int
    retries: int
    pause: float

    def write(self, iterator: Iterator[Row]) -> Prepared:
        folder = Folder(self.path, self.run)
        batch = int(TaskContext.get().getLocalProperty("streaming.sql.batchId"))
        if folder.has(folder.manifest(batch)):  # the epoch is run again after its commit
            return Prepared()
        saved, entries, held = folder.saved(batch), [], []

        def save() -> None:
            if held:
                folder.write(f"{folder.progress(batch)}/{uuid.uuid4().hex}.jsonl", "".join(json.dumps(e) + "\n" for e in held))
                held.clear()

        for row in iterator:
            entry = saved.get(row["file"])
            if entry is None:
                status = attempt(lambda r: self.send(r, self.store), row.asDict(), self.retries)
                entry = {"file": row["file"], "status": status, "updated_at": time.time()}
                held.append(entry)
                if len(held) >= self.save_every:
                    save()
                if self.pause:
                    time.sleep(self.pause)
            entries.append(entry)
        save()
        if not entries:
            return Prepared()
        part = f"{self.run}-{batch:012d}-{uuid.uuid4().hex}.jsonl"
        folder.write(f"{folder.root}/parts/{part}", "".join(json.dumps(e) + "\n" for e in entries))
        return Prepared(part, len(entries))

    def commit(self, messages: list[Prepared | None], batchId: int) -> None:  # noqa: N803
        folder = Folder(self.path, self.run)
        parts = [m for m in messages if m and m.part]
        if folder.has(folder.manifest(batchId)):
            self.abort(messages, batchId)
            return
        body = {"store": self.store, "batch": batchId, "at": time.time(), "n": sum(m.n for m in parts), "parts": [m.part for m in parts]}
        folder.write(folder.manifest(batchId), json.dumps(body))
        if folder.has(folder.progress(batchId)):
            folder.files.delete_dir(folder.progress(batchId))

    def abort(self, messages: list[Prepared | None], batchId: int) -> None:  # noqa: N803
        """The parts go, the saved progress stays for the next attempt."""
        folder = Folder(self.path, self.run)
        for m in messages:
            if m and m.part and folder.has(path := f"{folder.root}/parts/{m.part}"):
                folder.files.delete_file(path)


class UploadSink(DataSource):
    """Options: path, run, store, send (a pickled callable), save_every, retries, pause."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> UploadWriter:  # noqa: N802
        from pyspark import cloudpickle

        o = self.options
        return UploadWriter(o["path"], o["run"], o["store"], cloudpickle.loads(base64.b64decode(o["send"])), int(o["save_every"]), int(o["retries"]), float(o["pause"]))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(file, status, updated_at) of all committed epochs."""
    folder = Folder(path, "")
    if not folder.has(f"{folder.root}/epochs") or not folder.has(f"{folder.root}/parts"):
        return spark.createDataFrame([], ENTRY)
    named = spark.read.schema("parts array<string>").json(f"{path}/epochs").select(F.explode("parts").alias("part"))
    rows = spark.read.schema(ENTRY).option("pathGlobFilter", "*.jsonl").json(f"{path}/parts").select("*", F.col("_metadata.file_name").alias("part"))
    return rows.join(named, "part", "left_semi").select("file", "status", F.timestamp_seconds("updated_at").alias("updated_at"))


def last_store(spark: SparkSession, path: str) -> str | None:
    """The store that the ledger's last epoch was sent to."""
    folder = Folder(path, "")
    if not folder.has(f"{folder.root}/epochs"):
        return None
    found = spark.read.schema("store string, at double").json(f"{path}/epochs").agg(F.max_by("store", "at")).first()
    return found[0]


def upload(
    stream: DataFrame, send: Callable[[dict, str], bool], ledger: str, checkpoint: str, store: str = "default",
    resume: bool = True, save_every: int = 10, retries: int = 5, pause: float = 0.0,
) -> StreamingQuery:
    """Sends each row whose file the ledger doesn't know, and commits (file, status: uploaded or failed) by epoch.

    send: runs on executors, (row as a dict, store); false is a failure, and so is an error, which is tried again with
    growing pauses if it speaks of a rate limit.  Files in the ledger are not sent again, failed ones neither, whatever
    the checkpoint; ``resume`` tells whether the ledger's last store is used again or ``store``.  Progress is saved every
    ``save_every`` files of a task, with ``pause`` seconds after each.  What a lost task sent since it last saved may be
    sent again.  Bound a micro-batch at the source, as with maxFilesPerTrigger."""
    from pyspark import cloudpickle

    spark = stream.sparkSession
    spark.dataSource.register(UploadSink)
    left = stream.join(read_ledger(spark, ledger).select("file").distinct(), "file", "left_anti").dropDuplicates(["file"])
    options = {
        "path": ledger, "run": hashlib.md5(checkpoint.encode()).hexdigest()[:12], "store": (last_store(spark, ledger) if resume else None) or store,
        "send": base64.b64encode(cloudpickle.dumps(send)).decode(), "save_every": str(save_every), "retries": str(retries), "pause": str(pause), "checkpointLocation": checkpoint,
    }
    return left.writeStream.format(FORMAT).options(**options).trigger(availableNow=True).start()
