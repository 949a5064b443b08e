"""Status files of long runs: a fixed schema, tolerant reading, atomic writing."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.sources.status_files import StatusFiles

SCHEMA = (
    "state string, step int, total_steps int, stage string, stage_index int, stages int, loss double, learning_rate double, device string, hardware string, precision string, "
    "parameters double, workers int, cores int, fonts array<string>, rate double, elapsed_seconds double, eta_seconds double, "
    "history array<struct<step:int,stage:string,char_accuracy:double,line_accuracy:double,loss:double>>, "
    "real struct<documents:int,documents_read:int,not_located:int,lines_read:int,char_rate:double,document_rate:double,confusions:array<struct<want:string,got:string,count:int>>,per_document:array<struct<name:string,ok:boolean>>>, "
    "real_history array<struct<step:int,documents_read:int,documents:int,char_rate:double>>, error string, started_at double, updated_at double"
)

def read_status(spark: SparkSession, path: str) -> DataFrame:
    """A row for each readable status file under path; unknown keys are left out, broken files give no row."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("s")).select("s.*")
    return raw.where(F.col("state").isNotNull() | F.col("step").isNotNull())


def stream_status(spark: SparkSession, path: str) -> DataFrame:
    """(path, written, a status' columns) as a stream of all states of the status files below a folder, those of files that are written again included. A file that holds no status gives no row; one that is written in again gives one then."""
    spark.dataSource.register(StatusFiles)
    raw = spark.readStream.format(StatusFiles.name()).option("path", path).load()
    # several statuses may stand in a file, one a line
    each = F.when(F.col("value").rlike(r"\}[\x20\r]*\n\s*\{"), F.split("value", "\n")).otherwise(F.array("value"))
    read = raw.select("path", "written", F.explode(each).alias("value")).select("path", "written", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("s")).select("path", "written", "s.*")
    return read.where(F.col("state").isNotNull() | F.col("step").isNotNull())


def _replace_local(path: str, text: str) -> None:
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path), suffix=".tmp")
    with os.fdopen(handle, "w") as f:
        f.write(text)
    os.replace(name, path)


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file of any scheme beside the one at path and renames it over that in one step. Hadoop's local file system deletes before it renames, so local files are renamed by the operating system."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    store = target.getFileSystem(conf)
    if store.getUri().getScheme() == "file":
        local = store.makeQualified(target).toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return _replace_local(local, text)
    out = store.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(beside), store.makeQualified(target), over)


class StatusWriter:
    """Keeps one run's status and writes it whole. Every write is stamped, so that a healthy run never looks stale. Writing never stops the run.

    directory is a local folder; with a session it may be any that Hadoop's file systems know, such as the one driver and executors share. The file is written beside the old one and renamed over it, so no reader sees half of it.
    """

    KEYS = frozenset(("state", "step", "total_steps", "stage", "stage_index", "stages", "loss", "learning_rate", "device", "hardware", "precision", "parameters", "workers", "cores", "fonts", "rate", "elapsed_seconds", "eta_seconds", "history", "real", "real_history", "error", "started_at", "updated_at"))

    def __init__(self, directory: str, spark: SparkSession | None = None):
        self.path, self.status, self.spark = f"{directory.rstrip('/')}/status.json", {}, spark

    def update(self, now: float, **values) -> None:
        if unknown := set(values) - self.KEYS:
            raise KeyError(f"not in a status: {sorted(unknown)}")
        self.status |= values | {"updated_at": now}
        self.write()

    @contextmanager
    def running(self, clock: Callable[[], float] = time.time) -> Iterator[StatusWriter]:
        """Within it a failure is written down as the run's last state, and goes on."""
        try:
            yield self
        except BaseException as e:
            self.update(clock(), state="failed", error=f"{type(e).__name__}: {e}")
            raise

    def write(self) -> None:
        text = json.dumps(self.status, default=str)
        try:
            if self.spark is None:
                _replace_local(self.path, text)
            else:
                _replace(self.spark, self.path, text)
        except (OSError, Py4JJavaError):
            pass
