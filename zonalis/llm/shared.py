"""What several of these operators need: the shared work folder, written intermediate tables, word patterns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java and Python character class, and the same as plain characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary one in a local session; on a cluster an error, since executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="zonalis-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, readable after an executor is lost."""
    path = f"{work_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where tables that written made lie, while they are in use.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing will read again; other tables are left alone."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def numbered(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df with a number _row that tells its rows apart: the id, if all ids differ and none is null; else a number given to each row, and df is written, so that it stays the same."""
    key = F.col(id_col).cast("long")
    if df.groupBy(key.alias("_row")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR _row IS NULL").isEmpty():
        return df.withColumn("_row", key)
    return written(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words; empty for a null text or one without words."""
    bare = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def small_side(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast df if its counted rows are within the limit, else leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df
