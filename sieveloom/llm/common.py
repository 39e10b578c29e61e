"""Shared by the operators: staged tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of whole texts that go to Python at a time. Spark's own number lets one batch of
#: long texts stand several times in a task's memory: in the JVM, on the way, in Python.
TEXT_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_folders: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session gets its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        held = context._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sieveloom-"))
        named = context._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, cleared when the driver's Python ends."""
    path = f"{shared_folder(spark)}/sieveloom-{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_sweep)
    _folders[path] = spark
    return path


def stage_texts(spark: SparkSession, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``stage`` of a table that Python makes from whole texts: TEXT_ROWS of them at a
    time, or fewer where the session says so."""
    before = spark.conf.get(_BATCH)
    now = int(before)
    spark.conf.set(_BATCH, str(min(now, TEXT_ROWS) if now > 0 else TEXT_ROWS))
    try:
        return stage(spark, df, name, parts)
    finally:
        spark.conf.set(_BATCH, before)


def stage(spark: SparkSession, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends
    there, so a lost executor costs a reread and not the work above. ``parts`` is
    the most files to write, for tables whose size is known to be small for the
    number of shuffle partitions."""
    path = fresh_folder(spark, name)
    (df if parts is None else df.coalesce(max(1, parts))).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no unwritten result reads any more."""
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path in _folders:
            _delete(_folders.pop(path), path)


#: Cells of the bitmap of ids: 4 MB, whatever the number of ids.
CELLS = 1 << 25


def _marked(rows: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` with a column: may the id be among ``ids`` (one column of longs)? A
    bitmap of hash cells answers, of fixed size and so safe to broadcast. It is
    full, and every answer yes, where ids are many times its cells."""
    bucket, bits, found = (free_name(rows.columns, c) for c in ("_bucket", "_bits", "_found"))
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS)) + 1
    key = F.col(ids.columns[0])
    maps = ids.groupBy(F.bitmap_bucket_number(cell(key)).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell(key))).alias(bits))
    own = cell(F.col(id_col).cast("long"))
    at = F.bitmap_bit_position(own).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod((byte / F.pow(F.lit(2), at % 8)).cast("int"), F.lit(2)) == 1
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(own)).join(F.broadcast(maps), bucket, "left")
    return marked.withColumn(found, F.coalesce(bit, F.lit(False))).drop(bucket, bits), found


def without_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is null or not among ``ids``. Only rows that may be are exchanged."""
    marked, found = _marked(rows, id_col, ids)
    key = free_name(rows.columns, "_id")
    maybe = marked.where(found).join(ids.toDF(key), F.col(id_col).cast("long") == F.col(key), "left_anti")
    return marked.where(~F.col(found)).unionByName(maybe).drop(found)


def with_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ``ids``. Only rows that may be are exchanged."""
    marked, found = _marked(rows, id_col, ids)
    key = free_name(rows.columns, "_id")
    return marked.where(found).join(ids.toDF(key), F.col(id_col).cast("long") == F.col(key), "left_semi").drop(found)


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, or that with underscores behind it, which is no column of ``taken``."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _sweep() -> None:
    for path, spark in _folders.items():
        try:
            _delete(spark, path)
        except Exception:  # the JVM has ended: whoever owns the folder clears it
            return


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
