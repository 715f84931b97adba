"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker handles at once; Spark also bounds a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS = 1000

#: Rows of a few numbers that are broadcast: 32 MB, and about 130 MB as a table in an executor's memory.
BROADCAST_ROWS = 2_000_000
_ROWS, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; an own one only where that is unset and all run on one machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.inkstone.shared", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="inkstone-shared-")
        spark.conf.set("spark.inkstone.shared", path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Have Python workers get BATCH_ROWS rows at once, unless the session says otherwise.

    By default Spark holds 64 MB of rows outside the heap for each task that feeds a worker.  The number
    is the same for all operators, and one that the user has set stays.
    """
    if spark.conf.get(_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that what is made of them needs little memory."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives the loss of any executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table made by ``written``, to be broadcast if it has so few rows; else joins shuffle it as they see fit.

    For decisions about documents, a few numbers each, that meet the documents' texts: a million of them is
    less than what shuffling the texts of a thousand would be.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that is not needed any more."""
    jvm = df.sparkSession._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
