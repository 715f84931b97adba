"""Conversion of files as they arrive.  An extension: the batch operators, over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.operators.dictionary import convert
from inkstone.operators.quotes import normalize_quotes
from inkstone.sources.files import decoded


def arriving(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)


def convert_arriving(spark: SparkSession, folder: str, out: str, checkpoint: str, config: str = "s2t", punctuation: bool = False) -> StreamingQuery:
    """Each new file once: decoded, its quotes normalised, converted, and appended to a Parquet table; stops when all are done."""
    text = convert(normalize_quotes(decoded(F.col("content"))), config, punctuation=punctuation)
    rows = arriving(spark, folder).select("path", "modificationTime", text.alias("text"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
