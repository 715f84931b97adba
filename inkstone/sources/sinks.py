"""Writing results: one file for each row, published whole, and dictionaries."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.sources.shared import fresh

_LOG = "name string, status string, message string"


def _published(folder: str, name: str, data: bytes) -> None:
    """Beside the target first, then moved over it: readers see the old file or the new one."""
    handle, temp = tempfile.mkstemp(dir=folder, prefix=".writing-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temp, os.path.join(folder, os.path.basename(name)))
    except BaseException:
        os.unlink(temp)
        raise


def distinct_names(rows: DataFrame, name_col: str = "name", path_col: str = "path") -> DataFrame:
    """``rows`` with names that no two files share: files of equal names, case aside, keep apart by a digest of their path.

    Which files share a name is found by grouping names, without one task that sees them all.  Rows of the
    same path and name keep the same name.  Null names stay null.
    """
    key, n, p = (fresh(x, rows) for x in ("key", "paths", "path_of"))
    many = rows.groupBy(F.lower(name_col).alias(key)).agg(F.count_distinct(path_col).alias(n)).where(F.col(n) > 1).select(key)
    dot = F.regexp_extract(name_col, r"(\.[^.]*)\z", 1)
    apart = F.concat(F.left(F.col(name_col), F.length(name_col) - F.length(dot)), F.lit("_"), F.left(F.sha2(F.col(path_col).cast("string"), 256), F.lit(16)), dot)
    shared = F.col(key).isNotNull()
    out = rows.join(many, F.lower(name_col) == F.col(key), "left")
    return out.select(*(F.when(shared, apart).otherwise(F.col(name_col)).alias(c) if c == name_col else F.col(f"`{c}`") for c in rows.columns))


def write_files(rows: DataFrame, folder: str, name_col: str = "name", data_col: str = "text") -> DataFrame:
    """Write each row's text (UTF-8 without a mark) or bytes to a file of a folder that all executors mount.

    Returns (name, status, message), which has to be acted on for the files to be written.  A row's
    failure is a row of the log.  A task that runs again writes the same files again.  Of rows that share
    a name, case aside, none is written over another: all of them fail with a message; ``distinct_names``
    gives them names of their own.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in it:
            log = []
            for name, data, shared in zip(pdf["name"], pdf["data"], pdf["shared"], strict=True):
                try:
                    if shared:
                        raise ValueError("another row has this name")
                    if name is None or data is None:
                        raise ValueError("no name or no data")
                    _published(folder, name, data.encode() if isinstance(data, str) else bytes(data))
                    log.append((name, "written", ""))
                except Exception as e:  # noqa: BLE001
                    log.append((name, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(log, columns=["name", "status", "message"])

    own = rows.select(F.col(name_col).alias("name"), F.col(data_col).alias("data"))
    base = F.lower(F.regexp_extract("name", r"([^/]*)\z", 1))
    many = own.groupBy(base.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    marked = own.join(many, base == F.col("key"), "left").select("name", "data", F.col("key").isNotNull().alias("shared"))
    return marked.mapInPandas(run, _LOG)


def counted(log: DataFrame) -> tuple[DataFrame, Observation]:
    """A log of files, and an observation of its counts: files, written (or converted), failed, skipped.

    The counts come from the very run that acts on the log, without a second pass; they can be read from the
    observation once that run has ended.  An empty log has zeros.
    """
    seen = Observation("files")
    n = lambda status: F.coalesce(F.sum(F.when(F.col("status").isin(status), 1)), F.lit(0)).alias(status[0])
    return log.observe(seen, F.count("*").alias("files"), n(["written", "converted"]), n(["failed"]), n(["skipped"])), seen


def write_dictionary(dictionary: DataFrame, path: str, form: str = "parquet") -> None:
    """(slot, key, value) as Parquet or JSON, a folder for each slot; Spark's commit publishes it whole."""
    dictionary.write.mode("overwrite").partitionBy("slot").format(form).save(path)


@F.pandas_udf(T.BinaryType())
def _compressed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: pa.Codec("zstd").compress(t.encode(), asbytes=True) if t is not None else None)


def write_dictionary_zstd(dictionary: DataFrame, folder: str) -> DataFrame:
    """(slot, key, value) as one file for each slot, a JSON object compressed by Zstandard; the log of ``write_files``.

    A slot's entries are one text, as they are in the reader's memory, so that a slot is bounded by what a
    row can hold.  Null slots, keys and values are left out; of equal keys the greatest value counts.
    """
    rows = dictionary.dropna(subset=["slot", "key", "value"]).groupBy("slot", "key").agg(F.max("value").alias("value"))
    entries = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    whole = rows.groupBy("slot").agg(F.to_json(F.create_map(F.first("slot"), entries)).alias("text"))
    return write_files(whole.select(F.concat(F.url_encode("slot"), F.lit(".json.zst")).alias("name"), _compressed("text").alias("data")), folder, data_col="data")
