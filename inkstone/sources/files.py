"""Files as rows: plain text, format detection, dictionaries, settings, and pages of a pluggable PDF extractor."""

from __future__ import annotations

import codecs
import io
import json
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.functions.text import extension
from inkstone.options import merge


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content); content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def decoded(content: Column) -> Column:
    """Text of bytes by their byte-order mark, UTF-8 without one; the mark goes, wrong bytes become U+FFFD."""
    head = F.substring(content, 1, 3)
    utf8 = F.when(head == F.lit(codecs.BOM_UTF8), F.substring(content, 4, 1 << 30)).otherwise(content)
    two = F.substring(content, 1, 2)
    rest = F.substring(content, 3, 1 << 30)
    wide = F.when(two == F.lit(codecs.BOM_UTF16_LE), F.decode(rest, "UTF-16LE")).when(two == F.lit(codecs.BOM_UTF16_BE), F.decode(rest, "UTF-16BE"))
    return F.coalesce(wide, F.make_valid_utf8(utf8.cast("string")))


def texts(files: DataFrame) -> DataFrame:
    return files.select("path", decoded(F.col("content")).alias("text"))


def is_pdf(content: Column) -> Column:
    """``%PDF-`` in the first 1,024 bytes."""
    return F.coalesce(F.contains(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), F.lit("%PDF-")), F.lit(False))


@F.pandas_udf(T.StructType([T.StructField("entries", T.ArrayType(T.StringType())), T.StructField("mimetype", T.StringType())]))
def zip_entries(content: pd.Series) -> pd.DataFrame:
    """Names in a zip file and its mimetype entry; nulls where it is none."""
    rows = []
    for c in content:
        try:
            with zipfile.ZipFile(io.BytesIO(c)) as z:
                names = z.namelist()
                rows.append((names, z.read("mimetype").decode("ascii", "replace").strip() if "mimetype" in names else None))
        except Exception:  # noqa: BLE001  no zip file, or a broken one
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["entries", "mimetype"])


def detected(files: DataFrame) -> DataFrame:
    """``files`` with format: docx, odt, epub, pdf or text.  Only office names are opened as zip files."""
    e = extension(F.col("path"))
    zipped = e.isin(".docx", ".odt", ".epub")
    z = F.when(zipped, zip_entries(F.when(zipped, F.col("content"))))
    has = lambda name: F.coalesce(F.array_contains(F.col("_z.entries"), name), F.lit(False))
    odf = F.col("_z.mimetype").isNull() | (F.col("_z.mimetype") == "application/vnd.oasis.opendocument.text")
    kind = (
        F.when((e == ".docx") & has("word/document.xml") & has("[Content_Types].xml"), "docx")
        .when((e == ".odt") & has("content.xml") & odf, "odt")
        .when((e == ".epub") & has("META-INF/container.xml"), "epub")
        .when(is_pdf(F.col("content")), "pdf")
        .otherwise("text")
    )
    return files.withColumn("_z", z).withColumn("format", kind).drop("_z")


def pdf_pages(files: DataFrame, extract: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """(path, page_no, page_count, text, error) from a function that gives a file's page texts.

    There is no PDF library here; a failing file gives one row with its error.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages = list(extract(content))
                    yield pd.DataFrame({"path": path, "page_no": range(1, len(pages) + 1), "page_count": len(pages), "text": pages, "error": None})
                except Exception as e:  # noqa: BLE001  a file's failure is a row
                    yield pd.DataFrame({"path": [path], "page_no": [None], "page_count": [None], "text": [None], "error": [f"{type(e).__name__}: {e}"]})

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, page_count int, text string, error string")


def dictionary_texts(spark: SparkSession, path: str) -> DataFrame:
    """(slot, key, value) from text files named by their slot: a key, a tab, and values of which the first counts."""
    rows = spark.read.text(path, pathGlobFilter="*.txt", recursiveFileLookup=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("slot"))
    parts = F.split("value", "\t")
    return rows.where(~F.col("value").startswith("#") & (F.size(parts) >= 2)).select(F.url_decode("slot").alias("slot"), parts[0].alias("key"), F.split(parts[1], " ")[0].alias("value"))


def dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON rows of slot, key, value."""
    return spark.read.schema("slot string, key string, value string").json(path)


def dictionary_zstd(spark: SparkSession, path: str, pattern: str = "*.zst*") -> DataFrame:
    """(slot, key, value) of files compressed by Zstandard, each a JSON object of slots, which are objects of keys and values.

    Each file is a row, and is unpacked in its task by Arrow's codec; a file that can't be read gives no rows.
    """

    @F.pandas_udf("string")
    def unpacked(content: pd.Series) -> pd.Series:
        def text(c: bytes) -> str | None:
            try:
                with pa.input_stream(pa.py_buffer(c), compression="zstd") as s:
                    return s.read().decode("utf-8-sig")
            except (OSError, ValueError):
                return None

        return content.map(text)

    slots = F.from_json(unpacked("content"), "map<string,map<string,string>>")
    found = binary_files(spark, path, pattern).select(F.explode(slots).alias("slot", "entries"))
    return found.select("slot", F.explode("entries").alias("key", "value"))


def settings(default: str, user: str | None = None) -> dict:
    """Default settings with the user's over them; a file that is missing or no JSON adds nothing."""
    with open(default, encoding="utf-8-sig") as f:
        out = json.load(f)
    try:
        with open(user or "", encoding="utf-8-sig") as f:
            return merge(out, json.load(f))
    except (OSError, ValueError):
        return out


def path_of_uri(uri: Column) -> Column:
    """A ``file://`` address as a path, percent signs decoded; anything else as it is."""
    raw = F.replace(F.regexp_replace(uri, "^file://(localhost)?", ""), F.lit("+"), F.lit("%2B"))
    return F.when(uri.startswith("file://"), F.url_decode(raw)).otherwise(uri)
