"""A batch from files to results: classify, read, normalise, reflow, convert, name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import extension, normalize_newlines
from inkstone.operators.batch import kind, output_name
from inkstone.operators.dictionary import convert, normalize_compat, round_tables, script_of
from inkstone.operators.quotes import normalize_quotes
from inkstone.operators.reflow import reflow
from inkstone.options import PdfOptions
from inkstone.sources.containers import docx_texts, epub_texts, odt_texts
from inkstone.sources.files import decoded, detected
from inkstone.sources.office import convert_containers


def opened(files: DataFrame) -> DataFrame:
    """(path, text, error) of text, DOCX, ODT and EPUB files; other kinds have an error."""
    files = detected(files)
    of = lambda f: files.where(F.col("format") == f)
    readable = (kind(F.col("path")) == "text") | (extension(F.col("path")) == "")
    reason = F.when(kind(F.col("path")) == "office", "broken file, or an office format without a text reader").otherwise("unsupported file type")
    plain = of("text").select("path", F.when(readable, decoded(F.col("content"))).alias("text"), F.when(~readable, reason).alias("error"))
    pdf = of("pdf").select("path", F.lit(None).cast("string").alias("text"), F.lit("no PDF engine: use pdf_pages with an extractor").alias("error"))
    return plain.unionByName(docx_texts(of("docx"))).unionByName(odt_texts(of("odt"))).unionByName(epub_texts(of("epub"))).unionByName(pdf)


def convert_files(files: DataFrame, config: str = "s2t", direction: str = "s2t", punctuation: bool = False, reflowed: bool = False, quotes: bool = False, compat: bool = False, options: PdfOptions | None = None, level: int = 2) -> DataFrame:
    """(path, out_name, text, status, message, content) for every file; a file that can't be read is a row, not the batch's end.

    Office and e-book containers are converted inside, through all rounds of the configuration: they stay
    containers, with content for the sink and no text.  Content of other files is their text in UTF-8.
    """
    office = kind(F.col("path")) == "office"
    boxes = convert_containers(files.where(office).select("path", "content", F.substring(extension(F.col("path")), 2, 9).alias("format")), round_tables(config, punctuation=punctuation))
    rows = opened(files.where(~office))
    text = normalize_newlines(F.col("text"))
    if compat:
        text = normalize_compat(text, extended=True)
    rows = rows.withColumn("text", text)
    if reflowed:
        rows = rows.withColumn("blank", F.col("text").isNull())
        rows = reflow(rows, options, level).withColumn("text", F.when(~F.col("blank"), F.col("reflowed"))).drop("blank", "segments", "reflowed")
    text = normalize_quotes(F.col("text")) if quotes else F.col("text")
    rows = rows.withColumn("text", convert(text, config, punctuation=punctuation))
    rows = rows.select("path", "text", F.encode("text", "UTF-8").alias("content"), "error").unionByName(boxes.withColumn("text", F.lit(None).cast("string")))
    return rows.select(
        "path",
        output_name(F.col("path"), F.lit(direction), F.lit(config)).alias("out_name"),
        "text",
        F.when(F.col("error").isNull(), "converted").otherwise("skipped").alias("status"),
        F.coalesce("error", F.lit("")).alias("message"),
        "content",
    )


def detect_scripts(files: DataFrame) -> DataFrame:
    """(path, script, label) of text files; others are skipped."""
    script = F.when(kind(F.col("path")) == "text", script_of(decoded(F.col("content"))))
    label = F.when(script.isNull(), "skipped").when(script == 1, "traditional").when(script == 2, "simplified").otherwise("other")
    return files.select("path", script.alias("script"), label.alias("label"))
