"""Page text: overlay filtering of text objects, line breaks between bands, pages in order with markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions.chars import W, bound, utf16_length

#: Bands that lie between two kept objects when a new line begins.
LINE_GAP = 3


def punctuation_only(s: Column) -> Column:
    return s.rlike(rf"^[\p{{P}}\p{{S}}{W}]*\z")


def untrusted(norm: Column, repeats: Column) -> Column:
    """The text stands over four times in its band, or is one short token again and again."""

    def tiled(tokens: Column) -> Column:
        first = F.try_element_at(tokens, F.lit(1))
        same = F.size(F.filter(tokens, lambda t: t == first))
        return (F.size(tokens) >= 6) & ~punctuation_only(first) & (same >= F.size(tokens) - 1) & (utf16_length(first) <= 32)

    often = (repeats > 4) & utf16_length(norm).between(3, 200)
    # six tokens have five spaces between them: most texts are never split
    spaces = F.length(norm) - F.length(F.translate(norm, " ", ""))
    again = F.when(spaces >= 5, bound(F.filter(F.split(norm, " "), lambda t: t != ""), tiled)).otherwise(False)
    return (often | F.coalesce(again, F.lit(False))) & ~punctuation_only(norm)


def by_page(objects: DataFrame, partitions: int | None = None) -> DataFrame:
    """Text objects dealt by page: the filter, the line breaks and the page's text need no further shuffle.  A page is one text in the end, so that it is one task's work anyway."""
    return objects.repartition("doc_id", "page_no") if partitions is None else objects.repartition(partitions, "doc_id", "page_no")


def kept_objects(objects: DataFrame, dealt: bool = False) -> DataFrame:
    """(doc_id, page_no, obj_no, raw, norm, y_bucket) without blank and overlay objects.

    One scan and one shuffle, by page; repeats are counted in a window of the page's partition, whose rows
    Spark spills where a text tiles a page many times over.  Null texts are blank; repeated rows count each.
    Objects that are dealt by page already, as ``by_page`` deals, are not shuffled again.
    """
    same = Window.partitionBy("doc_id", "page_no", "norm", "y_bucket")
    shown = objects.where(F.col("norm") != "")
    own = (shown if dealt else by_page(shown)).withColumn("repeats", F.count("*").over(same))
    return own.where(~untrusted(F.col("norm"), F.col("repeats"))).select("doc_id", "page_no", "obj_no", "raw", "norm", "y_bucket")


def page_texts(kept: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): raw texts joined, a line break where the band is LINE_GAP or more from the last kept object's."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("obj_no")
    far = F.abs(F.col("y_bucket") - F.lag("y_bucket").over(w)) >= LINE_GAP
    parts = kept.withColumn("part", F.concat(F.when(far, "\n").otherwise(""), F.col("raw")))
    ordered = F.array_sort(F.collect_list(F.struct("obj_no", "part")))
    return parts.groupBy("doc_id", "page_no").agg(F.array_join(ordered["part"], "").alias("text"))


def documents_of_pages(pages: DataFrame, header: bool = True) -> DataFrame:
    """(doc_id, page_count, text): pages in order, each behind its marker if asked for; a blank page is an empty line."""
    trimmed = F.concat(F.regexp_replace("text", f"^[{W}]+|[{W}]+$", ""), F.lit("\n"))
    own = pages.select("doc_id", F.struct("page_no", trimmed.alias("body")).alias("page")).groupBy("doc_id")
    own = own.agg(F.max("page.page_no").alias("page_count"), F.array_sort(F.collect_list("page")).alias("pages"))
    marker = lambda x: F.concat(F.format_string("=== [Page %d/%d] ===\n", x["page_no"], F.col("page_count")), x["body"]) if header else x["body"]
    return own.select("doc_id", "page_count", F.array_join(F.transform("pages", marker), "").alias("text"))
