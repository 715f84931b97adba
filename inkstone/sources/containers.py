"""Text of DOCX, ODT and EPUB containers.

A file is a row; a pandas function opens the zip file and walks the XML, part by part.  For EPUB the
spine, manifest and parts are tables, joined by Spark.  Errors are values: a broken file has a null text
and its error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.functions.text import cap_blank_lines, combine_path, directory, normalize_newlines

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


# ---------------------------------------------------------------- list numbers
def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def _roman(n: int) -> str:
    from inkstone.functions.text import ROMAN

    return "M" * (n // 1000) + "".join(x[n // u % 10] for x, u in zip(ROMAN, (100, 10, 1), strict=True))


def format_counter(n: int, form: str) -> str:
    n = max(n, 1)
    forms = {"decimalZero": f"{n:02d}", "lowerLetter": _letters(n), "upperLetter": _letters(n).upper(), "lowerRoman": _roman(n).lower(), "upperRoman": _roman(n)}
    return forms.get(form, str(n))


# ---- fixed values: bullets that are shown as they are, and signs of the Wingdings font
PLAIN_BULLETS = "•●○■▪◆◇✓✔➤➔➢"
WINGDINGS = {"\uf0fc": "✓", "\uf0d8": "➤", "\uf0a7": "▪", "n": "■", "u": "◆", "v": "◇"}
# ---- end of fixed values


def bullet(text: str, font: str) -> str:
    """What shows for a bullet's first character in its font; a dot where nothing better is known."""
    sign, font = text.replace("\t", "").replace("\xa0", " ").strip()[:1], font.strip().lower()
    if sign and sign in PLAIN_BULLETS:
        return sign
    if font.startswith("wingdings"):
        return WINGDINGS.get(sign, "•")
    return "○" if font == "courier new" and sign == "o" else "•"


class Numbering:
    """Counters of a part's lists, by number and level."""

    def __init__(self, numbering: bytes | None, styles: bytes | None):
        self.levels: dict[tuple[str, int], tuple[str, str, str]] = {}
        self.abstract: dict[str, str] = {}
        self.style: dict[str, tuple[str, int]] = {}
        self.counts: dict[str, list[int]] = {}
        get = lambda e, tag, default="": (x.get(_W + "val", default) if (x := e.find(tag)) is not None else default)
        for root in [ET.fromstring(numbering)] if numbering else []:
            for a in root.iter(_W + "abstractNum"):
                for lvl in a.iter(_W + "lvl"):
                    fonts = lvl.find(f"{_W}rPr/{_W}rFonts")
                    font = "" if fonts is None else fonts.get(_W + "ascii") or fonts.get(_W + "hAnsi") or ""
                    level = int(lvl.get(_W + "ilvl", "0"))
                    self.levels[a.get(_W + "abstractNumId", ""), level] = (get(lvl, _W + "numFmt", "decimal"), get(lvl, _W + "lvlText", f"%{level + 1}."), font)
            for n in root.iter(_W + "num"):
                self.abstract[n.get(_W + "numId", "")] = get(n, _W + "abstractNumId")
        for root in [ET.fromstring(styles)] if styles else []:
            for s in root.iter(_W + "style"):
                num, level = s.find(f".//{_W}numPr/{_W}numId"), s.find(f".//{_W}numPr/{_W}ilvl")
                if num is not None and level is not None:
                    self.style[s.get(_W + "styleId", "")] = (num.get(_W + "val", ""), int(level.get(_W + "val", "0")))

    def prefix(self, num: str | None, level: int | None, style: str | None) -> str:
        """The next number of the paragraph's list; its own number goes before its style's."""
        if num is None:
            if style not in self.style:
                return ""
            num, level = self.style[style]
        level = min(8, max(0, level or 0))
        abstract = self.abstract.get(num)
        if (abstract, level) not in self.levels:
            return ""
        counts = self.counts.setdefault(num, [0] * 9)
        counts[level] += 1
        counts[level + 1 :] = [0] * (8 - level)
        form, template, font = self.levels[abstract, level]
        if form == "bullet":
            text = bullet(template, font)
        else:
            text = re.sub(r"%([1-9])", lambda m: format_counter(counts[int(m[1]) - 1], self.levels.get((abstract, int(m[1]) - 1), ("decimal",))[0]), template)
        text = text.replace("\xa0", " ").replace("\t", " ")
        return text if not text or text.endswith(" ") else text + " "


# ---------------------------------------------------------------- word processing
class _Table:
    """Cells of a table that is being read: a row is a line, its cells have tabs between."""

    def __init__(self):
        self.rows: list[str] = []
        self.cell: list[str] | None = None

    def end_cell(self) -> None:
        if self.cell is not None:
            self.rows.append("".join(self.cell).rstrip("\r\n"))
            self.cell = None

    def end_row(self) -> str:
        line, self.rows = "\t".join(self.rows) + "\n", []
        return line


def word_text(xml: bytes, numbering: Numbering) -> str:
    """Paragraphs, tabs, breaks, list numbers, tables and notes of a part."""
    out: list[str] = []
    table = _Table()
    skip = inside = 0  # depth in a note that is left out, and in a paragraph's properties
    num: str | None = None
    level: int | None = None
    style: str | None = None
    numbered = False

    def put(s: str) -> None:
        (table.cell if table.cell is not None else out).append(s)

    def begin() -> None:
        nonlocal numbered
        if not numbered and (p := numbering.prefix(num, level, style)):
            numbered = True
            put(p)

    for event, e in ET.iterparse(io.BytesIO(xml), events=("start", "end")):
        if not e.tag.startswith(_W):
            continue
        tag = e.tag[len(_W) :]
        if tag in ("footnote", "endnote") and event == "start":
            odd = e.get(_W + "type") in ("separator", "continuationSeparator") or int(e.get(_W + "id", "0") or 0) <= 0
            skip += bool(skip or odd)
        elif tag in ("footnote", "endnote"):
            skip -= bool(skip)
        elif skip:
            continue
        elif event == "start":
            if tag == "p":
                num = level = style = None
                numbered = False
            elif tag == "pPr":
                inside += 1
            elif tag == "tc":
                table.cell = []
        elif tag == "pPr":
            inside -= 1
        elif tag == "pStyle":
            style = e.get(_W + "val")
        elif tag == "numId" and inside:
            num = e.get(_W + "val")
        elif tag == "ilvl" and inside:
            level = int(e.get(_W + "val", "0"))
        elif tag == "t":
            begin()
            put(e.text or "")
        elif tag in ("tab", "br", "cr") and not inside:
            begin()
            put("\t" if tag == "tab" else "\n")
        elif tag == "p":
            put("\n")
            e.clear()
        elif tag == "tc":
            table.end_cell()
        elif tag == "tr":
            out.append(table.end_row())
    return "".join(out)


def _wanted(names: list[str]) -> list[str]:
    """Parts in reading order; of names that differ in case only the first."""
    fixed = ["word/document.xml", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml"]
    rest = [sorted((n for n in names if re.fullmatch(rf"word/{k}[^/]*\.xml", n, re.I)), key=str.upper) for k in ("header", "footer")]
    seen: dict[str, str] = {}
    for n in [*fixed, *rest[0], *rest[1]]:
        seen.setdefault(n.upper(), n)
    return [n for n in seen.values() if n in names]


def docx_text(content: bytes, headings: bool = False) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        read = lambda n: z.read(n) if n in names else None
        numbering = Numbering(read("word/numbering.xml"), read("word/styles.xml"))
        out = []
        for n in _wanted(names):
            numbering.counts.clear()
            xml = z.read(n)
            if b"<!DOCTYPE" in xml[:1024]:
                raise ValueError(f"{n} has a document type")
            out.append((f"=== {n} ===\n" if headings else "") + word_text(xml, numbering) + "\n")
    return "".join(out)


# ---------------------------------------------------------------- open document
_TEXT, _TABLE = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"


def odt_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("content.xml")
    out: list[str] = []
    table = _Table()
    depth = 0
    put = lambda s: (table.cell if table.cell is not None else out).append(s)

    def walk(e: ET.Element) -> None:
        nonlocal depth
        ns, _, tag = e.tag.rpartition("}")
        ns += "}"
        text = ns == _TEXT
        if text and tag == "list":
            depth += 1
        if text and tag in ("p", "h") and depth:
            put("  " * (depth - 1) + "- ")
        if ns == _TABLE and tag == "table-cell":
            table.cell = []
        if text and tag == "tab":
            put("\t")
        elif text and tag == "line-break":
            put("\n")
        elif text and tag == "s":
            put(" " * int(e.get(_TEXT + "c", "1")))
        if e.text and e.text.strip():
            put(e.text)
        for child in e:
            walk(child)
            if child.tail and child.tail.strip():
                put(child.tail)
        if text and tag in ("p", "h"):
            put("\n")
        if text and tag == "list":
            depth -= 1
        if ns == _TABLE and tag == "table-cell":
            table.end_cell()
        if ns == _TABLE and tag == "table-row":
            out.append(table.end_row())

    walk(ET.fromstring(xml))
    return "".join(out)


# ---------------------------------------------------------------- books
# ---- fixed values: elements that are skipped, and that stand on lines of their own
_SKIP = frozenset("script style head svg math noscript".split())
_BLOCKS = frozenset("p div section article blockquote li h1 h2 h3 h4 h5 h6 hr".split())
# ---- end of fixed values


def xhtml_text(xml: bytes) -> str:
    """Text of a well-formed page: blocks have a blank line between, white space is one space."""
    xml = re.sub(rb"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", b"", xml)
    xml = re.sub(rb"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)\w+;", b" ", xml)
    out = ""

    def put(s: str | None) -> None:
        nonlocal out
        if s and s.strip():
            s = re.sub(r"\s+", " ", s.replace("\xad", "").replace("\xa0", " "))
            out += s.lstrip() if not out or out[-1] in " \n" else s

    def part() -> None:
        nonlocal out
        out = out.rstrip(" \n")
        out += "\n\n" if out else ""

    def walk(e: ET.Element) -> None:
        nonlocal out
        tag = e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else "script"
        if tag in _SKIP:
            return
        if tag in _BLOCKS:
            part()
        if tag == "br":
            out += "\n"
        put(e.text)
        for child in e:
            walk(child)
            put(child.tail)
        if tag in _BLOCKS:
            part()

    walk(ET.fromstring(xml))
    return out.rstrip(" \n")


_BOOK_ROWS = "path string, kind string, id string, pos int, name string, href string, media string, nav boolean, content binary, error string"


def _book_rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Manifest, spine and page rows of each book."""
    columns = [c.split()[0] for c in _BOOK_ROWS.split(", ")]
    for pdf in it:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    roots = [r.get("full-path") or r.get("fullpath") for r in ET.fromstring(z.read("META-INF/container.xml")).iter() if r.tag.endswith("rootfile")]
                    if not roots or not (roots[0] or "").strip():
                        raise ValueError("the book has no package file")
                    opf = roots[0].strip()
                    pos = n = 0
                    for e in ET.fromstring(z.read(opf)).iter():
                        tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
                        if tag == "item" and e.get("id") and e.get("href"):
                            rows.append({"kind": "manifest", "id": e.get("id"), "pos": n, "name": opf, "href": e.get("href"), "media": e.get("media-type") or "", "nav": "nav" in (e.get("properties") or "").lower().split()})
                            n += 1
                        elif tag == "itemref" and e.get("idref"):
                            rows.append({"kind": "spine", "id": e.get("idref"), "pos": pos})
                            pos += 1
                    rows += [{"kind": "page", "name": i, "content": z.read(i)} for i in z.namelist() if re.search(r"(?i)\.(x?html?|xml)$", i)]
            except Exception as e:  # noqa: BLE001  a file's failure is a row
                rows = [{"kind": "error", "error": f"{type(e).__name__}: {e}"}]
            out = pd.DataFrame([dict.fromkeys(columns) | {"path": path} | r for r in rows], columns=columns)
            out["pos"] = out["pos"].astype("Int32")
            yield out


_TEXT_OR_ERROR = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_TEXT_OR_ERROR)
def _page_text(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        try:
            rows.append((xhtml_text(c), None))
        except Exception as e:  # noqa: BLE001
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["text", "error"])


def is_html(media: Column, href: Column) -> Column:
    by_name = href.rlike(r"(?i)\.(xhtml|html|htm)$")
    return F.when(media == "", by_name).otherwise(media.rlike("(?i)html") | by_name)


def epub_texts(files: DataFrame) -> DataFrame:
    """(path, text, error) of books: spine to manifest (of equal ids the last) to pages, in spine order; navigation is skipped."""
    rows = files.select("path", "content").mapInPandas(_book_rows, _BOOK_ROWS)
    manifest = rows.where("kind = 'manifest'").groupBy("path", "id").agg(F.max_by(F.struct("name", "href", "media", "nav"), "pos").alias("m"))
    spine = rows.where("kind = 'spine'").select("path", "id", "pos")
    wanted = spine.join(manifest, ["path", "id"]).where(is_html(F.col("m.media"), F.col("m.href")) & ~F.col("m.nav"))
    wanted = wanted.select("path", "pos", combine_path(directory(F.col("m.name")), F.col("m.href")).alias("name"))
    pages = rows.where("kind = 'page'").select("path", "name", _page_text("content").alias("t"))
    found = wanted.join(pages, ["path", "name"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("t.text").alias("x")))), lambda r: r["x"]), "\n\n")
    good = found.groupBy("path").agg(ordered.alias("text"), F.min("t.error").alias("error"))
    bad = rows.where("kind = 'error'").select("path", F.col("error").alias("failed"))
    out = files.select("path").join(good, "path", "left").join(bad, "path", "left")
    error = F.coalesce("failed", "error")
    return out.select("path", F.when(error.isNull(), cap_blank_lines(normalize_newlines(F.coalesce("text", F.lit(""))))).alias("text"), error.alias("error"))


def _text_udf(extract):
    @F.pandas_udf(_TEXT_OR_ERROR)
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append((extract(c), None))
            except Exception as e:  # noqa: BLE001  a file's failure is a value
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return run


def docx_texts(files: DataFrame, headings: bool = False) -> DataFrame:
    """(path, text, error) of word-processing files."""
    out = files.select("path", _text_udf(lambda c: docx_text(c, headings))("content").alias("t"))
    return out.select("path", normalize_newlines(F.col("t.text")).alias("text"), "t.error")


def odt_texts(files: DataFrame) -> DataFrame:
    out = files.select("path", _text_udf(odt_text)("content").alias("t"))
    return out.select("path", normalize_newlines(F.col("t.text")).alias("text"), "t.error")
