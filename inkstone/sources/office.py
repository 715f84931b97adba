"""Converting the texts inside office and e-book containers, bytes to bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the parts whose text is converted, by format
PARTS = {
    "docx": r"word/(document|footnotes|endnotes|comments|header\d*|footer\d*)\.xml",
    "xlsx": r"xl/(sharedStrings|worksheets/[^/]+)\.xml",
    "pptx": r"ppt/(slides|notesSlides)/[^/]+\.xml",
    "odt": r"(content|styles)\.xml",
    "ods": r"content\.xml",
    "odp": r"content\.xml",
    "epub": r".*\.(xhtml|html|htm|opf|ncx)",
}
# ---- end of fixed values
_BETWEEN = re.compile(r"(?<=>)[^<]+")


def convert_container(content: bytes, form: str, convert: Callable[[str], str]) -> bytes:
    """The container with the text between tags of its parts converted; all else is copied, the mimetype first and stored."""
    wanted = re.compile(PARTS[form], re.I)
    out, found = io.BytesIO(), False
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        entries = sorted(z.infolist(), key=lambda i: i.filename != "mimetype")
        for i in entries:
            data = z.read(i)
            if wanted.fullmatch(i.filename):
                found = True
                data = _BETWEEN.sub(lambda m: convert(m[0]), data.decode("utf-8")).encode()
            new.writestr(i.filename, data, zipfile.ZIP_STORED if i.filename == "mimetype" else zipfile.ZIP_DEFLATED)
    if not found:
        raise ValueError(f"no part of a {form} file in it")
    return out.getvalue()


def convert_containers(files: DataFrame, tables: dict[str, str] | list[dict[str, str]]) -> DataFrame:
    """(path, content, error) of files with a format column, by forward maximum matching over one table, or over several in turn."""
    from inkstone.operators.dictionary import match_longest

    rounds: list[tuple[dict[str, str], dict[str, int]]] = []
    for table in [tables] if isinstance(tables, dict) else tables:
        starts: dict[str, int] = {}
        for k in table:
            starts[k[0]] = max(starts.get(k[0], 0), len(k))
        rounds.append((table, starts))

    def through(text: str) -> str:
        for table, starts in rounds:
            text = match_longest(text, table, starts)
        return text

    @F.pandas_udf("content binary, error string")
    def run(content: pd.Series, form: pd.Series) -> pd.DataFrame:
        rows = []
        for c, f in zip(content, form, strict=True):
            try:
                rows.append((convert_container(c, f, through), None))
            except Exception as e:  # noqa: BLE001  a file's failure is a value
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["content", "error"])

    return files.select("path", run("content", "format").alias("r")).select("path", "r.content", "r.error")
