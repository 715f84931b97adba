"""Paragraph reflow: broken lines of Chinese text are put together into paragraphs.

Lines are rows: a document is exploded, its lines follow each other in one task, and all facts about a line
are columns of generated code.  The walk over the lines, which carries a buffer, is Python on Arrow batches;
it gets a line's text, kind and flags, and holds one paragraph, not one document.  What it asks about the
buffer is kept as the buffer grows, so that it is linear in the text.  One scan, no shuffle.  A Latin text is
a single row that goes through as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from inkstone.functions import chars as c
from inkstone.functions import text as t
from inkstone.operators import predicates as p
from inkstone.options import PdfOptions, boundary_level

_SPACE = c.WHITE
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")
_HAN_OR_LETTER = re.compile("[㐀-䶿一-鿿豈-﫿A-Za-z]")
_MARK = {x: k for k, pair in enumerate(p.QUOTE_COUNTERS) for x in "".join(pair)}
_BRACKET = re.compile(c.any_of(c.BRACKETS))
_QUOTE = re.compile("[" + "".join(a + b for a, b in p.QUOTE_COUNTERS).translate({ord(x): None for x in "〞〟"}) + "]")  # 〞 and 〟 close nothing here
#: Characters at either end of a buffer that are looked at without joining its lines.
_HEAD = 256
#: Lines of a batch that are Python objects at once; Latin texts are among them, whole.
ROWS = 256


#: Kinds of lines, and flags of those that are neither alone nor empty.
TEXT, EMPTY, DIVIDER, MARKER, CUSTOM, TITLE, METADATA, HEADING, AS_IS, BLANK = range(10)
ALONE_KINDS = {DIVIDER: "divider", MARKER: "marker", CUSTOM: "custom title", TITLE: "title", METADATA: "metadata"}
CONTINUES, DIALOG, LIST, CLOSER, BRACKET, QUOTE, ALONE, INDENT = (1 << k for k in range(8))


def line_facts(lines: DataFrame, options: PdfOptions) -> DataFrame:
    """(doc, text, kind, flags) of lines (raw, mode, doc); mode AS_IS or BLANK goes through without a look, its text is the document's."""
    whole = F.coalesce(F.col("mode"), F.lit(TEXT)) != TEXT
    own = lines.select("doc", "mode", "raw", F.when(whole, "").otherwise(t.strip_half_width_indent(t.right_trim(F.col("raw")))).alias("stripped"))
    own = own.select("*", p.divider(t.probe(F.col("stripped"))).alias("divider"))
    own = own.select("*", F.when(F.col("divider"), F.col("stripped")).otherwise(t.collapse_line(F.col("stripped"))).alias("text"))
    text = F.col("text")
    own = own.select("*", t.probe(text).alias("probe"), c.last_char(text).alias("last"), p.begins_list(text).alias("list"), p.unclosed_bracket(text).alias("bracket"), p.unclosed_quote(text).alias("quote"))
    own = own.select("*", c.strip(F.col("probe")).alias("s"))
    last = F.col("last")
    heading = p.heading_ladder(F.col("s"), last, c.utf16_length(F.col("s")), F.col("bracket") | F.col("quote"), options.short_heading)
    kind = (
        F.when(whole, F.col("mode"))
        .when(F.col("divider"), DIVIDER)
        .when(text == "", EMPTY)
        .when(p.page_marker(text), MARKER)
        .when(p.custom_title(F.col("probe"), options.short_heading), CUSTOM)
        .when(p.title(F.col("probe")), TITLE)
        .when(p.metadata(F.col("probe")), METADATA)
        .when(heading, HEADING)
        .otherwise(TEXT)
    )
    flags = [
        (CONTINUES, last.isin(*c.COLON, "）", ")") | p.all_cjk(text, white_space=True)),
        (DIALOG, c.first_char(text).isin(*c.DIALOG_OPEN)),
        (LIST, F.col("list")),
        (CLOSER, last.isin(*c.DIALOG_CLOSE)),
        (BRACKET, F.when(F.col("list"), p.list_unclosed_bracket(text)).otherwise(F.col("bracket"))),
        (QUOTE, F.col("quote")),
        (ALONE, last.isin(*c.STRONG_END, *c.COLON) | p.ends_ellipsis(text)),
        (INDENT, p.indented(F.col("raw"))),
    ]
    bits = reduce(lambda a, x: a.bitwiseOR(x), [F.when(f, bit).otherwise(0) for bit, f in flags])
    own = own.select("doc", "raw", "text", "last", "list", "bracket", "quote", kind.cast("int").alias("kind"))
    return own.select("doc", "text", "kind", F.when(F.col("kind").isin(TEXT, HEADING), bits).otherwise(0).cast("int").alias("flags"))


# ---------------------------------------------------------------- the walk's questions about its buffer
def _bracketed(s: str) -> bool:
    s = s.strip(_SPACE)
    if len(s) < 2 or c.PAIRS.get(s[0]) != s[-1]:
        return False
    inner = s[1:-1].strip(_SPACE)
    depth = 0
    for x in s:
        depth += (x == s[0]) - (x == s[-1])
        if depth < 0:
            return False
    return bool(inner) and depth == 0 and _Han(inner).mostly


class _Han:
    """Han and ASCII letters of a text that grows: some Han, no fewer than letters, never over four letters more."""

    def __init__(self, text: str = ""):
        self.lead = self.most = self.han = 0
        self.add(text)

    def add(self, text: str) -> None:
        for x in _HAN_OR_LETTER.findall(text):
            if x.isascii():
                self.lead += 1
                self.most = max(self.most, self.lead)
            else:
                self.lead -= 1
                self.han += 1

    @property
    def mostly(self) -> bool:
        return self.han > 0 and self.lead <= 0 and self.most <= 4


class Buffer:
    """Lines of a paragraph so far, and what the rules ask of them."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = self.units = 0  # characters, and UTF-16 units
        self.head = self.tail = ""
        self.stack: list[str] = []  # closers that are due
        self.spoilt = False
        self.han, self.counted = _Han(), 0

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)
        self.units += len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) >> 1
        if len(self.head) < _HEAD:
            self.head += text
        self.tail = (self.tail + text)[-_HEAD:] if len(text) < _HEAD else text
        for x in () if self.spoilt else _BRACKET.findall(text):
            if x in c.PAIRS:
                self.stack.append(c.PAIRS[x])
            elif not self.stack or self.stack.pop() != x:
                self.spoilt = True
                break

    @property
    def text(self) -> str:
        return "".join(self.parts)

    @property
    def nests(self) -> bool:
        return not self.spoilt and not self.stack

    @property
    def mostly_han(self) -> bool:
        while self.counted < len(self.parts):
            self.han.add(self.parts[self.counted])
            self.counted += 1
        return self.han.mostly

    @property
    def end(self) -> str:
        """The end of the text, white space behind it gone."""
        s = self.tail.rstrip(_SPACE)
        return s if s or len(self.tail) == self.size else self.text.rstrip(_SPACE)

    @property
    def last(self) -> str:
        return self.end[-1:]

    @property
    def begins_list(self) -> bool:
        return bool(_LIST.match(self.head if self.head.strip(_SPACE) else self.text))

    @property
    def bracketed(self) -> bool:
        if c.PAIRS.get(self.head.lstrip(_SPACE)[:1], "") != self.last and self.head.strip(_SPACE):
            return False
        return _bracketed(self.text)

    def sentence_ends(self, level: int) -> bool:
        s = self.end
        last, head = s[-1:], s[:-1].rstrip(_SPACE)
        if not last:
            return False
        if last in c.STRONG_END or level >= 3 and last in ".:" and _HAN.match(s[-2:-1]) and self.mostly_han:
            return True
        if last in c.DIALOG_CLOSE + "）)" and head:
            if head[-1] in c.STRONG_END:
                return True
            if head[-1] == "." and _HAN.match(head[:-1].rstrip(_SPACE)[-1:]) and self.mostly_han:
                return True
        if level >= 3:
            return False
        if (last == "：" or s.endswith(("…", "..."))) and self.mostly_han:
            return True
        return level < 2 and last in "；：;:"


class Walk:
    """Rules in order; the first that holds decides.  Segments are (text, rule)."""

    def __init__(self, keep_blank: bool, level: int):
        self.keep_blank, self.level = keep_blank, level
        self.out: list[tuple[str, str]] = []
        self.buffer = Buffer()
        self.depth = [0] * len(p.QUOTE_COUNTERS)

    def flush(self, rule: str, reset: bool = True) -> None:
        if self.buffer.size:
            self.out.append((self.buffer.text, rule))
            self.buffer = Buffer()
            if reset:
                self.depth = [0] * len(self.depth)

    def emit(self, text: str, rule: str, reset: bool = True) -> None:
        self.flush("before " + rule, reset)
        self.out.append((text, rule))

    def take(self, text: str, anew: bool = False) -> None:
        if anew:
            self.depth = [0] * len(self.depth)
        self.buffer.add(text)
        for x in _QUOTE.findall(text):
            k = _MARK[x]
            self.depth[k] = self.depth[k] + 1 if x == p.QUOTE_COUNTERS[k][0] else max(0, self.depth[k] - 1)

    @property
    def talking(self) -> bool:
        return any(self.depth)

    def heading_stands(self, flags: int) -> bool:
        if not self.buffer.size:
            return True
        if not self.buffer.nests:
            return False
        last = self.buffer.last
        return not last or last not in c.COMMA and not (flags & CONTINUES and last not in c.CLAUSE_END)

    def step(self, text: str, kind: int, flags: int) -> None:
        if kind == EMPTY:
            if not self.keep_blank and self.buffer.size and (self.talking or not self.buffer.nests or (last := self.buffer.last) and last not in c.STRONG_END):
                return
            self.flush("blank line")
        elif kind in ALONE_KINDS:
            self.emit(text, ALONE_KINDS[kind])
        elif kind == HEADING and self.heading_stands(flags):
            self.emit(text, "heading")
        elif flags & (DIALOG | LIST):
            self.opening(text, flags)
        else:
            self.ordinary(text, flags)

    def opening(self, text: str, flags: int) -> None:
        """A line that opens dialog or a list item."""
        sound = not flags & (BRACKET | QUOTE)
        if flags & DIALOG and flags & CLOSER and sound:
            self.emit(text, "dialog")
            self.depth = [0] * len(self.depth)
        elif flags & LIST and flags & ALONE and sound:
            self.emit(text, "list item", reset=False)
        else:
            last = self.buffer.last
            parted = last and last not in c.COMMA and not _HAN.match(last) and not self.talking and self.buffer.nests
            if parted or flags & LIST and self.buffer.size and self.buffer.begins_list:
                self.flush("opening", reset=False)
            self.take(text, anew=bool(flags & DIALOG))

    def ordinary(self, text: str, flags: int) -> None:
        buffer = self.buffer
        if flags & ALONE and not self.talking and not flags & (CLOSER | QUOTE):
            if buffer.size and (buffer.units > 120 or buffer.nests):
                buffer.add(text)
                self.flush("sentence end")
                return
            if not buffer.size and not flags & BRACKET:
                self.emit(text, "sentence end")
                return
        if not buffer.size:
            self.take(text, anew=True)
        elif flags & CLOSER:
            before = text.rstrip(_SPACE)[:-1].rstrip(_SPACE)[-1:] or buffer.last
            spoilt = not buffer.nests
            self.take(text)
            if not self.talking and before and before in c.CLAUSE_END and (not spoilt or flags & BRACKET or buffer.units > 120):
                self.flush("dialog end")
        elif not self.talking and (buffer.sentence_ends(self.level) and buffer.nests or buffer.bracketed or flags & INDENT):
            self.flush("boundary")
            self.take(text, anew=True)
        else:
            self.take(text)


_LIST = re.compile(p.LIST_STARTER.replace(c.W, _SPACE).replace(c.CJK, "㐀-䶿一-鿿豈-﫿"))
_SEGMENT = pa.struct([("text", pa.string()), ("rule", pa.string())])


class _Out:
    """Finished documents on their way to a batch."""

    def __init__(self, names: list[str], between: str):
        self.names, self.between = names, between
        self.docs: list[pa.StructArray] = []
        self.ends, self.segments, self.texts = [0], [], []

    def add(self, doc: pa.StructArray, segments: list[tuple[str, str]], text: str | None = None) -> None:
        self.docs.append(doc)
        self.segments += segments
        self.ends.append(len(self.segments))
        self.texts.append(self.between.join(x for x, _ in segments) if text is None else text)

    def batch(self) -> pa.RecordBatch:
        pairs = pa.StructArray.from_arrays([pa.array([s[k] for s in self.segments], pa.string()) for k in (0, 1)], fields=list(_SEGMENT))
        segments = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([*pa.concat_arrays(self.docs).flatten(), segments, pa.array(self.texts, pa.string())], self.names)


def _walked(options: PdfOptions, level: int, names: list[str], text_at: int):
    """Over lines in order, a document's first with the document: the documents with segments and joined text.

    Batches are taken in slices, so that a task's Python holds Spark's batch and what is made of ROWS lines of it.
    """
    between = "\n" if options.compact else "\n\n"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = walk = None

        def close() -> None:
            if walk is not None:
                walk.flush("end")
                out.add(doc, walk.out)

        for b in (whole.slice(k, ROWS) for whole in it for k in range(0, whole.num_rows, ROWS)):
            out = _Out(names, between)
            docs = b.column(0)
            first = docs.is_valid().to_numpy(zero_copy_only=False)
            for i, (text, kind, flags) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                if first[i]:
                    close()
                    doc, walk = docs.take(pa.array([i])), Walk(options.add_page_header, level)  # a copy: a slice would keep its batch
                if kind == AS_IS or kind == BLANK:
                    out.add(doc, [], doc.field(text_at)[0].as_py() if kind == AS_IS else "")
                    walk = None
                else:
                    walk.step(text, kind, flags)
            if out.docs:
                yield out.batch()
        out = _Out(names, between)
        close()
        if out.docs:
            yield out.batch()

    return run


def reflow(docs: DataFrame, options: PdfOptions | None = None, level: int = 2, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns segments (text and rule of each paragraph) and reflowed (joined).

    Null and blank texts become an empty text without segments.  Latin texts stay as they are, to the
    byte, with no segments.  Paragraphs are joined by one line break (compact) or two.  All columns and rows
    stay, repeated ones and nulls too; columns named segments or reflowed are replaced.
    """
    options, level = options or PdfOptions(), boundary_level(level)
    docs = docs.drop("segments", "reflowed")
    text = F.col(text_col)
    seen = F.coalesce(c.strip(F.left(text, F.lit(_HEAD))), F.lit("")) != ""
    blank = ~seen & (F.coalesce(c.strip(text), F.lit("")) == "")
    mode = F.when(blank, BLANK).when(p.latin_leading(text), AS_IS).otherwise(TEXT)
    own = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("doc"), text.alias("text"), mode.alias("mode"))
    lines = F.when(F.col("mode") == TEXT, F.split(t.normalize_newlines(F.col("text")), "\n", -1)).otherwise(F.array("text"))
    # the document goes with its first line only, so that no line carries the whole text
    rows = F.transform(lines, lambda x, i: F.struct(x.alias("raw"), F.when(i == 0, F.col("mode")).alias("mode"), F.when(i == 0, F.col("doc")).alias("doc")))
    facts = line_facts(own.select(F.explode(rows).alias("x")).select("x.*"), options)
    segments = ArrayType(StructType([StructField("text", StringType()), StructField("rule", StringType())]))
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in docs.schema.fields), StructField("segments", segments), StructField("reflowed", StringType())])
    return facts.mapInArrow(_walked(options, level, schema.names, [x.lower() for x in docs.columns].index(text_col.lower())), schema)


def paragraphs(reflowed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seg_no, text, rule) of every paragraph."""
    return reflowed.select(id_col, F.posexplode("segments").alias("seg_no", "s")).select(id_col, "seg_no", "s.text", "s.rule")
