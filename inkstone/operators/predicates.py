"""Predicates on lines, as columns.  Rules that count are ordered, early conditions first, in one CASE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.chars import (
    CJK,
    CLAUSE_END,
    COLON,
    COMMA,
    DIALOG_CLOSE,
    DIALOG_OPEN,
    DIGIT,
    DIVIDER,
    LATINISH,
    LETTER,
    NEUTRAL,
    PAIRS,
    QUOTE_CLOSE,
    QUOTE_OPEN,
    SEPARATOR,
    STRONG_END,
    W,
    any_of,
    bound,
    char_before_last,
    first_char,
    last_char,
    strip,
    utf16_length,
)
from inkstone.options import ShortHeading

# ---- fixed values: patterns and lists that the rules name
TITLES = r"目录|目錄|前言|序章|楔子|终章|尾声|尾聲|后记|後記|番外.{0,15}|.{0,10}?第.{0,5}?([章节部卷節回][^分合的])|(?:卷|章)[一二三四五六七八九十](?:$|.{0,20}?)"
LATE_COMMA = r"^.{20,}[,，]"
INDENT = rf"^[{W}]{{2,}}"
LIST_STARTER = rf"^[{W}]*(?:[\-*＊•‧▪◦○●※][{W}]|\([0-9０-９一二三四五六七八九十]{{1,2}}\)|（[0-9０-９一二三四五六七八九十]{{1,2}}）|[0-9０-９一二三四五六七八九十]{{1,2}}(?:[)）、]|\.[ {CJK}]))"
METADATA_KEYS = [
    "書名", "书名", "作者", "原著", "譯者", "译者", "校訂", "校订", "產品經理", "产品经理", "出版社", "出版時間", "出版时间", "出版日期",
    "版權", "版权", "版權頁", "版权页", "版權信息", "版权信息", "責任編輯", "责任编辑", "編輯", "编辑", "責編", "责编", "定價", "定价",
    "簡介", "简介", "前言", "序章", "終章", "终章", "尾聲", "尾声", "後記", "后记", "品牌方", "出品方", "授權方", "授权方",
    "電子版權", "数字版权", "掃描", "扫描", "發行", "发行", "OCR", "CIP", "在版編目", "在版编目", "分類號", "分类号", "主題詞", "主题词",
    "類型", "类型", "標簽", "标签", "内容標簽", "内容标签", "系列", "發行日", "发行日", "初版", "ISBN",
]
# ---- end of fixed values
MAX_KEY = max(map(len, METADATA_KEYS))


def contains_cjk(s: Column) -> Column:
    return s.rlike(f"[{CJK}]")


def all_ascii(s: Column) -> Column:
    return s.rlike(r"^[\x00-\x7F]+\z")


def all_ascii_digits(s: Column) -> Column:
    return s.rlike(rf"^[ {DIGIT}]+\z") & s.rlike(f"[{DIGIT}]")


def all_cjk(s: Column, white_space: bool = False) -> Column:
    if white_space:
        return s.rlike(rf"^[{W}{CJK}]+\z") & contains_cjk(s)
    return s.rlike(rf"^[{CJK}]+\z")


def mixed_cjk_ascii(s: Column) -> Column:
    """Neutral, Han or alphanumeric characters until both of the latter have been seen; what follows does not count."""
    a, n = f"{LETTER}{DIGIT}", NEUTRAL
    return s.rlike(f"^[{n}]*(?:[{a}][{a}{n}]*[{CJK}]|[{CJK}][{CJK}{n}]*[{a}])")


def mostly_cjk(s: Column) -> Column:
    """Some Han, no fewer than ASCII letters, and no prefix with over four letters more than Han."""
    start = F.struct(F.lit(0).alias("lead"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        lead = a["lead"] + F.when(c == "1", 1).otherwise(-1)
        return F.struct(lead.alias("lead"), F.greatest(a["most"], lead).alias("most"))

    def early(t: Column) -> Column:
        kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, f"[^{CJK}{LETTER}]+", ""), f"[{CJK}]", "0"), f"[{LETTER}]", "1")
        return F.aggregate(F.split(kinds, ""), start, step, lambda a: a["most"])

    def holds(t: Column) -> Column:
        # characters are counted by taking them away in runs, which is a match for each run and not for each character
        cjk, letters = (F.length(t) - F.length(F.regexp_replace(t, f"[{x}]+", "")) for x in (CJK, LETTER))
        # the fold is needed only where the totals leave room for an early failure
        enough = lambda n: (n["cjk"] > 0) & (n["cjk"] >= n["letters"]) & F.when(n["letters"] <= 4, True).otherwise(early(t) <= 4)
        return bound(F.struct(cjk.alias("cjk"), letters.alias("letters")), enough)

    return bound(s, holds)


def latin_leading(t: Column, limit: int = 200) -> Column:
    """The first 200 visible characters are Latin text: no Han, 40 at least, nine tenths Latin."""
    head = F.regexp_replace(F.regexp_extract(t, f"^(?:[{W}]*[^{W}]){{0,{limit}}}", 0), f"[{W}]", "")
    return bound(head, lambda h: ~contains_cjk(h) & (F.length(h) >= 40) & (F.regexp_count(h, F.lit(f"[{LATINISH}]")) * 10 >= F.length(h) * 9))


def begins_dialog(s: Column) -> Column:
    return s.rlike(f"^[{W}]*[{DIALOG_OPEN}]")


def ends_dialog(s: Column) -> Column:
    return s.rlike(rf"[{DIALOG_CLOSE}][{W}]*\z")


def begins_list(s: Column) -> Column:
    return s.rlike(LIST_STARTER)


def has_comma(s: Column) -> Column:
    return s.rlike(f"[{COMMA}]")


def ends_colon(s: Column) -> Column:
    return s.rlike(rf"[{COLON}][{W}]*\z")


def ends_ellipsis(s: Column) -> Column:
    """Ungated: an ellipsis, or two full stops."""
    return s.rlike(rf"(?:…|\.\.)[{W}]*\z")


def has_strong_end(s: Column) -> Column:
    return s.rlike(f"[{STRONG_END}]")


def ends_strong(s: Column) -> Column:
    return s.rlike(rf"[{STRONG_END}][{W}]*\z")


def divider(s: Column) -> Column:
    return s.rlike(rf"^[{W}{DIVIDER}]+\z") & s.rlike(f"^(?:[{W}]*[{DIVIDER}]){{3}}")


def indented(raw: Column) -> Column:
    return raw.rlike(INDENT)


def page_marker(s: Column) -> Column:
    return s.startswith("=== ") & s.endswith("===")


def title(s: Column) -> Column:
    return ~s.rlike(LATE_COMMA) & s.rlike(rf"^(?=.{{0,50}}$)(?:{TITLES})")


def custom_title(s: Column, heading: ShortHeading) -> Column:
    rx = heading.custom()
    return s.rlike(rx) if rx else F.lit(False)


def metadata(line: Column) -> Column:
    """``key separator value`` of 30 UTF-16 units at most, with a known key and a value that opens no dialog."""
    rx = f"^[{W}]*([^{SEPARATOR}]+)[{SEPARATOR}][{W}]*([^{W}])"
    short = F.when(utf16_length(line) <= 30, line).otherwise("")  # the expression never sees a longer line
    raw = F.regexp_extract(short, rx, 1)
    value = F.regexp_extract(short, rx, 2)
    return F.length(raw).between(1, MAX_KEY) & strip(raw).isin(METADATA_KEYS) & ~value.isin(*DIALOG_OPEN)


def _unbalanced(marks: Column, up: Column) -> Column:
    """Whether openers and closers, an array of both, leave some open or close one too early; ``up`` tells an opener."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("low"))

    def step(a: Column, c: Column) -> Column:
        d = a["d"] + F.when(up(c), 1).otherwise(-1)
        return F.struct(d.alias("d"), F.least(a["low"], d).alias("low"))

    return F.aggregate(marks, start, step, lambda a: (a["d"] != 0) | (a["low"] < 0))


def bracket_balanced(s: Column, opener: str) -> Column:
    return ~_unbalanced(F.filter(F.split(s, ""), lambda c: c.isin(opener, PAIRS[opener])), lambda c: c == opener)


#: Quotes that are counted together: each opener with its closers.
QUOTE_COUNTERS = [("“", "”〞〟"), ("‘", "’"), ("「", "」"), ("『", "』"), ("﹁", "﹂"), ("﹃", "﹄")]


def unclosed_quote(s: Column) -> Column:
    """Some quote is left open, or closed before it is opened; the six kinds count apart."""
    any_mark = "".join(a + b for a, b in QUOTE_COUNTERS)

    def of_kind(marks: Column, up: str, down: str) -> Column:
        own = F.filter(F.split(marks, ""), lambda c: c.isin(up, *down))
        return marks.rlike(f"[{up}{down}]") & _unbalanced(own, lambda c: c == up)

    def wrong(marks: Column) -> Column:
        out = F.lit(False)
        for up, down in QUOTE_COUNTERS:
            out = out | of_kind(marks, up, down)
        return out

    return s.rlike(f"[{any_mark}]") & bound(F.regexp_replace(s, f"[^{any_mark}]", ""), wrong)


def unclosed_bracket(s: Column) -> Column:
    """Brackets do not nest properly: a stack is folded over them; a stray or wrong closer spoils it."""
    brackets = any_of("".join(a + b for a, b in PAIRS.items()))[1:-1]
    closer = F.create_map(*(F.lit(x) for p in PAIRS.items() for x in p))
    step = lambda a, c: (
        F.when((a == "!") | (c == ""), a).when(c.isin(*PAIRS), F.concat(F.element_at(closer, c), a)).when(F.left(a, F.lit(1)) == c, F.substr(a, F.lit(2))).otherwise("!")
    )
    return bound(s, lambda t: t.rlike(f"[{brackets}]") & (F.aggregate(F.split(F.regexp_replace(t, f"[^{brackets}]", ""), ""), F.lit(""), step) != ""))


def list_unclosed_bracket(s: Column) -> Column:
    """The same behind a list number like ``1)``."""
    return unclosed_bracket(F.regexp_replace(s, rf"^[{W}]*[0-9０-９一二三四五六七八九十]{{1,2}}[)）]", ""))


def bracket_boundary(s: Column) -> Column:
    """One matching pair of brackets round text that is mostly Han, balanced for its kind."""
    pairs = F.create_map(*(F.lit(x) for p in PAIRS.items() for x in p))

    def holds(t: Column) -> Column:
        first, last = F.left(t, F.lit(1)), F.right(t, F.lit(1))
        paired = F.coalesce(F.try_element_at(pairs, first) == last, F.lit(False))
        # the other characters go in runs: only brackets are looked at one by one
        brackets = any_of("".join(a + b for a, b in PAIRS.items()))[1:-1]
        marks = F.filter(F.split(F.regexp_replace(t, f"[^{brackets}]+", ""), ""), lambda c: (c == first) | (c == last))
        inside = strip(F.substr(t, F.lit(2), F.length(t) - 2))
        return (F.length(t) >= 2) & paired & ~_unbalanced(marks, lambda c: c == first) & bound(inside, lambda x: (x != "") & mostly_cjk(x))

    return bound(strip(s), holds)


def wrapped(s: Column) -> Column:
    """The first character pairs with the last visible one, three characters at least."""
    pair = F.try_element_at(F.create_map(*(F.lit(x) for p in PAIRS.items() for x in p)), F.left(s, F.lit(1)))
    return F.coalesce((F.length(s) >= 3) & (pair == last_char(s)), F.lit(False))


def suspicious_quotes(line: Column) -> Column:
    """Both ends are quotation marks that make no pair: reversed, or of different kinds."""

    def holds(t: Column) -> Column:
        first, last = F.left(t, F.lit(1)), F.right(t, F.lit(1))
        reverse = first.isin(*QUOTE_CLOSE) & last.isin(*QUOTE_OPEN)
        pair = F.translate(first, QUOTE_OPEN, QUOTE_CLOSE)
        return (F.length(t) >= 2) & (reverse | (first.isin(*QUOTE_OPEN) & last.isin(*QUOTE_CLOSE) & (pair != last)))

    return bound(strip(line), holds)


def sentence_boundary(s: Column, level: int = 2) -> Column:
    """The ladder of sentence ends; level 3 is the strictest and alone takes an ASCII stop after Han."""
    closers = any_of("".join(PAIRS.values()) + QUOTE_CLOSE + "﹂﹄")[1:-1]
    ocr_end = s.rlike(rf"[{CJK}][.:][{W}]*\z") & mostly_cjk(s)
    ocr_closed = s.rlike(rf"[{CJK}][{W}]*\.[{W}]*[{closers}][{W}{closers}]*\z") & mostly_cjk(s)

    def ladder(last: Column, before: Column) -> Column:
        closing = last.isin(*(QUOTE_CLOSE + "﹂﹄"), "）", ")") & (before != "")
        case = F.when(last == "", False).when(last.isin(*STRONG_END), True)
        if level >= 3:
            case = case.when(last.isin(".", ":") & ocr_end, True)
        case = case.when(closing & before.isin(*STRONG_END), True).when(closing & (before == ".") & ocr_closed, True)
        if level >= 3:
            return case.otherwise(False)
        case = case.when((last == "：") & mostly_cjk(s), True).when(s.rlike(rf"(?:…|\.\.\.)[{W}]*\z") & mostly_cjk(s), True)
        return case.otherwise(False) if level >= 2 else case.otherwise(last.isin("；", "：", ";", ":"))

    return bound(F.struct(last_char(s).alias("last"), char_before_last(s).alias("before")), lambda x: ladder(x["last"], x["before"]))


def heading_ladder(s: Column, last: Column, n: Column, unclosed: Column, heading: ShortHeading | None = None) -> Column:
    """The ladder of short headings over what is known of a line: trimmed text, last visible character, UTF-16 length, a bracket or quote left open."""
    h = heading or ShortHeading()
    base = min(30, max(3, h.max_len))
    wide = min(30, max(10, 2 * base))
    longer = F.lit(False)
    kinds = F.lit(False)
    if h.all_ascii:
        longer, kinds = longer | all_ascii(s), kinds | all_ascii(s)
    if h.mixed:
        longer, kinds = longer | mixed_cjk_ascii(s), kinds | mixed_cjk_ascii(s)
    if h.all_cjk:
        kinds = kinds | all_cjk(s)
    if h.all_ascii_digits:
        kinds = kinds | all_ascii_digits(s)
    return (
        F.when((s == "") | page_marker(s), False)
        .when(unclosed, False)
        .when(last.isin(*COLON) & (n <= h.max_len) & s.rlike(rf"^[{CJK}]+[{COLON}]\z"), True)
        .when(last.isin("）", ")") & ~has_comma(s), True)
        .when(wrapped(s) & mostly_cjk(s), True)
        .when(last.isin(*CLAUSE_END) | has_comma(s), False)
        .when(n > wide, False)
        .when((n > base) & ~longer, False)
        .when(has_strong_end(s), False)
        .otherwise(kinds)
    )


def short_heading(line: Column, heading: ShortHeading | None = None) -> Column:
    """The ladder of short headings."""
    parts = lambda s: F.struct(s.alias("s"), last_char(s).alias("last"), utf16_length(s).alias("n"))
    return bound(bound(strip(line), parts), lambda x: heading_ladder(x["s"], x["last"], x["n"], unclosed_bracket(x["s"]) | unclosed_quote(x["s"]), heading))
