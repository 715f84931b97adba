"""Character classes, written so that Java's and RE2's regular expressions read them alike (``\\x{...}``).

Lengths: Spark counts code points; limits that count UTF-16 units use ``utf16_length``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the classes that the rules name
#: White space, as bare \s and trim differ between engines.
W = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Han of the Basic Multilingual Plane; supplementary planes are not counted.
#: The same as characters, for trimming.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
DIGIT = "0-9０-９"
LETTER = "A-Za-z"
NEUTRAL = r" \-/:.—–…·・～―‐、："
DIALOG_OPEN, DIALOG_CLOSE = "“‘「『﹁﹃", "”’」』﹂﹄"
COMMA = "，,、"
COLON = "：:"
STRONG_END = "。！？!?"
CLAUSE_END = "。！？；：…—”」’』）】》〗〕］｝＞〉>.):!?"
QUOTE_OPEN, QUOTE_CLOSE = "“‘「『", "”’」』"
SEPARATOR = r":：\x{3000}·・"
DIVIDER = r"\x{2500}-\x{257F}\-=_~～*＊★☆"
BRACKETS = "（）()[]［］{}｛｝<>＜＞〈〉【】《》〔〕〖〗"
LATINISH = r"A-Za-z0-9.,!?:;'\"()\[\]{}\-_/\\@#$%&*+=<>\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
# ---- end of fixed values

OPENERS, CLOSERS = BRACKETS[::2], BRACKETS[1::2]
PAIRS = dict(zip(OPENERS, CLOSERS, strict=True))


def any_of(chars: str) -> str:
    """A class of literal characters."""
    return "[" + "".join("\\" + c if c in r"\]^-[" else c for c in chars) + "]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; also inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def utf16_length(s: Column) -> Column:
    return F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE))


def first_char(s: Column) -> Column:
    """First character that is not white space, or an empty string."""
    return F.left(F.ltrim(s, F.lit(WHITE)), F.lit(1))


def last_char(s: Column) -> Column:
    return F.right(F.rtrim(s, F.lit(WHITE)), F.lit(1))


def char_before_last(s: Column) -> Column:
    """Last but one of the characters that are not white space, or an empty string."""
    return last_char(bound(F.rtrim(s, F.lit(WHITE)), lambda t: F.left(t, F.length(t) - 1)))
