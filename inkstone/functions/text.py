"""Scalar functions on texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.chars import WHITE, W, bound


def normalize_newlines(t: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(t, "\r\n?", "\n")


def save_newlines(t: Column) -> Column:
    """All line endings, those of Unicode too, become LF."""
    return F.regexp_replace(t, r"\r\n|[\r\f\x{85}\x{2028}\x{2029}]", "\n")


def strip_half_width_indent(s: Column) -> Column:
    return F.regexp_replace(s, "^ +", "")


def right_trim(s: Column) -> Column:
    return F.rtrim(s, F.lit(WHITE))


def probe(s: Column) -> Column:
    """Without spaces in front, half- and full-width."""
    return F.regexp_replace(s, r"^[ \x{3000}]+", "")


def normalize_white_space(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, f"[{W}]+", " "), "^ | $", "")


def drop_soft_hyphens(s: Column) -> Column:
    """Soft hyphens go, no-break spaces become spaces."""
    return F.translate(s, " ­", " ")


def cap_blank_lines(t: Column) -> Column:
    return F.regexp_replace(t, "\n{3,}", "\n\n")


def trim_trailing_newlines(t: Column) -> Column:
    return F.regexp_replace(t, r"(?<![\r\n])[\r\n]+\z", "")


def directory(path: Column) -> Column:
    """Up to the last slash, which is included."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def combine_path(base: Column, href: Column) -> Column:
    """A path inside a container: backslashes are slashes, ``.`` and empty parts go, ``..`` takes the part before."""
    parts = F.split(F.translate(F.concat(base, href), "\\", "/"), "/")
    none = F.slice(F.array(F.lit("")), 1, 0)
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, none, step), "/")


def letters(n: Column) -> Column:
    """Bijective base 26: 1 is a, 27 is aa; numbers below 1 count as 1."""
    n = F.greatest(n.cast("long"), F.lit(1))
    digits = F.sequence(F.lit(0), F.lit(12))
    start = F.struct(n.alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.when(a["n"] == 0, a).otherwise(
        F.struct(F.floor((a["n"] - 1) / 26).alias("n"), F.concat(F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), ((a["n"] - 1) % 26 + 1).cast("int"), F.lit(1)), a["s"]).alias("s"))
    )
    return F.aggregate(digits, start, step, lambda a: a["s"])


def _roman_digits(one: str, five: str, ten: str) -> list[str]:
    return ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]


#: Numerals of each decimal digit, tens by tens; thousands repeat.
ROMAN = [_roman_digits("C", "D", "M"), _roman_digits("X", "L", "C"), _roman_digits("I", "V", "X")]


def roman(n: Column) -> Column:
    n = F.greatest(n.cast("int"), F.lit(1))
    digit = lambda table, unit: F.element_at(F.array(*map(F.lit, table)), (F.floor(n / unit) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *(digit(x, u) for x, u in zip(ROMAN, (100, 10, 1), strict=True)))


def counter(n: Column, form: Column) -> Column:
    """A list number in its form; an unknown form is decimal, numbers below 1 count as 1."""
    n = F.greatest(n.cast("int"), F.lit(1))
    return (
        F.when(form == "decimalZero", F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")))
        .when(form == "lowerLetter", letters(n))
        .when(form == "upperLetter", F.upper(letters(n)))
        .when(form == "lowerRoman", F.lower(roman(n)))
        .when(form == "upperRoman", roman(n))
        .otherwise(n.cast("string"))
    )


def middle_ellipsis(s: Column, most: int = 50, head: int | None = None, tail: int | None = None, dots: str = "...") -> Column:
    """Long texts keep their head and tail; null is empty.  What is not given of the two shares the room that the dots leave."""
    room = most - len(dots)
    head = max(0, int(room / 2) if head is None else head)
    tail = max(0, room - head if tail is None else tail)
    if head + tail > room:
        tail = max(0, room - head)
    s = F.coalesce(s, F.lit(""))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.left(s, F.lit(head)), F.lit(dots), F.right(s, F.lit(tail))))


def collapse_token(token: Column) -> Column:
    """A token of three or more copies of a unit of 4 to 10 characters becomes the unit."""
    return F.when(F.length(token).between(12, 100), F.regexp_replace(token, r"^(.{4,10}?)\1{2,}\z", "$1")).otherwise(token)


#: The first phrase of up to 8 tokens that stands three times: what comes before it, and itself.  Nothing here repeats without a bound but single characters, which Java matches in a loop.
_PHRASE = r"(?s)^(.*?)(?<![^ ])([^ ]++(?: [^ ]++){0,7}?)(?: \2){2}(?![^ ])"
#: A token of 12 to 100 characters that is three or more copies of a unit of 4 to 10.
_COPIES = r"(?<![^ ])(?=[^ ]{12,100}(?![^ ]))([^ ]{4,10}?)\1{2,}+(?![^ ])"


def collapse_phrases(line: Column) -> Column:
    """Of tokens with single spaces between: the first phrase of up to 8 tokens that stands three times or more stays once; of phrases that begin there the shortest.

    The expression finds the first three copies; how many follow is counted by replacing each by a tab,
    which no token has.  Linear in the line.
    """
    head, phrase = F.regexp_extract(line, _PHRASE, 1), F.regexp_extract(line, _PHRASE, 2)

    def once(x: Column) -> Column:
        unit = F.concat(x["phrase"], F.lit(" "))
        rest = F.concat(F.substr(line, F.length(x["head"]) + 1), F.lit(" "))
        marked = F.replace(rest, unit, F.lit("\t"))
        copies = F.length(marked) - F.length(F.ltrim(marked, F.lit("\t")))
        out = F.concat(x["head"], unit, F.substr(rest, copies * F.length(unit) + 1))
        return F.left(out, F.length(out) - 1)

    return F.when(line.rlike(_PHRASE), bound(F.struct(head.alias("head"), phrase.alias("phrase")), once)).otherwise(line)


def collapse_line(line: Column) -> Column:
    """Runs of spaces and tabs become one space, then phrases and tokens collapse; a line without tokens stays."""
    spaced = F.trim(F.regexp_replace(line, "[ \t]+", " "))
    return F.when(spaced == "", line).otherwise(F.regexp_replace(collapse_phrases(spaced), _COPIES, "$1"))


def progress_bar(percent: Column, width: int = 10) -> Column:
    full = F.floor(F.least(F.greatest(percent, F.lit(0)), F.lit(100)) * width / 100).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("🟩"), full), F.repeat(F.lit("🟨"), width - full), F.lit("]"))


def progress_block(pages: Column) -> Column:
    """Every how many pages progress is told."""
    return F.when(pages <= 20, 1).when(pages <= 100, 3).when(pages <= 300, 5).otherwise(F.greatest(F.lit(1), F.floor(pages / 20))).cast("int")


def band(bottom: Column, top: Column) -> Column:
    """Number of the five-unit band of a text object's middle; 0 where it is unknown."""
    return F.coalesce(F.floor((bottom + top) * 0.5 / 5), F.lit(0)).cast("int")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)\z", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"\.[^.]*\z", "")


def splice(text: Column, start: Column, length: Column, new: Column) -> Column:
    """``new`` in place of a selection; a selection that is none replaces all."""
    ok = (start >= 0) & (length > 0) & (start + length <= F.length(text))
    return F.when(ok, F.concat(F.substr(text, F.lit(1), start), new, F.substr(text, start + length + 1))).otherwise(new)
