"""Dictionary conversion: forward maximum matching in rounds, layered dictionaries, script detection.

The package the reference takes its dictionaries from is not at hand; the mechanism is here, the tables
below are small, and larger ones are read as data (slot, key, value).
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys beyond which matching goes through a trie in Arrow batches instead of one regular expression.
EXPRESSION_KEYS = 2000

# ---- fixed values: conversion configurations, dictionary slots, and a small sample dictionary
CONFIGS = ["s2t", "s2tw", "s2twp", "s2hk", "s2hkp", "t2s", "t2tw", "t2twp", "t2hk", "t2hkp", "tw2s", "tw2sp", "tw2t", "tw2tp", "hk2s", "hk2sp", "hk2t", "hk2tp", "t2jp", "jp2t"]
SLOTS = [
    "STCharacters", "STPhrases", "STPunctuations", "TSCharacters", "TSPhrases", "TSPunctuations",
    "TWVariants", "TWVariantsRev", "TWVariantsPhrases", "TWVariantsRevPhrases", "TWPhrases", "TWPhrasesRev",
    "HKVariants", "HKVariantsRev", "HKVariantsPhrases", "HKVariantsRevPhrases", "HKPhrases", "HKPhrasesRev",
    "JPSCharacters", "JPSCharactersRev", "JPSPhrases",
]
SAMPLE = {
    "STCharacters": {"国": "國", "这": "這", "个": "個", "们": "們", "来": "來", "时": "時", "为": "為", "说": "說", "后": "後", "发": "發", "里": "裡", "面": "面"},
    "STPhrases": {"中国": "中國", "皇后": "皇后", "头发": "頭髮", "这里": "這裡", "来到": "來到", "时大": "時大"},
    "STPunctuations": {"“": "「", "”": "」", "‘": "『", "’": "』"},
    "TWPhrases": {"軟件": "軟體", "網絡": "網路"},
    "TWVariants": {"裡": "裏", "為": "爲"},
}
#: Tables the other way round, for the configurations that need them.
_INVERSE = {"STCharacters": "TSCharacters", "STPhrases": "TSPhrases", "STPunctuations": "TSPunctuations", "TWPhrases": "TWPhrasesRev", "TWVariants": "TWVariantsRev"}
SAMPLE |= {back: {v: k for k, v in SAMPLE[name].items()} for name, back in _INVERSE.items()}
# ---- end of fixed values

def _decomposed(kind: str, *blocks: tuple[int, int]) -> dict[str, str]:
    """Characters of some blocks that Unicode decomposes into one other character, canonically (no kind) or by compatibility."""
    out = {}
    for low, high in blocks:
        for code in range(low, high):
            *tag, first = unicodedata.decomposition(chr(code)).split()[:2] or [""]
            if first and tag == ([kind] if kind else []) and len(unicodedata.decomposition(chr(code)).split()) == 1 + bool(kind):
                out[chr(code)] = chr(int(first, 16))
    return out


#: From the standard library's Unicode data: compatibility ideographs, and, extended, radicals; beside them what Unicode has no mapping for.
COMPAT = {"⸺": "—"} | _decomposed("", (0xF900, 0xFB00), (0x2F800, 0x2FA20))
COMPAT_EXTENDED = {"⻚": "页"} | _decomposed("<compat>", (0x2E80, 0x2FE0))

#: Rounds of slots for each configuration, assumed from the slots' names: characters and phrases of one table make a round.
ROUNDS: dict[str, list[list[str]]] = {}
for _c in CONFIGS:
    _from, _to = _c.split("2")
    _rounds: list[list[str]] = []
    _back = {"tw": "TW", "hk": "HK"}.get(_from)
    if _back:
        if _c.endswith("p"):
            _rounds.append([f"{_back}PhrasesRev"])
        _rounds.append([f"{_back}VariantsRevPhrases", f"{_back}VariantsRev"])
    if _from == "s":
        _rounds.append(["STPhrases", "STCharacters"])
    if _from == "jp":
        _rounds.append(["JPSPhrases", "JPSCharactersRev"])
    if _to.rstrip("p") == "s":
        _rounds.append(["TSPhrases", "TSCharacters"])
    _fore = {"tw": "TW", "hk": "HK"}.get(_to.removesuffix("p"))
    if _fore:
        if _c.endswith("p"):
            _rounds.append([f"{_fore}Phrases"])
        _rounds.append([f"{_fore}VariantsPhrases", f"{_fore}Variants"])
    if _to == "jp":
        _rounds.append(["JPSCharacters"])
    ROUNDS[_c] = _rounds


def parse_config(name: str) -> str:
    """The configuration's canonical name; an unknown one is s2t."""
    key = name.strip().lower().split(" ", 1)[0]
    return key if key in CONFIGS else "s2t"


def config_of(label: Column) -> Column:
    """The same for a column of labels."""
    key = F.substring_index(F.lower(F.trim(label)), " ", 1)
    return F.when(key.isin(CONFIGS), key).otherwise("s2t")


def rounds(config: str, punctuation: bool = False) -> list[list[str]]:
    config = parse_config(config)
    extra = {"s": "STPunctuations", "t": "TSPunctuations"}.get(config.split("2")[0][:1]) if punctuation else None
    return ROUNDS[config] + ([[extra]] if extra else [])


def round_table(slots: list[str], tables: dict[str, dict[str, str]]) -> dict[str, str]:
    """Keys of a round: of equal keys the earlier slot's value."""
    return reduce(lambda a, s: {**tables.get(s, {}), **a}, slots, {})


def pattern(table: dict[str, str]) -> str:
    """Longest key first, then any character: leftmost alternatives make it a forward maximum match."""
    keys = sorted(table, key=lambda k: (-len(k), k))
    return "(?s)" + "|".join([re.escape(k) for k in keys] + ["."])


def convert_expression(text: Column, table: dict[str, str]) -> Column:
    """Forward maximum matching over a small table.

    Keys and values of one character are a translation.  The others are found by an expression, longest
    first, which takes what cannot begin one of them in runs; a run, and a character that begins none after
    all, is translated.  A text without any of the long keys is translated as a whole.
    """
    single = {k: v for k, v in table.items() if len(k) == len(v) == 1}
    long = {k: v for k, v in table.items() if k not in single}
    translated = lambda t: F.translate(t, "".join(single), "".join(single.values())) if single else t
    if not long:
        return translated(text)
    keys = "|".join(re.escape(k) for k in sorted(long, key=lambda k: (-len(k), k)))
    others = "[^" + "".join(sorted({re.escape(k[0]) for k in long})) + "]+"
    values = F.create_map(*(F.lit(x) for kv in sorted(long.items()) for x in kv))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){keys}|{others}|."), F.lit(0))
    whole = F.array_join(F.transform(pieces, lambda w: F.coalesce(F.try_element_at(values, w), translated(w))), "")
    return F.when(text.rlike(keys), whole).otherwise(translated(text))


def match_longest(text: str, table: dict[str, str], starts: dict[str, int]) -> str:
    """The same of one text; ``starts`` has the longest key's length by first character."""
    out, at = [], 0
    while at < len(text):
        for n in range(min(starts.get(text[at], 0), len(text) - at), 0, -1):
            value = table.get(text[at : at + n])
            if value is not None:
                out.append(value)
                at += n
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def convert_batches(text: Column, table: dict[str, str]) -> Column:
    starts: dict[str, int] = {}
    for k in table:
        starts[k[0]] = max(starts.get(k[0], 0), len(k))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else match_longest(t, table, starts))

    return run(text)


def round_tables(config: str, tables: dict[str, dict[str, str]] | None = None, punctuation: bool = False) -> list[dict[str, str]]:
    """One table for each round of a configuration."""
    return [{k: v for k, v in round_table(slots, SAMPLE if tables is None else tables).items() if k} for slots in rounds(config, punctuation)]


def convert(text: Column, config: str, tables: dict[str, dict[str, str]] | None = None, punctuation: bool = False) -> Column:
    """A text through a configuration's rounds; null stays null, what no key covers stays.

    A round without any entry is told by a warning; a configuration none of whose rounds has one is an
    error, as its results would be its inputs.
    """
    found = round_tables(config, tables, punctuation)
    if not any(found):
        raise ValueError(f"no dictionary has entries for {parse_config(config)}")
    if not all(found):
        warnings.warn(f"{parse_config(config)}: no entries for round {[n for n, x in enumerate(found, 1) if not x]}", stacklevel=2)
    for table in found:
        text = convert_expression(text, table) if len(table) <= EXPRESSION_KEYS else convert_batches(text, table)
    return text


def overlay(base: DataFrame, custom: DataFrame, specs: DataFrame) -> DataFrame:
    """(slot, key, value) of a base dictionary with custom entries over it.

    ``specs`` (ord, slot, mode, path) apply in order to the base, never to an earlier result: Append adds
    and replaces keys, Override first empties the slot.  ``custom`` has (path, key, value).
    """
    reset = specs.where("mode = 'Override'").groupBy("slot").agg(F.max("ord").alias("since"))
    rows = base.select(F.lit(-1).alias("ord"), "slot", "key", "value").unionByName(custom.join(specs, "path").select("ord", "slot", "key", "value"))
    rows = rows.join(reset, "slot", "left").where(F.col("since").isNull() | (F.col("ord") >= F.col("since")))
    return rows.groupBy("slot", "key").agg(F.max_by("value", F.struct("ord", "value")).alias("value"))


def check_specs(specs: list[tuple[str, str, str]]) -> None:
    """Rows of (slot, mode, path); the first bad one is named by its number."""
    for n, (slot, mode, path) in enumerate(specs, 1):
        if slot not in SLOTS or mode not in ("Append", "Override") or not (path or "").strip():
            raise ValueError(f"row {n}: a slot, Append or Override, and a file are needed")


def script_of(text: Column, tables: dict[str, dict[str, str]] | None = None) -> Column:
    """0 neither, 1 traditional, 2 simplified: by which characters the tables would change.  A definition of our own."""
    table = (SAMPLE if tables is None else tables)["STCharacters"]
    pairs = {k: v for k, v in table.items() if len(k) == 1 and len(v) == 1 and k != v}
    simple, full = "".join(sorted(pairs)), "".join(sorted(set(pairs.values()) - set(pairs)))
    s, t = F.regexp_count(text, F.lit(f"[{simple}]")), F.regexp_count(text, F.lit(f"[{full}]"))
    return F.when((s == 0) & (t == 0), 0).when(t > s, 1).otherwise(2)


def normalize_compat(text: Column, extended: bool = False) -> Column:
    table = COMPAT | (COMPAT_EXTENDED if extended else {})
    return F.translate(text, "".join(table), "".join(table.values()))


# ---- fixed values: first code point of each extension block
EXTENSIONS = {"ExtB": 0x20000, "ExtC": 0x2A700, "ExtD": 0x2B740, "ExtE": 0x2B820, "ExtF": 0x2CEB0, "ExtG": 0x30000, "ExtH": 0x31350, "ExtI": 0x2EBF0}
# ---- end of fixed values


def detofu(text: Column, table: dict[str, str], level: str = "ExtB") -> Column:
    """Replace rare Han of ``level`` and later blocks by the table; others stay."""
    use = {k: v for k, v in table.items() if ord(k) >= EXTENSIONS[level]}
    return F.translate(text, "".join(use), "".join(use.values())) if use else text


def latest_requests(requests: DataFrame, session: str, order: str) -> DataFrame:
    """The last request of each session, by partial sums: no session's requests are sorted in one task."""
    rest = [c for c in requests.columns if c != session]
    last = F.max_by(F.struct(*rest), order).alias("_last")
    return requests.groupBy(session).agg(last).select(session, *(F.col(f"_last.{c}").alias(c) for c in rest))


def label(name: str, specs: list[tuple[str, str, str]]) -> str:
    """A dictionary's name with the distinct slots that are customised, in their order."""
    slots = list(dict.fromkeys(s for s, *_ in specs))
    return f"{name} + {', '.join(slots)}" if slots else name


def valid_specs(specs: DataFrame) -> DataFrame:
    """Stored rows (ord, slot, mode, path) that can be used again; others are left out."""
    return specs.where(F.col("slot").isin(SLOTS) & F.col("mode").isin("Append", "Override") & (F.trim("path") != ""))
