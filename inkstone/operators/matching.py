"""Conversion by dictionary tables too large for an expression: an automaton for each round, shipped once.

A dictionary is a table (slot, key, value).  The slots that a configuration needs are checked for their
size and brought to the driver, broadcast, and compiled once by each worker.  A text is read once for a round:
the automaton gives every key that ends at each place, the longest of those that begin at a place counts,
and places are taken from the left, which is forward maximum matching.  Linear in the text and its matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.operators.dictionary import round_table, rounds
from inkstone.sources.shared import fresh

#: Characters of keys and values that a configuration's slots may have; ten times a large public dictionary.
MOST_CHARACTERS = 64_000_000


class Matcher:
    """Forward maximum matching over one table."""

    def __init__(self, table: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for key, value in table.items():
            if key:
                self.automaton.add_word(key, (len(key), value))
        self.automaton.make_automaton()
        self.empty = not len(self.automaton)

    def convert(self, text: str) -> str:
        if self.empty:
            return text
        found: dict[int, tuple[int, str]] = {}
        for end, (n, value) in self.automaton.iter(text):
            found[end + 1 - n] = (n, value)  # of keys that begin at a place the longest ends last
        out, at = [], 0
        for start in sorted(found):
            if start >= at:
                n, value = found[start]
                out += [text[at:start], value]
                at = start + n
        out.append(text[at:])
        return "".join(out)


def slot_tables(dictionary: DataFrame, slots: list[str], most: int = MOST_CHARACTERS) -> dict[str, dict[str, str]]:
    """{slot: {key: value}} of some slots of (slot, key, value), if they are small enough to be shipped; else an error.

    Null and empty keys and null values are left out; of equal keys the greatest value counts.
    """
    rows = dictionary.where(F.col("slot").isin(slots) & (F.col("key") != "") & F.col("value").isNotNull()).groupBy("slot", "key").agg(F.max("value").alias("value"))
    size = rows.agg(F.sum(F.length("key") + F.length("value"))).first()[0] or 0
    if size > most:
        raise ValueError(f"the dictionary has {size} characters for these slots, more than the {most} that are shipped to workers")
    out: dict[str, dict[str, str]] = {}
    for slot, key, value in rows.collect():
        out.setdefault(slot, {})[key] = value
    return out


#: What a worker has compiled last, by the broadcast's number.
_LAST: dict[int, list[Matcher]] = {}


def convert_texts(docs: DataFrame, dictionary: DataFrame, config: str, text_col: str = "text", punctuation: bool = False, most: int = MOST_CHARACTERS) -> DataFrame:
    """``docs`` with ``text_col`` taken through the rounds of a configuration, over a dictionary table.

    Null texts stay null, characters that no key covers stay.  A configuration without an entry is an error.
    Other columns and all rows stay.
    """
    steps = rounds(config, punctuation)
    tables = slot_tables(dictionary, sorted({s for step in steps for s in step}), most)
    own = [table for step in steps if (table := round_table(step, tables))]
    if not own:
        raise ValueError(f"the dictionary has no entries for {config}")
    shared = docs.sparkSession.sparkContext.broadcast(own)  # of MOST_CHARACTERS at most

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number = shared.id if hasattr(shared, "id") else id(shared)
        if number not in _LAST:
            _LAST.clear()
            _LAST[number] = [Matcher(t) for t in shared.value]
        for texts in batches:
            for m in _LAST[number]:
                texts = texts.map(lambda t, m=m: t if t is None else m.convert(t))
            yield texts

    new = fresh("converted", docs)
    return docs.withColumn(new, run(F.col(text_col))).select(*(F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
