"""Forward maximum matching: expression, automaton and plain loop agree, up to 100,000 keys."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkstone.operators import dictionary as dic
from inkstone.operators.matching import Matcher, convert_texts, slot_tables


def starts(table):
    out = {}
    for k in table:
        out[k[0]] = max(out.get(k[0], 0), len(k))
    return out


@pytest.mark.parametrize("seed", range(300))
def test_automaton_equals_a_plain_loop(seed):
    r = random.Random(seed)
    keys = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 7))}
    table = {k: r.choice(["", k, "xyz", "b"]) for k in keys}
    m = Matcher(table)
    for _ in range(20):
        text = "".join(r.choice("abcd\n") for _ in range(r.randint(0, 20)))
        assert m.convert(text) == dic.match_longest(text, table, starts(table))


@pytest.mark.parametrize("seed", range(8))
def test_expression_equals_a_plain_loop(spark, seed):
    r = random.Random(seed)
    alphabet = "ab]^-\\[.𠀀\n"
    table = {"".join(r.choice(alphabet) for _ in range(r.choice([1, 1, 2, 3]))): "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 1, 2]))) for _ in range(r.randint(1, 8))}
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = [x[0] for x in df.select(dic.convert_expression(F.col("text"), table)).collect()]
    assert got == [dic.match_longest(t, table, starts(table)) for t in texts] + [None]


def test_a_table_of_100000_keys(spark):
    r = random.Random(1)
    han = [chr(0x4E00 + k) for k in range(3000)]
    keys = {"".join(r.choice(han) for _ in range(r.choice([1, 2, 2, 3, 4, 6]))) for _ in range(125_000)}
    rows = [(("STCharacters" if len(k) == 1 else "STPhrases"), k, k[::-1] + "x" * (len(k) % 2)) for k in keys]
    assert len(rows) >= 100_000
    dictionary = spark.createDataFrame([*rows, ("STPhrases", None, "x"), ("STPhrases", "", "x"), ("STPhrases", "键", None), ("HKVariants", "一", "二")], "slot string, key string, value string")
    texts = ["".join(r.choice(han + ["，", "a"]) for _ in range(400)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate([*texts, None, ""])], "doc_id int, text string, key int, converted string")
    began = time.time()
    got = convert_texts(docs, dictionary, "s2t").orderBy("doc_id").collect()
    assert time.time() - began < 60
    table = dic.round_table(["STPhrases", "STCharacters"], slot_tables(dictionary, ["STPhrases", "STCharacters"]))
    own = starts(table)
    assert [x.text for x in got] == [dic.match_longest(t, table, own) for t in texts] + [None, ""]
    assert got[0].converted == "c" and got[0].asDict().keys() == set(docs.columns)
    with pytest.raises(ValueError, match="characters"):
        convert_texts(docs, dictionary, "s2t", most=1000)
    with pytest.raises(ValueError, match="no entries"):
        convert_texts(docs, dictionary, "t2jp")
