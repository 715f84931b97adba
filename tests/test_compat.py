"""Compatibility tables against Unicode's own normalisation, character by character."""

import unicodedata

from pyspark.sql import functions as F

from inkstone.operators import dictionary as dic


def test_tables():
    assert len(dic.COMPAT) == 1 + 1002 and len(dic.COMPAT_EXTENDED) == 1 + 216
    for c, to in dic.COMPAT.items():
        assert len(to) == 1 and (c == "⸺" or unicodedata.normalize("NFD", c)[0] == unicodedata.normalize("NFD", to)[0] == unicodedata.normalize("NFC", c))
    for c, to in dic.COMPAT_EXTENDED.items():
        assert c == "⻚" or unicodedata.normalize("NFKC", c) == to


def test_texts_keep_their_length_and_all_else(spark):
    text = "".join([*dic.COMPAT, *dic.COMPAT_EXTENDED]) + "ﬁ①Ａ…é漢"  # what full compatibility would change too
    df = spark.createDataFrame([(text,), (None,)], "text string")
    plain, extended = (df.select(dic.normalize_compat(F.col("text"), x)).collect() for x in (False, True))
    assert plain[0][0] == "".join(dic.COMPAT.get(c, c) for c in text)
    assert extended[0][0] == "".join((dic.COMPAT | dic.COMPAT_EXTENDED).get(c, c) for c in text)
    assert plain[0][0].endswith("ﬁ①Ａ…é漢") and plain[1][0] is None
