"""The source divergence audit (op12) against its SQL on small tables, and its pieces with tiny blocks."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import divergence as d
from inkstone.llm import terms

SCHEMA = "doc_id long, text string, lang string, source string, chunk int, block int, n int, v int, part string"
ROWS = [
    ("The cat sat on the mat", "en", "a"), ("the cat, the dog", "en", "b"), ("The CAT the", "en", "a"), ("the dog sat; a dog", "en", "c"), ("dog", "en", "c"), ("sat sat", "en", "d"),
    ("12 34 !", "en", "empty"), (None, "en", "none"), ("", "en", None), ("cat the", "en", None), ("der Hund", "de", "a"), ("der Hund der", "de", "b"), ("der", "de", "b"),
    ("allein", "xx", "a"), ("zwei", "xx", "b"), ("été été", "fr", "a"), ("été à", "fr", "a"), ("ÉTÉ été", "fr", "b"), ("le the été", "fr", "solo"), ("the cat sat", None, "a"), ("the the", None, "a"), ("the", None, "z"), ("zzz the", None, "z"),
    ("The cat sat on the mat", "en", "a"), ("Ab\x00ab\x7fab_ab中文。", "en", "b"), ("ab ab ab", "en", "b"), ("ab", "en", "e"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 1, 2, 3, 4, "x") for i, (t, l, s) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("block", "chunks"), [(64, None), (2, 3), (1, 20)])
def test_equals_sql(spark, block, chunks):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("small", pa.table({"text": pa.array([r[0] for r in ROWS], pa.string()), "lang": pa.array([r[1] for r in ROWS], pa.string()), "source": pa.array([r[2] for r in ROWS], pa.string())}))
    want = sorted(con.sql(d.divergence_sql("small")).fetchall())
    got = sorted(tuple(r) for r in d.divergence(frame(spark, ROWS).repartition(3), block=block, chunks=chunks).collect())
    assert got == want
    assert {r[1] for r in got if r[0] == "en" and r[2] == "pair"} == {"a", "b", "c", "d", "e", "empty", "none", ""}


def test_empty(spark):
    assert d.divergence(frame(spark, []), chunks=4).count() == 0


def test_only_the_best_terms_in_order(spark):
    rows = [(f"t{chr(97 + i)}{chr(97 + j)} common", "en", "s" if i % 2 else "r") for i, j in itertools.product(range(6), range(6)) for _ in range(3)]
    got = [r for r in d.divergence(frame(spark, rows), top=7, chunks=5).collect() if r.part == "term"]
    full = [r for r in d.divergence(frame(spark, rows), top=1000, chunks=5).collect() if r.part == "term"]
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in full if r["rank"] <= 7)
    for s in "rs":
        own = sorted((r for r in full if r.source == s), key=lambda r: r["rank"])
        assert [r.item for r in own] == [r.item for r in sorted(own, key=lambda r: (-r.value, r.item.encode()))]


def test_share_is_exact():
    rng = np.random.default_rng(1)
    count = np.concatenate([rng.integers(0, 10, 50), rng.integers(0, 10**15, 50), [0, 10**15]])
    total = count + 1 + rng.integers(1, 10**12, len(count))
    assert d.share(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total, strict=True)]


@pytest.mark.parametrize(("held", "size"), [(1 << 19, 1 << 21), (4, 30), (1, 5)])
def test_counts_do_not_depend_on_blocks(monkeypatch, held, size):
    monkeypatch.setattr(d, "HELD", held)
    monkeypatch.setattr(terms.blocks, "__defaults__", (size,))
    rows = [((t or "") + " long tail of the text " * (i % 3), l or "", s or "") for i, (t, l, s) in enumerate(ROWS)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part]) for k in (1, 2, 0)], ["lang", "source", "text"]) for part in (rows[:9], rows[9:])]
    dealt = sorted((r for b in d._tally(3)(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
    table = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in dealt[j : j + 2]]) for k in range(3)], ["lang", "chunk", "packed"]) for j in range(0, len(dealt), 2)]
    n, docs = Counter(), defaultdict(set)
    for i, (t, l, s) in enumerate(rows):
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)):
            n[l, s, w] += 1
            docs[l, w].add(i)
    want = {k: c for k, c in n.items() if len(docs[k[0], k[2]]) >= 3}
    got, words = {}, None
    for b in d._vectors(3)(iter(table)):
        r = {k: b.column(k)[0].as_py() for k in b.schema.names}
        t = d._unpacked(r["packed"])
        if r["source"] is None:
            words = t.column(0).to_pylist()
            assert r["size"] == len(words) and r["total"] == sum(t.column(1).to_pylist())
        else:
            for p, c in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                got[r["lang"], r["source"], words[p]] = c
    assert got == want


def test_tiles_equal_brute_force(monkeypatch):
    monkeypatch.setattr(d, "SLICE", 3)
    rng = np.random.default_rng(4)
    v, sides = 40, [[("a", 0), ("b", 0), ("c", 0)], [("d", 0), ("e", 0)]]
    counts = {s: rng.integers(0, 3, v) * rng.integers(0, 2, v) for s in "abcde"}
    counts["e"][:] = 0
    described = [[(s, int(counts[s].sum()), v) for s, _ in side] for side in sides]
    tile = d._Tile("en", False, described)
    for low in (0, 15):
        high = {0: 15, 15: 30}[low]  # the last ten terms come in no chunk that this tile sees
        vectors = [{k: (np.flatnonzero(counts[s][low:high]), counts[s][low:high][counts[s][low:high] > 0]) for k, (s, _) in enumerate(side) if counts[s][low:high].any()} for side in sides]
        tile.add(high - low, vectors)
    for s in "abcde":
        counts[s][30:] = 0
    got = {(r["source"], r["item"]): r["value"] + (r["v"] - r["seen"]) * r["rest"] for r in tile.rows().to_pylist()}
    n = {s: next(m[1] for side in described for m in side if m[0] == s) for s in "abcde"}
    p = {s: [1 + 10**9 * (int(c) + 1) // (n[s] + v) for c in counts[s]] for s in "abcde"}
    want = {(a, b): sum((x - y) ** 2 // y for x, y in zip(p[a], p[b], strict=True)) for a, b in [*itertools.product("abc", "de"), *itertools.product("de", "abc")]}
    assert got == want and math.prod(want.values()) > 0
