"""Ranked search (op13) against its SQL and brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import ranked, terms

SCHEMA = "doc_id long, text string, score int, rank int, query int, item_id int"
RX = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def cut(t):
    return re.findall(RX, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus(n=150):
    rng = np.random.default_rng(6)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 4000) % 60]
    texts = [" ".join(words[i * 20 : i * 20 + int(rng.integers(1, 40))]) for i in range(n)]
    texts += [texts[3]] * 70 + ["", None, " .. ", "Été W1, w2! w2", "x" * 500 + " w3 " + "w4 " * 3000]
    ids = [int(x) for x in rng.permutation(len(texts))]
    return list(zip(ids, texts, strict=True)) + [(None, "w5 w6 w7"), (ids[5], texts[5]), (7, "w9")]


ITEMS = [(1, "w1 w2 w3"), (2, "W5, w5 w6 - w40"), (3, ""), (4, None), (5, "nowhere"), (6, "été w55 w54"), (2, "w8"), (None, "w9 w10"), (8, " ".join(f"w{i}" for i in range(60)))]


def test_equals_sql(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    rows = corpus()
    con = duckdb.connect()
    con.register("docs", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    con.register("items", pa.table({"item_id": pa.array([r[0] for r in ITEMS], pa.int64()), "text": pa.array([r[1] for r in ITEMS], pa.string())}))
    want = sorted(map(repr, con.sql(ranked.search_sql("docs", "items")).fetchall()))
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(5)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    assert sorted(repr(tuple(r)) for r in ranked.search(docs, items).collect()) == want
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 4)  # several blocks of queries
    assert sorted(repr(tuple(r)) for r in ranked.search(docs, items).collect()) == want
    assert ranked.search(docs.limit(0), items).count() == ranked.search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize(("docs", "size", "block"), [(4096, 1 << 21, 1 << 21), (7, 1 << 21, 300), (1, 3, 20), (50, 60, 64), (5, 1000, 1 << 21)])
def test_pieces_hold_every_document_once(monkeypatch, docs, size, block):
    monkeypatch.setattr(ranked, "PIECE_DOCS", docs)
    monkeypatch.setattr(ranked, "PIECE_TERMS", size)
    monkeypatch.setattr(terms.blocks, "__defaults__", (block,))
    rows = [(k, t) for k, (_, t) in enumerate(corpus())]
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part], pa.string())], ["id", "text"]) for part in (rows[:100], rows[100:101], rows[101:])]
    got, pieces = {}, 0
    for b in ranked._indexed(["ids", "docs", "tokens", "words", "forward"])(iter(batches)):
        r = {k: b.column(k)[0].as_py() for k in b.schema.names}
        words, forward = ranked.unpacked(r["words"]), ranked.unpacked(r["forward"])
        term = words["word"].to_pylist()
        own = [Counter() for _ in r["ids"]]
        for d, t, n in zip(*(forward[c].to_pylist() for c in ("doc", "term", "tf")), strict=True):
            assert own[d][term[t]] == 0
            own[d][term[t]] = n
        df = Counter(w for c in own for w in c)
        assert [df[w] for w in term] == words["df"].to_pylist() and set(df) <= set(term)
        assert r["docs"] == sum(bool(c) for c in own) and r["tokens"] == sum(map(Counter.total, own))
        assert len(r["ids"]) <= docs and (sum(map(Counter.total, own[:-1])) <= size or sum(map(bool, own[:-1])) == 1)  # the last can go on in later blocks
        assert not set(r["ids"]) & set(got)
        got |= dict(zip(r["ids"], own, strict=True))
        pieces += 1
    assert got == {i: Counter(cut(t)) for i, t in rows}
    assert pieces >= len(rows) // docs


@pytest.mark.parametrize("seed", range(6))
def test_the_algorithm_misses_nothing(monkeypatch, seed):
    monkeypatch.setattr(ranked, "DEPTH", 2)
    rng = np.random.default_rng(seed)
    n, kinds, k = 300, 12, 10
    doc, term = np.nonzero(rng.random((n, kinds)) < rng.random(kinds) ** 2)
    impact = rng.integers(1, 5 if seed % 2 else 1000, len(doc))
    lists = ranked.Lists(n, doc, term, impact, kinds)
    w = rng.integers(0, 4 if seed % 2 else 900, kinds)
    dense = np.zeros((n, kinds), np.int64)
    dense[doc, term] = impact
    for own in (np.arange(kinds), np.array([1, 5, 7]), np.array([0])):
        score = dense[:, own] @ w[own]
        order = sorted(np.flatnonzero(score > 0).tolist(), key=lambda d: (-score[d], d))[:k]
        for floor in (0, int(score[order[-1]]) if len(order) == k else 0):
            d, s = ranked.best(lists, own, w[own], k, floor)
            assert len(set(d.tolist())) == len(d) and s.tolist() == score[d].tolist()
            assert sorted(d.tolist(), key=lambda x: (-score[x], x))[:k] == order


def test_reading_stops_early():
    n = 2000
    doc, term = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    impact = np.where(doc < 50, 100, 1)
    lists = ranked.Lists(n, doc, term, impact, 2)
    d, _ = ranked.best(lists, np.array([0, 1]), np.array([5, 5]), 50)
    assert len(d) == 50
    r = ranked.Ranking(3)
    r.add([5, None, 2], [7, 7, 7])
    r.add([9, 1], [8, 7])
    assert r.rows == [(9, 8), (1, 7), (2, 7)] and r.floor == 7
