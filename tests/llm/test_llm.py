import hashlib
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, fp int, vec int, node int, k int"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), 1, 2, 3, 4, 5) for i, t, l, s in rows], SCHEMA)


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# ---------------------------------------------------------------- components
def test_components(spark):
    from inkstone.llm.components import components

    edges = [(i, i + 1) for i in range(200)] + [(500, 300), (300, 500), (7, 7), (None, 3), (1000, 1001)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b").collect()))
    assert got == {i: 0 for i in range(1, 201)} | {500: 300, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---------------------------------------------------------------- op1
def test_vectors(spark):
    from inkstone.llm.neardup_vectors import vector_components

    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:10] + 0.1 * rng.standard_normal((10, 16)), np.repeat(base[:1], 30, axis=0) + 0.02 * rng.standard_normal((30, 16)), base[:5], base[:5] * 2]).astype(np.float32)
    label = rng.integers(0, 2, len(x)).tolist()
    rows = [(i, v.tolist(), label[i], "x", 1) for i, v in enumerate(x)]
    rows += [(900, None, 0, "x", 1), (901, [], 0, "x", 1), (902, [0.0] * 16, 0, "x", 1), (903, [float("nan")] * 16, 0, "x", 1), (904, [None] + [1.0] * 15, 0, "x", 1), (905, x[0].tolist(), None, "x", 1), (906, x[0].tolist()[:8], label[0], "x", 1)]
    schema = "vec_id long, embedding array<float>, label int, vec string, node int"
    df = spark.createDataFrame(rows, schema)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    root = union_find(len(x), zip(*np.nonzero(near), strict=True))
    want = {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(len(x))} | {i: (0, i, True) for i in range(900, 907)}
    for block in (2048, 4):  # the second: every bucket of some size is a grid of blocks
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_components(df, block=block).collect()}
        assert got == want
    assert vector_components(spark.createDataFrame([], schema)).count() == 0


def test_vectors_in_few_products(monkeypatch):
    """Small buckets are compared together, and many vectors need few tables; links are those of each bucket by itself."""
    import pyarrow as pa

    from inkstone.llm import neardup_vectors as nv

    assert nv.tables(nv.hashes(60_000)) <= 20
    calls, links = [], nv.links
    monkeypatch.setattr(nv, "links", lambda *a, **k: calls.append(1) or links(*a, **k))
    x = np.random.default_rng(4).standard_normal((6000, 8)).astype(np.float32)
    x[1::2] = x[::2] * np.float32(1.5)
    x[4:6] = x[:2]  # in another bucket, so that they don't meet
    n = len(x)
    key = np.arange(n) // 2
    names = ["tab", "key", "i", "j", "label", "size", "block", "node", "weight", "vec"]
    cols = [np.zeros(n, np.int32), key, *(np.zeros(n, np.int64),) * 3, np.full(n, 8), np.zeros(n, np.int64), np.arange(n), np.ones(n, np.int64)]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array([v.tobytes() for v in x], pa.binary())], names)
    got = {(node, k, root) for b in nv._verify(2, 4, 0.93, "<f4")(iter([batch.slice(0, 2001), batch.slice(2001)])) for node, k, root in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert got == {(i, 1, i - i % 2) for i in range(n)} and len(calls) < 100


# ---------------------------------------------------------------- op2
def test_urls(spark):
    from inkstone.llm.urlfilter import filter_urls

    rows = [("HTTP://A.Example.ORG/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org", "example.org", "", None, "allow"), ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("nourl", "", "", None, "allow"), (None, "", "", None, "allow"), ("://h.com/de/#f", "h.com", "/de/", "com/de/", "block"), ("a://://b", ":", "//b", None, "allow")]
    df = spark.createDataFrame([(i, r[0], "h", "p") for i, r in enumerate(rows)], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}
    assert filter_urls(df.limit(0)).count() == 0


def test_url_method_learns(spark):
    from inkstone.llm.urlfilter import filter_urls

    rows = [(i, f"http://s.com/de/{i}") for i in range(30)] + [(100 + i, f"http://t.net/de/{i}") for i in range(9)] + [(200 + i, f"http://t.net/fr/{i}") for i in range(9)] + [(300 + i, f"http://s.com/fr/{i}") for i in range(30)]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[100 + i] == "block" and got[200 + i] == "allow" for i in range(9))


# ---------------------------------------------------------------- op3
def test_toxicity(spark):
    from inkstone.llm import toxicity as tx

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choice(words, 60).tolist()
        toxic = i % 4 == 0
        if toxic:
            for k in rng.choice(60, 5, replace=False):
                w[k] = str(rng.choice(["rotten", "rottenly,", "Vile!"]))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "so vile", None, None), (1002, "word " * 3000 + "vile", None, None)]
    d, y = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(d, y).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(400) if got[i].held_out]) > 0.95
    assert got[1000].predicted == got[1001].predicted == 0 and not got[None].held_out and all(0 <= r.score <= 1 for r in got.values())
    field = tx.learn(d, y)
    spans = tx.toxic_spans(d.where("doc_id = 0"), field).collect()
    text = rows[0][1]
    assert {re.sub(r"\W", "", text[r.start : r.end].lower()) for r in spans} <= {"rotten", "rottenly", "vile"} and len(spans) >= 4
    assert tx.toxicity(d, y.limit(0)).where("score > 0.01").count() == 0 and tx.toxicity(d.limit(0), y).count() == 0


def slow_sums(e, moves):
    """Marginals, expected transitions and P(all clean) of one document, over all paths."""
    from itertools import product

    n = len(e)
    weight = {p: np.exp(sum(e[k] * p[k] for k in range(n)) + sum(moves[p[k], p[k + 1]] for k in range(n - 1))) for p in product((0, 1), repeat=n)}
    total = sum(weight.values())
    pairs = [[sum(w * sum(q[k] == a and q[k + 1] == b for k in range(n - 1)) for q, w in weight.items()) / total for b in (0, 1)] for a in (0, 1)]
    return [sum(w for q, w in weight.items() if q[k]) / total for k in range(n)], pairs, weight[(0,) * n] / total


def test_sums_over_paths_do_not_depend_on_chains():
    from inkstone.llm.toxicity import Chains

    rng = np.random.default_rng(3)
    moves, n = rng.normal(size=(2, 2)), np.array([4, 0, 9, 1, 11])
    e = rng.normal(size=int(n.sum()))
    ends = np.cumsum(n)
    want = [slow_sums(e[b - k : b], moves) for b, k in zip(ends, n, strict=True)]
    for length in (1, 2, 3, 4, 128):
        c = Chains(n, length)
        p, pairs, clean = c.sums(c.spread(e), moves)
        assert np.allclose(c.marginals(c.spread(e), moves), np.concatenate([w[0] for w in want]))
        assert np.allclose(p[c.row, c.col], np.concatenate([w[0] for w in want]))
        for d, w in enumerate(want):
            assert np.allclose(pairs[:, :, c.document == d].sum(axis=2), w[1]) and np.isclose(np.exp(clean[d]), w[2])


def test_document_scores_are_brute_force_marginals(monkeypatch):
    from inkstone.llm import toxicity as tx

    f = tx.Field()
    f.bias, f.moves, f.document = -2.0, np.array([[0.5, -0.4], [-0.3, 0.8]]), np.array([-1.0, 0.7, 1.5, -0.6])
    f.weights = {"=vile": 3.0, "^rot": 2.0, "&you sick": 2.5}
    f.ready()
    texts = ["so vile! a rotten day", "you sick man", "feel sick", "", " \t", "vile", "a b c d e f g h i j"]
    e = [[-2, 1, -2, 0, -2], [-2, 0.5, -2], [-2, -2], [], [], [1], [-2] * 10]
    want = []
    for x in e:
        p = slow_sums(x, f.moves)[0] if x else []
        want.append(1 / (1 + np.exp(-(f.document @ [1, np.log1p(sum(p)), max(p, default=0), np.log1p(len(x)) / 10]))))
    assert np.allclose(f.scores(texts), want)
    for chain, block in ((3, 4_000_000), (128, 5)):
        monkeypatch.setattr(tx, "CHAIN", chain)
        monkeypatch.setattr(tx, "BLOCK", block)
        assert np.allclose(f.scores(texts), want)
    assert f.logistic(np.array([[0, 0, -1 / 0.6]]))[0] == 0.5  # counts as toxic


def test_context_decides(spark):
    """The same word is toxic behind another one only, which no list of words can tell."""
    from inkstone.llm import toxicity as tx

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choice(words, 40).tolist()
        w[3:5], w[20:22] = (["you", "sick"], ["feel", "tired"]) if i % 3 == 0 else (["feel", "sick"], ["you", "tired"])
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(i % 3 == 0)))
    rows.append((5000, "word " * 2000 + "you sick", "en", "s"))  # a late span counts
    d = docs(spark, rows)
    field = tx.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = field.scores([t for _, t, *_ in rows])
    assert np.mean([(x >= 0.5) == (i % 3 == 0) for i, x in enumerate(score[:400])]) > 0.98
    assert any("sick" in rows[0][1][a:b] for a, b, _ in field.spans(rows[0][1])) and not field.spans(rows[1][1])
    assert field.spans(rows[-1][1])


def test_labels_of_held_out_rows_are_not_read(spark):
    from inkstone.llm import toxicity as tx

    rows = [(i, f"word{i % 7} other {'vile' if i % 2 else 'fine'} end", "en", "s") for i in range(200)]
    out = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    d = docs(spark, rows + rows[:3])  # repeated rows
    got = []
    for flip in (0, 1):
        y = [(i, (i % 2) ^ (flip if i in out else 0)) for i in range(200)] + [(1, 0), (None, 1), (2, None)]
        got.append(sorted((r.doc_id, r.score) for r in tx.toxicity(d, spark.createDataFrame(y, "doc_id long, toxic int")).collect()))
    assert got[0] == got[1] and len(got[0]) == 203


# ---------------------------------------------------------------- op4
TEXTS = [None, "", " ", "  a", "The quick brown fox.\nJumps!! over 3 lazy dogs", "é日本😀 ▁x  y", "\n\n", "a" * 300, "word " * 3000, "x\x00y\t<s></s><0x41>", "don't"]


def test_pieces(spark, monkeypatch):
    import sentencepiece

    from inkstone.llm import piece_bpe as pb

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(0, "again", None, None), (None, "null id", None, None)]
    d = docs(spark, rows)

    def want(t):
        ids = sp.encode(t or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    assert sorted(map(repr, map(tuple, pb.piece_digests(d, path).collect()))) == sorted(repr((i, *want(t))) for i, t, *_ in rows)
    enc = pb.encode_texts(d, path)
    assert all(r.ids == sp.encode(rows[r.doc_id][1] or "") and r.round_trip for r in enc.where("doc_id > 0 and doc_id <> 5").collect())
    assert {r.decoded for r in pb.decode_ids(enc.where("doc_id = 4"), path).collect()} == {TEXTS[4]}
    assert pb.piece_digests(d.limit(0), path).count() == 0
    monkeypatch.setattr(pb, "MEMO", 3)
    p = pb.Pieces(path)
    assert all(p.digest(t) == want(t) for t in TEXTS for _ in (0, 1))


# ---------------------------------------------------------------- op5
def slow_fingerprint(t):
    import xxhash

    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_miss_nothing():
    from inkstone.llm.simhash import keys

    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63 - 1, 400)
    for d in range(5):
        flip = np.array([sum(1 << int(b) for b in rng.choice(64, d, replace=False)) for _ in base], dtype=np.uint64)
        other = (base.view(np.uint64) ^ flip).view(np.int64)
        of = [dict(), dict()]
        for m, x in zip(of, (base, other), strict=True):
            for k, f in zip(*(a.tolist() for a in keys(x)), strict=True):
                m.setdefault(f, set()).add(k)
        assert all(of[0][a] & of[1][b] for a, b in zip(base.tolist(), other.tolist(), strict=True))


def test_simhash(spark):
    from inkstone.llm.simhash import deduplicate, simhash_components

    rng = np.random.default_rng(3)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(60):
        w = rng.choice(words, 300).tolist()
        rows.append((3 * i + 5, " ".join(w), "en", "s"))
        for k in range(3 if i < 10 else 0):
            v = list(w)
            v[int(rng.integers(300))] = "Changed"
            rows.append((1000 + 10 * i + k, " ".join(v), "en", "s"))
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, "one two", None, None), (2003, "ONE two", None, None), (5, rows[0][1], "en", "s"), (None, "one two", None, None), (2004, "long " * 20000, None, None)]
    d = docs(spark, rows)
    f = np.array([slow_fingerprint(t) for _, t, *_ in rows], np.uint64)
    root = union_find(len(rows), [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4)])
    low = {}
    for (i, *_), r in zip(rows, root, strict=True):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    want = sorted(repr((i, f"{x:016x}", low.get(r))) for (i, *_), x, r in zip(rows, f.tolist(), root, strict=True))
    for block in (200_000, 3):
        assert sorted(repr(tuple(r)) for r in simhash_components(d, block=block).collect()) == want
    kept = sorted(r.doc_id for r in deduplicate(d).where("doc_id is not null").collect())
    assert kept == sorted(set(low.values()))
    assert simhash_components(d.limit(0)).count() == 0


# ---------------------------------------------------------------- near-dedup by shingles
def slow_shingles(t):
    w = re.sub("[ \\t\\n\\v\\f\\r\\0]+", " ", (t or "").lower()).strip(" ")
    w = w.split(" ") if w else []
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_texts(spark):
    from inkstone.llm.neardup_texts import deduplicate, similar_components
    from inkstone.llm.simhash import deduplicate as by_simhash

    rng = np.random.default_rng(5)
    words = ["w%d" % i for i in range(900)]
    rows = []
    for i in range(80):
        w = rng.choice(words, int(rng.integers(30, 300))).tolist()
        rows.append((10 * i, " ".join(w), "en", "s"))
        for k in range(1, 8):  # copies whose similarities lie on both sides of 0.8
            v = list(w)
            for at in rng.choice(len(v), max(1, int(len(v) * k / 120)), replace=False):
                v[int(at)] = "Changed%d" % k
            rows.append((10 * i + k, " ".join(v), "en", "s"))
    shared = rng.choice(words, 60).tolist()
    rows += [(5000 + i, " ".join(shared + rng.choice(words, 60).tolist()), "en", "s") for i in range(40)]  # a common passage links nothing
    rows += [(9000, None, None, None), (9001, "", None, None), (9002, "one two", None, None), (9003, "ONE\ttwo", None, None), (10, rows[8][1], "en", "s"), (None, "one two", None, None), (9004, "long " * 20000, None, None), (9005, "\0 ", None, None)]
    own = [slow_shingles(t) for _, t, *_ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    root = union_find(len(rows), near)
    low = {}
    for (i, *_), r in zip(rows, root, strict=True):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    want = sorted(repr((i, low.get(r))) for (i, *_), r in zip(rows, root, strict=True))
    d = docs(spark, rows)
    for options in ({}, {"block": 3}, {"shingles": 500}):
        assert sorted(repr(tuple(r)) for r in similar_components(d, **options).collect()) == want, options
    kept = sorted(r.doc_id for r in deduplicate(d).where("doc_id is not null").collect())
    assert kept == sorted(set(low.values())) and len(kept) < by_simhash(d).where("doc_id is not null").count()
    assert deduplicate(d.limit(0)).count() == 0 and deduplicate(d).columns == d.columns


def test_near_texts_in_the_pipeline(spark):
    import corpus_pipeline

    rng = np.random.default_rng(2)
    w = ["w%d" % i for i in rng.integers(0, 5000, 400)]
    rows = [(1, " ".join(w), "en", "s")]
    for i in range(2, 12):  # eight of 400 words apart: similarity 0.82
        v = list(w)
        for k in range(8):
            v[20 + 45 * k] = f"other{i}"
        rows.append((i, " ".join(v), "en", "s"))
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()] == [1]


def test_near_texts_by_simhash(spark, monkeypatch):
    """The pipeline's stage takes candidates of SimHashes and Golay keys; with MinHash keys out of use it still finds them."""
    import corpus_pipeline
    from inkstone.llm import neardup_texts as nt

    rng = np.random.default_rng(7)
    rows, near = [], set()
    for i in range(30):
        w = ["w%d" % k for k in rng.integers(0, 5000, 900)]
        v = list(w)
        v[450] = "other"
        rows += [(2 * i, " ".join(w), "en", "s"), (2 * i + 1, " ".join(v), "en", "s")]
        x, y = (nt.simhash(s) for s in nt.sets([" ".join(w), " ".join(v)]))
        if bin((x ^ y) & (1 << 64) - 1).count("1") <= 4:
            near.add(2 * i + 1)
    assert len(near) > 10

    def none(it):
        for b in it:
            yield b.slice(0, 0).select([0, 1]).rename_columns(["a", "b"])

    monkeypatch.setattr(nt, "_candidates", lambda block: none)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()}
    assert kept == set(range(60)) - near


# ---------------------------------------------------------------- op6
def test_line_dedup(spark):
    from inkstone.llm.linededup import drop_boilerplate

    rows = [(i, f"own line {i}\nmenu\n\nrare {i % 30}", "en", "a") for i in range(100)]
    rows += [(200 + i, "menu\ncopied text", "en", "b") for i in range(40)] + [(300 + i, f"menu {i}\nfoot", "en", None) for i in range(6)]
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (0, rows[0][1], "en", "a")]
    got = {(r.doc_id, r.source): r for r in drop_boilerplate(docs(spark, rows)).collect()}
    assert got[3, "a"].text == "own line 3\n\nrare 3" and got[3, "a"].n_lines == 4 and got[3, "a"].n_dropped == 1
    assert got[200, "b"].text == "menu\ncopied text"  # one page, copied often, is no template
    assert got[300, None].text == "menu 0" and got[400, "a"].text is None and got[401, "a"].text == "" and got[400, "a"].n_lines == 0
    assert got[3, "a"].fp == 2 and len(got) == len(rows) - 1
    assert drop_boilerplate(docs(spark, rows).limit(0)).count() == 0


# ---------------------------------------------------------------- op7
def test_token_file(spark, monkeypatch):
    from tokenizers import Tokenizer

    from inkstone.llm import tokenfile as tf

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i * 7 % 101, t, None, None) for i, t in enumerate(TEXTS + ["a<|endoftext|>b", "it's  'quoted' 12³", "x\x1cy\x85z"])] + [(-5, "first", None, None), (None, "null", None, None)]
    d = docs(spark, rows)
    parts = tf.write_tokens(d, path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, t, *_ in order:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(map(repr, map(tuple, tf.read_checksums(parts).collect()))) == sorted(repr(w[:4]) for w in want)
    assert sorted(repr((r.doc_id, r.start, r.n_tokens, r.ids)) for r in tf.read_tokens(parts).collect()) == sorted(repr((w[0], w[1], w[2], w[4])) for w in want)
    assert tf.read_checksums(tf.write_tokens(d.limit(0), path)).count() == 0


def test_coding_round_trips():
    from inkstone.llm import tokenfile as tf

    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 5000, 700_001):
        ids = np.minimum(rng.zipf(1.2, n), 50_000).astype(np.int64)
        table = tf.Table.loads(tf.Table.of(ids).dumps())
        payload = tf.encode_block(ids, table)
        assert np.array_equal(tf.decode_block(payload, table), ids)
    assert np.array_equal(tf.decode_block(payload, table, 1, 2), ids[tf.CHECKPOINT * tf.LANES : 2 * tf.CHECKPOINT * tf.LANES])
    assert len(payload) * 8 / n < 1.1 * -sum(c / n * np.log2(c / n) for c in np.bincount(ids) if c) + 0.6


# ---------------------------------------------------------------- op8
def test_decontamination(spark, monkeypatch):
    from inkstone.llm import decontaminate as de

    rng = np.random.default_rng(6)
    word = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "iota"], n))
    items = [(i, word(int(rng.integers(5, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (93, "...")]
    rows = []
    for i in range(120):
        t = word(int(rng.integers(0, 400)))
        if i % 3 == 0:
            w = items[i % 40][1].split()
            t = f"{t} {' '.join(w[: max(5, int(len(w) * rng.uniform(0.6, 1)))]).upper()}! {word(50)}"
        rows.append((i, t, None, None))
    rows += [(500, None, None, None), (501, "Two, words", None, None), (502, "x " * 30000 + items[0][1], None, None), (None, items[1][1], None, None)]
    want = []
    for i, t, *_ in rows:
        for n, x in items:
            s = de.shingles(x)
            if s and len(s & de.shingles(t)) >= 0.8 * len(s) - 1e-9:
                want.append(repr((i, n, len(s & de.shingles(t)), len(s))))
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        monkeypatch.setattr(de, "ITEMS", block)
        assert sorted(repr(tuple(r)[:4]) for r in de.contaminated(d, b).collect()) == sorted(want)
    assert len(want) > 20 and de.contaminated(d.limit(0), b).count() == de.contaminated(d, b.limit(0)).count() == 0
    bad = {eval(w)[0] for w in want} - {None}
    assert sorted(str(r.doc_id) for r in de.decontaminate(d, b).collect()) == sorted(str(r[0]) for r in rows if r[0] not in bad)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    from inkstone.llm import decontaminate as de

    texts = ["one two three four five six", "", "a b", "seven " * 50, "one two three four five"]
    row, h = de.text_hashes(texts)
    monkeypatch.setattr(de, "BLOCK", 8)
    de._table.cache_clear()
    again = de.text_hashes(texts)
    de._table.cache_clear()
    assert np.array_equal(row, again[0]) and np.array_equal(h, again[1])


# ---------------------------------------------------------------- op9
def test_languages(spark):
    from inkstone.llm.langid import identify, keep_identified

    rng = np.random.default_rng(7)
    parts = {"xx": ["ba", "bo", "ru", "ti"], "yy": ["ké", "lö", "mu", "ti"], "zz": ["日", "本", "語", "文"]}
    rows = []
    for i in range(300):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang, "s"))
    rows += [(900, None, "xx", "s"), (901, "", "xx", "s"), (902, "123 !", "xx", "s"), (903, rows[1][1], None, "s"), (None, rows[0][1], "xx", "s"), (904, "q", None, None), (905, rows[2][1] * 300, None, None)]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in identify(d).collect()}
    assert all(got[i].lang_pred == rows[i][2] and got[i].score > 0.5 for i in range(300))
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None, 905)] == ["und", "und", "und", "yy", "xx", "zz"] and got[900].score == 0 and got[904].lang_pred in parts
    assert got[5].held_out == (zlib.crc32(b"5") % 5 == 0) and got[None].held_out is False
    kept = keep_identified(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in (900, 901, 902, 904))  # 904: nothing known in it
    assert identify(d.limit(0)).count() == 0 and identify(docs(spark, [(1, "abc", None, None)])).first().lang_pred == "und"


def test_languages_beyond_a_word_of_the_mask(spark):
    from inkstone.llm.langid import identify, learn

    rng = np.random.default_rng(1)
    letters = {f"l{k:02}": [chr(0x4E00 + 40 * k + i) for i in range(30)] for k in range(70)}
    rows = [(100 * k + j, " ".join("".join(rng.choice(x, 2)) for _ in range(200)), name, "s") for k, (name, x) in enumerate(letters.items()) for j in range(10)]
    rows += [(90_000 + j, rows[0][1], "l00", "s") for j in range(500)]  # a frequent language displaces none
    d = docs(spark, rows)
    got = identify(d).collect()
    assert len(learn(d, "doc_id", "text", "lang").slots) == 2
    assert len({r.lang_pred for r in got}) == 70
    lang = {i: x for i, _, x, _ in rows}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.99


def test_ngrams_do_not_depend_on_windows(monkeypatch):
    from inkstone.llm import langid

    texts = ["alpha beta " * 40, "", "x", "İstanbul ΣΑΣ ß " * 9, "word" * 100, "a b c"]

    def tally():
        return sorted((int(i), int(x)) for of, g in langid.blocks(texts) for i, x in zip(of, g, strict=True))

    whole = tally()
    assert whole == sorted((i, int(x)) for i, t in enumerate(texts) for x in langid.grams(t.lower() + " " * langid.NGRAM) if x)
    for block in (7, 16, 100):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert tally() == whole
    monkeypatch.setattr(langid, "BLOCK", 1 << 20)
    long = "one two three " * 100_000  # beyond the window: as many different n-grams as in a short one
    assert len({int(x) for _, g in langid.blocks([long]) for x in g}) == len({int(x) for _, g in langid.blocks(["one two three " * 3]) for x in g})


def test_popcounts_are_counted_languages():
    """A brute-force version: sets of n-grams for each language."""
    from inkstone.llm.langid import Filters, blocks

    rng = np.random.default_rng(4)
    grams = np.unique(rng.integers(1, 1 << 63, 4000).astype(np.uint64))
    own = [set(rng.choice(grams, 1500).tolist()) for _ in range(67)]
    masks = np.zeros((2, len(grams)), np.uint64)
    for k, s in enumerate(own):
        masks[k // 64] |= np.where(np.isin(grams, list(s)), np.uint64(1) << np.uint64(k % 64), np.uint64(0))
    f = Filters([f"l{k}" for k in range(67)], grams, masks)
    words = list(f.containing(grams))
    for k, s in enumerate(own):
        found = words[k // 64] & np.uint64(1 << k % 64) != 0
        assert set(grams[found].tolist()) >= s and found.sum() < len(s) + 0.1 * len(grams)


# ---------------------------------------------------------------- names that clash, rows that repeat
def test_inner_names_and_repeated_rows(spark):
    from inkstone.llm.decontaminate import decontaminate
    from inkstone.llm.linededup import drop_boilerplate
    from inkstone.llm.neardup_texts import deduplicate
    from inkstone.llm.simhash import deduplicate as by_simhash

    inner = ["_id", "_leak", "_line_host", "_key", "_text_key", "_site", "_gone", "_left", "low", "t", "fp", "root", "host", "item"]
    a, b = "one two three four five six seven eight nine ten", "other words that are not the same as those before them"
    rows = [(1, a), (1, a), (1, b), (2, b), (3, a.upper()), (None, a)]
    d = spark.createDataFrame([(i, t, "s", *range(len(inner))) for i, t in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in inner))
    for f in (deduplicate, by_simhash):  # id 1 with a and id 1 with b are rows of two components
        got = f(d)
        assert got.columns == d.columns and sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, a), (1, b), (None, a)]))
    items = spark.createDataFrame([(7, b)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate(d, items).collect()) == ["3", "None"]  # the id goes with all its rows
    assert drop_boilerplate(d).count() == len(rows)


# ---------------------------------------------------------------- op10
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>Menu</ul></nav>
<!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>First &eacute;<br><p>Second   long
paragraph with a link <a href=x>here</a>, and so on and on.<div class="comments"><p>Nice post!</p></div></article><form>Name</form><footer>foot</footer>"""


def test_html(spark):
    from inkstone.llm.htmltext import extract_pages, main_text

    assert main_text(PAGE) == "Head & more First é Second long paragraph with a link here , and so on and on.".replace("here ,", "here,")
    plain = '<body class="has-sidebar"><div id=header>Site</div><div class=main><h2>Head</h2><p>A first paragraph that is long enough to be the content of the page.</p><p>Short.</p><p>And another paragraph that is long enough to be content, I think.</p></div><div id="sidebar">x</div>'
    assert main_text(plain) == "Head A first paragraph that is long enough to be the content of the page. Short. And another paragraph that is long enough to be content, I think."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (1, "u", PAGE), (4, "u", "<![if x]><article>" + "<p>long text here. " * 5000)]
    d = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = extract_pages(d).collect()
    assert len(got) == 6 and {r.n_chars == len(r.text) for r in got} == {True}
    assert sorted(str(r.page_id) for r in got if not r.text) == ["2", "3", "None"]
    assert next(r for r in got if r.page_id == 4).text.count("long text here.") == 5000
    assert extract_pages(d.limit(0)).count() == 0


LONG = "A paragraph that is long enough to be the content of the page, and that goes on and on for a while."
SOUP = f'<body><div>{"".join(f"<ul><li><a href=/{i}>Link {i}</a></ul>" for i in range(30))}</div><div><div><h1>Title</h1></div><div><p>{LONG}</p><p>Short.</p><ul>{"<li>item</li>" * 6}</ul><p>{LONG}</p><p>{LONG}</p><p>End.</p></div></div><div>(c) the site</div>'


def test_html_regions():
    from inkstone.llm.htmltext import main_text

    text = f"{LONG} Short. {LONG}"
    body = f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    assert main_text(SOUP) == f"Title {LONG} Short. item item item item item item {LONG} {LONG} End."
    assert main_text(f"<article><header><h1>Title</h1></header>{body}<footer>by me</footer></article>") == f"Title {text}"
    assert main_text(f"<nav><a>Home</a></nav><form action=x>{body}</form>") == text
    assert main_text(f'<div class="page-header-wrap">{body}</div><div class=sidebar>x</div>') == text
    assert main_text(f'<div class=post><h1 class="entry-header">Title</h1>{body}</div><div class=comments><p>{LONG}</p></div>') == f"Title {text}"
    assert main_text(f"<article><p>Tiny.</p></article><footer>{LONG}</footer>") == "Tiny."
    assert main_text("<div>" * 3000 + f"<p>{LONG}" + "</b></i></td>" * 3000) == LONG  # deep, never closed, stray ends
    assert main_text(f"<table><tr><td>{'<a>menu</a><br>' * 9}</td><td>{body}</td></tr></table>") == text


def test_html_lines_are_chosen_by_smoothed_ratios(monkeypatch):
    import math

    from inkstone.llm import htmltext as ht

    page = ht.Page(SOUP)
    ratio = [n / max(1, t) / (1 if page.worst[e] == ht.FOR else ht.AGAINST) for n, t, e in zip(page.length, page.tags, page.at, strict=True)]
    smooth = []
    for i in range(len(ratio)):
        near = [(math.exp(-0.5 * (d / ht.SIGMA) ** 2), ratio[i + d]) for d in range(-ht.REACH, ht.REACH + 1) if 0 <= i + d < len(ratio)]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    bound = ht.THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    assert ht.chosen_lines(page)[0].tolist() == [x >= bound for x in smooth]
    want = ht.main_text(SOUP)
    monkeypatch.setattr(ht, "smoothed", lambda r: np.ones(len(r)))
    assert ht.main_text(SOUP) != want and "Link" in ht.main_text(SOUP)


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from inkstone.llm.decontaminate import shingles

    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijk"), 4)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, text(30)) for i in range(3)]
    rows = [(i, f"{text(60)}\nmenu of the site\n{text(60)}", "en", "s") for i in range(60)]
    rows += [(100, rows[5][1], "en", "s"), (101, rows[6][1] + " tail", "en", "s"), (102, f"{text(20)} {items[1][1]} {text(20)}", "en", "s"), (103, None, "en", "s"), (104, "12 34", "en", "s")]
    spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    rest = {i: "\n".join(x for x in (t or "").split("\n") if x != "menu of the site") for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    f = {i: slow_fingerprint(t) for i, t in rest.items()}
    root = union_find(1000, [(a, b) for a in f for b in f if bin(f[a] ^ f[b]).count("1") <= 4])
    keep = {i for i in rest if root[i] == i and not any(len(s & shingles(rest[i])) >= 0.8 * len(s) for s in (shingles(x) for _, x in items))}
    assert set(got) == keep and 100 not in keep and 102 not in keep and 5 in keep
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.ids == sp.encode(rest[i]) and r.round_trip and r.n_tokens == len(r.ids) for i, r in got.items())
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert first.columns == ["doc_id", "text", "lang", "source", "n_chars"]
