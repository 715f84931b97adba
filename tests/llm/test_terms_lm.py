"""Terms in blocks, and the language model (op11) against slow versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import maxent, terms

SCHEMA = "doc_id long, text string, key int, held boolean, n_tokens int, score int, word int"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.mark.parametrize(("how", "rx"), [(terms.WORDS, r"[^\x20\x09-\x0D]+"), (terms.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (terms.LETTERS_DIGITS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("size", [3, 50, 1 << 20])
def test_terms(how, rx, size):
    texts = ["", None, "A b\tC\x1fd\x00", "É\x85x　中文 Ab9-c_d`{|}~", " \n\n ", "x" * 200 + " y " + "z" * 100, "last"]
    got = {i: [] for i in range(len(texts))}
    for b in terms.blocks(pa.array(texts), how, size):
        for r, o in zip(b.row.tolist(), b.of.tolist(), strict=True):
            got[r].append("END" if o == b.end else b.distinct[o].as_py())
    assert got == {i: [*re.findall(rx, lower(t)), "END"] for i, t in enumerate(texts)}


def test_hashes_and_endings_do_not_depend_on_the_block():
    words = ["a", "the", "the.", "ihn", "été", "x" * 700, "\n", "..."]
    one = terms.hashes(pa.array(words)), terms.endings(pa.array(words))
    for i, w in enumerate(words):
        assert terms.hashes(pa.array(["zz", w, "y"]).slice(1, 1))[0] == one[0][i]
        assert terms.endings(pa.array(["zz", w, "y"]).slice(1, 1))[0] == one[1][i]
    assert len(set(one[0].tolist())) == len(words)
    assert one[1][1] == one[1][2]


def corpus():
    rng = np.random.default_rng(3)
    out = []
    for i in range(160):
        words = ["The", "cat", "sat", "on", "Mat."] if i % 2 else ["der", "hund", "lief", "im", "wald"]
        out.append((i, " ".join(words[(j + int(rng.random() < 0.1)) % 5] + ("" if rng.random() < 0.9 else str(rng.integers(300))) for j in range(40))))
    return [*out, (5, out[5][1]), (5, out[5][1]), (1000, ""), (1001, None), (1002, " \t"), (None, "the cat"), (1003, "Unseen WORDS of another kind"), (1004, "x" * 300 + " cat")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_scores(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, True, 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(terms, "BLOCK", 64)  # here; workers read blocks of the usual size
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\n"] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if i is not None and not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, tokens, strict=True))
    found = maxent.score_texts(df).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    own = [r for r in found if r.held_out and r.n_tokens > 10]
    assert len(own) > 5
    assert sum(r.score for r in own) > sum(r.base_score for r in own) + 0.3 * sum(r.n_tokens for r in own)
    assert len({round(r.score, 6) for r in found if r.doc_id == 5}) == 1
    assert maxent.score_texts(df.limit(0)).count() == 0


def test_counts_beyond_the_known_words_come_by_a_join(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 1, True, 2, 3, 4) for i, t in corpus()], SCHEMA)
    usual = {(r.doc_id, r.n_tokens): (r.n_known, r.base_score, r.score) for r in maxent.score_texts(df).collect()}
    monkeypatch.setattr(maxent, "KNOWN", 12)
    for r in maxent.score_texts(df).collect():
        known, base, _ = usual[r.doc_id, r.n_tokens]
        assert r.n_known == known and r.base_score == pytest.approx(base, abs=1e-9)


def model(words, counts, seed=5):
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    w, n = pa.array([words[i] for i in order]), np.array([counts[i] for i in order])
    tail = slice(maxent.HEADS * maxent.WIDE, None)
    cls = maxent.tail_class(w[tail]) - maxent.HEADS
    m = maxent.Model(maxent.Vocabulary(w, n, int(n.sum()), len(n), np.bincount(cls, n[tail], minlength=maxent.TAILS), np.bincount(cls, minlength=maxent.TAILS)))
    rng = np.random.default_rng(seed)
    m.classes += rng.standard_normal(m.classes.shape).astype(np.float32)
    m.words += rng.standard_normal(m.words.shape).astype(np.float32)
    return m


def test_probabilities_add_up_to_one():
    words = [f"w{i}{'abcdefgh'[i % 8]}x" for i in range(900)]
    m = model(words, [900 - i for i in range(900)])
    known, cls, place, h = m.v.look_up(m.v.words)
    assert known.tolist() == list(range(900))
    for before in (np.array([h[3], h[700]]), np.array([maxent._BEFORE] * 2)):
        p = np.exp(m.log_probabilities(np.repeat(before[:, None], 900, axis=1), cls, place))
        tail = place < 0
        k = cls - maxent.HEADS
        within = np.where(tail, (m.v.counts + 1) / (m.v.tail_tokens + m.v.tail_words + 1)[np.maximum(k, 0)], 1.0)
        # unused places of head classes there are none; each tail class has a slot for unknown words
        slots = [np.exp(m.log_probabilities(before[:, None], np.array([maxent.HEADS + j]), np.array([-1])))[0] / (m.v.tail_tokens[j] + m.v.tail_words[j] + 1) for j in range(maxent.TAILS)]
        assert (p * within).sum() + sum(slots) == pytest.approx(1.0, abs=1e-4)


def test_log_probabilities_equal_a_slow_version():
    words = [f"w{i}{'abcdefgh'[i % 8]}x" for i in range(700)]
    m = model(words, [900 - i for i in range(700)])
    _, cls, place, h = m.v.look_up(m.v.words)
    rng = np.random.default_rng(1)
    at, before = rng.integers(0, 700, 200), h[rng.integers(0, 700, (2, 200))]
    got = m.log_probabilities(before, cls[at], place[at])

    def softmax(weights, bias, hashes, y):
        x = [float(b) + sum(float(weights[maxent._row(np.array([f]), len(weights))[0]][j]) for f in hashes) for j, b in enumerate(bias)]
        return x[y] - math.log(sum(map(math.exp, x)))

    for i in range(200):
        f = [x[0] for x in m.features(before[:, i : i + 1])]
        k = at[i]
        want = softmax(m.classes, m.class_bias, f, cls[k])
        if place[k] >= 0:
            with np.errstate(over="ignore"):
                want += softmax(m.words, m.word_bias[cls[k]], [x + np.uint64(cls[k] + 1) * maxent._MIX[5] for x in f], place[k])
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_steps_follow_the_gradient():
    m = model([f"w{i}" for i in range(600)], [600 - i for i in range(600)])
    t = maxent.Trainer(m)
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 9, 64)).astype(np.uint16)
    g, of = rng.standard_normal((16, 5)).astype(np.float32), rng.integers(0, 16, 64)
    rows, n, sums = t.summed(keys, g, of)
    assert rows.tolist() == sorted(set(keys.tolist())) and n.tolist() == [int((keys == r).sum()) for r in rows]
    for r, s in zip(rows, sums, strict=True):
        np.testing.assert_allclose(s, g[of[keys == r]].sum(axis=0), atol=1e-5)
    _, cls, place, h = m.v.look_up(m.v.words)
    at, before = rng.integers(0, 600, 500), h[rng.integers(0, 3, (2, 500))]
    first = m.log_probabilities(before, cls[at], place[at]).sum()
    for _ in range(20):
        t.learn(before, cls[at], place[at])
    assert m.log_probabilities(before, cls[at], place[at]).sum() > first + 100
