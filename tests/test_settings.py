"""Settings as tables against the merging and differencing of plain dictionaries, on random trees."""

import json
import random

from inkstone.operators.settings import differing, flattened, overlaid
from inkstone.options import difference, merge


def tree(r, depth=3):
    out = {}
    for k in r.sample(["a", "b", "c/d", "e~", "~1", "中"], r.randint(0, 4)):
        out[k] = tree(r, depth - 1) if depth and r.random() < 0.5 else r.choice([1, 1.5, "1", False, None, [], [1, {"a": 2}], {}, "x\"y"])
    return out


def flat(x, path=()):
    if isinstance(x, dict) and x:
        return {p: v for k, y in x.items() for p, v in flat(y, (*path, k.replace("~", "~0").replace("/", "~1"))).items()}
    return {"/".join(path): json.dumps(x, sort_keys=True)}


def rows(df):
    out = {}
    for r in df.collect():
        assert r.path not in out.setdefault(r.owner, {})
        out[r.owner][r.path] = json.dumps(json.loads(r.value), sort_keys=True)
    return out


def test_random_trees(spark):
    r = random.Random(5)
    default = {"a": {"b": 1, "c/d": {}}, "e~": [1, 2], "中": {"a": {"b": {"~1": "x"}}}, "b": None}
    own = {f"u{i}": tree(r) for i in range(120)} | {"same": default, "none": {}}
    base = flattened(spark.createDataFrame([("d", json.dumps(default))], "owner string, settings string"))
    users = flattened(spark.createDataFrame([(k, json.dumps(v)) for k, v in own.items()], "owner string, settings string").repartition(3))
    assert rows(users) == {k: flat(v) for k, v in own.items()}
    base = base.select("path", "value")
    assert rows(overlaid(base, users)) == {k: flat(merge(default, v)) for k, v in own.items()}
    want = {k: flat(d) for k, v in own.items() if (d := difference(default, v))}
    assert rows(differing(base, users)) == want


def test_odd_texts(spark):
    df = spark.createDataFrame([("n", None), ("b", "{broken"), ("e", "{}"), ("s", "[1, 2]"), (None, '{"a": {"b": 1}}')], "owner string, settings string")
    got = sorted(((r.owner, r.path, r.value) for r in flattened(df).collect()), key=str)
    assert got == sorted([("e", "", "{}"), ("s", "", "[1,2]"), (None, "a/b", "1")], key=str)
    assert flattened(df.limit(0)).count() == 0
