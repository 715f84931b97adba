"""Sinks that keep files apart, dictionaries compressed by Zstandard, and the user's title pattern."""

import json
import os

import zstandard
from pyspark.sql import functions as F

from inkstone.operators import predicates as p
from inkstone.options import ShortHeading
from inkstone.sources import files, sinks


def test_names_that_collide(spark, tmp_path):
    rows = [("/x/a.txt", "a.txt", "1"), ("/y/a.txt", "a.txt", "2"), ("/z/A.TXT", "A.TXT", "3"), ("/x/b.txt", "b.txt", "4"), ("/x/n", None, "5"), ("/x/c", "c", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "path string, name string, text string, key int, paths int")
    log = sorted((r.name or "", r.status) for r in sinks.write_files(df, str(tmp_path / "one")).collect())
    assert log == [("", "failed"), ("A.TXT", "failed"), ("a.txt", "failed"), ("a.txt", "failed"), ("b.txt", "written"), ("c", "failed")]
    assert os.listdir(tmp_path / "one") == ["b.txt"]
    apart = sinks.distinct_names(df)
    assert apart.columns == df.columns
    log = sinks.write_files(apart.where("name is not null and text is not null"), str(tmp_path / "two")).collect()
    assert [r.status for r in log] == ["written"] * 4
    got = {n: (tmp_path / "two" / n).read_text() for n in os.listdir(tmp_path / "two")}
    assert sorted(got.values()) == ["1", "2", "3", "4"] and got["b.txt"] == "4"
    assert all(n.endswith((".txt", ".TXT")) for n in got)


def test_dictionaries_by_zstandard(spark, tmp_path):
    rows = [("STPhrases", "中国", "中國"), ("STPhrases", "里\n\"x", "裡"), ("TWVariants", "裡", "裏"), ("STCharacters", "国", "國")]
    log = sinks.write_dictionary_zstd(spark.createDataFrame([*rows, ("X", None, "y")], "slot string, key string, value string"), str(tmp_path / "d")).collect()
    assert sorted(map(tuple, log)) == [(f"{s}.json.zst", "written", "") for s in ("STCharacters", "STPhrases", "TWVariants")]
    assert sorted(map(tuple, files.dictionary_zstd(spark, str(tmp_path / "d")).collect())) == sorted(rows)
    os.makedirs(tmp_path / "e")
    whole = json.dumps({"STPhrases": {"中国": "中國"}, "TSPhrases": {}}).encode()
    (tmp_path / "e" / "dictionary.json.zstd").write_bytes(zstandard.compress(whole))
    (tmp_path / "e" / "broken.zst").write_bytes(b"no zstandard")
    assert [tuple(r) for r in files.dictionary_zstd(spark, str(tmp_path / "e")).collect()] == [("STPhrases", "中国", "中國")]


def test_the_pattern_is_checked_by_the_engine_that_runs_it(spark):
    df = spark.createDataFrame([("漢字",), ("第一",), ("abc",)], "line string")
    holds = lambda rx: [r[0] for r in df.select(p.custom_title(F.col("line"), ShortHeading(custom_regex=rx))).collect()]
    assert holds(r"^\p{IsHan}+$") == [True, True, False]  # Java's alone
    assert holds("(?P<a>第)") == holds("(") == holds("  ") == [False] * 3  # Python's alone, nobody's, blank
    assert holds("^第") == [False, True, False]


def test_counts_come_from_the_run_itself(spark, tmp_path):
    df = spark.createDataFrame([(f"n{k % 90}", None if k % 7 == 0 else "x") for k in range(100)], "name string, text string").repartition(5)
    log, seen = sinks.counted(sinks.write_files(df, str(tmp_path)))
    rows = log.collect()
    got = seen.get
    assert got == {"files": 100, "written": sum(r.status == "written" for r in rows), "failed": sum(r.status == "failed" for r in rows), "skipped": 0}
    assert got["written"] == len(os.listdir(tmp_path)) > 0 and got["failed"] > 20
    log, seen = sinks.counted(sinks.write_files(df.limit(0), str(tmp_path)))
    assert log.collect() == [] and seen.get == {"files": 0, "written": 0, "failed": 0, "skipped": 0}
