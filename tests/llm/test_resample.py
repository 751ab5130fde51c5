"""Importance resampling against plain Python; nulls, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib

import pytest

from linkforge.llm import resample

SCHEMA = "doc_id long, text string, row long, pos int, word string, bucket int, gain long, rank long, score long"


def brute(docs, target, n, buckets, seed, percent, least):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in docs:
        for b in grams(x)[1]:
            s[b] += 1
    for x in target:
        for b in grams(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        m, f = grams(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), m])
    drawn = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = drawn[: percent * len(drawn) // 100]
    place = {id(r): i for i, r in enumerate(drawn, 1)}
    return sorted(((*r[:4], place.get(id(r))) for r in rows), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "été", "Ünder", "ÉCOLE", "x1y", "of", "it's", "日本", "naïve", "ſt"]
    out = [(i, " ".join(r.choice(words) + r.choice(["", ",", "!", " 12 "]) for _ in range(r.randrange(0, 60)))) for i in range(120)]
    return [*out, (500, None), (501, ""), (502, "1234 --- \x7f"), (503, "word " * 5000), (None, "null id " * 30), out[7], (7, "another text of one id " * 9)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_equals_plain_python(spark, rows, n):
    docs = spark.createDataFrame([(d, t, 1, 2, "w", 3, 4, 5, 6) for d, t in rows], SCHEMA).repartition(3)
    target = ["alpha beta of été", None, "", "x1y École it's " * 4]
    got = resample.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), n=n, buckets=97, seed=2024, percent=10)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, n, 97, 2024, 10, 20)


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(f"d{i}", "one two three " * 9) for i in range(30)], "doc_id string, text string")
    none = docs.where("false")
    got = resample.resample(docs, none, n=2, buckets=11, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16))
    assert resample.resample(none, docs, n=2, buckets=11).count() == 0


def test_a_hot_score_is_numbered_over_several_tasks(spark):
    df = spark.range(4000).selectExpr("id % 1 as score", "id as doc_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resample.numbered(df.repartition(4), [df["score"].desc(), df["doc_id"]], "place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["place"] for r in got.orderBy("doc_id").collect()] == list(range(4000))
