"""Importance resampling against a version that lists all features."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rastermill.llm import resample
from rastermill.llm.queries import queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def buckets(found):
    return Counter(zlib.crc32(f.encode()) % 10_000 for f in found)


def brute(docs, target):
    rows = [(doc_id, *features(text)) for doc_id, text in docs]
    s, t = Counter(), Counter()
    for _, _, found in rows:
        s += buckets(found)
    for text in target:
        t += buckets(features(text)[1])
    big_s, big_t = float(sum(s.values()) + 10_000), float(sum(t.values()) + 10_000)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    out = []
    for doc_id, n, found in rows:
        weight = sum(gain(b) * k for b, k in buckets(found).items())
        hashed = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((hashed + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_is_that_of_lists(spark, sf_dir):
    docs, target = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = listed(queries()["op12_resample"](spark, sf_dir))
    assert got == brute(list(zip(docs.doc_id, docs.text, strict=True)), target.text.tolist())
    assert sorted(r[4] for r in got if r[4]) == list(range(1, len([r for r in got if r[4]]) + 1)) != []


LONG = "Überlong wörd 42 lorem-ipsum " * 3000
ODD = [(1, None), (2, ""), (None, "no id but some words " * 6), (3, "x" * 70_000), (4, LONG), (4, LONG), (5, " \n\t!?"), (6, "a" * 65 + " B" * 30), (7, "!" * 50_000), (8, "é" * 40_000 + " end")] + [(100 + i, f"word{i} common text of twenty words or more " * 5) for i in range(50)]


@pytest.mark.parametrize("words", [1, 2, 7, 4096])
def test_chunks_lose_nothing(spark, monkeypatch, words):
    monkeypatch.setattr(resample, "CHUNK_WORDS", words if words > 100 else words * 300)
    monkeypatch.setattr(resample, "LONG_CHARS", 32_768 if words > 100 else 200)
    target = ["common text of twenty words", None, "", "lorem ipsum " * 4000]
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("kept") for c in ("row", "own", "DATA", "weight", "score", "chunk", "place", "n_words")})
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert listed(got) == brute(ODD, target)


def test_few_words_a_chunk_are_cut_right(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK_WORDS", 2)
    monkeypatch.setattr(resample, "LONG_CHARS", 5)
    random.seed(3)
    docs = [(i, " ".join(random.choice(["a", "bé", "c" * 70, "-", "D"]) for _ in range(random.randint(0, 40)))) for i in range(60)]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a d bé",)], "text string"))
    assert listed(got) == brute(docs, ["a d bé"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert listed(resample.resample(none, none)) == []
    rows = [(1, "some words " * 20)]
    assert listed(resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), none)) == brute(rows, [])


def test_checksums_of_runs():
    random.seed(1)
    texts = ["Ab cD 12 é你 x" + "y" * 200 + " z", "", "one", "a b", "x" * 1000 + " " + "q" * 70 + " " + "r" * 64 + " " + "s" * 65 + " t" * 5, "k " + "v" * 300_000 + " w"]
    texts += ["".join(random.choice("aB é9-\n你Z ") for _ in range(random.randint(0, 300))) for _ in range(200)]
    found = resample.Features([t.encode() for t in texts])
    for i, text in enumerate(texts):
        got = sorted(int(c) for crc, there in zip(found.crc, found.there, strict=True) for c in crc[there & (found.row == i)])
        assert got == sorted(zlib.crc32(f.encode()) for f in features(text)[1])


def test_the_draw_leans_to_the_target(spark):
    random.seed(5)
    near, far = ["alpha beta gamma delta".split(), "red green blue white".split()]
    docs = [(i, " ".join(random.choices(near if i % 10 == 0 else far, k=30))) for i in range(1000)]
    target = [(" ".join(random.choices(near, k=30)),) for _ in range(50)]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "text string"))
    assert np.mean([r.doc_id % 10 == 0 for r in got.filter("rank is not null").collect()]) == 1
