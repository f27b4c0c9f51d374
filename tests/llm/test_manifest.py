"""Merkle manifest against a version that hashes lists."""

import hashlib
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rastermill.llm import merkle
from rastermill.llm.queries import queries

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def record(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """Root, and for each leaf its (siblings, fold) steps."""
    steps = [[] for _ in leaves]
    nodes = [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        up = []
        for lo in range(0, len(nodes), 8):
            run = nodes[lo : lo + 8]
            for k, (_, below) in enumerate(run):
                before, after = "".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])
                for i in below:
                    steps[i].append((before, after))
            up.append((h(*(d for d, _ in run)), [i for _, below in run for i in below]))
        nodes = up
    return nodes[0][0], steps


def brute(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    low = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    made = []
    for doc_id, text, lang, source, n_chars in rows:
        other = text.translate(low) if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else text
        made.append((lang, doc_id, record(doc_id, source, lang, n_chars, text), record(doc_id, source, lang, n_chars, other)))
    langs = sorted({m[0] for m in made}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((m for m in made if m[0] == lang), key=lambda m: (m[1] is not None, m[1] or 0, m[2])) for lang in langs]
    trees = [tree([m[2] for m in g]) for g in groups]
    root, tops = tree([t[0] for t in trees])
    out = []
    for g, (subroot, steps), top in zip(groups, trees, tops, strict=True):
        for m, own in zip(g, steps, strict=True):
            folded = m[3]
            for before, after in own + top:
                folded = h(before, folded, after)
            out.append((m[1], m[2], subroot, root, h(*(b + a for b, a in own + top)), folded, folded == root))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def listed(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_query_is_that_of_lists(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").astype(object)
    docs = docs.where(docs.notna(), None)
    want = brute([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.itertuples()])
    got = listed(queries()["op11_merkle_manifest"](spark, sf_dir))
    assert got == sorted(want, key=repr) and {r[-1] for r in got} == {True, False}


ODD = [(1, "AB", "en", "a", 2), (1, "AB", "en", "a", 2), (None, "X", "en", None, None), (2, None, None, None, None), (3, "", "", "s", 0), (4, "Zé\n" * 5000, "ü", "", 10), (5, "é" * 70_000, "z", "a:b", -3), (None, None, None, None, None)]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_odd_rows_and_heights(spark, n):
    rows = ODD + [(10 + i, f"Text {i}", "tall", "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("tree", "idx", "digest", "other", "place", "preimage", "N_", "way", "tie_")})
    assert listed(merkle.audit(docs, merkle.tampered())) == sorted(brute(rows), key=repr)


def test_many_languages_and_one_document(spark):
    rows = [(i, "A", f"l{i % 70}", "s", 1) for i in range(90)]
    assert listed(merkle.audit(spark.createDataFrame(rows, KIND), merkle.tampered())) == sorted(brute(rows), key=repr)
    one = listed(merkle.audit(spark.createDataFrame(rows[:1], KIND)))
    assert one[0][1] == one[0][3] == one[0][5] and one[0][4] == h() and one[0][6] is True


def test_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], KIND), merkle.tampered()).collect() == []


def test_any_change_shows(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en" if i % 3 else "de", "s", i) for i in range(40)], KIND)
    same = merkle.audit(docs)
    assert {r.verified for r in same.collect()} == {True}
    changed = merkle.audit(docs, {"n_chars": F.when(F.col("doc_id") == 7, 99).otherwise(F.col("n_chars"))}).filter("not verified").collect()
    assert [r.doc_id for r in changed] == [7]
    assert {r.root for r in merkle.audit(docs.filter("doc_id != 39")).collect()} != {r.root for r in same.collect()}


def test_order_of_rows_and_partitions_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(100)], KIND)
    assert listed(merkle.audit(docs.repartition(7))) == listed(merkle.audit(docs.orderBy(F.desc("doc_id")).coalesce(1)))
