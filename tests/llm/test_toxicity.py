"""Toxicity on held-out labels, and its parts by hand."""

import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rastermill.llm import toxicity
from rastermill.llm.queries import queries

LEX = toxicity.Lexicon({"idiot": 5.0, "troll*": 3.0, "ab": 2.0}, ("village idiot", "troll doll", "trolley"))


def found(text):
    folded, place = toxicity.fold(text)
    return [(text[place[a] : place[b - 1] + 1], entry) for a, b, entry, _ in LEX.matches(folded)]


@pytest.mark.parametrize("text, want", [
    ("You IDIOT!", [("IDIOT", "idiot")]), ("you 1d10t, you !d!ot", [("1d10t", "idiot")]), ("іdіоt ïdïöt ｉｄｉｏｔ", [("іdіоt", "idiot"), ("ïdïöt", "idiot"), ("ｉｄｉｏｔ", "idiot")]),
    ("idi​ot idiót", [("idi​ot", "idiot"), ("idiót", "idiot")]), ("idiot$$$ and !!idiot!!", [("idiot", "idiot"), ("idiot", "idiot")]), ("idiotic antidiot", []),
    ("trolling tr0lls", [("troll", "troll*"), ("tr0ll", "troll*")]), ("the village idiot", []), ("a village  IDIOT, an idiot", [("idiot", "idiot")]), ("troll doll trolley trolleys", [("troll", "troll*")]),
    ("", []), (None, []), ("ab", [("ab", "ab")]), ("15 30 1 3 $5", []), ("@b", [("@b", "ab")]), ("id\niot", []),
])
def test_matches(text, want):
    assert found(text) == want


def slow_fold(text):
    """One character after another."""
    letters, _ = toxicity._tables()
    out = []
    for i, c in enumerate(text):
        k = letters[ord(c)]
        if k == 32 and c in toxicity.SUBSTITUTES:
            lo, hi = i, i
            while lo > 0 and text[lo - 1] in toxicity.SUBSTITUTES:
                lo -= 1
            while hi + 1 < len(text) and text[hi + 1] in toxicity.SUBSTITUTES:
                hi += 1
            after = hi + 1 < len(text) and letters[ord(text[hi + 1])] != 32
            before = lo > 0 and letters[ord(text[lo - 1])] != 32
            if after and hi - lo < 2 and (c not in "!|" or before):
                k = ord(toxicity.SUBSTITUTES[c])
        out.append(chr(k))
    return " " + " ".join("".join(out).split(" ")).strip() + " "


def test_folding_one_by_one():
    random.seed(2)
    for _ in range(3000):
        text = "".join(random.choice("aBé5$!|@0 -\nк7") for _ in range(random.randint(0, 30)))
        folded, place = toxicity.fold(text)
        assert folded.split() == slow_fold(text).split() and "   " not in folded and len(place) == len(folded)
        assert all(toxicity._tables()[0][ord(text[p])] in (ord(c), 32) for c, p in zip(folded[1:-1], place[1:-1], strict=True) if c != " ")


def test_score_falls_with_length_and_rises_with_matches():
    score = lambda t: LEX.score(toxicity.fold(t)[0])
    filler = "some quiet words here "
    assert score(filler * 10) < score(filler * 200 + "idiot") < score(filler * 10 + "idiot") < score(filler * 10 + "idiot trolls") <= 1
    assert score("") == score(None) == score(filler * 10) >= 0


def test_held_out_labels(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    got = queries()["op13_toxicity"](spark, d).toPandas()
    docs, labels = (pd.read_parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    held = got[got.held_out].merge(labels, on="doc_id")
    toxic, clean = held[held.toxic == 1].score, held[held.toxic == 0].score
    assert (toxic.to_numpy()[:, None] > clean.to_numpy()).mean() > 0.9
    assert (toxic >= 0.3).mean() > 0.88 and (clean >= 0.3).mean() < 0.03


def made(n, seed):
    """Texts of invented words; the toxic ones hold one of two words, or words with one stem, which also begins a harmless
    one; a phrase with a toxic word stands in others.
    """
    random.seed(seed)
    vocabulary = ["".join(random.choices("aeioulnrst", k=6)) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = random.choices(vocabulary, k=60)
        if toxic:
            words[random.randrange(60)] = random.choice(["grumph", "zorblat" + random.choice(["a", "en", "iss", "or"])])
        elif i % 4 == 0:
            words[random.randrange(58)] = "tame grumph"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learning_finds_words_stems_and_exceptions(spark):
    rows = made(2000, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    learnt = [w for w in lexicon.weights if w not in toxicity.KNOWN]
    assert any(w.startswith("zorbl") and w.endswith("*") for w in learnt) and not any("tame" == w for w in learnt)
    out = toxicity.find_toxic(spark.createDataFrame(made(500, 1)[:200] + [(1000 + i, t, y) for i, t, y in made(500, 1)[200:]], "doc_id long, text string, toxic int").select("doc_id", "text"), lexicon)
    hits = {r.doc_id % 1000: r.predicted for r in out.collect()}
    truth = {i: y for i, _, y in made(500, 1)}
    zorb = [i for i, t, y in made(500, 1) if y and "zorblat" in t]
    assert all(hits[i] for i in zorb) and sum(hits[i] for i in truth if not truth[i]) <= 4


def test_no_labels_and_odd_rows(spark):
    odd = [(1, None), (2, ""), (None, "you idiot"), (3, "x" * 300_000), (3, "x" * 300_000), (4, "stupid " * 50_000), (5, "😀 moron")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit("kept") for c in ("score", "toxic", "LABELLED", "h", "predicted", "spans")})
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    lexicon = toxicity.learn(docs, none)
    assert lexicon == toxicity.default_lexicon()
    strange = spark.createDataFrame([(1, 7), (None, 1), (99, 0), (3, None), (2, 1), (2, 1)], "doc_id long, toxic int")
    assert set(toxicity.learn(docs, strange).weights) == set(toxicity.KNOWN)
    rows = toxicity.find_toxic(docs, lexicon).collect()
    assert len(rows) == 7 and rows[0].score == rows[1].score == rows[3].score and rows[3] == rows[4]
    assert rows[2].predicted == 1 and rows[5].predicted == 1 and rows[6].spans == "2:7:moron" and rows[2].spans == "4:9:idiot"
    assert toxicity.find_toxic(docs.limit(0), lexicon).count() == 0


def test_labels_and_partitions_do_not_matter_to_the_score(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs.repartition(5), labels.repartition(3))
