"""The pipeline against a version of its own: each stage done anew in plain Python, with nothing of the library but the
fitted models (the line field and the Markov tables), whose scores are computed here once more.
"""

import hashlib
import math
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from rastermill.llm import bpe, pipeline, quality, secrets

from .test_operators import WORD, brute_quality, brute_secrets, brute_targets


def bag_of(text):
    words = WORD.findall(text or "")
    width = min(5, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else Counter()


def classes_of(texts):
    bags, own = [bag_of(t) for t in texts], list(range(len(texts)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if 5 * min(a.total(), b.total()) >= 4 * max(a.total(), b.total()):
                both = (a & b).total()
                if not a and not b or both >= 0.8 * (a.total() + b.total() - both):
                    x, y = root(i), root(j)
                    own[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def is_good(text, field):
    n, _, _, _, repeat = brute_quality(text or "")
    if n < 50 or 100 * repeat > 50 * n:
        return False
    features, lines = quality.shape(text).features, [len(WORD.findall(x)) for x in text.split("\n") if WORD.search(x)]
    score, step = features @ field.emit, field.step
    best, back = score[0], []
    for s in score[1:]:
        paths = best[:, None] + step
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + s
    state = [int(best.argmax())]
    for k in reversed(back):
        state.append(int(k[state[-1]]))
    return sum(w for w, s in zip(lines, reversed(state), strict=True) if s == 0) >= quality.CONTENT_SHARE * n


def without_secrets(text, models):
    base = [tuple(int(x) for x in s.split(":")[1:]) for s in brute_secrets(text)]
    # What the models add is tested by itself; here only that it never touches a fixed span, and where it lies.
    added = [(a, b) for k, a, b in secrets.spans_of(text, models)[1] if k == "random"]
    assert not any(a < y and x < b for a, b in added for x, y in base)
    out, end = [], 0
    for a, b in sorted(base + added):
        if a >= end:
            out += [text[end:a], "[secret]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    return pipeline.run(spark, sf_dir).toPandas()


def test_run(spark, sf_dir, result):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = docs.toPandas().sort_values("doc_id")
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = table[[is_good(t, field) for t in table.text]].reset_index(drop=True)
    one = good[[i == c for i, c in enumerate(classes_of(good.text.tolist()))]].copy()
    assert 0 < len(one) < len(good) < len(table)
    models = secrets.train(spark.createDataFrame(one))
    one["text"] = [without_secrets(t, models) for t in one.text]
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(public_tokenizers.path(bpe.VOCABULARY)).ranks, special_tokens={})
    want = {d: encoder.encode_ordinary(t) for d, t in zip(one.doc_id, one.text, strict=True)}
    assert set(result.doc_id) <= set(want)
    for d, n, ids, sha in zip(result.doc_id, result.n_tokens, result.token_ids, result.decoded_sha256, strict=True):
        assert n == len(ids) and list(ids) == want[d]
        assert sha == hashlib.sha256(encoder.decode_bytes(want[d])).hexdigest()
    one["size"] = [len(WORD.findall(t)) for t in one.text]
    times = Counter(result.doc_id)
    one["taken"] = [times[d] * n for d, n in zip(one.doc_id, one["size"], strict=True)]
    targets = brute_targets(one.groupby("source", dropna=False)["size"].sum().to_dict())
    for source, g in one.groupby("source", dropna=False):
        assert abs(g.taken.sum() - targets[source]) <= g["size"].max()
        # Budgets are nested: what is taken once more has lesser hashes than most of what is not.
        copies = math.floor(targets[source] / g["size"].sum())
        assert set(times[d] for d in g.doc_id) <= {copies, copies + 1}
    assert max(times.values()) <= 3


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "near-dedup", "secret scan", "mix sources", "encode"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 and empty.columns == docs.columns


def test_the_entry_beside_the_package():
    import corpus_pipeline

    assert corpus_pipeline.STAGES is pipeline.STAGES and corpus_pipeline.run is pipeline.run and corpus_pipeline.ORACLE_SQL is None
