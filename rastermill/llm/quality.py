"""Quality rules: fixed text statistics, and a linear-chain conditional random field over lines.

Viterbi decoding marks each line as content or boilerplate; a document stays when enough of its words lie in content
lines. The field is trained here, on a bounded sample of labelled documents. Labels are by document, so lines of good
documents count as content, and lines of bad ones start as boilerplate; a line that looks like those of good documents
is turned to content before the field itself is fitted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, mix64, read, text_bytes, window_hashes, word_hashes

#: What the field is fitted on: labelled documents at most (those with the least hash of their id), code points and lines
#: of the longest of them, and lines in all, which bounds the driver's memory to some 60 MB.
SAMPLE_DOCS, SAMPLE_CHARS, DOC_LINES, SAMPLE_LINES = 1500, 12_000, 400, 150_000
#: Share of words in content lines from which a document stays.
CONTENT_SHARE = 0.5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_LOUD = _SYMBOL.copy()
_LOUD[np.frombuffer(b"!{}[]=~^_@\\/+", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

FEATURES = ("always", "symbols", "many symbols", "capitals", "digits", "repeats", "mostly repeats", "short", "long words", "seen before", "ends a sentence", "symbol words")


@dataclass
class Shape:
    """Statistics of one text, and features of its lines that hold a word."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    line_words: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def shape(text: str | None) -> Shape:
    data = text_bytes(text)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
    words = word_hashes(data)
    n = len(words)
    none = np.zeros((0, len(FEATURES)))
    if not n:
        return Shape(0, 0, 0, 0, 0, np.zeros(0, np.int64), none)
    word_chars = int((~space & (data & 0xC0 != 0x80)).sum())
    repeat = 0
    if n >= 3:
        window = window_hashes(words, 3)
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(window)] |= twice
        repeat = int(covered.sum())
    breaks = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    line_of = np.searchsorted(breaks, start, side="right") - 1
    lines, first, per_line = np.unique(line_of, return_index=True, return_counts=True)
    texts = (text or "").split("\n")
    seen: set[str] = set()
    again = np.zeros(len(lines), bool)
    for i, k in enumerate(lines.tolist()):
        again[i] = texts[k] in seen
        seen.add(texts[k])
    ends = np.append(breaks[1:], len(data) + 1)[lines] - 1
    starts = breaks[lines]

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[ends] - total[starts]

    ink = np.maximum(inside(~space), 1)
    loud, upper, lower, digit = (inside(m[data]) for m in (_LOUD, _UPPER, _LOWER, _DIGIT))
    loud_words = np.add.reduceat((np.add.reduceat(_LOUD[data].astype(np.int64), start) > 0).astype(np.int64), first)
    key = mix64(words ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, where = np.unique(key, return_index=True)
    own = np.bincount(np.searchsorted(lines, line_of[where]), minlength=len(lines))
    fresh = own / per_line
    tail = np.array([texts[k].rstrip()[-1:] in ".?!:;\"'»”)" if texts[k].strip() else False for k in lines.tolist()])
    f = np.column_stack([
        np.ones(len(lines)), loud / ink > 0.04, loud / ink > 0.15, upper / np.maximum(upper + lower, 1) > 0.6, digit / ink > 0.3,
        (fresh < 0.6) & (per_line > 12), (fresh < 0.3) & (per_line > 12), per_line < 4, ink / per_line > 15, again, tail, loud_words / per_line > 0.4,
    ]).astype(np.float64)
    return Shape(n, word_chars, int(_SYMBOL[data].sum()), int(again.sum()), repeat, per_line, f)


@dataclass
class Field:
    """Linear-chain conditional random field of two states: 0 content, 1 boilerplate."""

    emit: np.ndarray
    step: np.ndarray

    def labels(self, features: np.ndarray) -> np.ndarray:
        """Viterbi path; ties go to content."""
        score = features @ self.emit
        n = len(score)
        if not n:
            return np.zeros(0, np.int64)
        (cc, cb), (bc, bb) = self.step.tolist()
        back: list[tuple[int, int]] = []
        c, b = score[0].tolist()
        for sc, sb in score[1:].tolist():
            from_c, from_b = (0 if c + cc >= b + bc else 1), (0 if c + cb >= b + bb else 1)
            c, b = max(c + cc, b + bc) + sc, max(c + cb, b + bb) + sb
            back.append((from_c, from_b))
        out = np.zeros(n, np.int64)
        out[-1] = state = 0 if c >= b else 1
        for k in range(n - 2, -1, -1):
            out[k] = state = back[k][state]
        return out

    def content_share(self, s: Shape) -> float:
        return float(s.line_words[self.labels(s.features) == 0].sum() / s.n_words) if s.n_words else 0.0


#: With no labelled documents of both kinds, every line is content.
NEUTRAL = Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[tuple[np.ndarray, int]], rounds: int = 80, penalty: float = 1e-3) -> Field:
    """Fits the field on (line features, document is good) pairs by gradient ascent on the conditional likelihood."""
    sequences = [(f, good) for f, good in sequences if len(f)]
    if len({good for _, good in sequences}) < 2:
        return NEUTRAL
    x = np.concatenate([f for f, _ in sequences])
    y = np.concatenate([np.full(len(f), 1 - good) for f, good in sequences]).astype(np.float64)
    # Lines alone first; each document weighs the same, so that one long document does not decide.
    weight = np.concatenate([np.full(len(f), 1 / len(f)) for f, _ in sequences])
    w = np.zeros(x.shape[1])
    for _ in range(300):
        p = 1 / (1 + np.exp(-x @ w))
        w += 2.0 * (x.T @ (weight * (y - p)) / weight.sum() - penalty * w)
    p = 1 / (1 + np.exp(-x @ w))
    tags, at = [], 0
    for f, good in sequences:
        own = p[at : at + len(f)]
        tags.append(np.zeros(len(f), np.int64) if good else ((own > 0.5) | (own == own.max())).astype(np.int64))
        at += len(f)
    # Longest first, all first lines, then all second lines, and so on: nothing is padded.
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i][0]))
    length = np.array([len(sequences[i][0]) for i in order])
    active = [int((length > t).sum()) for t in range(length[0])]
    start = np.concatenate([[0], np.cumsum(active)])
    place = np.concatenate([start[:n] + i for i, n in enumerate(length)])
    x = np.empty((len(place), x.shape[1]))
    x[place] = np.concatenate([sequences[i][0] for i in order])
    tag = np.empty(len(place), np.int64)
    tag[place] = np.concatenate([tags[i] for i in order])
    owner = np.concatenate([np.arange(n) for n in active])
    size, last, later = len(order), start[length - 1] + np.arange(len(order)), np.arange(active[0], len(x))
    former = np.concatenate([start[t - 1] + np.arange(active[t]) for t in range(1, len(active))]) if len(active) > 1 else np.zeros(0, np.int64)
    one_hot, pairs = np.eye(2)[tag], np.zeros((2, 2))
    np.add.at(pairs, (tag[former], tag[later]), 1)
    emit, step = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(step), np.zeros_like(step)]
    for r in range(1, rounds + 1):
        score = x @ emit
        alpha, beta = score.copy(), np.zeros_like(score)
        for t in range(1, len(active)):
            lo, hi = start[t], start[t + 1]
            alpha[lo:hi] += _logsumexp(alpha[start[t - 1] : start[t - 1] + active[t], :, None] + step, 1)
        for t in range(len(active) - 2, -1, -1):
            lo, hi = start[t + 1], start[t + 2]
            beta[start[t] : start[t] + active[t + 1]] = _logsumexp(step + (score[lo:hi] + beta[lo:hi])[:, None, :], 2)
        whole = _logsumexp(alpha[last], 1)
        node = np.exp(alpha + beta - whole[owner, None])
        edge = np.exp(alpha[former, :, None] + step + (score + beta)[later, None, :] - whole[owner[later], None, None])
        slopes = (x.T @ (one_hot - node) / size - penalty * emit, (pairs - edge.sum(0)) / size - penalty * step)
        for k, (value, slope) in enumerate(zip((emit, step), slopes, strict=True)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m[:] = 0.9 * m + 0.1 * slope
            v[:] = 0.99 * v + 0.01 * slope**2
            value += 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(emit, step)


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits the field on a bounded sample of labelled documents, whatever the order of their rows. Features are taken
    where the documents lie; only they come to the driver. Without labels of both kinds, every line is content.
    """
    chosen = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("labelled"), (F.col("quality") == 1).cast("int").alias("good"))
    chosen = chosen.filter(F.col("labelled").isNotNull()).orderBy(F.xxhash64("labelled"), "labelled", "good").limit(SAMPLE_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).filter(F.length("text") <= SAMPLE_CHARS)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shape(t).features for t in batch.column("text").to_pylist()]
        bits = [f.astype(bool).tobytes() if 0 < len(f) <= DOC_LINES else None for f in found]
        return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("good"), pa.array(bits, pa.binary())], names=["h", "good", "bits"])

    found = map_batches(rows.select(F.xxhash64("doc_id").alias("h"), "good", "text"), each, "h bigint, good int, bits binary", rows=256).filter("bits IS NOT NULL")
    # Several rows may have one id, so the limit is by an order that leaves no choice.
    found = found.orderBy("h", "good", "bits").limit(2 * SAMPLE_DOCS).collect()
    sequences, lines = [], 0
    for r in found:
        f = np.frombuffer(bytes(r.bits), bool).reshape(-1, len(FEATURES)).astype(np.float64)
        if lines + len(f) > SAMPLE_LINES:
            break
        sequences.append((f, r.good))
        lines += len(f)
    return fit(sequences)


def score_quality(docs: DataFrame, field: Field) -> DataFrame:
    """Statistics and verdict of every whole text, one row for each row in, in one narrow pass.

    Null text has no words and, like every text of fewer than 50 words, fails. Repeated rows are judged alike; columns
    other than doc_id and text are not read. An empty table gives none.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        shapes = [shape(t) for t in batch.column("text").to_pylist()]
        share = [field.content_share(s) for s in shapes]
        failed = [s.base_failed for s in shapes]
        counts = [pa.array([getattr(s, c) for s in shapes], pa.int64()) for c in names[1:6]]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(failed), pa.array([not b and c >= CONTENT_SHARE for b, c in zip(failed, share, strict=True)]), pa.array(share, pa.float64())], names=names)

    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double", rows=256)


def keep_good(docs: DataFrame, field: Field) -> DataFrame:
    """The rows that pass, with all their columns, whatever their names; repeated rows pass or go together. Null and
    empty texts go, as all of fewer than 50 words do. Texts are read whole. An empty table gives none.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        shapes = [shape(t) for t in batch.column("text").to_pylist()]
        return batch.filter(pa.array([not s.base_failed and field.content_share(s) >= CONTENT_SHARE for s in shapes], pa.bool_()))

    return map_batches(docs, each, docs.schema, rows=256)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, read(spark, sf_dir, "labels")))
