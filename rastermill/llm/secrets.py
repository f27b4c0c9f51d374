"""Secret scans: fixed patterns, and strings that look random to character Markov models.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled samples. A
token is reported when its log-likelihood ratio is above a limit. The samples: random strings are what the fixed
patterns find in a bounded sample of documents, and strings drawn from usual key alphabets; ordinary ones are the words
of these documents, alone and joined the way identifiers are.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import like, map_batches, read, text_bytes

#: Documents read for training (those with the least hash of their id), and the longest text among them.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
#: Shortest token looked at; the log-likelihood ratio needed in all and by character: by a whole run with digits of
#: `USUAL` characters or more, by a part of such a run, and by shorter ones and those without digits.
SHORTEST, USUAL = 12, 16
LEAST, PART, STRICT = (12.0, 1.0), (20.0, 1.5), (24.0, 2.0)

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
WORDS = ("password", "passwd", "secret", "token", "api")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_TOKEN = _CODE >= 0
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def _runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    lo, hi = edge[::2], edge[1::2]
    keep = hi - lo >= least
    return list(zip(lo[keep].tolist(), hi[keep].tolist(), strict=True))


def base_spans(text: str, data: np.ndarray) -> list[tuple[str, int, int]]:
    """What the fixed patterns find, in code points. `data` is the text in UTF-8."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    if runs := _runs(_HEX[data], 32):
        at = Chars(data)
        found += [("hex", at(a), at(b)) for a, b in runs]
    return found


class Chars:
    """Code point at a byte offset."""

    def __init__(self, data: np.ndarray):
        self.tail = np.flatnonzero(data & 0xC0 == 0x80)

    def __call__(self, offset: int) -> int:
        return offset - int(np.searchsorted(self.tail, offset))


@dataclass
class Models:
    """log P(random) - log P(ordinary) of a first letter and of each pair of letters."""

    first: np.ndarray
    pair: np.ndarray

    def score(self, token: np.ndarray) -> float:
        code = _CODE[token]
        return float(self.first[code[0]] + self.pair[code[:-1], code[1:]].sum())

    def spans(self, text: str, data: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        out, at = [], None
        for a, b in _runs(_TOKEN[data], SHORTEST):
            for lo, hi in self._found(data, a, b):
                at = at or Chars(data)
                lo, hi = at(lo), at(hi)
                if not any(x < hi and lo < y for _, x, y in base):
                    out.append(("random", lo, hi))
        return out

    def _passes(self, token: np.ndarray, limits: tuple[float, float]) -> bool:
        if len(token) < SHORTEST:
            return False
        if len(token) < USUAL or not ((token >= 48) & (token <= 57)).any():
            limits = STRICT
        if self.score(token) < limits[1] * len(token):
            return False
        # A pair that comes again is no further evidence, else any one letter repeated would pass.
        return self.score(token) >= limits[0] and float(self.pair.ravel()[np.unique(_CODE[token[:-1]] * len(ALPHABET) + _CODE[token[1:]])].sum()) >= limits[0] / 2

    def _found(self, data: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
        """The run if it passes, or else its best parts, one after another: a key may be joined to a path or a name."""
        out, todo, limits = [], [(a, b)], LEAST
        while todo:
            lo, hi = a, b = todo.pop()
            if limits is PART:
                if b - a < SHORTEST:
                    continue
                code = _CODE[data[a:b]]
                gain = np.cumsum(np.concatenate([[0.0], self.pair[code[:-1], code[1:]] - PART[1]]))
                least = np.minimum.accumulate(gain)
                end = int((gain - least).argmax())
                lo, hi = a + int(gain[: end + 1].argmin()), a + end + 1
            cut = lo, hi
            while lo < hi and data[lo] in b"=/-_+":
                lo += 1
            while hi > lo and data[hi - 1] in b"/-_+":
                hi -= 1
            if self._passes(data[lo:hi], limits):
                out.append((lo, hi))
                if limits is PART:
                    todo += [(a, cut[0]), (cut[1], b)]
            elif limits is LEAST:
                limits = PART
                todo.append((a, b))
            elif cut[1] - cut[0] > 1:
                todo += [(a, cut[0]), (cut[1], b)]
        return sorted(out)


def _counts(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(ALPHABET)
    first, pair = np.full(n, 0.5), np.full((n, n), 0.05)
    for s in strings:
        code = _CODE[np.frombuffer(s.encode(), np.uint8)]
        first[code[0]] += 1
        np.add.at(pair, (code[:-1], code[1:]), 1)
    return np.log(first / first.sum()), np.log(pair / pair.sum(axis=1, keepdims=True))


def drawn_strings(each: int = 1500, seed: int = 7) -> list[str]:
    """Strings over the alphabets keys are made of; the models are fitted on those of the default seed."""
    rng = np.random.default_rng(seed)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:64], ALPHABET[:62] + "_-")
    return ["".join(rng.choice(list(k), size=int(rng.integers(20, 44)))) for k in kinds for _ in range(each)]


def ordinary_strings(words: list[str], each: int = 4000) -> list[str]:
    """Words alone and joined as names and paths: snake_case, kebab-case, camelCase, CAPS, with a number behind, a/b/c."""
    rng = np.random.default_rng(11)
    pick = lambda k: [words[i].lower() for i in rng.integers(0, len(words), k)]
    joins = (lambda w: "_".join(w), lambda w: "-".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "".join(x.title() for x in w), lambda w: "/".join(w), lambda w: "_".join(w).upper(), lambda w: "_".join(w) + f"_{rng.integers(0, 3000)}", lambda w: "-".join(w) + f"{rng.integers(1, 100)}")
    return words + [j(pick(int(rng.integers(2, 5)))) for j in joins for _ in range(each)]


def train(docs: DataFrame) -> Models:
    """Fits both models on at most `SAMPLE_DOCS` documents; without any, on drawn strings and a few usual names."""
    ids = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), F.length("text").alias("n")).filter(F.col("n") <= SAMPLE_CHARS).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select(F.col("doc_id").alias("in_sample")).distinct()
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("in_sample"), "left_semi").filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * SAMPLE_DOCS).collect()
    secret, plain = [], {"account", "identifier", "configuration", "document", "controller", "version"}
    for text in sorted(r.text for r in rows):
        data = text_bytes(text)
        spans = base_spans(text, data)
        secret += [re.sub(r"[^A-Za-z0-9+/_=-]", "", ASSIGN.fullmatch(text[a:b])[2] if kind == "assign" else text[a:b]) for kind, a, b in spans]
        plain.update(w for w in re.findall(r"[A-Za-z]{3,}", text) if not w.startswith("AKIA"))
    rf, rp = _counts([s for s in secret if len(s) > 1] + drawn_strings())
    of, op = _counts(ordinary_strings(sorted(plain)))
    return Models(rf - of, rp - op)


def spans_of(text: str | None, models: Models) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added spans together, each by start, then kind."""
    text = text or ""
    data = text_bytes(text)
    base = base_spans(text, data)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(base + models.spans(text, data, base), key=order)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """Spans of secrets in every whole text, one row for each row in, repeated rows included; null text counts as empty,
    empty has no spans. An empty table gives no rows. Columns other than doc_id and text are not read.

    Overlaps: kinds are found apart, so one place may have two base spans; an added span never touches a base one.
    """
    models = models or train(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [spans_of(t, models) for t in batch.column("text").to_pylist()]
        count = lambda k: pa.array([sum(s[0] == k for s in b) for b, _ in both], pa.int64())
        base = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in both], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), count("assign"), count("access"), count("hex"), base, pa.array([_joined(s) for _, s in both], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", rows=256)


def redact(docs: DataFrame, models: Models | None = None, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret replaced by `mark` and n_chars, where there is one, counted again.

    All columns, whatever their names, and all rows stay, repeated ones too; a null text stays null, an empty one empty.
    Texts are read whole; an empty table gives an empty one.
    """
    models = models or train(docs)
    schema, counted = like(docs), "n_chars" in docs.columns

    def clean(text: str | None) -> str | None:
        if not text or not (spans := spans_of(text, models)[1]):
            return text
        out, end = [], 0
        for _, a, b in spans:
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column("text").to_pylist()
        new = [clean(t) for t in old]
        columns = {c: batch.column(c) for c in batch.schema.names}
        columns["text"] = pa.array(new, schema.field("text").type)
        if counted:
            was = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([w if n == o else len(n) for w, n, o in zip(was, new, old, strict=True)], schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_batches(docs, each, docs.schema, rows=256)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(read(spark, sf_dir, "documents"))
