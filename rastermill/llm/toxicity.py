"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton over folded text and normalised by length.

Folding writes one character for each of a text's, so that spans can be mapped back: look-alike letters of other scripts,
letters with accents and compatibility forms become plain letters, digits and signs that stand for letters are read as
these inside a word, and everything else is a gap. The automaton then finds words and stems (beginnings of words).
Exception phrases are patterns, too: a match that lies in one does not count.

Entries and their weights come from labelled texts: candidates are all words and their beginnings, counted by class on
the executors; those that occur far more often in toxic texts stay, a stem where it says more than the longer words it
begins, a phrase as an exception where it is at home in other texts. A text's weighted matches, as such and for its
length, give the score, by a logistic function fitted on the same texts.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches, read
from .personal_data import LOOK_ALIKE

#: What is learnt from: labelled documents at most (those with the least hash of their id), code points of the longest.
SAMPLE_DOCS, SAMPLE_CHARS = 12_000, 20_000
#: Entries of the lexicon, candidates looked at for it, and exception phrases, at most.
ENTRIES, CANDIDATES, EXCEPTIONS = 500, 20_000, 500
#: A candidate must occur in so many toxic texts, `RATIO` times as often for their words as in others, and chance must
#: give as many of its texts to the toxic ones with a probability below exp(-`SURPRISE`).
LEAST_DOCS, RATIO, SURPRISE = 4, 4.0, 14.0
#: Shortest and longest beginning of a word that can be a stem.
STEM = (4, 8)
#: An exception phrase occurs in so many texts, at least this share of them not toxic.
PHRASE_DOCS, PHRASE_CLEAN = 4, 0.9
THRESHOLD = 0.3

#: Words that count where labels say nothing (fixed values, with one weight).
KNOWN = ("idiot", "moron", "stupid", "scum", "loser", "imbecile", "retard", "bastard", "asshole", "bitch")
KNOWN_WEIGHT = 4.0
#: Phrases in which they are not meant (fixed values).
KNOWN_EXCEPTIONS = ("sore loser", "stupid question", "village idiot")

#: What digits and signs stand for (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}


def _letters() -> np.ndarray:
    """For each code point the letter it is read as; a blank for what is none."""
    table = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c in LOOK_ALIKE:
            table[k] = ord(LOOK_ALIKE[c].lower()) if LOOK_ALIKE[c].isalpha() else 32
        elif c.isalpha():
            plain = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
            low = plain[0].lower() if len(plain) == 1 else c.lower()
            table[k] = ord(low) if len(low) == 1 else k
    return table


def _signs() -> np.ndarray:
    table = np.zeros(0x110000, np.uint32)
    for k, v in SUBSTITUTES.items():
        table[ord(k)] = ord(v)
    return table


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Made once in each worker."""
    if not _TABLES:
        _TABLES["letters"], _TABLES["signs"] = _letters(), _signs()
    return _TABLES["letters"], _TABLES["signs"]


#: Marks on the letter before and invisible characters; they do not end a word.
def _is_nothing(codes: np.ndarray) -> np.ndarray:
    return (codes >= 0x300) & (codes < 0x370) | (codes >= 0x200B) & (codes <= 0x200D) | (codes == 0x2060) | (codes == 0xFEFF) | (codes == 0xAD)


def fold(text: str | None) -> tuple[str, np.ndarray]:
    """Folded text, words parted by one blank each, with a blank at both ends, and for each of its characters the place
    in the text. A sign counts as a letter if a letter follows its run; of ! and | also only right after a letter.
    """
    letters, signs = _tables()
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(codes))
    if len(codes) and int(codes.max()) >= 0xAD and (nothing := _is_nothing(codes)).any():
        codes, place = codes[~nothing], place[~nothing]
    out = letters[codes]
    sign = np.flatnonzero(signs[codes])
    if len(sign):
        # Runs of signs: the place after the run decides for all of it.
        ends = np.append(np.flatnonzero(np.diff(sign) > 1), len(sign) - 1)
        run = np.searchsorted(ends, np.arange(len(sign)))
        after = sign[ends] + 1
        before = sign[np.append(0, ends[:-1] + 1)] - 1
        letter_after = (after < len(out)) & (out[np.minimum(after, len(out) - 1)] != 32)
        letter_before = (before >= 0) & (out[np.maximum(before, 0)] != 32)
        weak = np.isin(codes[sign], (0x21, 0x7C))
        short = np.diff(np.append(-1, ends))[run] <= 2
        read = letter_after[run] & np.where(weak, letter_before[run] & short, short)
        out[sign[read]] = signs[codes[sign[read]]]
    gap = out == 32
    keep = ~(gap & np.append(True, gap[:-1])) if len(out) else gap
    folded, at = out[keep], place[keep]
    tail = len(folded) > 0 and folded[-1] == 32
    return " " + folded.tobytes().decode("utf-32-le", "surrogatepass") + ("" if tail else " "), np.concatenate([[0], at, [] if tail else [len(text or "")]]).astype(np.int64)


@dataclass
class Lexicon:
    """Weights of entries (words, or stems with * at the end), exception phrases, and the logistic function's weights
    for 1, the log of weighted matches, and the log of weighted matches a thousand words.
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...] = KNOWN_EXCEPTIONS
    scale: tuple[float, float, float] = (-4.0, 1.0, 1.0)
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "scale": self.scale, "_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            own = ahocorasick.Automaton()
            for phrase in self.exceptions:
                own.add_word(f" {phrase} ", (len(phrase), "", 0.0))
            for entry, weight in self.weights.items():
                stem = entry.endswith("*")
                own.add_word(f" {entry[:-1]}" if stem else f" {entry} ", (len(entry) - stem, entry, weight))
            if len(own):
                own.make_automaton()
            self._automaton = own
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(start, end, entry, weight) in folded text, in order; none within an exception phrase. Of the entries that
        start at one word, the one with the largest weight counts.
        """
        own = self.automaton()
        found: dict[int, tuple[int, str, float]] = {}
        safe: list[tuple[int, int]] = []
        for end, (length, entry, weight) in own.iter(folded) if len(own) else ():
            # The last character is the blank after a word, but of a stem its own.
            first = end - length + (1 if entry.endswith("*") else 0)
            if not entry:
                safe.append((first, end))
            elif first not in found or weight > found[first][2]:
                found[first] = (first + length, entry, weight)
        out = [(first, *found[first]) for first in sorted(found)]
        if not safe:
            return out
        safe.sort()
        kept, k, reach = [], 0, 0
        for m in out:
            while k < len(safe) and safe[k][0] <= m[0]:
                reach, k = max(reach, safe[k][1]), k + 1
            if m[1] > reach:
                kept.append(m)
        return kept

    def evidence(self, folded: str, matches: list[tuple[int, int, str, float]] | None = None) -> tuple[float, float]:
        """Log of the weighted matches, and of those a thousand words. A word said n times counts 1 + log n times, so
        that one word said over and over is not the whole text's verdict.
        """
        times: dict[tuple[str, float], int] = {}
        for start, _, _, weight in self.matches(folded) if matches is None else matches:
            said = folded[start : folded.index(" ", start)]
            times[said, weight] = times.get((said, weight), 0) + 1
        worth = sum(weight * (1 + math.log(n)) for (_, weight), n in times.items())
        words = max(folded.count(" ") - 1, 0)
        return math.log1p(worth), math.log1p(1000 * worth / (words + 50))

    def score(self, folded: str, matches: list[tuple[int, int, str, float]] | None = None) -> float:
        a, b = self.evidence(folded, matches)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.scale[0] + self.scale[1] * a + self.scale[2] * b))))


def default_lexicon() -> Lexicon:
    return Lexicon(dict.fromkeys(KNOWN, KNOWN_WEIGHT))


def _counted(sample: DataFrame) -> DataFrame:
    """(entry, toxic texts, others, occurrences in each) of all words and stems; a task sends sums. The empty entry stands
    for all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = fold(text)[0].split()
                times = Counter(words)
                for w, n in list(times.items()):
                    for k in range(STEM[0], min(STEM[1], len(w)) + 1):
                        times[f"{w[:k]}*"] += n
                times[""] = len(words)
                for entry, n in times.items():
                    own = sums.setdefault(entry, [0, 0, 0, 0])
                    own[0 if toxic else 1] += 1
                    own[2 if toxic else 3] += n
            columns = list(zip(*sums.values(), strict=True)) if sums else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["entry", "d1", "d0", "n1", "n0"])

    found = sample.select("text", "toxic").mapInArrow(run, "entry string, d1 bigint, d0 bigint, n1 bigint, n0 bigint")
    return found.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("d1", "d0", "n1", "n0")])


def _chosen(counts: DataFrame, docs: tuple[int, int], words: tuple[int, int]) -> dict[str, float]:
    """Entries and weights: the log ratio of their rates in toxic texts and in others. `docs` and `words` count the
    texts and words of toxic texts, then of others.
    """
    weight = F.log((F.col("n1") + 0.5) / float(words[0] + 1) * float(words[1] + 1) / (F.col("n0") + 0.5))
    # Texts that hold the entry, against what chance would give them (Chernoff's bound); repeats in a text say nothing.
    share = float(docs[0]) / float(docs[0] + docs[1])
    both = F.col("d1") + F.col("d0")
    others = F.when(F.col("d0") > 0, F.col("d0") * F.log(F.col("d0") / both / (1 - share))).otherwise(0.0)
    surprise = F.col("d1") * F.log(F.col("d1") / both / share) + others
    good = counts.filter((F.col("d1") >= LEAST_DOCS) & (F.col("entry") != "") & (F.col("d1") / both > share)).withColumn("weight", weight).filter((F.col("weight") >= math.log(RATIO)) & (surprise >= SURPRISE))
    # How much it says, and in how many texts; a longer one and a whole word come first where that is equal.
    gain = F.round(F.col("weight") * F.col("d1"), 6)
    best = good.orderBy(F.desc(gain), F.desc(F.length("entry")), "entry").limit(CANDIDATES).select("entry", "weight").collect()
    out: dict[str, float] = {}
    whole, stems, begun = set(), set(), set()
    for r in best:
        stem = r.entry.endswith("*")
        core = r.entry.rstrip("*")
        # Neither below a stem that counts nor above an entry that does.
        if any(core[:n] in stems for n in range(STEM[0], len(core) + 1)) or stem and core in begun or not stem and core in whole:
            continue
        (stems if stem else whole).add(core)
        begun.update(core[:n] for n in range(STEM[0], len(core) + 1))
        out[r.entry] = round(float(r.weight), 4)
        if len(out) == ENTRIES:
            break
    return out


def _phrases(sample: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Two and three words around a match that are at home in other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded = fold(text)[0]
                seen: set[str] = set()
                for start, _, _, _ in lexicon.matches(folded):
                    end = folded.index(" ", start)
                    former = folded[folded.rfind(" ", 0, max(start - 1, 0)) + 1 : start - 1] if start > 1 else ""
                    later = folded[end + 1 : (folded.find(" ", end + 1) + 1 or len(folded) + 1) - 1]
                    word = folded[start:end]
                    seen.update(p for p in (f"{former} {word}" if former else "", f"{word} {later}" if later else "", word) if p)
                for p in seen:
                    sums.setdefault(p, [0, 0])[0 if toxic else 1] += 1
            columns = list(zip(*sums.values(), strict=True)) if sums else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["phrase", "d1", "d0"])

    sums = sample.select("text", "toxic").mapInArrow(run, "phrase string, d1 bigint, d0 bigint").groupBy("phrase").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0"))
    at_home = sums.filter((F.col("d0") >= PHRASE_DOCS) & (F.col("d0") >= PHRASE_CLEAN * (F.col("d0") + F.col("d1"))))
    return tuple(r.phrase for r in at_home.orderBy(F.desc("d0"), "phrase").limit(EXCEPTIONS).collect())


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """The logistic function's weights by Newton's method, drawn a little towards the default ones."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [lexicon.evidence(fold(t)[0]) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)), batch.column("toxic")], names=["a", "b", "toxic"])

    rows = map_batches(sample.select("text", "toxic"), each, "a double, b double, toxic int").toPandas()  # SAMPLE_DOCS rows at most
    rows = rows.sort_values(["a", "b", "toxic"])  # so that the sums do not depend on the rows' order
    x = np.column_stack([np.ones(len(rows)), rows[["a", "b"]].to_numpy(float)])
    y = rows["toxic"].to_numpy(float)
    start = np.array(Lexicon({}).scale)
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (y - p) - 0.5 * (w - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    # More matches never make a text less toxic.
    return float(w[0]), max(float(w[1]), 0.0), max(float(w[2]), 0.0)


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Lexicon:
    """Lexicon from a bounded sample of labelled documents, whatever the order of their rows. `usable` is a condition on
    labels' `doc_id`. Labels other than 0 and 1, and ids without a document, count for nothing; repeated rows count
    each. Without labels of both kinds the lexicon is `KNOWN`.
    """
    with Scratch(docs.sparkSession) as scratch:
        chosen = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        chosen = (chosen if usable is None else chosen.filter(usable)).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
        chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled", "toxic").limit(SAMPLE_DOCS)
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).filter(F.length("text") <= SAMPLE_CHARS)
        # One id may have many documents, so the bound is drawn again, in an order that leaves no choice.
        sample = scratch.keep(rows.select("text", "toxic").orderBy(F.xxhash64("text"), "text", "toxic").limit(SAMPLE_DOCS).repartition(16, F.xxhash64("text")))
        counts = scratch.keep(_counted(sample))
        every = counts.filter("entry = ''").first()
        if not every or not every.d1 or not every.d0:
            return default_lexicon()
        found = _chosen(counts, (every.d1, every.d0), (every.n1, every.n0))
        own = {w: KNOWN_WEIGHT for w in KNOWN if w not in found} | found
        lexicon = Lexicon(own)
        lexicon = Lexicon(own, tuple(dict.fromkeys(KNOWN_EXCEPTIONS + _phrases(sample, lexicon))))
        return Lexicon(own, lexicon.exceptions, _calibrated(sample, lexicon))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for testing; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def find_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and spans of every whole text, one row for each row in, in one narrow pass.

    A span is start:end:entry, in code points of the text, end exclusive, comma-joined. Null and empty texts have no
    matches and the lowest score. Repeated rows score alike; columns other than doc_id and text are not read. An empty
    table gives none.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, spans = [], []
        for text in batch.column("text").to_pylist():
            folded, place = fold(text)
            matches = lexicon.matches(folded)
            scores.append(lexicon.score(folded, matches))
            spans.append(",".join(f"{place[a]}:{place[b - 1] + 1}:{entry}" for a, b, entry, _ in matches))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, pa.string())], names=["doc_id", "score", "predicted", "spans"])

    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, score double, predicted int, spans string", rows=256)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents")
    lexicon = learn(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return find_toxic(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
