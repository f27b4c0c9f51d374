"""Personal data: fixed patterns, and the same looked for in a normalised text whose spans are mapped back.

A chain of transducers normalises a text: look-alike letters and digits of other scripts and invisible characters,
spelled digits, and disguises of @ and of the dot. Each keeps, for every character it writes, which characters of the
source it stands for. Identifiers found in the normalised text thus become spans of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin at the first digit of a run only, so later digits of a run are passed over at once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return sum(own[::2] + [d * 2 - 9 * (d > 4) for d in own[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the fixed patterns find, leftmost first and without overlaps within a kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and _LOCAL.match(text, lo - 1):
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", lo, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    if not _ANY_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: Letters of other scripts that look like Latin ones (fixed values); compatibility forms follow from Unicode itself.
LOOK_ALIKE = {
    **dict(zip("АВЕЅІЈКМНОРСТХУЗ", "ABESIJKMHOPCTXY3", strict=True)),
    **dict(zip("авеѕіјкмнорстхуԁԛԝһӏ", "abesijkmhopctxydqwhl", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True)),
    **dict(zip("αονιρτυχκϲ", "aoviptuxkc", strict=True)),
}
_OTHER_SCRIPT = re.compile("[Ͱ-֏؀-ۿऀ-෿๐-๙Ꭰ-᏿­​-‏‐-―․‪-‮⁠-⁤⁰-ₜ℀-⅏①-⓿❶-➓　-。︀-️﹒﹫﻿＀-￯\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff]")


@lru_cache(maxsize=1 << 14)
def plain(c: str) -> str:
    """What a character stands for: a look-alike's Latin letter, a digit, nothing for invisible ones, else itself."""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    if unicodedata.category(c) == "Cf" or "︀" <= c <= "️":
        return ""
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    if "‐" <= c <= "―":
        return "-"
    form = unicodedata.normalize("NFKC", c)
    form = {"。": ".", "․": "."}.get(form, form)
    return form if form.isascii() and 0 < len(form) <= 3 else c


DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w))) + r"|[0-9]++)"
_POINT = r"(?:dot|point|punkt|punto)"
_AT = r"(?:at|arroba|chez|ät)"
#: At least two spelled or plain digits apart, one of them spelled; with plus before and parentheses, dots between.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus)\s+)?(?:double\s+|triple\s+)?{_DIGIT}(?:(?:[\s()-]|\.|\s{_POINT}\s){{1,4}}(?:double\s+|triple\s+)?{_DIGIT}(?!\w))+", re.IGNORECASE)
_PART = re.compile(rf"(?P<plus>plus\s+)|(?P<times>double|triple)\s+|(?P<digit>{_DIGIT})|(?P<point>\s*{_POINT}\s*)|(?P<gap>[\s()-]+|\.)", re.IGNORECASE)
#: Patterns begin at a bracket, an @ or an "at", and what stands around is looked at from there, so that no long run of
#: blanks, hyphens or letters is read again from each of its characters.
_BRACKETED = re.compile(rf"[\[({{<]\s*+(?:(?P<at>{_AT}|@)|(?P<dot>{_POINT}|\.))\s*+[\])}}>]", re.IGNORECASE)
_MARK = re.compile(rf"(?<=\s){_AT}(?=\s)|@", re.IGNORECASE)
_DOMAIN_WORDS = re.compile(rf"[A-Za-z0-9-]++(?:(?:\s++{_POINT}\s++|\.)[A-Za-z0-9-]++)++(?!\w)", re.IGNORECASE)
_POINT_BEFORE = re.compile(rf"(?<=\s){_POINT}\Z", re.IGNORECASE)
_WORDED_DOT = re.compile(rf"\s+{_POINT}\s+", re.IGNORECASE)
_HINT = re.compile(r"[\[({<]\s*+(?:at|arroba|chez|ät|@|dot|point|punkt|punto|\.)\s*+[\])}>]|\b(?:dot|point|punkt|punto)\b|\s@|@\s", re.IGNORECASE)
_TLD = re.compile(r"[A-Za-z]{2,}")


class Mapped:
    """A text with, for each of its characters, the span of the source it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.lo = np.arange(len(text))
        self.hi = self.lo + 1

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replaces spans by new strings; each new character stands for its whole span's source."""
        texts, end = [], 0
        for a, b, new in changes:
            texts += [self.text[end:a], new]
            end = b
        first, behind, size = (np.fromiter(x, np.int64, len(changes)) for x in ([c[0] for c in changes], [c[1] for c in changes], [len(c[2]) for c in changes]))
        inside = np.zeros(len(self.text) + 1, np.int64)
        inside[first] += 1
        np.add.at(inside, behind, -1)
        times = 1 - np.cumsum(inside)[:-1]
        times[first] = size
        last = np.arange(len(self.text))
        last[first] = behind - 1
        at = np.repeat(np.arange(len(self.text)), times)
        self.text = "".join([*texts, self.text[end:]])
        self.lo, self.hi = self.lo[at], self.hi[last[at]]


def _look_alikes(m: Mapped) -> None:
    found = {c: plain(c) for c in set(_OTHER_SCRIPT.findall(m.text))}
    m.text = m.text.translate({ord(c): x for c, x in found.items() if len(x) == 1})
    if longer := {c for c, x in found.items() if len(x) != 1}:
        m.rewrite([(i, i + 1, found[c]) for i, c in enumerate(m.text) if c in longer])


def _spelled_digits(m: Mapped) -> None:
    changes = []
    for run in _SPELLED.finditer(m.text):
        if run[0].replace(" ", "").replace("-", "").isdigit() or not any(c.isalpha() for c in run[0]):
            continue
        out, times, spelled = [], 1, 0
        for p in _PART.finditer(run[0]):
            if p["plus"]:
                out.append((p.start(), p.end(), "+"))
            elif p["times"]:
                times = {"double": 2, "triple": 3}[p["times"].lower()]
                out.append((p.start(), p.end(), ""))
            elif p["digit"]:
                digit = DIGIT_WORDS.get(p["digit"].lower(), p["digit"])
                spelled += digit != p["digit"]
                out.append((p.start(), p.end(), digit * times))
                times = 1
            elif p["point"]:
                out.append((p.start(), p.end(), "."))
            elif p["gap"] and p["gap"].isspace():
                out.append((p.start(), p.end(), ""))
        if spelled >= 2 and sum(len(x) for _, _, x in out) >= 4:
            changes += [(run.start() + a, run.start() + b, x) for a, b, x in out]
    if changes:
        m.rewrite(changes)


def _left(text: str, at: int, floor: int, blank: bool) -> int:
    """Start of the run of blanks, or else of characters of a local part, that ends at `at`."""
    while at > floor and (text[at - 1].isspace() if blank else _LOCAL.match(text, at - 1)):
        at -= 1
    return at


def _local_part(text: str, end: int, floor: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the local part that ends at `end` begins, and its worded dots; `floor` is the end of what came before."""
    lo, dots = _left(text, end, floor, False), []
    while lo < end and (word := _left(text, lo, floor, True)) < lo:
        point = _POINT_BEFORE.search(text, max(floor, word - 6), word)
        before = _left(text, point.start(), floor, True) if point else word
        if not point or before == point.start() or (first := _left(text, before, floor, False)) == before:
            break
        dots.append((before, lo))
        lo = first
    return lo, dots[::-1]


def _disguises(m: Mapped) -> None:
    text, changes, end = m.text, [], 0
    for x in _BRACKETED.finditer(text):
        lo, hi = _left(text, x.start(), end, True), x.end()
        while hi < len(text) and text[hi].isspace():
            hi += 1
        changes.append((lo, hi, "@" if x["at"] else "."))
        end = hi
    if changes:
        m.rewrite(changes)
    text, changes, end = m.text, [], 0
    marks = [(x.start(), x.end()) for x in _MARK.finditer(text)]
    for (a, b), (limit, _) in pairwise([*marks, (len(text), 0)]):
        lo, hi = _left(text, a, end, True), b
        while hi < limit and text[hi].isspace():
            hi += 1
        floor, end = end, b
        domain = _DOMAIN_WORDS.match(text, hi, limit)
        if not domain:
            continue
        # Prose has "at", too: a worded address needs a worded dot or a real @, and ends as a domain does.
        dots = list(_WORDED_DOT.finditer(domain[0]))
        if text[a] != "@" and not dots or not _TLD.fullmatch(re.split(rf"\s+{_POINT}\s+|\.", domain[0], flags=re.IGNORECASE)[-1]):
            continue
        first, worded = _local_part(text, lo, floor)
        if first == lo or first and (text[first - 1].isalnum() or text[first - 1] == "_"):
            continue
        changes += [(*d, ".") for d in worded]
        if (lo, hi) != (a, b) or text[a] != "@":
            changes.append((lo, hi, "@"))
        changes += [(hi + d.start(), hi + d.end(), ".") for d in dots]
        end = domain.end()
    if changes:
        m.rewrite(changes)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that show in the normalised text only."""
    scripts = bool(not text.isascii() and _OTHER_SCRIPT.search(text))
    hint, spelled = _HINT.search(text), _SPELLED.search(text)
    if not (scripts or hint or spelled):
        return []
    m = Mapped(text)
    if scripts:
        _look_alikes(m)
    if spelled or scripts:
        _spelled_digits(m)
    if hint or scripts:
        _disguises(m)
    if m.text == text:
        return []
    # Within a kind, spans are found in order, and so are those of the source they map to.
    taken = {k: sorted((a, b) for own, a, b in base if own == k) for k in KINDS}
    out, last = [], dict.fromkeys(KINDS, 0)
    for kind, a, b in base_spans(m.text):
        lo, hi = int(m.lo[a:b].min()), int(m.hi[a:b].max())
        k = bisect_left(taken[kind], (hi,))
        if lo >= last[kind] and not (k and taken[kind][k - 1][1] > lo):
            out.append((kind, lo, hi))
            last[kind] = hi
    return out


def _order(s: tuple[str, int, int]) -> tuple[int, int, int]:
    return KINDS.index(s[0]), s[1], s[2]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text, one row for each row in, repeated rows included, in one narrow pass.

    Counts and digest are of base spans; `spans` has added ones, too, which never overlap a base span of their kind, and
    `n_found` counts both. Null text counts as empty, and an empty text has no spans. Time grows with a text's length.
    An empty table gives none. Columns other than doc_id and text are not read, whatever their names.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = [sorted(base_spans(t), key=_order) for t in texts]
        both = [sorted(b + added_spans(t, b), key=_order) for t, b in zip(texts, base, strict=True)]
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
        digests = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([_joined(b) for b in both], pa.string()), pa.array([len(b) for b in both], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found"])

    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_found bigint", rows=256)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_personal_data(read(spark, sf_dir, "documents"))
