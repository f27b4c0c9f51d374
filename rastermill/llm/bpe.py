"""Byte-level BPE over Arrow batches with the `tokenizers` library.

The vocabulary comes as ranks (base64 token, rank). The library wants the tokens in a printable alphabet, one
character a byte, and a list of merges. A merge is any split of a token into two tokens, ordered by the token's
rank, so the pair joined next is the one whose union has the lowest rank.

One case is not decided by ranks alone: tokens x, y, z in a row with x + y == y + z and x != z. Both joins make the
same token; leftmost must win, while a merge list prefers one of the two splits. `risky` lists the byte strings
x + y + z for which that can happen; a piece that holds one of them is encoded by the rank library instead.

The pattern cuts a text into pieces, and pieces repeat: a worker keeps the ids of those it has met, up to `MEMO` of
them, until its partition ends; the library sees each new piece of a batch once.

Character classes differ between Unicode versions only where a code point was unassigned before. A text with a code
point that this Python does not know goes to the rank library whole.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models, pre_tokenizers

from .common import map_batches, read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces whose ids a worker keeps, and the longest piece kept.
MEMO, MEMO_CHARS = 150_000, 64


def printable_bytes() -> dict[int, str]:
    """Byte to character: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encodes texts to ids with character offsets, and ids back to bytes and text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.table = printable_bytes()
        self.reverse = {c: b for b, c in self.table.items()}
        show = lambda token: "".join(map(self.table.__getitem__, token))
        merges, splits = [], defaultdict(list)
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    merges.append((show(token[:k]), show(token[k:])))
                    splits[token].append(k)
        # x + y == y + z: the token starts with x (length k) and y is both its tail after k and its head.
        self.risky = sorted({t + t[len(t) - k :] for t, ks in splits.items() for k in ks if len(t) - k in ks and t[k:] == t[: len(t) - k] and t[:k] != t[len(t) - k :]})
        self.finder = ahocorasick.Automaton()
        for s in self.risky:
            self.finder.add_word(s.decode("latin-1"), 1)
        if self.risky:
            self.finder.make_automaton()
        vocab = {show(t): i for t, i in ranks.items()}
        self.pieces, self.matches = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.memo: dict[str, bytes | None] = {}
        self.passing: list[str] = []
        self.missed = 0
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_rank = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values(), default=-1) + 1
        self.tokens = [b""] * size
        for t, i in ranks.items():
            self.tokens[i] = t
        #: All printable token strings end to end, where each begins, and the byte of each printable character.
        names = ["".join(self.table[b] for b in t) for t in self.tokens]
        self.length = np.array([len(x) for x in names], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.shown = np.frombuffer("".join(names).encode("utf-16-le"), np.uint16)
        self.byte_at = np.zeros(0x200, np.uint8)
        for c, b in self.reverse.items():
            self.byte_at[ord(c)] = b

    def _learn(self, pieces: list[str]) -> dict[str, bytes | None]:
        """Encodes new pieces in one call; what needs another way is looked for in all of them at once."""
        joined = "".join(pieces)
        data = joined.encode("utf-8", "surrogatepass")
        # Tokens never reach over a piece's end, so bytes passed tell which tokens are whose.
        lead = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
        ends = np.append(lead, len(data))[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]
        ids = np.array(self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        cuts = (4 * np.searchsorted(np.cumsum(self.length[ids]), ends, "right")).tolist()
        flat = ids.tobytes()
        out: dict[str, bytes | None] = {p: flat[a:b] for p, a, b in zip(pieces, [0, *cuts], cuts, strict=False)}
        if self.risky:
            for k in set(np.searchsorted(ends, [end for end, _ in self.finder.iter(data.decode("latin-1"))], "right").tolist()):
                out[pieces[k]] = array("I", self.by_rank.encode_ordinary(pieces[k])).tobytes()
        if odd := {c for c in set(joined) if unicodedata.category(c) == "Cn"}:
            out.update((p, None) for p in pieces if not odd.isdisjoint(p))
        return out

    def known(self, pieces: set[str]) -> dict[str, bytes | None]:
        """Packed ids of each piece (and of others), little-endian; None for one with a code point this Python does not
        know. Good until the next call, which drops what is not kept.
        """
        for p in self.passing:
            del self.memo[p]
        self.passing = []
        if self.missed > 4 * MEMO:
            self.memo, self.missed = {}, 0
        if new := list(pieces.difference(self.memo)):
            self.memo.update(self._learn(new))
            self.missed += len(new)
            self.passing = new if len(self.memo) > MEMO else [p for p in new if len(p) > MEMO_CHARS]
        return self.memo

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers in the machine's order (little-endian is assumed)."""
        cut = [self.pieces(t) for t in texts]
        ids_of, out = self.known(set(chain.from_iterable(cut))).__getitem__, []
        for text, pieces in zip(texts, cut, strict=True):
            try:
                out.append(b"".join(map(ids_of, pieces)))
            except TypeError:
                out.append(array("I", self.by_rank.encode_ordinary(text)).tobytes())
        return out

    def forget(self) -> None:
        """Frees what was learnt from texts; the vocabulary stays."""
        self.memo, self.passing, self.missed = {}, [], 0

    def counts(self, pieces: list[str], known: dict[str, bytes | None] | None = None) -> list[int]:
        """Tokens of each piece alone."""
        known = self.known(set(pieces)) if known is None else known
        try:
            return [n >> 2 for n in map(len, map(known.__getitem__, pieces))]
        except TypeError:
            return [len(self.by_rank.encode_ordinary(p)) if known[p] is None else len(known[p]) >> 2 for p in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [array("I", x).tolist() for x in self.encode_packed(texts)]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point and the one behind the last that each token touches; tokens that split a character share it."""
        lead = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0 != 0x80
        char_of = np.cumsum(lead) - 1
        ends = np.cumsum(self.length[ids])
        return char_of[ends - self.length[ids]], char_of[ends - 1] + 1

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        ids = self.encode([text])[0]
        return ids, list(zip(*(x.tolist() for x in self.offsets(text, np.array(ids, np.int64))), strict=True))

    def decode_bytes(self, ids: list[int] | np.ndarray) -> bytes:
        """Joins the printable token strings and reverses the byte table over them."""
        ids = np.asarray(ids, dtype=np.int64)
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids) or not ends[-1]:
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.begin[ids] - (ends - length), length)
        return self.byte_at[self.shown[at]].tobytes()

    def decode(self, ids: list[int]) -> str:
        """Text of any run of ids; bytes of a character that the run cuts in two become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One codec a worker and vocabulary file; `path` must exist on every worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Codec(ranks, pattern)


def _strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, with_ids: bool = False, with_offsets: bool = False) -> DataFrame:
    """Ids of every text, and their decoding, as one narrow pass without a shuffle.

    Null and empty texts have no tokens; the digests are then those of zero bytes. One row comes out for each row in,
    repeated rows included, and none of an empty table; columns other than id and text are not read. With `with_ids` the ids follow as `token_ids`;
    with `with_offsets`, too, the code points that each token touches, as `token_starts` and `token_ends`, the end behind
    the last one.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = dict(docs.dtypes)[id_column]
    schema = f"{id_column} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids + ", token_starts array<int>, token_ends array<int>" * with_offsets

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        texts = _strings(batch, text_column)
        packed = own.encode_packed(texts)
        ids = [np.frombuffer(x, dtype=np.uint32) for x in packed]
        columns = [
            batch.column(id_column),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
            pa.array([hashlib.sha256(own.decode_bytes(x)).hexdigest() for x in ids], pa.string()),
        ]
        if with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        if with_offsets:
            places = [own.offsets(t, x.astype(np.int64)) for t, x in zip(texts, ids, strict=True)]
            columns += [pa.array([p[k].astype(np.int32) for p in places], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids, *["token_starts", "token_ends"] * with_offsets])

    return map_batches(docs.select(id_column, text_column), each, schema, rows=96, after=lambda: codec(path).forget())


def decode_documents(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text) of token ids, by the reversed byte table; one row for each row in. Ids may be any part of a text's:
    bytes of a character that they cut in two become U+FFFD. Null ids give an empty text, ids that the vocabulary lacks
    are an error.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = dict(encoded.dtypes)[id_column]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        return pa.RecordBatch.from_arrays([batch.column(id_column), pa.array([own.decode(x or []) for x in batch.column(ids_column).to_pylist()], pa.string())], names=[id_column, "text"])

    return map_batches(encoded.select(id_column, ids_column), each, f"{id_column} {kind}, text string", rows=96)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document text and their decoding."""
    return encode_documents(read(spark, sf_dir, "documents"))
