"""Edit-aware token counting: a segment tree over each document's pre-tokens.

Leaves hold runs of pre-tokens with their token counts; inner nodes hold the code points and tokens below. An edit
finds its leaves from the root by code points, cuts the touched region and its boundary context into pre-tokens again
until a new boundary meets an old one, encodes the new pre-tokens only, and updates the sums above.

Why that is enough: the pattern decides a pre-token from its own start onwards, so once a boundary behind the edit is
met again, all that follows is as before; and it looks at most two code points beyond a pre-token's end, or, for white
space, to the end of the run, so three pre-tokens before the edit are cut again as context.

Trees are kept as a table, one row a document: the text, and the code points and tokens of each of its pre-tokens,
packed. Sums follow from these without any encoding, so a stored table can be edited, stored and edited again.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Codec, codec
from .common import Scratch, map_batches, read, settle

LEAF, CONTEXT = 64, 3


def pack(numbers: np.ndarray) -> bytes:
    """Small numbers as one byte each, after a byte that says so."""
    return b"\1" + numbers.astype(np.uint8).tobytes() if not len(numbers) or numbers.max() < 256 else b"\4" + numbers.astype("<u4").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8 if packed[0] == 1 else "<u4", offset=1).astype(np.int64)


class CountTree:
    """One document's pre-tokens and the sums over them. Leaves that no edit has touched are cut out of the text when
    they are asked for.
    """

    def __init__(self, text: str, codec: Codec, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        self.codec, self.encoded = codec, 0
        if chars is None or tokens is None:
            pieces = codec.pieces(text)
            chars, tokens = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(codec.counts(pieces), np.int64)
        self._build(text, chars, tokens)

    def _build(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.source, self.piece_chars, self.piece_tokens = text, chars, tokens
        starts = np.arange(0, max(len(chars), 1), LEAF)
        #: Pre-tokens and their tokens, of leaves that were edited; of the others, where they begin in the source.
        self.leaves: list[tuple[list[str], list[int]] | None] = [None] * len(starts)
        size = 1
        while size < len(starts):
            size *= 2
        self.size = size
        if not len(chars):
            self.begin, self.chars, self.tokens = [0], [0] * (2 * size), [0] * (2 * size)
            return
        sums = [np.add.reduceat(x, starts) for x in (chars, tokens)]
        self.begin = (np.cumsum(sums[0]) - sums[0]).tolist()
        levels = []
        for own in sums:
            level = [np.pad(own, (0, size - len(own)))]
            while len(level[-1]) > 1:
                level.append(level[-1].reshape(-1, 2).sum(axis=1))
            levels.append([0, *np.concatenate(level[::-1]).tolist()])
        self.chars, self.tokens = levels

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf(self, i: int) -> tuple[list[str], list[int]]:
        """Pre-tokens, and how many tokens each has."""
        if (own := self.leaves[i]) is not None:
            return own
        at, pieces = self.begin[i], []
        for n in self.piece_chars[i * LEAF : (i + 1) * LEAF].tolist():
            pieces.append(self.source[at : at + n])
            at += n
        return pieces, self.piece_tokens[i * LEAF : (i + 1) * LEAF].tolist()

    def arrays(self) -> tuple[str, np.ndarray, np.ndarray]:
        """Text, and code points and tokens of each pre-token, for storing."""
        texts, chars, tokens, i = [], [], [], 0
        while i < len(self.leaves):
            if (own := self.leaves[i]) is not None:
                texts += own[0]
                chars.append(np.fromiter(map(len, own[0]), np.int64, len(own[0])))
                tokens.append(np.array(own[1], np.int64))
                i += 1
                continue
            first = i
            while i < len(self.leaves) and self.leaves[i] is None:
                i += 1
            texts.append(self.source[self.begin[first] : self.begin[i] if i < len(self.begin) else len(self.source)])
            chars.append(self.piece_chars[first * LEAF : i * LEAF])
            tokens.append(self.piece_tokens[first * LEAF : i * LEAF])
        return "".join(texts), np.concatenate(chars), np.concatenate(tokens)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return self.arrays()[0]

    def _find(self, offset: int) -> tuple[int, int]:
        """Leaf that holds the code point at an offset, or the last leaf; and the offset of the leaf's start."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if offset >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), before

    def _set(self, i: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[i] = pieces, counts
        node = self.size + i
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), sum(counts)
        while node > 1:
            node //= 2
            self._sum(node)

    def edit(self, start: int, length: int, new: str) -> None:
        """Replaces `length` code points at `start` by `new`; both are clipped to the text."""
        start = min(max(start, 0), self.n_chars)
        end = min(start + max(length, 0), self.n_chars)
        if start == end and not new:
            return
        # Pieces from the context before the edit to the end of the leaf behind it; more leaves join as they are needed.
        first, base = self._find(max(start - 1, 0))
        place = bisect_right(list(accumulate(map(len, self.leaf(first)[0]))), max(start - 1, 0) - base)
        while place < CONTEXT and first > 0:
            first -= 1
            place += len(self.leaf(first)[0])
            base -= self.chars[self.size + first]
        last = max(first, self._find(end)[0])
        held = [self.leaf(i) for i in range(first, last + 1)]
        old, old_counts = (list(chain.from_iterable(leaf[k] for leaf in held)) for k in (0, 1))
        keep = max(0, min(place, len(old)) - CONTEXT)
        at = base + sum(map(len, old[:keep]))
        head, head_counts, old, old_counts = old[:keep], old_counts[:keep], old[keep:], old_counts[keep:]
        text = "".join(old)
        shift = len(new) - (end - start)
        text = text[: start - at] + new + text[end - at :]
        # Old boundaries behind the edit, in new coordinates from `at`.
        edges = {b + shift: i + 1 for i, b in enumerate(accumulate(map(len, old))) if b > end - at}
        fresh: list[str] = []
        done, rest = 0, len(old)
        while done < len(text):
            met = False
            for m in self.codec.matches(text, done):
                # A match that reaches the end of what is here could be longer, or end earlier, with what follows.
                if m.end() >= len(text) - 2 and last + 1 < len(self.leaves):
                    break
                fresh.append(m[0])
                done = m.end()
                if done in edges and done > start - at + len(new):
                    rest, met = edges[done], True
                    break
            if met or done >= len(text):
                break
            if last + 1 >= len(self.leaves):
                break
            last += 1
            more, more_counts = self.leaf(last)
            span = len(text)
            edges.update((span + b, len(old) + i + 1) for i, b in enumerate(accumulate(map(len, more))))
            edges[span] = len(old)
            old += more
            old_counts += more_counts
            rest = len(old)
            text += "".join(more)
        self.encoded += sum(map(len, fresh))
        pieces, counts = head + fresh + old[rest:], head_counts + self.codec.counts(fresh) + old_counts[rest:]
        if len(pieces) > 8 * LEAF * (last - first + 1):
            for k in range(first, last + 1):
                self.leaves[k] = (pieces, counts) if k == first else ([], [])
            self._build(*self.arrays())
            return
        share = -(-len(pieces) // (last - first + 1)) or 1
        for k in range(first, last + 1):
            lo, hi = (k - first) * share, (k - first + 1) * share
            self._set(k, pieces[lo:hi], counts[lo:hi])


_TREE = "n_tokens bigint, piece_chars binary, piece_tokens binary"


def trees(docs: DataFrame, *others: str, vocabulary: str | None = None) -> DataFrame:
    """The tree of every whole text, to be written as a table: doc_id, text, n_tokens, piece_chars and piece_tokens
    (packed), and the `others` among the columns. One row for each row in, repeated rows included, in one narrow pass.
    Null text counts as empty; an empty text has no pre-tokens; an empty table gives none. `others` named like the tree's
    own columns are an error.
    """
    if clash := {c.lower() for c in others} & {"doc_id", "text", "n_tokens", "piece_chars", "piece_tokens"}:
        raise ValueError(f"columns of the tree cannot be carried beside it: {sorted(clash)}")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *others)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        cut = [own.pieces(t) for t in batch.column("text").to_pylist()]
        known = own.known(set(chain.from_iterable(cut)))
        chars = [pack(np.fromiter(map(len, p), np.int64, len(p))) for p in cut]
        tokens = [np.array(own.counts(p, known), np.int64) for p in cut]
        columns = [*batch.columns, pa.array([int(t.sum()) for t in tokens], pa.int64()), pa.array(chars, pa.binary()), pa.array([pack(t) for t in tokens], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_tokens", "piece_chars", "piece_tokens"])

    return map_batches(docs, each, f"{kinds}, {_TREE}", rows=96, after=lambda: codec(path).forget())


def edit_trees(stored: DataFrame, edits: Column, vocabulary: str | None = None, texts: bool = True) -> DataFrame:
    """Applies edits to stored trees: doc_id, n_tokens_before, n_chars, reencoded_chars (code points encoded anew over
    all edits), n_tokens and, with `texts`, the edited text and its tree, which can be stored and edited again.

    `edits` is an array of structs (start, length, text) in code points, applied in turn, each to the text as it then
    is; null edits, and parts beyond the text, do nothing. Rows come out as they come in, none of an empty table, in one narrow pass; only
    touched regions are encoded.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = dict(stored.dtypes)["doc_id"]
    edits = F.transform(edits, lambda e: F.struct(e["start"].cast("long").alias("start"), e["length"].cast("long").alias("length"), e["text"].cast("string").alias("text")))
    names = ["doc_id", "n_tokens_before", "n_chars", "reencoded_chars", "n_tokens", *["text", "piece_chars", "piece_tokens"][: 3 * texts]]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = codec(path), []
        for text, before, chars, tokens, changes in zip(*(batch.column(c).to_pylist() for c in ("text", "n_tokens", "piece_chars", "piece_tokens", "changes")), strict=True):
            tree = CountTree(text, own, unpack(chars), unpack(tokens))
            for e in changes or []:
                if e is not None:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
            row = before, tree.n_chars, tree.encoded, tree.n_tokens
            if texts:
                text, new_chars, new_tokens = tree.arrays()
                row += text, pack(new_chars), pack(new_tokens)
            rows.append(row)
        types = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types[: len(names) - 1]))], names=names)

    schema = f"doc_id {kind}, n_tokens_before bigint, n_chars bigint, reencoded_chars bigint, n_tokens bigint" + ", text string, piece_chars binary, piece_tokens binary" * texts
    return map_batches(stored.select("doc_id", "text", "n_tokens", "piece_chars", "piece_tokens", edits.alias("changes")), each, schema, rows=96, after=lambda: codec(path).forget())


def usual_edits() -> Column:
    """Edits that every document gets in the query: its language put in front, twenty code points removed, and twelve
    replaced by its source, at places that follow from its id and length.
    """
    size = F.greatest(F.length(F.coalesce(F.col("text"), F.lit(""))), F.lit(1))
    place = lambda seed: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), size)
    edit = lambda start, length, text: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.coalesce(text, F.lit("")).alias("text"))
    return F.array(edit(F.lit(0), 0, F.concat(F.col("lang"), F.lit(": "))), edit(place(1), 20, F.lit("")), edit(place(2), 12, F.col("source")))


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after edits, which are applied to stored trees. A later round of edits
    would keep the table of trees; here it goes once the counts are written.
    """
    docs = read(spark, sf_dir, "documents").withColumn("changes", usual_edits())
    with Scratch(spark) as scratch:
        where = f"{scratch.folder}/trees"
        trees(docs, "changes").write.option("compression", "zstd").parquet(where)
        out = edit_trees(spark.read.parquet(where), F.col("changes"), texts=False)
        return settle(out.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.col("n_chars").alias("n_chars_edited"), "reencoded_chars"))
