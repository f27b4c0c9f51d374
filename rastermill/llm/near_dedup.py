"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

Similarity is the weighted Jaccard of the multisets of five-word windows. Its unbiased signature: every window of
weight w owns Poisson processes over time, one for each dyadic interval [0,1), [1,2), [2,4), ... of the weight axis; a
point has a time, a component and a level, and counts when its level lies below w. A component's value is its earliest
counting point, so two texts agree there with the probability of their similarity. Points are made in order of time
and only while they can still be the earliest of some component, which is what makes it quick.

Texts with the same words are one node. Nodes that share a band of the signature are candidates. A bucket is not
expanded into pairs: a leader is compared with the members that are not in its component yet, then leaves the bucket.
Leaders are the nodes with the most links so far, and their number grows fourfold each round and then eightfold, so a
bucket of one group is done in a round or two.

What is left after two rounds are mostly texts that share a common passage and are not similar. Their windows are of
three kinds: those that one component alone holds, common ones, in more than `COMMON` of the texts left, and shared
ones. A text of weight n can be similar to one of another component only where common and shared windows make up 4n/5.
With common weight c, a similar text then shares at least k = 4n/5 - c of its shared windows; so, in an order that is
the same for all texts, one of the first ones, up to a rest below k, is among those of the other text, too (prefix
filter). Texts are therefore looked for in groups with such a window, of which none is large; only texts whose common
windows alone make up 4n/5 stay in their old buckets. No pair is lost by this, whatever the sizes of texts and groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_batches, mix64, read, settle, text_bytes, window_hashes, word_hashes

WIDTH, SIMILAR = 5, 0.8
#: A pair at 0.8 shares one of 20 bands of 5 components with a probability of 0.9996; one at 0.3 with 0.05.
BANDS, ROWS = 20, 5

#: Texts that a window is in at most, if it is not a common one.
COMMON = 32
#: Kinds of windows go to all executors as two bitmaps of up to 2 ** `SLOT_BITS` hash slots (8 MB each), with at least
#: `SLOTS_EACH` slots a window; for more windows, kinds are joined to them by a shuffle.
SLOT_BITS, SLOTS_EACH = 26, 8

_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of a text in order of hash, and how often each occurs."""
    return np.unique(window_hashes(word_hashes(text_bytes(text)), WIDTH), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets; of two empty ones, 1."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0]).clip(max=max(len(b[0]) - 1, 0))
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(0, bool)
    both = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 1.0


def signature(keys: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Earliest counting point of each component."""
    out = np.full(size, np.inf)
    # One process for each dyadic interval of levels that begins below the weight.
    state, low, width, weight = [mix64(keys)], [np.zeros(len(keys), np.int64)], [np.ones(len(keys), np.int64)], [weights]
    at = 1
    while (own := weights > at).any():
        state.append(mix64(keys[own] ^ np.full(int(own.sum()), at, np.uint64) * _OTHER))
        low.append(np.full(int(own.sum()), at))
        width.append(np.full(int(own.sum()), at))
        weight.append(weights[own])
        at *= 2
    state, low, width, weight = map(np.concatenate, (state, low, width, weight))
    time = np.zeros(len(state))
    count = np.zeros(len(state), np.uint64)
    while len(state):
        some = max(1, min(512, 3 * size // len(state)))
        draw = mix64(state[:, None] + (count[:, None] + np.arange(1, some + 1, dtype=np.uint64)) * _STEP)
        gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (size * width[:, None])
        times = np.add.accumulate(np.concatenate([time[:, None], gaps], axis=1), axis=1)[:, 1:]
        second = mix64(draw ^ _OTHER)
        component = ((second >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        level = low[:, None] + ((second & np.uint64(0xFFFFFFFF)).astype(np.int64) * width[:, None] >> 32)
        counts = level < weight[:, None]
        np.minimum.at(out, component[counts], times[counts])
        time, count = times[:, -1], count + np.uint64(some)
        on = time < out.max()
        state, low, width, weight, time, count = (x[on] for x in (state, low, width, weight, time, count))
    return out


def bands(text_bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One 64-bit key a band, or none for a text without words."""
    if not len(text_bag[0]):
        return np.zeros(0, np.int64)
    rows = signature(*text_bag).view(np.uint64).reshape(BANDS, ROWS)
    key = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
    for k in range(ROWS):
        key = mix64(key * _OTHER + rows[:, k])
    return key.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, `words` (a digest of its words in order), windows, and band keys; a narrow pass."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, windows, keys, known = [], [], [], {}
        for text in batch.column("text").to_pylist():
            words = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
            name = hashlib.blake2b(words, digest_size=16).hexdigest()
            if name not in known:
                b = bag(text)
                known[name] = int(b[1].sum()), bands(b)
            node.append(name)
            windows.append(known[name][0])
            keys.append(known[name][1])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(node, pa.string()), pa.array(windows, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "words", "windows", "bands"])

    return map_batches(rows, each, f"doc_id {kind}, text_hash bigint, words string, windows bigint, bands array<bigint>", rows=512)


def _stored(texts: DataFrame) -> DataFrame:
    """(node, keys, counts): bags as bytes, so that a text is cut into windows once; no counts where all are one."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = [bag(t) for t in batch.column("text").to_pylist()]
        counts = [b"" if not len(n) or n.max() == 1 else n.astype(np.int32).tobytes() for _, n in bags]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([k.tobytes() for k, _ in bags], pa.binary()), pa.array(counts, pa.binary())], names=["node", "keys", "counts"])

    return map_batches(texts.select("node", "text"), each, "node bigint, keys binary, counts binary")


def _bag_of(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(keys, np.uint64)
    return own, np.frombuffer(counts, np.int32).astype(np.int64) if counts else np.ones(len(own), np.int64)


def _overlaps(pairs: DataFrame) -> DataFrame:
    """(a, b) and the bags of both to (a, b) of those similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("keys_a", "counts_a", "keys_b", "counts_b")]
            hit = []
            for row in zip(*columns, strict=True):
                ka, ca, kb, cb = (x.as_py() for x in row)
                hit.append(similarity(_bag_of(ka, ca), _bag_of(kb, cb)) >= SIMILAR)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.select("a", "b", "keys_a", "counts_a", "keys_b", "counts_b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the least node reachable over (a, b) links. Labels spread to neighbours and are then followed to
    their own label, so long chains shrink by halves; every step is a table of its own.
    """
    both = scratch.keep(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select(F.col("b"), F.col("a"))))
    label = scratch.keep(both.groupBy("node").agg(F.min("to").alias("comp")).select("node", F.least("node", "comp").alias("comp")))
    while True:
        near = both.join(label.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("comp").alias("near"))
        lower = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        follow = label.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        lower = scratch.keep(lower.join(follow, "comp", "left").select("node", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        label = lower.select("node", "comp")
        if lower.filter(F.col("was") != F.col("comp")).isEmpty():
            return label


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(keys ^ _OTHER) >> np.uint64(64 - bits)).astype(np.int64)


def _kinds(rows: DataFrame, key: str) -> DataFrame:
    """(key, often) of windows or slots that more than one component holds, from (key, n, low, high) rows."""
    sums = rows.groupBy(key).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    often = F.col("n") > COMMON
    return sums.filter((F.col("low") != F.col("high")) | often).select(key, often.alias("often"))


def slot_marks(left: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the slots of common and of shared windows. Texts are counted by slot, so a window's kind may come out
    as a more frequent one, which costs time but loses nothing. Slots are summed within a batch before they are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                own = [np.unique(_slots(np.frombuffer(k, np.uint64), bits)) for k in part.column("keys").to_pylist()]
                comp = np.repeat(part.column("comp").to_numpy(), [len(x) for x in own])
                slot, back, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
                low, high = np.full(len(slot), np.iinfo(np.int64).max), np.full(len(slot), -1)
                np.minimum.at(low, back, comp)
                np.maximum.at(high, back, comp)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot + 1, n, low, high)], names=["slot", "n", "low", "high"])

    kinds = _kinds(left.select("keys", "comp").mapInArrow(run, "slot bigint, n bigint, low bigint, high bigint"), "slot")
    at = F.bitmap_bit_position("slot")
    maps = kinds.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(*[F.bitmap_construct_agg(F.when(F.col("often") == kind, at)).alias(name) for name, kind in (("often", True), ("shared", False))])
    marks = np.zeros((2, max(1, (1 << bits) >> 15), 1 << 12), np.uint8)
    for row in maps.collect():
        marks[0, row.k - 1], marks[1, row.k - 1] = (np.frombuffer(bytes(x), np.uint8) for x in (row.often, row.shared))
    return marks[0].ravel(), marks[1].ravel()


def _listed(size: int, common: int, keys: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
    """Of a text's shared windows, those it is looked for by; None if no text of another component can be similar."""
    need, have = -(-4 * size // 5) - common, int(weight.sum())
    if have < need:
        return None
    order = np.argsort(mix64(keys ^ _STEP))
    if need >= 1:
        upto = np.cumsum(weight[order])
        order = order[upto - weight[order] <= have - need]
    return mix64(keys[order] * _OTHER + _STEP).view(np.int64)


_LISTED = "node bigint, windows bigint, comp bigint, common bigint, listed array<bigint>"


def _listed_rows(batch: pa.RecordBatch, common: list[int], shared: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    found = [_listed(n, c, *own) for n, c, own in zip(batch.column("windows").to_pylist(), common, shared, strict=True)]
    some = pa.array([x is not None for x in found], pa.bool_())
    columns = [batch.column(c) for c in ("node", "windows", "comp")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(common, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "windows", "comp", "common", "listed"]).filter(some)


def listed_by_marks(left: DataFrame, bits: int) -> DataFrame:
    """(node, windows, comp, common, listed) of the texts that may be similar to one of another component."""
    shared = left.sparkSession.sparkContext.broadcast(slot_marks(left, bits))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        common, own = [], []
        for keys, weight in map(_bag_of, batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            slot = _slots(keys, bits)
            often, some = ((m[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1 for m in shared.value)
            common.append(int(weight[often].sum()))
            own.append((keys[some], weight[some]))
        return _listed_rows(batch, common, own)

    return map_batches(left.select("node", "windows", "comp", "keys", "counts"), each, _LISTED)


def listed_by_join(left: DataFrame) -> DataFrame:
    """The same with every window as a row, for tables whose windows are too many for bitmaps."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, comp, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("node", "comp", "keys", "counts")), strict=True):
                own, weight = _bag_of(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(np.full(len(own), comp)), pa.array(own.view(np.int64)), pa.array(weight)], names=["node", "comp", "key", "weight"])

    windows = left.select("node", "comp", "keys", "counts").mapInArrow(rows, "node bigint, comp bigint, key bigint, weight bigint")
    kinds = _kinds(windows.select("key", F.lit(1).alias("n"), F.col("comp").alias("low"), F.col("comp").alias("high")), "key")
    of_text = windows.join(kinds, "key").groupBy("node").agg(F.sum(F.when(F.col("often"), F.col("weight"))).alias("common"), F.collect_list(F.when(~F.col("often"), F.struct("key", "weight"))).alias("own"))
    full = left.select("node", "windows", "comp").join(of_text, "node", "left").select("node", "windows", "comp", F.coalesce("common", F.lit(0)).alias("common"), F.col("own.key").alias("keys"), F.col("own.weight").alias("weights"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [(np.array(k or [], np.int64).view(np.uint64), np.array(w or [], np.int64)) for k, w in zip(batch.column("keys").to_pylist(), batch.column("weights").to_pylist(), strict=True)]
        return _listed_rows(batch, batch.column("common").to_pylist(), own)

    return map_batches(full, each, _LISTED)


def _by_shared_windows(members: DataFrame, bags: DataFrame, scratch: Scratch) -> DataFrame:
    """New buckets for what is left: by shared window, and the old ones with the texts that common windows could join."""
    left = scratch.keep(bags.join(members.select("node", "windows", "comp").distinct(), "node"))
    bits = max(int(left.agg(F.sum("windows")).first()[0] * SLOTS_EACH).bit_length(), 16)
    listed = scratch.keep(listed_by_marks(left, bits) if bits <= SLOT_BITS else listed_by_join(left))
    alone = listed.filter(5 * F.col("common") >= 4 * F.col("windows")).select("node", F.col("common").alias("own"))
    old = members.join(alone, "node").select("bucket", "node", "windows", "comp", "degree", F.col("own").alias("common"))
    by_window = listed.select("node", "windows", "comp", F.explode("listed").alias("bucket"))
    many = by_window.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("bucket")
    new = by_window.join(many, "bucket").select("bucket", "node", "windows", "comp", F.lit(0).cast("long").alias("degree"), F.lit(None).cast("long").alias("common"))
    return scratch.keep(old.unionByName(new))


def _could_join() -> Column:
    """Weights allow similarity, and in buckets by common windows these could suffice."""
    sizes = (5 * F.col("windows") >= 4 * F.col("size")) & (5 * F.col("size") >= 4 * F.col("windows"))
    enough = 9 * F.least("common", "leader_common") >= 4 * (F.col("windows") + F.col("size"))
    return sizes & (F.col("common").isNull() | enough)


def similar_components(nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, comp) of the nodes that similar candidates join; None if none are joined.

    `nodes`: node, doc_id, text_hash, windows, bands; one row a node, the document being one that has its words.
    """
    rows = nodes.select("node", "windows", F.explode("bands").alias("bucket"))
    many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = scratch.keep(rows.join(many, "bucket").select("bucket", "node", "windows", F.col("node").alias("comp"), F.lit(0).cast("long").alias("degree"), F.lit(None).cast("long").alias("common")))
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node")
    mine = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bags = scratch.keep(_stored(mine.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select("node", "text").dropDuplicates(["node"])))

    comp, tested, leaders, turn = None, [], 1, 0
    while True:
        alive = members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("bucket")
        state = scratch.keep(members.join(alive, "bucket"))
        if state.isEmpty():
            return comp
        if turn == 2:
            members, turn = _by_shared_windows(state, bags, scratch), 3
            continue
        part = F.pmod(F.xxhash64("node"), F.lit(leaders))
        lead = state.groupBy("bucket", part.alias("part")).agg(F.min(F.struct((-F.col("degree")).alias("d"), "node", "windows", "comp", "common")).alias("l"))
        lead = scratch.keep(lead.select("bucket", F.col("l.node").alias("leader"), F.col("l.windows").alias("size"), F.col("l.comp").alias("from"), F.col("l.common").alias("leader_common")))
        pairs = state.join(lead, "bucket").filter((F.col("comp") != F.col("from")) & _could_join())
        pairs = pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        if tested:
            seen = reduce(DataFrame.unionByName, tested)
            pairs = pairs.join(seen.unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        tested.append(pairs)
        rest = state.join(lead.select("bucket", F.col("leader").alias("node")), ["bucket", "node"], "left_anti")
        if not pairs.isEmpty():
            side = lambda c: bags.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}"), F.col("counts").alias(f"counts_{c}"))
            met = pairs.join(side("b"), "b").join(side("a"), "a")
            found = scratch.keep(_overlaps(met))
            if not found.isEmpty():
                comp, step = _joined(comp, found, scratch)
                moved = step.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
                degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("more"))
                rest = rest.join(moved, "comp", "left").join(degree, "node", "left").select("bucket", "node", "windows", F.coalesce("to", "comp").alias("comp"), (F.col("degree") + F.coalesce("more", F.lit(0).cast("long"))).alias("degree"), "common")
        members = scratch.keep(rest.select("bucket", "node", "windows", "comp", "degree", "common"))
        leaders *= 4 if turn < 3 else 8
        turn += 1


def _joined(comp: DataFrame | None, found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Components with new links: (node, comp) for all nodes, and (node, comp) for the components that these links
    connect. A component keeps the name of its least node.
    """
    if comp is None:
        step = components(found, scratch)
        return step, step
    of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).filter("a != b").distinct()
    step = components(between, scratch)
    moved = step.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = comp.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return scratch.keep(old.unionByName(step.join(comp.select("node"), "node", "left_anti"))), step


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row in: doc_id, class_id (least doc_id of its class), class_size (rows in it), kept.

    A class is what similarity of 0.8 or more connects, whole chains included. Texts with the same words are similar,
    so all texts without words, null ones too, are one class; a text of fewer than five words is a single window.
    `kept` marks the row that stands for its class; of fully repeated rows all are marked. An empty table gives none.
    Columns other than doc_id and text are not read.
    """
    out, _ = _classes(docs)
    return out.select("doc_id", "class_id", "class_size", "kept")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, class_id, class_size, kept) by row, and the (doc_id, text_hash) of repeated rows."""
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.keep(sign(docs))
        nodes = signed.groupBy("words").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count(F.lit(1)).alias("rows"), F.first("windows").alias("windows"), F.first("bands").alias("bands"))
        # Once written, a node's number stays.
        nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "words", "rows", "least.doc_id", "least.text_hash", "windows", "bands"))
        comp = similar_components(nodes, docs, scratch)
        of = nodes.select("node", "words", "rows", "doc_id", "text_hash")
        of = of.withColumn("comp", F.col("node")) if comp is None else of.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        of = scratch.keep(of.select("words", "rows", "doc_id", "text_hash", "comp"))
        # Classes are summed up over nodes, not rows, and then meet the rows by their words.
        sums = of.groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.sum("rows").alias("class_size"))
        sums = scratch.keep(sums.select("comp", F.col("least.doc_id").alias("class_id"), F.col("least.text_hash").alias("class_hash"), "class_size"))
        by_words = scratch.keep(of.select("words", "comp").join(sums, "comp").select(F.col("words").alias("own"), "class_id", "class_hash", "class_size"))
        out = signed.select("doc_id", "text_hash", "words").join(by_words, F.col("words") == F.col("own"))
        out = settle(out.select("doc_id", "text_hash", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))).alias("kept")))
        twice = settle(out.filter("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "text_hash"))
    return out, twice


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stand for their classes, with all their columns; of repeated rows, one stays.

    Null and empty texts and texts of blanks alone are one class; an empty table gives none. Columns may have any name.
    """
    out, twice = _classes(docs)
    names = {c: fresh(docs, f"dedup_{c}") for c in ("id", "hash", "text_hash")}
    keys = lambda t: t.select(F.col("doc_id").alias(names["id"]), F.col("text_hash").alias(names["hash"]))
    full = docs.withColumn(names["text_hash"], F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(names["id"])) & (F.col(names["text_hash"]) == F.col(names["hash"]))
    kept = full.join(keys(out.filter("kept")), same, "left_semi")
    if not twice.isEmpty():
        # Repeats are thinned within each task before any is moved.
        again = kept.join(keys(twice), same, "left_semi").dropDuplicates(["doc_id", names["text_hash"]])
        kept = kept.join(keys(twice), same, "left_anti").unionByName(again)
    return kept.select(*docs.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
