"""Merkle manifest of a dataset: one tree a language over its documents, one over the languages' roots.

Every parent keeps its preimage, the concatenated digests of its children. A leaf's way up is the list of its ancestors'
preimages and of its own slot in each: what is left of a preimage without the slot are the siblings that a proof needs,
and a preimage with another digest in the slot is what a changed document folds up to.

Leaves are put in order by ranges of (language, id), so that a language with a third of all rows is many tasks. Parents
hold at most `FAN` children, and the ways are handed down level by level: a level has an eighth of the rows of the one
below it, so what is moved is dominated by the lowest one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, read, settle

#: Children of a parent, at most.
FAN = 8
#: Trees whose sizes and places go to every executor, at most (about 40 bytes each); more are joined by a shuffle.
SMALL_TREES = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def record_digest(*fields: Column) -> Column:
    """Digest of one record: each field as its count of UTF-8 bytes, a colon and its value, or `-` if it is null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _parents(nodes: DataFrame, *members: str) -> DataFrame:
    """(tree, idx, n, preimage, digest) one level up from (tree, idx, n, digest); n is the number of a tree's nodes at
    the node's level. With names of columns, the children's are kept with them in `members`, and a tree of one node is
    its own parent, without a preimage.
    """
    child = F.struct("idx", "digest", *members)
    up = (nodes if members else nodes.filter("n > 1")).groupBy("tree", F.expr(f"idx div {FAN}").alias("idx"), "n").agg(F.sort_array(F.collect_list(child)).alias("members"))
    digests = F.col("members.digest")
    up = up.withColumn("preimage", F.when(F.col("n") > 1, F.array_join(digests, "")))
    return up.select("tree", "idx", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "preimage", F.coalesce(F.sha2("preimage", 256), digests[0]).alias("digest"), *(["members"] if members else []))


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _ways(levels: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level's nodes, each with `way`, the (preimage, slot) of its ancestors, nearest first, and what `above`
    (tree, way, ...) has for its tree. Trees may differ in height.
    """
    more = [c for c in above.columns if c not in ("tree", "way")]
    up = None
    for level in reversed(levels):
        found = level.filter("n = 1").join(above, "tree")
        if up is not None:
            step = F.array(F.struct(F.col("up_preimage").alias("preimage"), (F.col("idx") % FAN).cast("int").alias("slot")))
            higher = up.select("tree", F.col("idx").alias("up_idx"), F.col("preimage").alias("up_preimage"), F.col("way").alias("up_way"), *more)
            inner = level.filter("n > 1").withColumn("up_idx", F.expr(f"idx div {FAN}")).join(higher, ["tree", "up_idx"])
            found = found.unionByName(inner.withColumn("way", F.concat(step, "up_way")).select(found.columns))
        up = found
    return up


_WAY = "array<struct<preimage: string, slot: int>>"
#: A preimage without the slot, and one with another digest in it.
_SIBLINGS = "array_join(transform(way, x -> concat(substring(x.preimage, 1, 64 * x.slot), substring(x.preimage, 64 * x.slot + 65))), '')"
_FOLDED = "aggregate(way, {0}, (digest, x) -> sha2(concat(substring(x.preimage, 1, 64 * x.slot), digest, substring(x.preimage, 64 * x.slot + 65)), 256))"


class Manifest:
    """The trees over records (lang, doc_id, digest, ...), kept in `scratch`.

    Leaves of a language ascend by doc_id (null first), then by digest. Rows that agree in both keep a place each.
    Without rows there is no root.
    """

    def __init__(self, scratch: Scratch, records: DataFrame):
        carried = [c for c in records.columns if c not in ("lang", "digest")]
        tied = scratch.keep(records.withColumn("tie_", F.monotonically_increasing_id()))
        placed = numbered(scratch, tied, F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.col("digest"), F.col("tie_"))
        groups = scratch.keep(placed.groupBy("lang").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
        size = groups.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("n")).first()
        self.trees, self.root = size.trees, None
        trees = numbered(scratch, groups, F.col("first")).select(F.col("lang").alias("of"), "first", "n", F.col("place").alias("tree"))
        side = F.broadcast(trees) if self.trees <= SMALL_TREES else trees
        leaves = placed.join(side, F.col("lang").eqNullSafe(F.col("of"))).select("tree", (F.col("place") - F.col("first")).alias("idx"), "n", "digest", *carried)
        #: Parents by level, the lowest first; the lowest keep their leaves.
        self.levels = [scratch.keep(_parents(leaves, *carried))]
        for _ in range(_height(size.n or 0) - 1):
            self.levels.append(scratch.keep(_parents(self.levels[-1])))
        ends = [level.filter("n = 1").select("tree", F.col("digest").alias("subroot")) for level in self.levels]
        for end in ends[1:]:
            ends[0] = ends[0].unionByName(end)
        #: The languages' roots (tree, subroot).
        self.subroots = scratch.keep(ends[0])
        if not self.trees:
            return
        nodes = self.subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("idx"), F.lit(self.trees).alias("n"), F.col("subroot").alias("digest"), F.col("subroot"))
        tops = [scratch.keep(_parents(nodes, "subroot"))]
        for _ in range(_height(self.trees) - 1):
            tops.append(scratch.keep(_parents(tops[-1])))
        self.root = tops[-1].first().digest
        start = tops[-1].select("tree", F.array().cast(_WAY).alias("way"))
        self.above = scratch.keep(_children(_ways(tops, start)).select(F.col("idx").alias("tree"), "way", F.col("subroot")))

    def proofs(self) -> DataFrame:
        """Every leaf with what it was built from, its `way`, subroot and the root."""
        if not self.trees:
            return _children(self.levels[0].withColumns({"way": F.array().cast(_WAY), "subroot": F.lit("")})).withColumn("root", F.lit(None).cast("string"))
        return _children(_ways(self.levels, self.above)).withColumn("root", F.lit(self.root))


def _children(nodes: DataFrame) -> DataFrame:
    """The nodes' members, with their own step before the node's way."""
    rest = [c for c in nodes.columns if c not in ("tree", "idx", "n", "preimage", "digest", "members", "way")]
    out = nodes.select(*[F.col(c).alias(f"node_{c}") for c in rest], "preimage", F.col("way").alias("node_way"), F.explode("members").alias("m")).select("*", "m.*")
    step = F.when(F.col("preimage").isNotNull(), F.array(F.struct("preimage", (F.col("idx") % FAN).cast("int").alias("slot")))).otherwise(F.array().cast(_WAY))
    kept = [c for c in out.columns if c not in ("m", "preimage", "node_way") and not c.startswith("node_")]
    return out.select(*kept, F.concat(step, F.col("node_way")).alias("way"), *[F.col(f"node_{c}").alias(c) for c in rest if c not in kept])


def manifest_of(scratch: Scratch, docs: DataFrame, changed: dict[str, Column] | None = None) -> Manifest:
    """Manifest of documents. With `changed`, other versions of fields, records carry `other`, the digest they would have
    with these.

    Rows count one by one: repeated rows are leaves of their own. Null in any field is a value of its own, a null language
    a tree of its own, before the others. Texts are read whole. Columns beyond the five of documents are not read.
    """
    columns = {c: F.col(c) for c in FIELDS}
    records = docs.select("doc_id", "lang", record_digest(*columns.values()).alias("digest"), record_digest(*(columns | (changed or {})).values()).alias("other"))
    return Manifest(scratch, records)


def audit(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row: its way is folded up from the
    changed record (the original one where nothing is changed) and held against the root. An empty table gives none.
    """
    with Scratch(docs.sparkSession) as scratch:
        proofs = manifest_of(scratch, docs, changed).proofs()
        folded = F.expr(_FOLDED.format("other"))
        out = proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.expr(_SIBLINGS), 256).alias("proof_sha256"), folded.alias("folded_root"))
        return settle(out.withColumn("verified", F.col("folded_root") == F.col("root")))


def tampered() -> dict[str, Column]:
    """The contract's changes: texts without capitals, for a third of the ids; rows without an id stay."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return {"text": F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))}


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what its tampered version folds up to."""
    return audit(read(spark, sf_dir, "documents"), tampered())
