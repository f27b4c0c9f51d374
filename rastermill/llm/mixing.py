"""Mixing sources to target weights by hash thresholds; documents are not sorted.

Every document gets a 60-bit hash of its id. A source's budget is a threshold on that hash: documents below it are in.
Words are summed by source and the hash's leading bits; the bucket where the budget runs out is the only one that is
looked into further, hash by hash. Sets for smaller budgets are subsets of those for larger ones, since the hash is the
same. Histograms are summed up within each task before they are moved, so a source with a third of all rows moves no
more than any other one, and rows meet their source's plan where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, read, settle

#: Leading bits of the hash in the first histogram, and the rest, by which its boundary bucket is split.
LEADING, REST = 12, 48
ABOVE = (1 << 63) - 1
#: Thresholds found one after another, each among the documents that still fit.
PASSES = 3
#: Up to so many sources are sent to all executors, and ranked in one task; more are joined by a shuffle and ranked by
#: ranges.
SMALL = 20_000


def word_count(text: Column) -> Column:
    """Words of a text, null as none; each becomes one letter, so no list of words is held."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), " \t\n\u000b\f\r", "")).cast("long")


def hashed(doc_id: Column) -> Column:
    """The leading 60 bits of a digest of the id, which other engines have, too."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _before(rows: DataFrame, order: list[Column], large: bool, sums: dict[str, Column]) -> DataFrame:
    """Adds to each row, under each name, the sum of a column over all rows that come before it. Many rows are dealt by
    ranges of the order; then only one sum a range meets those of the others.
    """
    dealt = rows.repartitionByRange(*order) if large else rows.coalesce(1)
    dealt = settle(dealt.withColumn("part", F.spark_partition_id()))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    parts = parts.select(F.col("part").alias("of_part"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_earlier") for n in sums])
    out = dealt.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    out = out.join(F.broadcast(parts), F.col("part") == F.col("of_part"))
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"{n}_earlier")).alias(n) for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """One row a source: its words, and its share of all words by weight, at most `most` times its words.

    Sources rank by code point with null last and weigh as listed, repeating. What a full source cannot take goes to
    the others by weight until none is above. Filling sources in order of `most * size / weight` finds the level at
    which that ends.
    """
    by = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    large = by.count() > SMALL
    by = _before(by, [F.col("source").asc_nulls_last()], large, {"rank": F.lit(1)})
    limit = (F.col("source_size") * F.lit(most)).cast("double")
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    by = by.withColumns({"limit": limit, "fill": limit / F.col("weight")})
    by = _before(by, [F.col("fill"), F.col("source").asc_nulls_last()], large, {"limits": F.col("limit"), "weights": F.col("weight")})
    whole = by.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    by = by.withColumn("level", (F.lit(whole.size) - F.col("limits")) / (F.lit(whole.weight) - F.col("weights")))
    first = by.filter("level <= fill").agg(F.min(F.struct("fill", "level")).alias("m")).first().m
    target = F.col("limit") if first is None else F.least(F.col("limit"), F.lit(first.level) * F.col("weight"))
    return by.select("source", "source_size", target.alias("target"))


def _near(sizes: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """Rows with their source's plan, which goes to them where it is small."""
    plan = plan.withColumnRenamed("source", "of")
    return sizes.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("of")))


def _first_over(bins: DataFrame, at: str) -> DataFrame:
    """By source, from sums by `at`: all words, and the first place where the sum so far exceeds `rest`: the place, the
    sum before it, and the words there.
    """
    upto = F.sum("words").over(W.partitionBy("source").orderBy(at).rowsBetween(W.unboundedPreceding, 0))
    over = F.when(F.col("upto") > F.col("rest"), F.struct(at, (F.col("upto") - F.col("words")).alias("before"), "words"))
    return bins.withColumn("upto", upto).groupBy(F.col("source").alias("of")).agg(F.sum("words").alias("total"), F.min(over).alias("m"))


def _with(plan: DataFrame, found: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return plan.join(found, F.col("source").eqNullSafe(F.col("of")), "left").select(*[c for c in plan.columns if c not in columns], *[c.alias(n) for n, c in columns.items()])


def cut(sizes: DataFrame, plan: DataFrame, k: int, small: bool) -> DataFrame:
    """`plan` (source, rest, and thresholds t, l of the `k` passes before) with those of one more pass: documents with a
    hash below `t` are the most that fit into `rest`; `l` remains, less than the `i` words at the threshold itself.
    Only documents count that no pass before has taken and that fit into what it left. Where all of them fit, the
    threshold is above every hash.
    """
    open_ = F.lit(True)
    for j in range(k):
        open_ = open_ & (F.col("hash") >= F.col(f"t{j}")) & (F.col("size") <= F.col(f"l{j}"))
    rows = _near(sizes, plan, small).filter(open_)
    lead = F.shiftright("hash", REST)
    bins = rows.groupBy("source", "rest", lead.alias("bin")).agg(F.sum("size").alias("words"))
    fits = F.col("rest") - F.coalesce("total", F.lit(0))
    plan = settle(_with(plan, _first_over(bins, "bin"), {"bin": F.col("m.bin"), "rest": F.when(F.col("m").isNull(), fits).otherwise(F.col("rest") - F.col("m.before"))}))
    inside = _near(sizes, plan, small).filter(open_ & (lead == F.col("bin")))
    hashes = inside.groupBy("source", "rest", "hash").agg(F.sum("size").alias("words"))
    left = F.when(F.col("m").isNull(), F.col("rest")).otherwise(F.col("rest") - F.col("m.before"))
    return settle(_with(plan.drop("bin"), _first_over(hashes, "hash"), {f"t{k}": F.coalesce("m.hash", F.lit(ABOVE)), f"i{k}": F.coalesce("m.words", F.lit(0)), f"l{k}": left, "rest": left}))


def thresholds(sizes: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """For each source: whole copies of every document, and what decides on one more.

    Documents below `t0` are in. The one at `t0` did not fit; of those from there on that do (size up to `l0`), the
    ones below `t1` are in, and so once more with `l1` and `t2`. So a long document at a threshold does not leave its
    source far from the target. At `t2` itself the nearer side decides (`nearer`).
    Where to go over at `t0` and stop there comes nearer than all that, `over` says so.
    """
    some = F.col("source_size") > 0
    plan = targets.withColumn("copies", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("rest", F.when(some, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(F.lit(0.0)))
    for k in range(PASSES):
        plan = cut(sizes, plan, k, small)
    i, l = F.col(f"i{PASSES - 1}"), F.col(f"l{PASSES - 1}")
    plan = plan.withColumn("nearer", (i > 0) & (l * 2 >= i))
    off = F.when(F.col("nearer"), i - l).otherwise(l)
    plan = plan.withColumn("over", (F.col("i0") > 0) & (F.col("i0") - F.col("l0") < off))
    return plan.select(F.col("source").alias("of"), "source_size", "target", "copies", *[f"t{k}" for k in range(PASSES)], *[f"l{k}" for k in range(PASSES - 1)], "nearer", "over")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("hash"))


def _plan(sizes: DataFrame) -> DataFrame:
    targets = settle(source_targets(sizes))
    small = targets.count() <= SMALL
    plan = thresholds(sizes, targets, small)
    return F.broadcast(plan) if small else plan


def _copies(size: Column, hash: Column, at: Callable[[str], Column]) -> Column:
    """How often a document is taken; `at` gives a column of its source's plan."""
    fits, more = F.lit(True), F.lit(False)
    for k in range(PASSES):
        more = more | (fits & (hash < at(f"t{k}")))
        fits = fits & (hash >= at(f"t{k}")) & (size <= at(f"l{k}")) if k + 1 < PASSES else fits & (hash == at(f"t{k}")) & at("nearer")
    one_more = F.when(at("over"), hash <= at("t0")).otherwise(more | fits)
    return at("copies") + F.coalesce(one_more, F.lit(False)).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """Each row's part in the mix: doc_id, size, source_size, target, taken.

    Null text has size 0 and null is a source of its own. Rows with the same doc_id share a hash and are taken or left
    together. Empty tables give no rows; columns other than doc_id, source and text are not read. Reruns agree, as
    only ids, sources and sizes decide.
    """
    sizes = settle(_sized(docs))
    out = sizes.join(_plan(sizes), F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("size"), F.col("hash"), F.col)).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns, whatever their names. Text is
    not shuffled. Null and empty texts have no words and count for nothing; they are taken as their hash says. Repeated
    rows are taken alike; an empty table gives none.
    """
    sizes = settle(_sized(docs))
    plan = _plan(sizes)
    names = {c: fresh(docs, f"mix_{c}") for c in (*plan.columns, "hash", "size", "times", "one")}
    plan = plan.select(*[F.col(c).alias(names[c]) for c in plan.columns])
    full = docs.withColumns({names["hash"]: hashed(F.col("doc_id")), names["size"]: word_count(F.col("text"))})
    full = full.join(plan, F.col("source").cast("string").eqNullSafe(F.col(names["of"])), "left")
    full = full.withColumn(names["times"], _copies(F.col(names["size"]), F.col(names["hash"]), lambda c: F.col(names[c]))).filter(F.col(names["times"]) > 0)
    return full.withColumn(names["one"], F.explode(F.sequence(F.lit(1), F.col(names["times"])))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(read(spark, sf_dir, "documents"))
