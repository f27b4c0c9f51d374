"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Nearness is the inner product. Vectors get one more component that makes all of them equally long, after which the
largest inner product is the least distance, so cells and codes serve vectors of any length. Equal vectors are one
entry with their least ids, as many as an answer can hold; so a vector that a third of all rows share costs one entry.

Cells grow with the root of the number of vectors: up to `FLAT` have a centroid of their own, and beyond that each is split
by further centroids that all share, so the sample need not grow. Cells near to each other form a shelf. A query goes to a
shelf once, with the cells it looks into there, and only those are estimated. Entries that may reach what the sample already
offers the query, and a few at least, go on to exact reranking, and the best of the shelf leave the task.

How many cells a query looks into, and how far an estimate may fall short, are measured between some of the query rows and
all rows, since rows that the index was fitted on lie nearer to its centroids and codes than others do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, settle

#: Vectors the index is fitted on at most: those with the least hash of their components.
SAMPLE = 20_000
#: Cells: `PER_ROOT * sqrt(vectors)`, at least `LEAST`. Each query looks into as many as hold this share of the nearest
#: rows of `TRIALS` sample rows within the sample, and at least so many.
PER_ROOT, LEAST, FLAT, WANTED, TRIALS, PROBE_LEAST = 8, 8, 4096, 0.97, 200, 8
#: Query rows measured against all rows, the share of their nearest rows that must lie in cells looked into, and the share
#: whose estimates must be within the margin; together they leave out 5 %.
MEASURED, IN_CELLS, IN_MARGIN = 300, 0.96, 0.99
#: Numbers in the part of the sample that gives a query its first bound.
ANCHORS = 1 << 19
#: Centroids in a shelf, about.
SHELF = 32
#: Sub-vectors and codes each. This share of a cell by estimate holds nearly all of its nearest rows, if vectors have no structure.
PARTS, CODES = 16, 256
RERANK_SHARE = 0.2
#: Entries, and queries, that meet in one task at a time, queries estimated at a time, and pairs of them reranked.
BLOCK, QUERIES, ASKED, RERANKED = 4096, 2048, 256, 16_384
#: Parts that the rows which ask with the same vector are dealt into.
SALTS = 4096


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=k)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
        if (empty := np.flatnonzero(count == 0)).size:
            centres[empty] = x[rng.choice(len(x), size=len(empty))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    """Coarse centroids, the centroids that split them, shelves and residual codebooks; its size is bounded by the sample,
    but for the number of splits, which grows with the root of the number of vectors.
    """

    radius: float
    centres: np.ndarray
    splits: np.ndarray
    shelves: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, radius: float, cells: int) -> Index:
        x = lift(sample, radius)
        centres = k_means(x, min(cells, FLAT, len(x)))
        rest = x - centres[nearest(x, centres)]
        parts = -(-cells // len(centres)) if cells > FLAT else 1
        splits = k_means(rest, min(parts, len(rest)), seed=6) if parts > 1 else np.zeros((1, x.shape[1]))
        shelves = nearest(centres, k_means(centres, -(-len(centres) // SHELF), seed=7))
        rest = pad(rest - splits[nearest(rest, splits)])
        width = rest.shape[1] // PARTS
        books = np.stack([k_means(rest[:, p * width : (p + 1) * width], CODES, rounds=8, seed=p) for p in range(PARTS)])
        return cls(radius, centres, splits, shelves, books)

    @property
    def cells(self) -> int:
        return len(self.centres) * len(self.splits)

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.centres[cell // len(self.splits)] + self.splits[cell % len(self.splits)]

    def shelf(self, cell: np.ndarray) -> np.ndarray:
        return self.shelves[cell // len(self.splits)]

    def cell(self, x: np.ndarray) -> np.ndarray:
        x = lift(x, self.radius)
        first = nearest(x, self.centres)
        return first * len(self.splits) + nearest(x - self.centres[first], self.splits)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = pad(lift(x, self.radius) - self.centre(cell))
        width = self.books.shape[2]
        return np.stack([nearest(rest[:, p * width : (p + 1) * width], self.books[p]) for p in range(PARTS)], axis=1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int, ordered: bool = False) -> np.ndarray:
        """Cells nearest to each query, whose own last component is zero; scaled to the common length."""
        scale = self.radius / np.linalg.norm(q, axis=1, keepdims=True)
        x, n = np.hstack([q * scale, np.zeros((len(q), 1))]), min(n, self.cells)
        half = 0.5 * ((self.centres**2).sum(1)[:, None] + (self.splits**2).sum(1)) + self.centres @ self.splits.T
        out, step = [], max(1, (1 << 22) // self.cells)
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            score = ((part @ self.centres.T)[:, :, None] + (part @ self.splits.T)[:, None, :] - half).reshape(len(part), -1)
            out.append(np.argsort(-score, axis=1)[:, :n] if ordered else np.argpartition(-score, n - 1, axis=1)[:, :n])
        return np.concatenate(out)

    def probes_needed(self, sample: np.ndarray, k: int) -> int:
        """Cells to look into, measured by brute force between some sample rows and the whole sample."""
        q = sample[(np.linalg.norm(sample, axis=1) > 0)][:TRIALS]
        place = np.argsort(self.probes(q, self.cells, ordered=True), axis=1)
        cell, most = self.cell(sample), min(k + 1, len(sample))
        near = np.argpartition(-(q @ sample.T), most - 1, axis=1)[:, :most]
        return max(PROBE_LEAST, int(_quantile(np.take_along_axis(place, cell[near], axis=1), WANTED)) + 1)

    def places(self, q: np.ndarray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """When the query of that row in `q` would look into each of the cells; the first is 0."""
        out = np.zeros(len(row), np.int64)
        for lo in range(0, len(q), step := max(1, (1 << 22) // self.cells)):
            some = np.flatnonzero((row >= lo) & (row < lo + step))
            out[some] = np.argsort(self.probes(q[lo : lo + step], self.cells, ordered=True), axis=1)[row[some] - lo, cell[some]]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[query, part, code]: inner products of queries with what each code stands for."""
        x = pad(np.hstack([q, np.zeros((len(q), 1))]))
        width = self.books.shape[2]
        return np.stack([(x[:, p * width : (p + 1) * width] @ self.books[p].T).astype(np.float32) for p in range(PARTS)], axis=1)

    def estimate_each(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """[query, entry]: as `estimate`, where each query has entries of its own: cells [query, entry] and codes."""
        out = np.einsum("qd,qed->qe", np.hstack([q, np.zeros((len(q), 1))]), self.centre(cell)).astype(np.float32)
        tables, row = self.tables(q), np.arange(len(q))[:, None]
        for p in range(PARTS):
            out += tables[row, p, codes[:, :, p]]
        return out

    def estimate(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """[query, entry]: estimated inner products, where `asked` [query, cell in order] says a query looks; entries are in
        order of their cell. Elsewhere minus infinity.
        """
        tables, out = self.tables(q), np.full((len(q), len(cell)), -np.inf, np.float32)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        near = np.hstack([q, np.zeros((len(q), 1))]) @ self.centre(cell[first]).T
        for j, (a, b) in enumerate(zip(first, [*first[1:], len(cell)], strict=True)):
            rows = np.flatnonzero(asked[:, j])
            if len(rows):
                own = np.repeat(near[rows, j, None].astype(np.float32), b - a, axis=1)
                for p in range(PARTS):
                    own += tables[rows, p][:, codes[a:b, p]]
                out[rows, a:b] = own
        return out


def _quantile(values: np.ndarray, share: float) -> float:
    """The least of the values that so large a share of them does not exceed."""
    return np.sort(values, axis=None)[min(values.size - 1, int(share * values.size))]


def lift(x: np.ndarray, radius: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(radius**2 - (x**2).sum(1), 0))[:, None]])


def pad(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))


def usable(v: Column) -> Column:
    """Not null or empty, all components finite, not all of them zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def measured(placed: DataFrame, index: Index, shared: Broadcast, trials: pd.DataFrame, k: int) -> tuple[int, float]:
    """(cells to look into, margin): measured by brute force between some queries (h, v) and all entries (h, v, cell, codes).
    The margin is how far an estimate falls short of the inner product, for a query of length one. A task sends `k` rows a
    query, so the work grows with the entries alone.
    """
    q, own = _matrix(trials["v"]), trials["h"].to_numpy()
    length = np.linalg.norm(q, axis=1)
    asked = placed.sparkSession.sparkContext.broadcast((q, own))

    def nearest_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (q, own), found = asked.value, None
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.iloc[lo : lo + BLOCK]
                score = q @ _matrix(part["v"]).T
                score[own[:, None] == part["h"].to_numpy()] = -np.inf
                new = [score, np.broadcast_to(part["cell"].to_numpy(), score.shape), np.broadcast_to(np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(-1, PARTS), (*score.shape, PARTS))]
                some = np.argpartition(-score, k - 1, axis=1)[:, :k] if len(part) > k else np.broadcast_to(np.arange(len(part)), score.shape)
                new = [np.take_along_axis(x, some[:, :, None] if x.ndim == 3 else some, axis=1) for x in new]
                both = new if found is None else [np.concatenate(x, axis=1) for x in zip(found, new, strict=True)]
                best = np.argsort(-both[0], axis=1)[:, :k]
                found = [np.take_along_axis(x, best[:, :, None] if x.ndim == 3 else best, axis=1) for x in both]
        if found is not None:
            score, cell, codes = found
            short = score - shared.value.estimate_each(q, cell, codes)
            trial = np.broadcast_to(np.arange(len(q), dtype=np.int32)[:, None], score.shape)
            yield pd.DataFrame({"trial": trial.ravel(), "score": score.ravel(), "cell": cell.ravel(), "short": short.ravel()})

    near = placed.select("h", "v", "cell", "codes").mapInPandas(nearest_of, "trial int, score double, cell long, short double").filter(F.col("score") > F.lit(float("-inf")))
    near = near.withColumn("n", F.row_number().over(W.partitionBy("trial").orderBy(F.desc("score"), "cell", "short"))).filter(F.col("n") <= k).select("trial", "cell", "short").toPandas()
    if not len(near):
        return PROBE_LEAST, float("inf")
    trial = near["trial"].to_numpy()
    place = index.places(q, trial, near["cell"].to_numpy())
    return max(PROBE_LEAST, int(_quantile(place, IN_CELLS)) + 1), float(_quantile(near["short"].to_numpy() / length[trial], IN_MARGIN))


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the `k` nearest other rows found.

    Null, zero and non-finite vectors take no part, nor do rows without an id. Rows with the same id and vector are one; with the
    same id and another vector they stay apart, but none is a neighbour of its own id. Vectors of another length than most share no inner product with
    the rest and are left out. With no vectors there are no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("r")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, radius = sizes[0].d, float(np.sqrt(sizes[0].r))
    rows = rows.filter(F.size("v") == dimension).dropDuplicates(["vec_id", "v"]).withColumn("h", F.xxhash64("v"))

    # One entry for equal vectors, with the k + 1 least ids; thinned by salt first, so that no group is large.
    ids = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (["h", "v", "salt"], ["h", "v"]):
        ids = ids.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    entries = settle(ids.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    sample = _matrix(entries.orderBy("h", "ids").limit(SAMPLE).select("v").toPandas()["v"])
    index = Index.fit(sample, radius, max(LEAST, int(PER_ROOT * np.sqrt(n))))
    shared, anchors = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(sample[: max(k + 1, ANCHORS // dimension)])

    @F.pandas_udf("shelf int, cell long, codes binary")
    def place_of(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"shelf": pd.Series([], dtype=np.int32), "cell": pd.Series([], dtype=np.int64), "codes": pd.Series([], dtype=object)})
        x = _matrix(v)
        cell = shared.value.cell(x)
        return pd.DataFrame({"shelf": shared.value.shelf(cell).astype(np.int32), "cell": cell.astype(np.int64), "codes": [c.tobytes() for c in shared.value.encode(x, cell)]})

    @F.pandas_udf("double")
    def floor_of(v: pd.Series) -> pd.Series:
        """What the least of a query's k + 1 nearest entries reaches at least: the inner product of so many of the sample."""
        held, out = anchors.value, np.full(len(v), -np.inf)
        for lo in range(0, len(v) if len(held) > k else 0, ASKED):
            q = _matrix(v.iloc[lo : lo + ASKED])
            out[lo : lo + ASKED] = -np.partition(-(q @ held.T), k, axis=1)[:, k] - 1e-12 * radius * np.linalg.norm(q, axis=1)
        return pd.Series(out)

    @F.pandas_udf("array<binary>")
    def shelves_of(v: pd.Series) -> pd.Series:
        """For each shelf that a query goes to, its number (four bytes) and the cells it looks into there (eight each)."""
        out = []
        for cells in shared.value.probes(_matrix(v), probes) if len(v) else ():
            shelf = shared.value.shelf(cells)
            order = np.argsort(shelf, kind="stable")
            first = np.flatnonzero(np.diff(shelf[order], prepend=-1))
            out.append([int(shelf[own[0]]).to_bytes(4, "big") + np.sort(cells[own]).astype(np.int64).tobytes() for own in np.split(order, first[1:])])
        return pd.Series(out, dtype=object)

    placed = settle(entries.withColumn("place", place_of("v")).select("h", "v", "ids", "place.shelf", "place.cell", "place.codes"))
    blocks = placed.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).select("shelf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # Equal queries are asked once, for one more than `k`, and each then leaves its own row out.
    # Their answers go to the parts they are dealt into, so that a vector which many rows ask with is no task of its own.
    askers = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("asker"), "h", "v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    parts = askers.groupBy("h", "v", "salt").agg(F.min("asker").alias("least"))
    distinct = settle(parts.groupBy("h", "v").agg(F.min("least").alias("query_id"), F.collect_list("salt").alias("salts")))
    trials = askers.orderBy(F.xxhash64("asker"), "asker", "h").limit(MEASURED).select("h", "v").toPandas()
    probes, margin = measured(placed, index, shared, trials, k) if len(trials) else (PROBE_LEAST, float("inf"))
    probes = max(probes, index.probes_needed(sample, k))
    asked = distinct.select("query_id", F.col("v").alias("q"), floor_of("v").alias("least"), F.explode(shelves_of("v")).alias("pack"))
    asked = asked.withColumn("shelf", F.conv(F.hex(F.substring("pack", 1, 4)), 16, 10).cast("int"))
    crowd = asked.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).select("shelf", F.ceil(F.col("n") / QUERIES).cast("int").alias("crowds"))
    # At most as many rows as there are shelves, FLAT / SHELF.
    grid = F.broadcast(settle(blocks.join(crowd, "shelf")))
    left = placed.join(grid, "shelf").withColumn("block", F.pmod(F.col("h"), F.col("blocks")).cast("int")).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
    right = asked.join(grid, "shelf").withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.col("crowds")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def meet(key: tuple, held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(held) or not len(queries):
            return empty
        held = held.sort_values("cell", kind="stable")
        own, x, q, cell = shared.value, _matrix(held["v"]), _matrix(queries["q"]), held["cell"].to_numpy()
        codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(x), PARTS)
        many = held["ids"].str.len().to_numpy()
        ids, first = np.concatenate(held["ids"].to_list()), np.cumsum(many) - many
        here, packs, asker, least, out = np.unique(cell), queries["pack"].to_list(), queries["query_id"].to_numpy(), queries["least"].to_numpy(), [empty]
        for lo in range(0, len(q), ASKED):
            looks = np.stack([np.isin(here, np.frombuffer(p[4:], np.int64), assume_unique=True) for p in packs[lo : lo + ASKED]])
            near, part, bound = own.estimate(q[lo : lo + ASKED], cell, codes, looks), q[lo : lo + ASKED], least[lo : lo + ASKED]
            slack = margin * np.linalg.norm(part, axis=1)
            # Those that look best go on in any case, so that a query gets its rows even where estimates fall short.
            goes_on, some = near >= (bound - slack)[:, None], np.argpartition(-near, min(k, len(x) - 1), axis=1)[:, : k + 1]
            np.put_along_axis(goes_on, some, True, axis=1)
            i, j = np.nonzero(goes_on & np.isfinite(near))
            score = np.concatenate([np.zeros(0), *((x[j[at : at + RERANKED]] * part[i[at : at + RERANKED]]).sum(axis=1) for at in range(0, len(i), RERANKED))])
            if not len(i):
                continue
            # All that are as near as the last one asked for, since ids decide between them.
            order = np.lexsort((-score, i))
            i, j, score = i[order], j[order], score[order]
            first_of = np.flatnonzero(np.diff(i, prepend=-1))
            size = np.diff(first_of, append=len(i))
            last = np.repeat(score[first_of + np.minimum(size, k + 1) - 1], size)
            i, entry, score = i[score >= last], j[score >= last], score[score >= last]
            each = np.repeat(np.arange(len(entry)), many[entry])
            place = np.arange(len(each)) - np.repeat(np.cumsum(many[entry]) - many[entry], many[entry])
            out.append(pd.DataFrame({"query_id": asker[lo + i[each]], "vec_id": ids[first[entry][each] + place], "score": score[each]}))
        return pd.concat(out)

    by = ["shelf", "block", "crowd"]
    found = left.select(*by, "cell", "v", "ids", "codes").groupBy(*by).cogroup(right.select(*by, "query_id", "q", "least", "pack").groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double")
    nearest_first = [F.desc("score"), F.asc("vec_id")]
    found = found.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(*nearest_first))).filter(F.col("n") <= k + 1)
    named = askers.join(distinct.select("h", "v", "query_id", F.explode("salts").alias("salt")), ["h", "v", "salt"]).select("asker", "query_id", "salt")
    answers = found.drop("n").join(distinct.select("query_id", F.explode("salts").alias("salt")), "query_id")
    each = named.join(answers, ["query_id", "salt"]).filter("asker != vec_id")
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("asker").orderBy(*nearest_first))).filter(F.col("rank") <= k)
    return each.select(F.col("asker").alias("query_id"), "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of every twentieth embedding."""
    return search(read(spark, sf_dir, "embeddings"))
