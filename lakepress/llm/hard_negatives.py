"""Hard negatives of anchors from inverted lists with radii (operator 11).

k-means cuts the vectors into lists; each list stores its centroid and its radius, so by Cauchy-Schwarz no vector of it
scores above a.c + |a| r against an anchor a, nor below a.c - |a| r. An anchor has windows: one without ends for its
positives, then one for the negatives of each positive. It visits the lists by falling upper bound, skips those that
lie outside of all its windows, and stops where the bound is strictly below the k-th score so far (an equal score may
still have a smaller id). The visits go in two waves, each a join of anchors with lists: the first takes the lists of
the highest bounds, the second all that the k-th scores of the first leave. Results are exact whatever the clusters;
they only save work. Of vectors without any clusters the second wave visits nearly all lists.

Centroids are fitted on a sample (SAMPLE rows by the hash of the id); every row is indexed. Lists are joined in bundles of about
BUNDLE rows, larger lists dealt over salts, and anchors in tiles of about TILE, so no key grows with the corpus. The
driver holds the sample and a row for each list (CLUSTERS at most), tasks a bundle and a tile.

Defined results: rows with a null id, label or vector, or with a component that is null, not finite or not finite when
scaled, take no part. A shorter vector is filled up with zeros. A vec_id names one row: of rows that repeat it the least by label and vector stands.
Equal scores are ordered by id. A label met once has no positives, and a negative positive score leaves an
empty window; such pairs give no rows. Scores are exact integers at any size of components, but end at those of 64 bits. Other columns
are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows that centroids are fitted on, lists at most, rounds of the fit.
SAMPLE, CLUSTERS, ROUNDS = 8192, 256, 8
#: Rows of a bundle of lists, anchors of a tile, anchors scored at a time.
BUNDLE, TILE, CHUNK = 4096, 4096, 128
#: The first wave visits one list in so many.
FIRST = 16
#: Scores and ids end at those of 64 bits.
LEAST, MOST = -(2**63), 2**63 - 1
#: Positives of an anchor, negatives of a pair, and the window of negatives in hundredths of the positive score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90

FOUND = "anchor_id long, slot int, vec_id long, score long"


def unpack(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b: by floats while these are exact, else by whole numbers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        d = (centroids * centroids).sum(1)[None, :] - 2 * (x @ centroids.T)
    return np.nan_to_num(d, nan=np.inf).argmin(1)


def fit(sample: np.ndarray, k: int) -> np.ndarray:
    """k centroids at most by Lloyd's rounds, from distinct rows of the sample at even distances of their order."""
    rows = np.unique(sample, axis=0)
    centroids = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(ROUNDS):
        at = nearest(sample, centroids)
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        with np.errstate(all="ignore"):
            np.add.at(sums, at, sample)
            moved = sums / np.maximum(n, 1)[:, None]
        keep = (n > 0) & np.isfinite(moved).all(1)
        centroids[keep] = moved[keep]
    return centroids


def quantised(vectors: DataFrame, dim: int, factor: int) -> DataFrame:
    """(vec_id, label, vec): components floor(factor * x) as packed doubles, filled up to dim."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.zeros((len(n), dim))
            x[np.arange(dim)[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                x = np.floor(x * factor)
            fine = np.isfinite(x).all(1)
            vec = pa.array([r.tobytes() for r in x[fine]], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fine)), b.column(1).filter(pa.array(fine)), vec], ["vec_id", "label", "vec"])

    return vectors.mapInArrow(pack, "vec_id long, label long, vec binary")


class Lists:
    """The inverted lists of a table (vec_id, label, vec): stored rows with cluster, bundle and salt, and what is known of each list."""

    def __init__(self, rows: DataFrame, dim: int):
        n = rows.count()
        order = F.xxhash64("vec_id")
        few = rows.where(F.pmod(order, F.lit(max(1, n // (4 * SAMPLE)))) == 0).orderBy(order, "vec_id").limit(SAMPLE)
        sample = [bytes(r.vec) for r in few.select("vec").collect()]
        sample = np.frombuffer(b"".join(sample), np.float64).reshape(len(sample), dim)
        self.n_rows, self.centroids = n, fit(sample, min(CLUSTERS, int(math.sqrt(n)) + 1)) if len(sample) else np.zeros((0, dim))
        centroids = self.centroids

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = unpack(f["vec"])
                    at = nearest(x, centroids)
                    with np.errstate(all="ignore"):
                        far = np.sqrt(((x - centroids[at]) ** 2).sum(1))
                    yield f.assign(cluster=at.astype(np.int32), far=np.nan_to_num(far, nan=np.inf))

        put = shared.materialize(rows.mapInPandas(assign, "vec_id long, label long, vec binary, cluster int, far double"), "lists")
        known = {r.cluster: (r.radius, r.n) for r in put.groupBy("cluster").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}
        self.radii = np.array([known.get(c, (0.0, 0))[0] for c in range(len(centroids))])
        self.sizes = np.array([known.get(c, (0.0, 0))[1] for c in range(len(centroids))], dtype=np.int64)
        # small lists share a bundle, large ones are dealt over salts
        self.bundle, self.salts, held = np.zeros(len(centroids), np.int64), [1], 0
        for c, m in enumerate(self.sizes.tolist()):
            if held and held + m > BUNDLE:
                self.salts.append(1)
                held = 0
            held += m
            self.bundle[c] = len(self.salts) - 1
            self.salts[-1] = max(1, math.ceil(held / BUNDLE))
        bundle = F.element_at(F.array(*[F.lit(int(b)) for b in self.bundle]), F.col("cluster") + 1) if len(centroids) else F.lit(0)
        salts = F.element_at(F.array(*[F.lit(s) for s in self.salts]), bundle + 1)
        self.rows = put.select("vec_id", "label", "vec", "cluster", bundle.alias("bundle"), F.pmod(F.xxhash64("vec_id", F.lit("salt")), salts).cast("int").alias("salt"))

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of anchors against lists, widened by what floats may lose."""
        with np.errstate(all="ignore"):
            mid, norm = a @ self.centroids.T, np.sqrt((a * a).sum(1))[:, None]
            reach = norm * self.radii[None, :] + 1e-9 * norm * (self.radii + np.sqrt((self.centroids**2).sum(1)))[None, :] + 1e-3
            low, high = mid - reach, mid + reach
        return np.nan_to_num(low, nan=-np.inf), np.nan_to_num(high, nan=np.inf)

    def known(self) -> Known:
        return Known(self.centroids, self.radii, self.sizes, self.bundle, self.salts)


class Known:
    """What tasks need of the lists; it has no Spark table in it."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray, sizes: np.ndarray, bundle: np.ndarray, salts: list[int]):
        self.centroids, self.radii, self.sizes, self.bundle, self.salts = centroids, radii, sizes, bundle, salts

    bounds = Lists.bounds

    def visits(self, f: pd.DataFrame, wave: int) -> np.ndarray:
        """Anchors by lists: which are visited in this wave. f: vec, low, high, least (arrays by window)."""
        lower, upper = self.bounds(unpack(f["vec"]))
        first_n = max(4, -(-len(self.sizes) // FIRST))
        out = np.zeros(lower.shape, bool)
        for i, (low, high, least) in enumerate(zip(f["low"], f["high"], f["least"], strict=True)):
            low, high, least = (np.array(x, np.float64)[:, None] for x in (low, high, least))
            inside = ((upper[i] >= low) & (lower[i] <= high) & (self.sizes > 0)).any(0)
            by_bound = np.flatnonzero(inside)[np.argsort(-upper[i][inside], kind="stable")]
            first = by_bound[:first_n]
            if wave == 0:
                out[i, first] = True
            else:
                rest = by_bound[first_n:]
                meets = (upper[i][rest] >= low) & (lower[i][rest] <= high) & (upper[i][rest] >= least)
                out[i, rest[meets.any(0)]] = True
        return out


def pick(found: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k fitting scores; equal ones by the smaller id."""
    at = np.flatnonzero(fits)
    if len(at) > k:
        least = np.partition(found[at], len(at) - k)[len(at) - k]
        at = at[found[at] >= least]
    return at[np.lexsort((ids[at], -found[at]))[:k]]


def wave(anchors: DataFrame, lists: Lists, n: int, k: int, same: bool) -> DataFrame:
    """The first k of each bundle that an anchor visits in the n-th wave, for each of its windows."""
    known, tiles = lists.known(), F.lit(0)
    n_tiles = max(1, math.ceil(anchors.count() / TILE))
    if n_tiles > 1:
        tiles = F.pmod(F.xxhash64("anchor_id", F.lit("tile")), F.lit(n_tiles)).cast("int")

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f) or not len(known.sizes):
                continue
            visited = known.visits(f, n)
            for b, salts in enumerate(known.salts):
                here = np.flatnonzero(known.bundle == b)
                some = visited[:, here].any(1)
                if some.any():
                    part = f[some].assign(bundle=np.int32(b), visited=[here[v].tolist() for v in visited[some][:, here]])
                    for s in range(salts):
                        yield part.assign(salt=np.int32(s))

    cols = "anchor_id long, label long, vec binary, low array<long>, high array<long>, least array<long>, tile int"
    left = anchors.withColumn("tile", tiles).mapInPandas(send, f"{cols}, bundle int, visited array<int>, salt int")
    right = lists.rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    key = ["bundle", "salt", "tile"]

    def score(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(x):
            x = x.sort_values("vec_id")
            ids, labels, cluster, vectors = x["vec_id"].to_numpy(), x["label"].to_numpy(), x["cluster"].to_numpy(), unpack(x["vec"])
            for start in range(0, len(a), CHUNK):
                c = a.iloc[start : start + CHUNK]
                found = scores(unpack(c["vec"]), vectors)
                for i, r in enumerate(c.itertuples(index=False)):
                    meets = np.isin(cluster, r.visited) & (ids != r.anchor_id) & ((labels == r.label) == same)
                    for slot, (low, high, least) in enumerate(zip(r.low, r.high, r.least, strict=True)):
                        at = pick(found[i], ids, meets & (found[i] >= max(low, least)) & (found[i] <= high), k)
                        if len(at):
                            out.append(pd.DataFrame({"anchor_id": r.anchor_id, "slot": np.int32(slot), "vec_id": ids[at], "score": found[i][at]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "slot": [], "vec_id": [], "score": []}).astype({"anchor_id": "int64", "slot": "int32", "vec_id": "int64", "score": "int64"})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(score, FOUND)


def first_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, lists: Lists, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, score, rank): the first k of each window; anchors: anchor_id, label, vec, low, high (arrays by window)."""
    anchors = anchors.withColumn("least", F.transform("low", lambda _: F.lit(LEAST)))
    near = shared.materialize(first_k(wave(anchors, lists, 0, k, same), k), "near")
    kth = near.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
    bound = F.transform("least", lambda v, i: F.coalesce(F.col("kth")[i], v))
    rest = shared.materialize(anchors.join(kth, "anchor_id", "left").withColumn("least", bound).drop("kth"), "anchors")
    return shared.materialize(first_k(near.drop("rank").unionByName(wave(rest, lists, 1, k, same)), k), "found")


def hard_negatives(vectors: DataFrame, label: Column, anchor: Column, vector: str = "embedding", factor: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the module's text.

    vectors: vec_id and the vector; label: the class of a row; anchor: whether a row is an anchor, by vec_id.
    """
    shared.prepare(vectors.sparkSession)
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    x = x.where(~F.coalesce(F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False)))
    dim = max(1, x.agg(F.max(F.size("v"))).first()[0] or 0)
    rows = quantised(x, dim, factor).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.*")
    lists = Lists(shared.materialize(rows, "vectors"), dim)
    anchors = lists.rows.where(anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vec")
    whole = lambda end: F.array(F.lit(end))
    positives = search(anchors.withColumn("low", whole(LEAST)).withColumn("high", whole(MOST)), lists, POSITIVES, True)
    positives = positives.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda of: F.col("p.positive_score").cast("decimal(20,0)") * F.lit(of).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    windows = positives.alias("p").select("anchor_id", F.struct("place", F.ceil(share(LOW)).cast("long").alias("low"), F.floor(share(HIGH)).cast("long").alias("high")).alias("w"))
    windows = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list("w")).alias("w")).select("anchor_id", "w.low", "w.high")  # five at most
    negatives = search(anchors.join(windows, "anchor_id"), lists, NEGATIVES, False)
    out = negatives.join(positives, (negatives.anchor_id == positives.anchor_id) & (negatives.slot + 1 == positives.place)).drop(positives.anchor_id)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
