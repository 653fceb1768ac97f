"""Approximate nearest neighbours by collision counting.

Rows are spread over shards. A shard keeps, for each of ``LINES`` random lines, its vectors in the order of their
projection. A query uses the ``USED`` lines on which its own projection lies farthest out, where few vectors
but many of its neighbours lie near it, and opens on each a window centred on its projection. Windows
widen by virtual rehashing (half-width times ``GROWTH``): they walk outwards over the sorted arrays and
only the vectors that they newly reach are counted. A vector that collides on ``COLLISIONS`` of the lines
exceeds the threshold and is verified by its inner product in double precision. The windows stop when a
vector as near as the k-th verified one would by now have exceeded the threshold with probability ``FOUND``,
whatever the size of the shard: nearer ones are likelier still. To search for the largest inner product, vectors get one more component that brings
them to the largest norm of the table and queries are scaled to it, so that a nearer vector is one of larger
inner product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_per_id

LINES, USED, COLLISIONS, START, GROWTH = 1024, 32, 0.3, 0.6, 1.2
#: Probability with which the search stops late enough for a neighbour.
FOUND = 0.9
SHARD_ROWS = 8192
AT_ONCE = 1 << 19  # counters (queries x vectors of the shard) of one numpy pass


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, to 1e-7 (a rational approximation of the error function)."""
    t = 1 / (1 + 0.3275911 / np.sqrt(2) * np.abs(x))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x / 2) / 2
    return np.where(x < 0, tail, 1 - tail)


def needed_rate(lines: int, threshold: int, found: float) -> float:
    """The collision rate at which ``threshold`` of ``lines`` collide with probability ``found``."""
    lo, hi = 0.0, 1.0
    for _ in range(40):
        p = (lo + hi) / 2
        reached = sum(math.comb(lines, c) * p**c * (1 - p) ** (lines - c) for c in range(threshold, lines + 1))
        lo, hi = (p, hi) if reached < found else (lo, p)
    return hi


class Shard:
    """Sorted projections of one shard's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, seed: int = 7):
        self.ids, self.vectors, self.largest = ids, vectors, largest
        n, dim = vectors.shape
        self.added = np.sqrt(np.maximum(0, 1 - (vectors**2).sum(1) / largest**2))  # the component that makes all norms equal
        full = np.hstack([vectors / largest, self.added[:, None]])
        self.lines = np.random.default_rng(seed).normal(size=(dim + 1, LINES))
        self.mean, self.spread, self.order, projected = np.empty(LINES), np.empty(LINES), np.empty(LINES * n, np.int32), np.empty(LINES * n)
        for j in range(0, LINES, 64):
            p = np.ascontiguousarray(self.lines[:, j : j + 64].T) @ full.T
            at, lines = np.argsort(p, axis=1, kind="stable"), slice(j * n, (j + len(p)) * n)
            self.mean[j : j + 64], self.spread[j : j + 64] = p.mean(1), np.maximum(p.std(1), 1e-9)
            self.order[lines], projected[lines] = at.ravel(), np.take_along_axis(p, at, 1).ravel()
        # all lines are one ascending array: each is moved beyond the one before, and projections can't leave theirs
        self.apart = 4 * float(np.linalg.norm(self.lines, axis=0).max()) + 4
        self.sorted = projected + self.apart * np.repeat(np.arange(LINES), n)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, shards: int = 1):
        """Ids and scores of the verified nearest, best first, of each query; also how many were verified and how many collisions counted.

        The k nearest of a table are dealt over its shards by chance: the windows stop by the nearest that may be among them here, k / shards and three deviations."""
        n = len(self.ids)
        own = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ self.lines[:-1]
        used = np.argsort(-np.abs((own - self.mean) / self.spread), axis=1, kind="stable")[:, :USED]
        centre, spread = np.take_along_axis(own, used, 1) + used * self.apart, self.spread[used]
        lo = np.searchsorted(self.sorted, centre)
        hi = lo.copy()
        count = np.zeros((len(queries), n), np.int16)
        seen = np.zeros((len(queries), n), bool)
        scores, at = [np.zeros(0)] * len(queries), [np.zeros(0, np.int64)] * len(queries)
        left, width, counted = np.arange(len(queries)), START, 0
        threshold = math.ceil(COLLISIONS * USED)
        deep = min(k, math.ceil(k / shards + 3 * math.sqrt(k / shards)))
        rate, longest = needed_rate(USED, threshold, FOUND), self.largest * np.linalg.norm(queries, axis=1)
        while len(left):
            first = used[left] * n
            a = np.clip(np.searchsorted(self.sorted, centre[left] - width * spread[left], "left"), first, lo[left])
            b = np.clip(np.searchsorted(self.sorted, centre[left] + width * spread[left], "right"), hi[left], first + n)
            # places of the sorted arrays that the windows newly reach, left and right
            start, size = np.concatenate([a, hi[left]], axis=1).ravel(), np.concatenate([lo[left] - a, b - hi[left]], axis=1)
            each, size = size.sum(1), size.ravel()
            place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            hit = np.bincount(self.order[place] + np.repeat(np.arange(len(left)) * n, each), minlength=len(left) * n)
            count[left] += hit.reshape(len(left), n).astype(np.int16)
            lo[left], hi[left] = a, b
            counted += len(place)
            new = (count[left] >= threshold) & ~seen[left]
            seen[left] |= new
            kth, added = np.full(len(left), -np.inf), np.zeros(len(left))
            for i in np.flatnonzero(new.any(1)):
                q = left[i]
                more = np.flatnonzero(new[i])
                more = more[self.ids[more] != query_ids[q]]
                at[q], scores[q] = np.concatenate([at[q], more]), np.concatenate([scores[q], (self.vectors[more] * queries[q]).sum(1)])
            for i, q in enumerate(left):
                if len(scores[q]) >= deep:
                    last = np.argpartition(scores[q], -deep)[-deep]
                    kth[i], added[i] = scores[q][last], self.added[at[q][last]]
            # a vector's place on a line: its cosine times the query's place, its added component's part, and a normal deviation for the rest
            cosine, added = np.clip(kth / longest[left], -1, 1)[:, None], added[:, None]
            moved = (cosine - 1) * np.take_along_axis(own[left], used[left], 1) + added * self.lines[-1][used[left]]
            rest, half = np.sqrt(np.maximum(1 - cosine**2 - added**2, 1e-12)), width * spread[left]
            reached = (normal_cdf((half - moved) / rest) - normal_cdf((-half - moved) / rest)).mean(1)
            done = (np.isfinite(kth) & (reached >= rate)) | (hi[left] - lo[left] == n).all(1)
            left, width = left[~done], width * GROWTH
        best = [np.lexsort((self.ids[x], -y))[:k] for x, y in zip(at, scores, strict=True)]
        return [(self.ids[x][b], y[b]) for x, y, b in zip(at, scores, best, strict=True)], sum(map(len, at)), counted


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a finite, non-zero vector, in double. Shorter vectors than the longest count as zero beyond their end."""
    v = F.col(vector).cast("array<double>")
    rows = one_per_id(df.select(F.col(key).cast("long").alias("id"), v.alias("v")), "id")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return rows


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest found rows for each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (inner product in double). Every row is indexed, in shards of about ``SHARD_ROWS``
    rows, and every query is searched in every shard. Null, empty, zero and non-finite vectors and null ids take no part; the inner
    product of vectors of different length is that of the shared components; of repeated ids one row stays; ties go to the smaller id;
    fewer than ``k`` candidates are all returned; an empty table gives no rows; extra columns are ignored."""
    rows = usable(df, key, vector)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    stats = rows.agg(F.count("*").alias("n"), F.max(norm).alias("largest"), F.max(F.size("v")).alias("dim")).collect()[0]
    largest, dim = stats["largest"] or 1.0, stats["dim"] or 1
    shards = max(1, -(-stats["n"] // SHARD_ROWS))
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
    data = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    both = data.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    among = int(shards)

    def run(batches):
        # data rows of a shard come first, then its queries in batches
        current, index, ids, vectors = None, None, [], []
        for batch in batches:
            shard, kind, qid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v = batch.column(3)
            flat = v.flatten().to_numpy(zero_copy_only=False)
            if len(qid) == 0:
                continue
            mat = flat.reshape(len(qid), -1)
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(qid)], strict=True):
                if shard[a] != current:
                    current, index, ids, vectors = shard[a], None, [], []
                if kind[a] == 0:
                    ids.append(qid[a:b])
                    vectors.append(mat[a:b])
                    continue
                if index is None:
                    if not ids:
                        continue
                    index = Shard(np.concatenate(ids), np.concatenate(vectors), largest)
                step = max(1, AT_ONCE // len(index.ids))
                for s in range(a, b, step):
                    e = min(b, s + step)
                    found, _, _ = index.search(qid[s:e], mat[s:e], k, among)
                    size = np.cumsum([0] + [len(x[0]) for x in found]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qid[s:e]), pa.array(np.full(e - s, current, np.int32)),
                         pa.ListArray.from_arrays(size, pa.array(np.concatenate([x[0] for x in found]))), pa.ListArray.from_arrays(size, pa.array(np.concatenate([x[1] for x in found])))],
                        names=["query_id", "shard", "ids", "scores"],
                    )

    found = both.mapInArrow(run, "query_id long, shard int, ids array<long>, scores array<double>")
    best = found.select("query_id", "shard", F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("neg"), i.alias("vec_id"))).alias("best"))
    while True:  # merge the shards' lists, at most 64 at a time
        shards = -(-shards // 64)
        merged = F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        best = best.groupBy("query_id", F.floor(F.col("shard") / 64).cast("int").alias("shard")).agg(merged)
        if shards <= 1:
            break
    out = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.neg")).alias("score"))
