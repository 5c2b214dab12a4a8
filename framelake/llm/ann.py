"""Approximate nearest neighbours on shifted Hilbert curves (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import checkpointed, least_hashed, lookup, tiles

#: The sample that curves and key ranges are fitted on: the vectors with the smallest hashes, so many at most and of so many bytes at most.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Curves; vectors in a key range at least; the recall that the number of ranges is chosen for, and the vectors of the sample that it is measured with.
CURVES, RANGE_ROWS, RECALL, ASKED = 16, 900, 0.93, 400


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2**bits (Skilling's transform)."""
    x = points.T.astype(np.int64).copy()
    m = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(m):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, m):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        t ^= np.where((x[m - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Several Hilbert orderings, each of its own random projection to a few dimensions, and shifted at random.

    sample: vectors that the projections are fitted on. Directions are drawn as the vectors themselves spread (random ones times the root of their
    covariance), and each axis is centred and scaled by theirs.
    """

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = 10, bits: int = 4, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        dims = min(dims, x.shape[1])
        size, axes = np.linalg.eigh(np.atleast_2d(np.cov(x.T, bias=True)))
        root = axes * np.sqrt(np.maximum(size, size.max() * 1e-6 + 1e-30))
        self.bits = bits
        self.planes = [np.linalg.qr(root @ rng.normal(size=(x.shape[1], dims)))[0] for _ in range(curves)]
        self.shifts = rng.uniform(0, 1, (curves, dims))
        placed = [x @ p for p in self.planes]
        self.centres = [y.mean(axis=0) for y in placed]
        self.widths = [np.where(y.std(axis=0) > 1e-9, y.std(axis=0), 1.0) for y in placed]

    def keys(self, vectors: np.ndarray, curves: int | None = None) -> np.ndarray:
        """A row for each curve, or for the first ones."""
        v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        top = 2**self.bits - 1
        parts = list(zip(self.planes, self.centres, self.widths, self.shifts, strict=True))[:curves]
        return np.array([hilbert_keys(np.clip((((v @ p - m) / w + 3) / 6 * top + s).astype(np.int64), 0, top), self.bits) for p, m, w, s in parts])


def fitted_bounds(keys: np.ndarray, sample: np.ndarray, most: int, k: int, recall: float = RECALL) -> np.ndarray:
    """Ends of key ranges, a row for each of the first curves: as few curves and as many ranges (`most` at most) as keep the recall, measured
    within the sample; the pair of these that meets the fewest vectors.

    A fraction of all vectors that finds the neighbours within a sample finds those among more vectors too, as these are nearer. So where vectors
    have clusters, ranges get narrower as the table grows; where they have none, no narrow range will do, and ranges stay wide.
    """
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    near = x[:ASKED] @ x.T
    near[np.arange(len(near)), np.arange(len(near))] = -2
    near = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    tried = [keys[:, :0]]
    found = [np.ones(len(keys))]  # recall of the first curves, for each number of ranges
    ranges = 1
    while ranges < most and found[-1][-1] >= recall:
        ranges = min(most, max(ranges + 1, ranges * 5 // 4))
        at = np.arange(1, ranges) / ranges
        tried.append(np.array([np.quantile(key, at, method="nearest") for key in keys]))
        cells = np.array([np.searchsorted(b, key, side="right") for b, key in zip(tried[-1], keys, strict=True)])
        met = np.abs(cells[:, : len(near), None] - cells[:, near]) <= 1
        found.append(np.logical_or.accumulate(met, axis=0).mean(axis=(1, 2)))
    pairs = [(c * min(1.0, 3 / (b.shape[1] + 1)), c, b) for b, r in zip(tried, found, strict=True) for c in range(1, len(keys) + 1) if r[c - 1] >= recall]
    _, c, b = min(pairs, key=lambda p: (p[0], p[1], -p[2].shape[1]))
    return b[:c]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, curves: int = CURVES, dims: int = 10, bits: int = 4, size: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest by cosine of each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Every curve orders all vectors; its order is cut into ranges of equal size at quantiles of a sample's keys (fitted_bounds()). A query meets all
    vectors of its own range and the two beside it on each curve (windows that merge and are reranked): in tiles of about `size` rows, so no range,
    however full, is one task, and each tile sends its best on. The best of all curves get their score anew, one sum in double
    precision in the order of the components. Nothing is capped.
    Equal vectors are one point with their k + 1 smallest ids, which is all that any answer can need; so copies cost nothing.
    Vectors null, zero, of another length than most, or with null or non-finite components take no part, nor do null ids; repeated rows
    count once, two vectors with one id are two candidates and two queries' answers in one list; ties go to smaller ids. Fewer
    candidates give fewer rows; an empty table gives none.
    """
    v = F.col("_v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("_v")).filter("vec_id IS NOT NULL AND _v IS NOT NULL")
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("_v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("_v") == lengths["n"])
    few = F.dense_rank().over(Window.partitionBy("_v").orderBy("vec_id"))
    points = rows.withColumn("_at", few).filter(F.col("_at") <= k + 1).groupBy("_v").agg(F.array_sort(F.collect_set("vec_id")).alias("_ids"))
    points = checkpointed(points.withColumns({"node": F.monotonically_increasing_id(), "least": F.col("_ids")[0]}))
    asked = checkpointed(rows.filter(F.col("vec_id") % every == 0).distinct())
    often = points.select("_v", "node").join(asked.groupBy("_v").agg(F.count("*").alias("_n")), "_v")
    often = checkpointed(often)
    queries = asked.count()
    asked = checkpointed(lookup(asked, often, "_v", "_n", queries).select(F.col("vec_id").alias("query_id"), "node"))
    sent = np.float32 if points.schema["_v"].dataType.elementType.typeName() == "float" else np.float64
    total = points.count()
    sample = _matrix(least_hashed(points.select("_v"), "_v", max(2, min(SAMPLE, SAMPLE_BYTES // (8 * lengths["n"])))).toPandas()["_v"])
    curve = Curves(sample, curves, dims, bits)
    bounds = fitted_bounds(curve.keys(sample), sample, total // RANGE_ROWS, k) if total >= 2 * RANGE_ROWS else np.zeros((1, 0))
    ranges = bounds.shape[1] + 1

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["_v"])
            keys = curve.keys(x, len(bounds))
            cells = np.array([np.searchsorted(bound, key, side="right") + c * (ranges + 2) + 1 for c, (bound, key) in enumerate(zip(bounds, keys, strict=True))])
            yield pd.DataFrame({"tag": b["node"], "least": b["least"], "v": [r.tobytes() for r in x.astype(sent)], "cells": list(cells.T)})

    dealt = checkpointed(points.select("node", "least", "_v").mapInPandas(deal, "tag long, least long, v binary, cells array<long>"))
    ask = dealt.join(asked.select(F.col("node").alias("tag")).distinct(), "tag", "left_semi")
    beside = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("_c") + d)
    residents = dealt.select(F.explode("cells").alias("cell"), "tag", "least", "v")
    probes = ask.select(F.explode("cells").alias("_c"), "tag", "least", "v").select(F.explode(beside).alias("cell"), "tag", "least", "v")
    keep = k + 6

    def compare(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        a = np.frombuffer(b"".join(own["v"]), sent).astype(np.float64).reshape(len(own), -1)
        b = np.frombuffer(b"".join(other["v"]), sent).astype(np.float64).reshape(len(other), -1)
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "c": [], "s": []}, dtype=np.int64)
        order = np.argsort(own["least"].to_numpy(np.int64), kind="stable")
        a = a[order] / np.linalg.norm(a[order], axis=1, keepdims=True)
        b = b / np.linalg.norm(b, axis=1, keepdims=True)
        tag, asks, out = own["tag"].to_numpy(np.int64)[order], other["tag"].to_numpy(np.int64), []
        for i in range(0, len(b), 256):
            s = np.round(b[i : i + 256] @ a.T, 13)
            best = np.argsort(-s, axis=1, kind="stable")[:, :keep] if s.shape[1] <= 64 else _best(s, keep)
            out.append((np.repeat(asks[i : i + 256], best.shape[1]), tag[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
        q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"q": q, "c": c, "s": s})

    near = tiles(residents, probes, size, compare, "q long, c long, s double")
    near = near.groupBy("q", "c").agg(F.max("s").alias("s")).join(points.select(F.col("node").alias("c"), "least"), "c")
    near = near.withColumn("_at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "least"))).filter(F.col("_at") <= keep)
    near = checkpointed(near.select("q", "c"))
    near = near.join(points.select(F.col("node").alias("c"), F.col("_v").alias("_b"), "_ids"), "c").join(points.select(F.col("node").alias("q"), F.col("_v").alias("_a")), "q")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda m, n: m.cast("double") * n.cast("double")), F.lit(0.0), lambda m, n: m + n)
    score = dot("_a", "_b") / (F.sqrt(dot("_a", "_a")) * F.sqrt(dot("_b", "_b")))
    lists = near.select("q", F.struct(score.alias("score"), "_ids").alias("_x")).groupBy(F.col("q").alias("node")).agg(F.collect_list("_x").alias("_l"))
    lists = checkpointed(lists.join(often.select("node", "_n"), "node"))
    got = lookup(asked, lists, "node", "_n", queries).select("query_id", F.explode("_l").alias("_x"))
    got = got.select("query_id", F.col("_x.score").alias("score"), F.explode("_x._ids").alias("vec_id")).filter("vec_id <> query_id")
    got = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return got.select("query_id", "rank", "vec_id", "score")


def _best(s: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the `keep` largest of each row, ties to smaller columns."""
    cut = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]
    out = np.empty((len(s), keep), np.int64)
    for r, row in enumerate(s >= cut):
        at = np.flatnonzero(row)
        out[r] = at[np.argsort(-s[r, at], kind="stable")][:keep]
    return out
