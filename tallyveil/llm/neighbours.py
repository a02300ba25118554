"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts by recursive bisection; a small softmax classifier learns
in which parts a vector's neighbours lie. Every row is indexed under its most probable part. A query goes to its most
probable parts, and is scored against every row of them exactly, in double precision.

A part's rows and queries are dealt in blocks of bounded size, so that a part holding a third of all rows is many tasks.
Queries whose parts hold fewer rows than are asked for are scored against all parts, so that none gets fewer than there are.
The number of parts grows with the rows up to MAX_PARTS, beyond which the rows scored for a query grow with the table: the
sample bounds how many parts can be learned.
The model is fitted on at most SAMPLE vectors (smallest hashes of their ids); only the model and the parts' counts are on
the driver.

Defined cases: vectors that are null, zero, of another length than most of the sample, or hold null or non-finite parts
take no part, nor do rows without id; rows with one id are candidates each, but never for a query of that id; ties go to
the smaller id; a table with no valid vectors gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyveil.llm.shared import stored

SAMPLE = 12_000
NEIGHBOURS = 20
#: Rows a part aims at, and the most parts.
PART_ROWS, MAX_PARTS = 600, 512
#: The fewest bisections tried, and the rows that merging one part's answers counts as, when the number of parts is chosen.
FEWEST_LEVELS, MERGE_COST = 4, 1000
#: The recall that the number of visited parts is chosen for, on sample vectors that the model has not seen.
TARGET_RECALL, HELD_OUT = 0.95, 1000
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
QUERY_EVERY = 20


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("embedding"))


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The k rows of largest inner product for each row, itself left out; in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(near: np.ndarray, depth: int, seed: int = 0) -> np.ndarray:
    """Each node's part of 2**depth, equal in size up to one node a level: bisection along a smoothed random vector,
    which power iteration turns towards the graph's slowest mixing direction."""
    rng, part = np.random.default_rng(seed), np.zeros(len(near), np.int64)
    for _ in range(depth):
        new = part.copy()
        for p in range(int(part.max()) + 1):
            own = np.flatnonzero(part == p)
            place = np.full(len(near), -1)
            place[own] = np.arange(len(own))
            links = place[near[own]]
            inside = links >= 0
            degree = np.maximum(1, inside.sum(1))
            y = rng.standard_normal(len(own))
            for _ in range(40):
                pulled = np.where(inside, y[links], 0).sum(1)
                back = np.zeros(len(own))
                np.add.at(back, links[inside], np.repeat(y, inside.sum(1)))
                y = y + (pulled + back) / (2 * degree)
                y -= y.mean()
                y /= np.linalg.norm(y) or 1
            order = np.argsort(y, kind="stable")
            new[own] = 2 * p
            new[own[order[len(own) // 2 :]]] = 2 * p + 1
        part = new
    return part


@dataclass(frozen=True)
class Router:
    """A softmax classifier over parts."""

    weights: np.ndarray
    bias: np.ndarray
    visited: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, near: np.ndarray, steps: int = 150) -> Router:
        n_parts = int(part.max()) + 1
        target = np.zeros((len(x), n_parts))
        for k in range(near.shape[1]):
            np.add.at(target, (np.arange(len(x)), part[near[:, k]]), 1.0)
        target[np.arange(len(x)), part] += 1
        target /= target.sum(1, keepdims=True)
        w, b = np.zeros((x.shape[1], n_parts)), np.zeros(n_parts)
        m = [np.zeros_like(w), np.zeros_like(b)]
        v = [np.zeros_like(w), np.zeros_like(b)]
        for t in range(1, steps + 1):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            gap = (p / p.sum(1, keepdims=True) - target) / len(x)
            for k, (at, g) in enumerate(((w, x.T @ gap), (b, gap.sum(0)))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                at -= 0.3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
        return cls(w, b)

    def ranked(self, x: np.ndarray, most: int) -> np.ndarray:
        """The `most` likeliest parts of each row; equal rows get equal parts."""
        z = np.stack([r @ self.weights for r in x]) + self.bias if len(x) else np.zeros((0, len(self.bias)))
        return np.argsort(-z, axis=1, kind="stable")[:, :most]


def fit(vectors: DataFrame, n_rows: int, sample: int = SAMPLE) -> Router | None:
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).collect()
    if not rows:
        return None
    dim = Counter(len(r["embedding"]) for r in rows).most_common(1)[0][0]
    x = np.array([r["embedding"] for r in rows if len(r["embedding"]) == dim])
    held = x[: min(HELD_OUT, len(x) // 10)]
    x = x[len(held) :]
    near = neighbour_graph(x)
    most = min(MAX_PARTS, max(1, n_rows // PART_ROWS), max(1, len(x) // 16)).bit_length() - 1
    best, least = None, np.inf
    for depth in range(min(FEWEST_LEVELS, most), most + 1):
        part = balanced_parts(near, depth)
        router = Router.fit(x, part, near)
        n, share = visits(router, held, x)
        # rows scored for a query, and the cost of merging what each visited part returns
        if (cost := share * n_rows + MERGE_COST * n) < least:
            best, least = Router(router.weights, router.bias, n), cost
    return best


def visits(router: Router, queries: np.ndarray, x: np.ndarray, k: int = NEIGHBOURS) -> tuple[int, float]:
    """The fewest parts to visit for TARGET_RECALL of the queries' true neighbours in x, and the share of x that they
    hold; all parts without queries."""
    n_parts = len(router.bias)
    if not len(queries):
        return n_parts, 1.0
    own = router.ranked(x, 1)[:, 0]
    k = min(k, len(x))
    true = np.concatenate([np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k] for q in np.array_split(queries, -(-len(queries) // 256))])
    ranked = router.ranked(queries, n_parts)
    rank = np.argsort(ranked, axis=1)
    at = np.take_along_axis(rank, own[true], axis=1).reshape(-1)
    found = np.cumsum(np.bincount(at, minlength=n_parts)) / len(at)
    n = int(np.searchsorted(found, TARGET_RECALL)) + 1
    return n, float((np.bincount(own, minlength=n_parts) / len(x))[ranked[:, :n]].sum(1).mean())


def _routed(vectors: DataFrame, router: Router, most: int) -> DataFrame:
    """vec_id, embedding, parts: the likeliest parts, best first."""
    dim = len(router.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            parts = router.ranked(x, most)
            flat = pa.array(parts.reshape(-1).astype(np.int32))
            ends = pa.array(np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32)) if parts.size else pa.array([0] * (batch.num_rows + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "embedding", "parts"])

    return vectors.where(F.size("embedding") == dim).mapInArrow(run, "vec_id long, embedding array<double>, parts array<int>")


def nearest_in_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of each query's k nearest in one block, exactly: a matrix product finds what can be among
    them, and a row-wise product, the same for equal vectors wherever they stand, orders it."""
    s = q @ x.T
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    margin = 1e-9 * (1 + np.abs(s).max(initial=0))
    for i in range(len(q)):
        others = np.flatnonzero(ids != q_ids[i])
        if len(others) > k:
            v = s[i, others]
            others = others[v >= np.partition(v, -k)[-k] - margin]
        exact = (x[others] * q[i]).sum(1)
        order = np.lexsort((ids[others], -exact))[:k]
        out.append((np.full(len(order), q_ids[i]), ids[others][order], exact[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors found for each row of queries (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows, asked = clean(vectors), clean(queries)
    router = fit(rows, rows.count(), sample)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_parts = len(router.bias)
    index = _routed(rows, router, 1).select("vec_id", "embedding", F.col("parts")[0].alias("part"))
    # as many counts as there are parts
    n_rows = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    routed = _routed(asked, router, n_parts)
    visited = min(router.visited, n_parts)
    found = stored(_scored(index, n_rows, _visiting(routed, visited), len(router.weights), k), "found")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    if visited < n_parts:
        # a query may be a candidate itself, or several, so all that are short of k rows are asked again
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        short = routed.join(enough, routed["vec_id"] == enough["query_id"], "left_anti")
        if short.limit(1).count():
            further = _scored(index, n_rows, _visiting(short, n_parts), len(router.weights), k)
            found = found.join(enough, "query_id", "left_semi").unionByName(further)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visiting(routed: DataFrame, n: int) -> DataFrame:
    return routed.select("vec_id", "embedding", F.explode(F.slice("parts", 1, n)).alias("part"))


def _scored(index: DataFrame, n_rows: dict[int, int], routed: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score: of each query, the k nearest rows in each block of each part that it visits."""
    spark = index.sparkSession
    n_asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = [(p, -(-n // BLOCK_ROWS), max(1, -(-n_asked.get(p, 0) // BLOCK_QUERIES))) for p, n in n_rows.items()]
    table = F.broadcast(spark.createDataFrame(blocks, "part int, row_blocks int, query_blocks int"))
    mine = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(table, "part").withColumn("query_block", mine("query_blocks")).withColumn("row_block", every("row_blocks"))
    right = index.join(table, "part").withColumn("row_block", mine("row_blocks")).withColumn("query_block", every("query_blocks"))
    key, columns = ["part", "row_block", "query_block"], ["part", "row_block", "query_block", "vec_id", "embedding"]

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t.column("vec_id").to_numpy(), t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def score(q: pa.Table, x: pa.Table) -> pa.Table:
        found = nearest_in_block(*matrix(q), *matrix(x), k) if q.num_rows and x.num_rows else ([], [], [])
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return left.select(columns).groupBy(*key).cogroup(right.select(columns).groupBy(*key)).applyInArrow(score, "query_id long, vec_id long, score double")


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
