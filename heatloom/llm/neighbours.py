"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut in halves; each half has its own centroids, whose number grows with the root of the table. A row's cell is its pair of
centroids. A query walks over the pairs by summed distance, with a heap, until the cells it has seen hold the wanted number of rows; the rows of these
cells are then ranked by the exact measure on the original vectors. The wanted number is measured: for some queries the true neighbours are found by brute
force, and the walk is made as long as it takes to meet the wanted share of them. So clustered vectors are searched in a few cells, and vectors without structure in many.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatloom.llm.common import drop, stored, trained

#: Rows that the centroids are fitted on, at most (by hash of their ids); all rows are indexed. Queries that the length of the walk is measured on, at most (by hash).
FIT_ROWS, MEASURED = 20_000, 256
#: Centroids of a half: a quarter of the root of the number of rows, between these. The table of cells goes to all tasks, and has at most the square of the latter.
LEAST_CENTROIDS, MOST_CENTROIDS = 8, 1_024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of rows with an id and a vector of the most common length without null, zero or infinite vectors."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (common.n if common else 0))


def matrix(column) -> np.ndarray:
    """A list column as a matrix of doubles."""
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centroids = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = distances(x, centroids).argmin(1)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def fit(rows, k: int) -> list[np.ndarray]:
    x = [r["embedding"] for r in rows]
    if not x:
        return []
    return [kmeans(h, k) if h.shape[1] else np.zeros((1, 0)) for h in halves(unit(np.array(x, np.float64)))]


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Cells by rising first[i] + second[j] until those seen hold `wanted` rows."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, got = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        n = held[a[i], b[j]]
        if n:
            out.append((int(a[i]), int(b[j])))
            got += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def best(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query among those in its cells; ties go to the smaller id."""
    rows = rows.sort_values("vec_id")
    x, q = np.stack(rows.embedding.to_list()), np.stack(queries.embedding.to_list())
    ux, uq = unit(x), unit(q)
    visits = np.zeros((len(queries), int(rows.c2.max()) + 1), bool)
    for n, cells in enumerate(queries.cells):
        cells = np.asarray(cells)
        visits[n, cells[cells < visits.shape[1]]] = True
    out = []
    ids, c2 = rows.vec_id.to_numpy(), rows.c2.to_numpy()
    for s in range(0, len(q), 512):
        score = np.where(visits[s : s + 512][:, c2], uq[s : s + 512] @ ux.T, -np.inf)
        if len(ids) > k:
            least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            least = np.full(len(score), -2.0)
        near_q, near_x = np.nonzero(score >= np.maximum(least - 1e-9, -2)[:, None])
        near_q += s
        # the exact measure, the same way for every pair, so that equal vectors tie
        dot = np.einsum("ij,ij->i", q[near_q], x[near_x])
        exact = dot / (np.sqrt(np.einsum("ij,ij->i", q, q))[near_q] * np.sqrt(np.einsum("ij,ij->i", x, x))[near_x])
        order = np.lexsort((ids[near_x], -exact, near_q))
        near_q, near_x, exact = near_q[order], near_x[order], exact[order]
        begins = np.searchsorted(near_q, near_q)
        kept = np.arange(len(near_q)) - begins < k
        out.append(pd.DataFrame({"qid": queries.qid.to_numpy()[near_q[kept]], "vec_id": ids[near_x[kept]], "score": exact[kept]}))
    return pd.concat(out)


@dataclass
class Index:
    """cells: vec_id, embedding, c1, c2 of all rows; books: the centroids of the halves; held: rows of each cell."""

    cells: DataFrame
    books: list[np.ndarray]
    held: np.ndarray

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [distances(h, b) for h, b in zip(halves(unit(x)), self.books, strict=True)]


def build_index(rows: DataFrame, centroids: int | None = None) -> Index | None:
    """The index of rows (vec_id, embedding: usable vectors); none of no rows."""
    count = rows.count()
    wanted = centroids or min(MOST_CENTROIDS, max(LEAST_CENTROIDS, round(count**0.5 / 4)))
    books = trained(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS), lambda found: fit(found, wanted))
    if not books:
        return None

    def assign(batches):
        for batch in batches:
            c = [distances(h, b).argmin(1).astype(np.int32) for h, b in zip(halves(unit(matrix(batch.column("embedding")))), books, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, c)], ["vec_id", "embedding", "c1", "c2"])

    cells = stored(rows.mapInArrow(assign, "vec_id bigint, embedding array<double>, c1 int, c2 int"), "vector-cells")
    held = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in cells.groupBy("c1", "c2").count().collect():  # a row a cell
        held[r.c1, r.c2] = r["count"]
    return Index(cells, books, held)


def rows_to_visit(index: Index, queries: DataFrame, k: int, recall: float) -> int:
    """Rows that a walk must meet so that `recall` of the true k neighbours of a sample of queries (qid, embedding) are among them."""
    total = int(index.held.sum())
    sample = queries.orderBy(F.xxhash64("qid"), "qid").limit(MEASURED).collect()
    if recall >= 1 or not sample:
        return total
    qid, q = np.array([r.qid for r in sample]), np.array([r.embedding for r in sample])
    uq = unit(q)

    def true_neighbours(batches):
        best_of: list[tuple] = []

        def kept() -> list[tuple]:
            score, n, ids, c1, c2 = (np.concatenate(x) for x in zip(*best_of, strict=True))
            order = np.lexsort((ids, -score, n))
            place = np.arange(len(order)) - np.searchsorted(n[order], n[order])
            return [tuple(x[order[place <= k]] for x in (score, n, ids, c1, c2))]

        for batch in batches:
            ids, c1, c2 = (batch.column(c).to_numpy() for c in ("vec_id", "c1", "c2"))
            x = unit(matrix(batch.column("embedding")))
            for a in range(0, len(x), 2_000):
                score = uq @ x[a : a + 2_000].T
                top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                n, at = np.repeat(np.arange(len(score)), top.shape[1]), top.ravel()
                best_of.append((score[n, at], n, ids[a + at], c1[a + at], c2[a + at]))
            best_of[:] = kept()
        for score, n, ids, c1, c2 in best_of:
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(ids), pa.array(score), pa.array(c1), pa.array(c2)], ["n", "vec_id", "score", "c1", "c2"])

    found = index.cells.mapInArrow(true_neighbours, "n bigint, vec_id bigint, score double, c1 int, c2 int")
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    d1, d2 = index.distances(q)
    need, taken = [], dict.fromkeys(range(len(sample)), 0)
    for r in sorted(top.collect(), key=lambda r: (r.n, r.place)):  # at most MEASURED times k + 1 rows
        if r.vec_id != qid[r.n] and taken[r.n] < k:
            taken[r.n] += 1
            sums = d1[r.n][:, None] + d2[r.n][None, :]
            need.append(int(index.held[sums <= sums[r.c1, r.c2]].sum()))
    return int(np.quantile(need, recall, method="higher")) if need else total


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.95, centroids: int | None = None, block: int = 4_096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row of vectors (vec_id, embedding) whose id is divisible by `every`.

    Rows with a null id, a null or zero vector, null or non-finite components or another length than most take no part. Rows with a repeated vec_id are
    one's own and never each other's neighbours. Of equal vectors the k + 1 smallest ids are kept in the index: others can be in no answer. Equal queries are searched once. Rows
    and queries of a centroid are dealt in blocks, so no cell meets in one task. Ties go to the smaller id. An empty table gives an empty one; other columns
    are ignored, so their names cannot clash. `recall` is the share of true neighbours that walks are measured for; 1 visits all cells.
    """
    rows = stored(usable(vectors), "vectors")
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    distinct_rows = stored(rows.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "vectors-distinct")
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    distinct = queries.groupBy("embedding").agg(F.min("vec_id").alias("qid"))
    index = build_index(distinct_rows, centroids)
    if index is None:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    drop(distinct_rows)
    cells, held = index.cells, index.held
    wanted = max(rows_to_visit(index, distinct, k, recall), 20 * k)
    bounds = Index(None, index.books, held)  # what tasks need

    def probe(batches):
        for batch in batches:
            d = bounds.distances(matrix(batch.column("embedding")))
            out: list[tuple[int, int, list[int]]] = []
            for n in range(batch.num_rows):
                found: dict[int, list[int]] = {}
                for i, j in walk(d[0][n], d[1][n], bounds.held, wanted):
                    found.setdefault(i, []).append(j)
                out += [(n, i, js) for i, js in found.items()]
            at = pa.array([n for n, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid").take(at), batch.column("embedding").take(at), pa.array([i for _, i, _ in out], pa.int32()), pa.array([js for _, _, js in out], pa.list_(pa.int32()))],
                ["qid", "embedding", "c1", "cells"],
            )

    probes = stored(distinct.select("qid", "embedding").mapInArrow(probe, "qid bigint, embedding array<double>, c1 int, cells array<int>"), "vector-probes")
    row_blocks = {i: max(1, -(-int(n) // block)) for i, n in enumerate(held.sum(1))}
    query_blocks = {i: 1 for i in row_blocks} | {r.c1: max(1, -(-r["count"] // block)) for r in probes.groupBy("c1").count().collect()}
    number = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("c1"))
    dealt_rows = cells.withColumn("rb", F.pmod(F.xxhash64("vec_id"), number(row_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), number(query_blocks) - 1)))
    dealt_queries = probes.withColumn("qb", F.pmod(F.xxhash64("qid"), number(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), number(row_blocks) - 1)))

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return best(x, q, k + 1) if len(x) and len(q) else pd.DataFrame({"qid": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ["c1", "rb", "qb"]
    found = dealt_rows.groupBy(*keys).cogroup(dealt_queries.groupBy(*keys)).applyInPandas(search, "qid bigint, vec_id bigint, score double")
    nearest_first = [F.desc("score"), F.asc("vec_id")]
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*nearest_first))).where(F.col("n") <= k + 1).drop("n")
    ids = distinct.join(queries.withColumnRenamed("vec_id", "query_id"), "embedding").select("qid", "query_id")
    pairs = ids.join(top, "qid").where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*nearest_first))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
