"""Exact top-k inner-product search by columnar branch and bound.

Components are quantised to floor(scale * x). Queries and candidates are dealt into blocks of bounded bytes; each pair
of a query block and a candidate slice is one group. In a group candidates lie in vertical layout, a row a dimension,
the dimensions of most energy first, the candidates of largest norm first. Partial scores grow dimension block by
dimension block; what the remaining dimensions can add is at most the product of both remaining norms (Cauchy-Schwarz).
The bound is decided for each query and candidate: pairs that can't reach the query's current k-th score leave. While
many pairs survive, candidates that no query of the batch needs are compacted away; once few do, the surviving pairs
themselves are compacted and only they are scored on. The k best of each slice then meet per query.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a query meets the
candidates of its own length; rows with the query's identifier are never its candidates; repeated candidates are rows
of their own, repeated queries count once; ties go to the smaller identifier; an empty table gives an empty result. All
scores are whole and exact; one beyond 64 bits counts as the nearest long. A quantised component beyond a double counts
as the largest one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Queries of a block and candidates of a slice, at most on average, and the bytes that either may take.
QUERY_BLOCK, SLICE, BLOCK_BYTES = 16_384, 65_536, 32 << 20
#: Queries that are scored together, candidates that one step takes on at most (the first steps take fewer, for early
#: k-th scores), and dimensions added at a time.
BATCH, STEP, DIMENSIONS = 256, 4_096, 8
#: Share of surviving pairs below which pairs are scored singly, and how many at a time.
PAIR_SHARE, PAIRS = 0.5, 1 << 16
_SCHEMA = "query_id long, vec_id long, score long"


def _matrix(table: pa.Table, id_col: str, vec_col: str, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and quantised vectors, by identifier, then vector."""
    ids = table.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = table.column(vec_col).combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.nan_to_num(np.floor(scale * values)).reshape(len(ids), -1)
    order = np.lexsort((*whole.T[::-1], ids)) if len(ids) != len(np.unique(ids)) else np.argsort(ids)
    return ids[order], whole[order]


class Best:
    """The k best candidates of each query of a batch so far; floor is the k-th score."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.rows, self.places, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def take(self, rows: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        rows, places, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.places, places), (self.scores, scores)))
        order = np.lexsort((places, -scores, rows))
        rows, places, scores = rows[order], places[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = rank < self.k
        self.rows, self.places, self.scores = rows[top], places[top], scores[top]
        full = rank == self.k - 1
        self.floor[rows[full]] = scores[full]


def _masses(rows: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of what remains from each dimension block on, and 0 at the end; rounded up."""
    squares = np.add.reduceat(rows**2, cuts, axis=1)
    left = squares[:, ::-1].cumsum(axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([left, np.zeros((len(rows), 1))], axis=1)) * (1 + 1e-9)


def _step(batch: np.ndarray, batch_mass: np.ndarray, vertical: np.ndarray, mass: np.ndarray, floor: np.ndarray, cuts: list[int], tally: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query row, candidate column, score) whose score may be among the best. batch and vertical: a row a dimension."""
    alive = np.arange(vertical.shape[1])
    score = np.zeros((batch.shape[1], len(alive)))
    for b, cut in enumerate(cuts):
        bound = score + batch_mass[:, b : b + 1] * mass[alive, b]
        near = bound + np.abs(bound) * 1e-12 >= floor[:, None]
        share = near.mean() if near.size else 0.0
        if share < PAIR_SHARE:
            rows, columns = np.nonzero(near)
            return _pairs(rows, alive[columns], score[rows, columns], batch, batch_mass, vertical, mass, floor, cuts[b:], b, tally)
        needed = near.any(axis=0)
        if not needed.all():
            alive, score = alive[needed], np.ascontiguousarray(score[:, needed])
        tally[b] += score.size
        score += batch[cut : cut + DIMENSIONS].T @ vertical[cut : cut + DIMENSIONS, alive]
    rows, columns = np.nonzero(score >= floor[:, None])
    return rows, alive[columns], score[rows, columns]


def _pairs(rows: np.ndarray, columns: np.ndarray, score: np.ndarray, batch: np.ndarray, batch_mass: np.ndarray, vertical: np.ndarray, mass: np.ndarray, floor: np.ndarray, cuts: list[int], first: int, tally: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for given pairs, those that can't reach the floor compacted away before each block."""
    kept = []
    for at in range(0, len(rows), PAIRS):
        r, c, s = rows[at : at + PAIRS], columns[at : at + PAIRS], score[at : at + PAIRS]
        for b, cut in enumerate(cuts, first):
            tally[b] += len(r)
            s = s + (batch[cut : cut + DIMENSIONS, r] * vertical[cut : cut + DIMENSIONS, c]).sum(axis=0)
            bound = s + batch_mass[r, b + 1] * mass[c, b + 1]
            near = bound + np.abs(bound) * 1e-12 >= floor[r]
            r, c, s = r[near], c[near], s[near]
        kept.append((r, c, s))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (rows, columns, score)


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, tally: Counter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, as rows (query row, candidate row, score). Candidates come by identifier.

    tally counts the pairs that each dimension block was added for.
    """
    tally = Counter() if tally is None else tally
    n_dims = queries.shape[1]
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * n_dims
    if reach >= 2**52:  # too large for doubles to hold the sums
        return _search_wide(query_ids, queries, ids, vectors, k, reach < 2**62)
    energy = (queries**2).sum(axis=0) * (vectors**2).sum(axis=0)
    order = np.argsort(-energy, kind="stable")
    cuts = list(range(0, n_dims, DIMENSIONS))
    by_norm = np.argsort(-(vectors**2).sum(axis=1), kind="stable")
    queries, vertical = queries[:, order], np.ascontiguousarray(vectors[by_norm][:, order].T)
    query_mass, mass = _masses(queries, cuts), _masses(vertical.T, cuts)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, len(queries), BATCH):
        batch, batch_mass, batch_ids = np.ascontiguousarray(queries[low : low + BATCH].T), query_mass[low : low + BATCH], query_ids[low : low + BATCH]
        best, at = Best(len(batch_ids), k), 0
        while at < len(ids):
            end = min(len(ids), at + min(STEP, max(256, 2 * k, at)))
            rows, columns, scores = _step(batch, batch_mass, vertical[:, at:end], mass[at:end], best.floor, cuts, tally)
            places = by_norm[at + columns]
            mine = batch_ids[rows] != ids[places]
            best.take(rows[mine], places[mine], scores[mine])
            at = end
        found.append((best.rows + low, best.places, best.scores))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _search_wide(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, fits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for components too large for doubles, all candidates scored in whole numbers of 64 bits or, if these don't fit, of any size."""
    limits = np.iinfo(np.int64)

    def whole(rows: np.ndarray) -> np.ndarray:
        return rows.astype(np.int64) if fits else np.array([[int(x) for x in row] for row in rows], dtype=object)

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(queries)):
        wanted = whole(queries[i : i + 1])[0]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(ids), STEP):
            product = whole(vectors[at : at + STEP]).dot(wanted)
            offered = np.array([min(max(int(x), limits.min), limits.max) for x in product], dtype=np.int64)
            mine = np.flatnonzero(ids[at : at + STEP] != query_ids[i])
            places, scores = np.concatenate([places, at + mine]), np.concatenate([scores, offered[mine]])
            top = np.lexsort((places, ~scores))[:k]
            places, scores = places[top], scores[top]
        found.append((np.full(len(places), i), places, scores))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite."""
    value = vector.cast("array<double>")
    return F.coalesce((F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query."""
    base = vectors.where(usable(vectors[f"`{vec_col}`"]) & vectors[f"`{id_col}`"].isNotNull())
    rows = base.select(vectors[f"`{id_col}`"].cast("long").alias("id"), vectors[f"`{vec_col}`"].cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n_rows, n_queries, longest = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vec"))).first()
    fitting = max(1, BLOCK_BYTES // (8 * (longest or 1)))
    slice_rows, query_block = min(slice_rows, fitting), min(query_block, fitting)
    spread = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    n_slices = max(1, -(-n_rows // slice_rows), min(-(-n_rows // 2048), spread))
    n_blocks = max(1, -(-n_queries // query_block))
    n_dims = F.size("vec").alias("n_dims")
    candidates = rows.select("id", "vec", n_dims, F.pmod(F.xxhash64("id"), F.lit(n_slices)).alias("slice"), _each(n_blocks).alias("block"))
    queries = rows.where("asks").select("id", "vec", n_dims, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).alias("block"), _each(n_slices).alias("slice"))

    def best(asking: pa.Table, offered: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score")
        if not asking.num_rows or not offered.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        query_ids, wanted = _matrix(asking, "id", "vec", scale)
        query_ids, first = np.unique(query_ids, return_index=True)
        ids, held = _matrix(offered, "id", "vec", scale)
        row, place, score = search(query_ids, wanted[first], ids, held, k)
        return pa.table({n: pa.array(v.astype(np.int64)) for n, v in zip(names, (query_ids[row], ids[place], score), strict=True)})

    keys = ["n_dims", "block", "slice"]
    partial = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(best, _SCHEMA)
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
