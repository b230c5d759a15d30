"""Exact nearest neighbours by cosine: blocks of queries against slices of candidates.

A matrix product gives each pair's similarity but for rounding. Pairs that can still be among a query's best are summed
again component by component, as numbers.cosine() does, so that ranks and ties are those of the plain definition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Queries of a block and candidates of a slice on average, queries and pairs that are scored at a time.
QUERY_BLOCK, SLICE, BATCH, PAIRS = 4_096, 16_384, 128, 1 << 16
#: More than the rounding of a matrix product of unit vectors.
SLACK = 1e-9
#: Ranks of undefined similarities: as Spark and SQL order them, NaN comes first and null last.
NAN_RANK, NULL_RANK = 10.0, -10.0


class _Rows:
    """Identifiers and vectors of one length; odd: without a usable norm; null: holding null."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, null: np.ndarray) -> None:
        self.ids, self.vectors, self.null = ids, vectors, null
        self.norms = np.sqrt(_summed(vectors, vectors))
        self.odd = null | ~((self.norms > 1e-100) & (self.norms < 1e100))
        self.units = np.where(self.odd[:, None], 0.0, vectors) / np.where(self.odd, 1.0, self.norms)[:, None]


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed in the order of the components."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
    return total


def _by_length(table: pa.Table, id_col: str, vec_col: str) -> dict[int | None, _Rows]:
    """Rows of a table by the length of their vectors; None: without one."""
    ids = table.column(id_col).to_numpy().astype(np.int64)
    lists = table.column(vec_col).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out: dict[int | None, _Rows] = {}
    for n in np.unique(sizes):
        held = np.flatnonzero(sizes == n)
        flat = lists.take(pa.array(held)).flatten()
        width = max(int(n), 0)
        vectors = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(held), width)
        null = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(held), width).any(axis=1) | (n < 0)
        out[None if n < 0 else int(n)] = _Rows(ids[held], vectors, null)
    return out


def _best(q: _Rows, c: _Rows, k: int, same: bool, unknown: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, match ids, similarities, whether null) that hold the k best of each query."""
    if unknown or not same:  # one value for all pairs, so that the least identifiers win
        ids = np.sort(c.ids)[: k + 1]
        rows, columns = (x.ravel() for x in np.meshgrid(np.arange(len(q.ids)), np.arange(len(ids)), indexing="ij"))
        other = q.ids[rows] != ids[columns]
        return [(q.ids[rows[other]], ids[columns[other]], np.zeros(other.sum()), np.full(other.sum(), unknown))]
    found = []
    for low in range(0, len(q.ids), BATCH):
        part = slice(low, low + BATCH)
        near = q.units[part] @ c.units.T
        near[:, c.odd] = -np.inf
        floor = np.partition(near, -(k + 1), axis=1)[:, -(k + 1)] if near.shape[1] > k + 1 else np.full(len(near), -np.inf)
        wanted = (near >= floor[:, None] - SLACK) | c.odd | q.odd[part, None]
        wanted &= q.ids[part, None] != c.ids
        rows, columns = np.nonzero(wanted)
        rows += low
        value, null = np.zeros(len(rows)), q.null[rows] | c.null[columns]
        with np.errstate(all="ignore"):
            for at in range(0, len(rows), PAIRS):
                r, s = rows[at : at + PAIRS], columns[at : at + PAIRS]
                norm = q.norms[r] * c.norms[s]
                value[at : at + PAIRS] = np.where(norm == 0, 0.0, _summed(q.vectors[r], c.vectors[s]) / np.where(norm == 0, 1.0, norm))
        ids = c.ids[columns]
        order = np.lexsort((ids, -np.where(null, NULL_RANK, np.where(np.isnan(value), NAN_RANK, value)), rows))
        rows, ids, value, null = rows[order], ids[order], value[order], null[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((q.ids[rows[top]], ids[top], value[top], null[top]))
    return found


def cosine_topk(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, match_id, similarity, rank: the k most similar candidates (match_id, cv) of each query (query_id, qv) among all but itself; ties go to the smaller identifier.

    Of equal vectors only the k + 1 of the least identifiers take part: the others are behind them for every query.
    """
    spread = 2 * queries.sparkSession.sparkContext.defaultParallelism
    first = F.row_number().over(Window.partitionBy("cv").orderBy("match_id"))
    c = candidates.select(F.col("match_id").cast("long"), F.col("cv").cast("array<double>")).withColumn("copy", first).where(F.col("copy") <= k + 1).drop("copy")
    q = queries.select(F.col("query_id").cast("long"), F.col("qv").cast("array<double>"))
    n_queries, n_candidates = queries.count(), candidates.count()
    n_slices = max(1, -(-n_candidates // SLICE), min(-(-n_candidates // 2_048), spread))
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    asking = q.select("query_id", "qv", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block"), each(n_slices).alias("slice"))
    offered = c.select("match_id", "cv", F.pmod(F.xxhash64("match_id"), F.lit(n_slices)).alias("slice"), each(n_blocks).alias("block"))

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            for n, ours in _by_length(asked, "query_id", "qv").items():
                for m, theirs in _by_length(held, "match_id", "cv").items():
                    found += _best(ours, theirs, k, n == m and n != 0, n is None or m is None)
        a, b, value, null = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        return pa.table({"query_id": pa.array(a, pa.int64()), "match_id": pa.array(b, pa.int64()), "similarity": pa.array(value, pa.float64(), mask=null)})

    keys = ["block", "slice"]
    partial = asking.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(best, "query_id long, match_id long, similarity double")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")))
    return ranked.where(F.col("rank") <= k)
