"""Exact top-k search by inner product: inverted lists scattered into dense score arrays.

Components become whole numbers first, so every score is exact.  All rows are cut into candidate blocks
and the query rows into query blocks; each pair of blocks is one group of a shuffle, so work is spread
over ``blocks x blocks`` tasks of bounded size.  A group turns its candidates into one list of postings
(row, weight) per component and walks the lists term by term: the weights, times the weight each query
has there, are added to the score arrays at the rows of the list; zero weights have no posting and no
step.  Then each query takes its best rows by partition selection, and the best of all blocks are merged.
Nothing is pruned or estimated.

Layout only, never results: a block has about ``BLOCK`` rows, and fewer where that would leave cores idle.

Defined results: vectors that are null or hold a null or non-finite component (also after scaling) take no
part; vectors of different length meet on the components both have; an empty vector scores 0 with all
others.  Rows of equal id are separate: each is a query of its own and a candidate of the others.  Ties go
to the smaller id, null ids last; a null id is never a query.  A score outside the range of a long counts
as the nearest end of that range.  An empty table has no queries.  Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.session import materialize

BLOCK = 1 << 16
#: Queries whose score arrays are held at once.
QUERIES_AT_ONCE = 32
LONG = (-(1 << 63), (1 << 63) - 1)
BEST = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _sparse(cells: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, component and whole-number weight of every non-zero component."""
    lengths = np.diff(cells.offsets.to_numpy())
    weights = np.floor(cells.flatten().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    used = weights != 0
    return row[used], term[used], weights[used]


def _whole(weights: np.ndarray, small: bool) -> np.ndarray:
    return weights.astype(np.int64) if small else np.array([int(x) for x in weights.tolist()], dtype=object)


class Postings:
    """For each component, the rows that have it and their weights."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int):
        order = np.argsort(term, kind="stable")
        self.n_rows, self.rows, self.weights = n_rows, row[order], weight[order]
        self.terms, starts = np.unique(term[order], return_index=True)
        self.bounds = np.append(starts, len(row))

    def scores(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_queries: int) -> np.ndarray:
        """Dense scores (rows x queries) of sparse query rows, one term after the other."""
        out = np.zeros((self.n_rows, n_queries), dtype=self.weights.dtype)
        order = np.argsort(term, kind="stable")
        row, term, weight = row[order], term[order], weight[order]
        lo, hi = np.searchsorted(term, self.terms, "left"), np.searchsorted(term, self.terms, "right")
        for i in np.flatnonzero(hi > lo).tolist():
            here = slice(self.bounds[i], self.bounds[i + 1])
            spread = np.zeros(n_queries, dtype=out.dtype)
            spread[row[lo[i] : hi[i]]] = weight[lo[i] : hi[i]]
            out[self.rows[here]] += self.weights[here, None] * spread[None, :]
        return out


def select_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the first places; in order of place."""
    if len(scores) <= k:
        return np.arange(len(scores))
    bar = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > bar)
    return np.sort(np.concatenate((above, np.flatnonzero(scores == bar)[: k - len(above)])))


def _search(key: tuple, queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The best ``rows`` of every query of one pair of blocks."""
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last
    q_row, q_term, q_weight = _sparse(queries["cells"].combine_chunks())
    row, term, weight = _sparse(rows["cells"].combine_chunks())
    largest = float(np.abs(q_weight).max(initial=0)), float(np.abs(weight).max(initial=0))
    # Whole numbers of any length where 64 bits might not hold a sum.
    small = largest[0] * largest[1] * (int(term.max(initial=0)) + 1) < 2.0**62 and max(largest) < 2.0**53
    postings = Postings(row, term, _whole(weight, small), len(rows))
    q_weight = _whole(q_weight, small)
    own, ids = rows["row"].to_numpy(), rows["vec_id"].combine_chunks()
    out: dict[str, list] = {name: [] for name in BEST.names}
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        n = min(QUERIES_AT_ONCE, len(queries) - at)
        lo, hi = np.searchsorted(q_row, [at, at + n])
        scores = postings.scores(q_row[lo:hi] - at, q_term[lo:hi], q_weight[lo:hi], n).T
        scores = np.ascontiguousarray(scores if small else np.clip(scores, *LONG).astype(np.int64))
        for i, (number, query_id) in enumerate(zip(queries["row"][at : at + n].to_pylist(), queries["vec_id"][at : at + n].to_pylist())):
            best = select_best(scores[i], k + 1)  # one more, for the query's own row
            best = best[own[best] != number]
            best = best[np.lexsort((best, ~scores[i][best]))][:k]
            out["query_row"] += [number] * len(best)
            out["query_id"] += [query_id] * len(best)
            out["vec_id"] += ids.take(pa.array(best, type=pa.int64())).to_pylist()
            out["score"] += scores[i][best].tolist()
    return pa.table(out, schema=BEST)


def search(rows: DataFrame, is_query: Column, k: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of every row that ``is_query`` (a condition on ``vec_id``) picks.

    Components count as ``floor(scale * component)``; one ``rank`` sequence per query row.
    """
    cells = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), cells.alias("cells"))
    infinite = float("inf")
    finite = F.forall("cells", lambda x: F.coalesce((F.abs(x) < infinite) & ~F.isnan(x), F.lit(False)))
    kept = kept.filter(F.col("cells").isNotNull() & finite).withColumn("row", F.monotonically_increasing_id())
    kept = materialize(kept, "vectors")  # the number of a row stays the same for all readers
    asked = kept.filter(F.col("vec_id").isNotNull() & is_query)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_rows, n_queries = kept.count(), asked.count()
    row_blocks = max(-(-n_rows // block), min(4 * cores, n_rows), 1)
    query_blocks = max(-(-n_queries // block), 1)

    def dealt(side: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        side = side.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = dealt(asked, "qb", query_blocks, "rb", row_blocks).groupBy("qb", "rb")
    right = dealt(kept, "rb", row_blocks, "qb", query_blocks).groupBy("qb", "rb")
    met = left.cogroup(right).applyInArrow(lambda key, a, b: _search(key, a, b, k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
