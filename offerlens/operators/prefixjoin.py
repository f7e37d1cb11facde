"""Set-similarity join on prefixes.

Tokens of a set are ordered by rising frequency in their block.  Two sets whose Jaccard similarity is
``t`` or more must share a token among the first ``n - ceil(t * n) + 1`` of each, and neither can be
smaller than ``t`` times the other, so only those tokens are joined: frequent tokens stand last and
mostly fall outside.  A pair may be met on several tokens; callers take a maximum or drop repeats.
Output is linear in the pairs that share a prefix token; there is no limit above which it changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.similarity import jaccard

EPS = 1e-9


def frequencies(*sides: tuple[DataFrame, str]) -> DataFrame:
    """(blk, tok, n): sets of a block that hold a token, over all sides (table, array column)."""
    parts = [df.select("blk", F.explode(column).alias("tok")) for df, column in sides]
    return reduce(DataFrame.unionAll, parts).groupBy("blk", "tok").agg(F.count("*").alias("n"))


def with_ordered(sets: DataFrame, key: str, column: str, freq: DataFrame, into: str = "toks") -> DataFrame:
    """Adds the tokens of ``column`` by rising frequency; ``key`` names a set.  Sets are short, so are the arrays."""
    ranked = sets.select(key, "blk", F.explode(column).alias("tok")).join(freq, ["blk", "tok"])
    ordered = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "tok"))).alias("p")).select(key, F.col("p.tok").alias(into))
    return sets.join(ordered, key, "left").withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def prefix_rows(sets: DataFrame, t: float, column: str = "toks", size: str | None = None) -> DataFrame:
    """One row for each prefix token of a set, with the size of the set as ``size``.

    ``size`` names the size of the whole set where ``column`` holds only the tokens that others may share; sets that
    hold too few of them to reach ``t`` give no row.
    """
    n, whole = F.size(column), F.col(size) if size else F.size(column)
    front = F.least(n, n - F.ceil(t * whole - EPS).cast("int") + 1)
    return sets.withColumn("size", whole).withColumn("tok", F.explode(F.slice(column, F.lit(1), F.greatest(front, F.lit(0)))))


def close_sizes(a: str, b: str, t: float):
    return (F.col(a) >= t * F.col(b) - EPS) & (F.col(b) >= t * F.col(a) - EPS)


def _combinations(front: Column, k: Column) -> Column:
    """Hashes of all single tokens, pairs or triples of tokens in front, for ``k`` from 1 to 3."""
    before = lambda i: F.slice(front, F.lit(1), i)
    pairs = F.flatten(F.transform(front, lambda y, i: F.transform(before(i), lambda x: F.xxhash64(x, y))))
    triples = F.flatten(F.transform(front, lambda z, j: F.flatten(F.transform(before(j), lambda y, i: F.transform(before(i), lambda x: F.xxhash64(x, y, z))))))
    return F.when(k == 1, F.transform(front, lambda x: F.xxhash64(x))).when(k == 2, pairs).otherwise(triples)


def sized_combinations(sets: DataFrame, key: str, sizes: list[int], t: float, left: bool, column: str = "toks") -> DataFrame:
    """(kind, key, id) of a set for each partner size with which it can reach ``t``."""
    n, m = F.size(column), F.col("_m")
    # Sets of n and m tokens reach t with this many in common.
    shared = F.ceil(t / (1 + t) * (n + m) - EPS).cast("int")
    own = sets.select(key, "blk", column, F.explode(F.array(*map(F.lit, sizes))).alias("_m")).withColumn("_o", shared)
    own = own.filter((F.col("_o") <= F.least(n, m)) & (F.col("_o") > 0)).withColumn("_k", F.least(F.col("_o"), F.lit(3)))
    front = F.slice(column, F.lit(1), F.least(n, n - F.col("_o") + F.col("_k")))
    kind = F.xxhash64("blk", *((n, m) if left else (m, n)))
    return own.select(kind.alias("kind"), F.explode(_combinations(front, F.col("_k"))).alias("key"), key)


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, t: float, column: str = "toks") -> DataFrame:
    """(left_key, right_key) of every pair of sets in one block with Jaccard similarity ``t`` or more, each once.

    Both sides hold ``blk`` and their tokens by rising frequency.  The sizes of two sets give the number of tokens
    they must share; the first three (two, one, if they need no more) stand in front of both, and only such
    combinations are joined.  Hashes bring sets together; the tokens themselves decide.
    """
    sizes = [sorted(r["n"] for r in df.select(F.size(column).alias("n")).filter("n > 0").distinct().collect()) for df in (left, right)]
    met = sized_combinations(left, left_key, sizes[1], t, True, column).join(sized_combinations(right, right_key, sizes[0], t, False, column), ["kind", "key"])
    met = met.select(left_key, right_key).distinct()
    met = met.join(left.select(left_key, F.col("blk").alias("_lb"), F.col(column).alias("_l")), left_key)
    met = met.join(right.select(right_key, F.col("blk").alias("_rb"), F.col(column).alias("_r")), right_key)
    return met.filter((F.col("_lb") == F.col("_rb")) & (jaccard(F.col("_l"), F.col("_r")) >= t)).select(left_key, right_key)
