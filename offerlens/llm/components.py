"""Connected components of a link table by repeated contraction.

Each round every node takes its smallest neighbour (or itself) as parent, links are rewritten to the
parents, and links inside one node vanish.  Nodes are ordered by a hash, so chains shrink by a factor
in every round whatever their ids.  Smallest neighbours are partial aggregates, so a node with very
many links costs one row per task.  Every round is written to the shared scratch folder, which cuts
the lineage and survives lost executors; the driver only learns whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with a link; all nodes of a component share one root (a hash)."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = links.filter(F.col(a) != F.col(b)).select(order(a).alias("u"), order(b).alias("v"))
    edges = materialize(edges.distinct(), "links")
    ends = edges.select("u").union(edges.select(F.col("v").alias("u"))).distinct()
    roots = ends.select(F.col("u.n").alias("node"), F.col("u").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        parents = materialize(parents, "parents")
        mapped = edges.join(parents, "u").select("v", F.col("p").alias("pu"))
        mapped = mapped.join(parents.withColumnRenamed("u", "v"), "v").select("pu", F.col("p").alias("pv")).filter("pu != pv")
        edges = materialize(mapped.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "links")
        step = parents.withColumnRenamed("u", "root")
        roots = materialize(roots.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
    return roots.select("node", F.col("root.h").alias("root"))
