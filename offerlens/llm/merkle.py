"""Merkle manifest of a table: a tree per group, a tree over the group roots, proofs by recomputation.

Leaves are digests of whole rows, placed in each group by a range sort, so one huge group is spread like
any other.  Two neighbours become the digest of their joined hex text; a last one without neighbour is
digested alone.  Only every ``STRIDE``-th level is written.  A proof walks down from the root: the
written nodes of each aligned subtree regenerate the levels between, every node of the subtree gets the
siblings on its way up followed by those of the subtree's root, and the regenerated nodes are
discarded.  A subtree has at most ``2 ** STRIDE`` nodes, so no task holds more of a group than that.

Defined results: null columns enter a leaf as ``-``; null ids stand first in their group, null groups
before all others; rows of equal id stand by their digest, so repeated rows are separate, equal leaves;
an empty table has no leaves, no root and no proofs.  Further columns are neither read nor returned,
whatever their names; ``carry`` names columns to keep.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.plans.compare import with_position
from offerlens.session import materialize

#: Levels of a tree between two that are written.
STRIDE = 5
NO_STEPS = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: bytes of its text, a colon, its text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


@dataclass(frozen=True)
class Tree:
    """Written levels of the trees of all groups, lowest first: ``grp, idx, n, digest`` (``n`` nodes of the group there)."""

    stored: list[DataFrame]
    stride: int

    @property
    def roots(self) -> DataFrame:
        return self.stored[-1].select("grp", "digest")


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes."""
    return F.length(F.bin(n - 1)) * (n > 1).cast("int")


def _above(nodes: Column) -> Column:
    """The next level of a run of nodes."""
    pairs = F.sequence(F.lit(0), (F.size(nodes) - 1).cast("int") - F.floor(F.size(nodes) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256))


def _subtrees(level: DataFrame, stride: int, *carry: str) -> DataFrame:
    """Aligned subtrees over a written level: ``grp, idx`` of its root, ``n``, its sorted ``nodes`` and all its ``levels``."""
    member = F.struct("idx", "digest", *carry)
    blocks = level.groupBy("grp", F.shiftright("idx", stride).alias("up"), "n").agg(F.array_sort(F.collect_list(member)).alias("nodes"))
    steps = F.least(F.lit(stride), _height(F.col("n")))
    climb = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(climb, F.array(F.col("nodes.digest")), lambda acc, _: F.array_append(acc, _above(F.element_at(acc, -1))))
    return blocks.select("grp", F.col("up").alias("idx"), "n", "nodes", levels.alias("levels"))


def build(nodes: DataFrame, stride: int = STRIDE) -> Tree:
    """Trees over written nodes ``grp, idx, n, digest`` (further columns stay on the lowest level)."""
    stored, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        size = F.shiftright(F.col("n") + ((1 << stride) - 1), stride)
        up = _subtrees(stored[-1], stride).select("grp", "idx", size.alias("n"), F.get(F.element_at("levels", -1), 0).alias("digest"))
        stored.append(materialize(up, "merkle-level"))
        most = (most + (1 << stride) - 1) >> stride
    return Tree(stored, stride)


def _steps(levels: Column, at: Column) -> Column:
    """For each level of a subtree, what stands before and after the node above place ``at``."""

    def step(nodes: Column, level: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(2), level)).cast("int")
        right = place % 2 == 1
        sibling = F.coalesce(F.get(nodes, F.when(right, place - 1).otherwise(place + 1)), F.lit(""))
        return F.struct(F.when(right, sibling).otherwise("").alias("before"), F.when(right, "").otherwise(sibling).alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def proofs(tree: Tree, above: DataFrame, *carry: str) -> DataFrame:
    """``grp, idx, digest, steps`` of every lowest node, its carried columns, and further columns of ``above``.

    ``above`` has the ``grp`` and the ``steps`` over each root; a node's steps run from its sibling upwards.
    """
    passed = [c for c in above.columns if c not in ("grp", "steps")]
    paths = above.withColumn("idx", F.lit(0).cast("long"))
    if len(tree.stored) == 1:  # every group is a single node
        return tree.stored[0].join(paths, ["grp", "idx"]).select("grp", "idx", "digest", *carry, "steps", *passed)
    for depth, level in reversed(list(enumerate(tree.stored[:-1]))):
        block = _subtrees(level, tree.stride, *(carry if depth == 0 else ())).join(paths, ["grp", "idx"])
        inside = F.transform("nodes", lambda x, i: F.struct(x.alias("node"), _steps(F.col("levels"), i).alias("own")))
        rows = block.select("grp", "steps", *passed, F.explode(inside).alias("x"))
        paths = rows.select("grp", "x.node.*", F.concat("x.own", "steps").alias("steps"), *passed)
        if depth:
            paths = materialize(paths.drop("digest"), "merkle-paths")
    return paths


def folded(digest: Column, steps: Column) -> Column:
    """The root that a digest gives with the siblings of a proof."""
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def siblings(steps: Column) -> Column:
    """The siblings of a proof, joined in order."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def group_key(group: Column) -> Column:
    """Text that sorts like the group, null first, and is never null."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def placed_leaves(rows: DataFrame, group: Column, order: Column, digest: Column, *carry: Column, stride: int = STRIDE) -> DataFrame:
    """Leaves of all rows: ``grp, idx, n, digest`` and the carried columns, in ascending order within each group."""
    narrow = rows.select(group_key(group).alias("grp"), order.alias("_by"), digest.alias("digest"), *carry)
    narrow = materialize(narrow, "merkle-rows")  # whole texts are read once
    ranked = with_position(narrow, [F.col("grp"), F.col("_by").asc_nulls_first(), F.col("digest")], "_pos")
    ranked = materialize(ranked.drop("_by"), "merkle-ranked")
    groups = ranked.groupBy("grp").agg(F.min("_pos").alias("_start"), F.count("*").alias("n"))
    return materialize(ranked.join(groups, "grp").withColumn("idx", F.col("_pos") - F.col("_start")).drop("_pos", "_start"), "merkle-leaves")


def manifest(leaves: DataFrame, *carry: str, stride: int = STRIDE) -> DataFrame:
    """Every leaf: ``grp, idx, digest``, the carried columns, ``steps`` to the root, ``subroot, root``."""
    tree = build(leaves, stride)
    roots = with_position(tree.roots, [F.col("grp")], "_pos")
    n = F.lit(roots.count())
    tops = roots.select(F.lit("").alias("grp"), (F.col("_pos") - 1).alias("idx"), n.alias("n"), "digest", F.col("grp").alias("own"))
    top = build(materialize(tops, "merkle-roots"), stride)
    above = top.roots.select("grp", F.array().cast(NO_STEPS).alias("steps"), F.col("digest").alias("root"))
    over = proofs(top, above, "own").select(F.col("own").alias("grp"), "steps", F.col("digest").alias("subroot"), "root")
    return proofs(tree, materialize(over, "merkle-tops"), *carry)
