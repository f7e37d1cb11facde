"""Linking two catalogues: blocked similarity join, two-tier choice and price comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.numbers import round4
from offerlens.functions.similarity import counted_similarity
from offerlens.functions.text import tokens
from offerlens.operators.prefixjoin import close_sizes, prefix_rows
from offerlens.session import materialize, widen


#: Bounds of the similarity join, from high to low.
ROUNDS = (0.8, 0.65, 0.5, 0.25)
#: What a score and its tier depend on.
SHAPE = ["blk", "qty", "toks", "size", "ltoks", "lsize"]


def block_key(columns: list[str]) -> Column:
    """One text key for null-safe equality on several columns."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))


def _looks(df: DataFrame, block: list[str], quantity: str, name: str, label: str) -> DataFrame:
    """Block, pack and the token sets of name and label of distinct texts, numbered as ``look``."""
    return df.withColumns(
        {
            "blk": block_key(block), "qty": F.col(quantity), "nset": tokens(F.col(name)), "lset": tokens(F.col(label)),
            "look": F.monotonically_increasing_id(),
        }
    )


def _words(looks: DataFrame) -> DataFrame:
    """(look, blk, part, tok): tokens of names (part n) and of labels (part l)."""
    named = lambda c, part: F.transform(c, lambda t: F.struct(F.lit(part).alias("part"), t.alias("tok")))
    return looks.select("look", "blk", F.explode(F.concat(named("nset", "n"), named("lset", "l"))).alias("w")).select("look", "blk", "w.*")


def common_words(a_looks: DataFrame, r_looks: DataFrame) -> DataFrame:
    """(blk, part, tok, n): tokens of a block that both sides hold, with the contacts they would make."""
    held = lambda looks, n: _words(looks).groupBy("blk", "part", "tok").agg(F.count("*").alias(n))
    both = held(a_looks, "_a").join(held(r_looks, "_r"), ["blk", "part", "tok"])
    return both.select("blk", "part", "tok", (F.col("_a") * F.col("_r")).alias("n"))


def shapes(looks: DataFrame, common: DataFrame) -> DataFrame:
    """(look, blk, qty, toks, size, ltoks, lsize): what the other side can see of a look.

    A token that the other side of the block lacks can never be shared: it counts in the size of its set only.  Looks that
    differ in such tokens alone score alike, so they are one shape.  Tokens stand by rising contacts; looks that share no
    token of the name with the other side are left out, as they score zero.
    """
    ordered = lambda part: F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("n", "tok")))), lambda x: x["tok"])
    seen = _words(looks).join(common, ["blk", "part", "tok"]).groupBy("look").agg(ordered("n").alias("toks"), ordered("l").alias("ltoks"))
    sizes = looks.select("look", "blk", "qty", F.size("nset").alias("size"), F.size("lset").alias("lsize"))
    return sizes.join(seen.filter(F.size("toks") > 0), "look").select("look", *SHAPE)


def candidate_scores(a_sets: DataFrame, r_sets: DataFrame, t: float) -> DataFrame:
    """Scores (sig, same, score, r_ord) of all pairs that reach ``t``, and of some that do not.

    Both inputs hold distinct ``shapes``; ``r_ord`` is the earliest rival row of a shape.  A score is at most the
    similarity of the names, so their prefixes find every pair.
    """
    a_side = prefix_rows(a_sets, t, size="size").select("sig", "blk", "tok", *SHAPE[1:])
    r_side = prefix_rows(r_sets, t, size="size").select("blk", "tok", "r_ord", *[F.col(c).alias(f"r_{c}") for c in SHAPE[1:]])
    met = a_side.join(r_side, ["blk", "tok"]).filter(close_sizes("size", "r_size", t))
    similarity = counted_similarity(
        *[F.size(F.array_intersect(c, f"r_{c}")) for c in ("toks", "ltoks")], *[F.col(c) for c in ("size", "r_size", "lsize", "r_lsize")]
    )
    scored = met.select("sig", (F.col("qty") == F.col("r_qty")).alias("same"), similarity.alias("score"), "r_ord")
    return scored.filter(F.col("score") > 0)


def best_scores(a_sets: DataFrame, r_sets: DataFrame, threshold: float, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """Best (score, -r_ord) per anchor shape in the same pack and across packs.

    Bounds fall from round to round.  After a round every pair at or over its bound is known, so an
    anchor leaves as soon as its choice is: a same-pack score at the bound and the threshold, a
    cross-pack one once the bound is at the threshold, or any score at the bound below it.  Few anchors
    see the last round, which meets all sets that share a token.
    """
    steps = sorted({t for t in rounds if t > threshold} | {t for t in rounds if t < threshold} | {threshold, 0.0}, reverse=True)
    rank = F.struct(F.col("score"), (-F.col("r_ord")).alias("neg"))
    left, settled = a_sets, []
    for t in steps:
        if settled and left.isEmpty():
            break
        met = candidate_scores(left, r_sets, t)
        best = materialize(
            met.groupBy("sig").agg(F.max(F.when(F.col("same"), rank)).alias("same"), F.max(F.when(~F.col("same"), rank)).alias("cross")), "best"
        )
        same, cross = F.coalesce("same.score", F.lit(0.0)), F.coalesce("cross.score", F.lit(0.0))
        known = (same >= max(t, threshold)) | (F.lit(t <= threshold) & ((cross >= threshold) | (F.greatest(same, cross) >= t)))
        done = best.filter(known) if t > 0 else best
        settled.append(done)
        left = materialize(left.join(done.select("sig"), "sig", "left_anti"), "left")
    return reduce(DataFrame.unionByName, settled)


def match_listings(
    anchors: DataFrame,
    rivals: DataFrame,
    *,
    block: list[str],
    quantity: str = "quantity",
    name: str = "name_clean",
    label: str = "label_clean",
    order: str = "ord",
    payload: list[str],
    threshold: float = 0.6,
    rounds: tuple[float, ...] = ROUNDS,
) -> DataFrame:
    """Best rival per anchor row: same pack first, then any pack, else no match.

    ``order`` is the unique row number of the rivals; the earliest rival wins ties.
    ``payload`` rival columns come back with an ``m_`` prefix.  ``match_score`` of an
    unmatched row is the best score seen.  Copies of a listing are scored once.
    """
    raw = list(dict.fromkeys([*block, quantity, name, label]))
    # Listings are read twice below, and preparing them costs more than writing them.
    anchors = materialize(anchors, "anchors")
    rivals = materialize(rivals.select(*dict.fromkeys([order, *raw, *payload])), "rivals")
    # Rows come down to distinct texts before these are cut into tokens.
    looks = materialize(_looks(widen(anchors.select(*raw).distinct()), block, quantity, name, label), "anchor-looks")
    r_looks = materialize(_looks(widen(rivals.groupBy(*raw).agg(F.min(order).alias("_first"))), block, quantity, name, label), "rival-looks")
    common = materialize(common_words(looks, r_looks), "common-words")
    shaped = materialize(shapes(looks, common).withColumn("sig", F.md5(F.to_json(F.struct(*SHAPE)))), "anchor-shapes")
    a_sets = widen(materialize(shaped.drop("look").dropDuplicates(["sig"]), "anchor-sets"))
    r_shaped = shapes(r_looks, common).join(r_looks.select("look", "_first"), "look")
    r_sets = materialize(r_shaped.groupBy(*SHAPE).agg(F.min("_first").alias("r_ord")), "rival-sets")
    best = best_scores(a_sets, r_sets, threshold, rounds)
    same_ok, cross_ok = F.col("same.score") >= threshold, F.col("cross.score") >= threshold
    chosen = best.select(
        "sig",
        F.when(same_ok, "name_same_bundle").when(cross_ok, "name_cross_bundle").otherwise("no_match").alias("match_method"),
        F.when(same_ok, F.col("same.score")).when(cross_ok, F.col("cross.score"))
        .otherwise(F.greatest(F.col("same.score"), F.col("cross.score"))).alias("match_score"),
        F.when(same_ok, -F.col("same.neg")).when(cross_ok, -F.col("cross.neg")).alias("r_ord"),
    )
    details = rivals.select(F.col(order).alias("r_ord"), *[F.col(c).alias(f"m_{c}") for c in payload])
    keys = [f"_raw{k}" for k in range(len(raw))]
    named = looks.select("look", *[F.col(c).alias(k) for c, k in zip(raw, keys)]).join(shaped.select("look", "sig"), "look")
    chosen = named.join(chosen, "sig").join(details, "r_ord", "left").drop("r_ord", "sig", "look")
    chosen = materialize(chosen, "choices")
    same_look = reduce(Column.__and__, [anchors[c].eqNullSafe(chosen[k]) for c, k in zip(raw, keys)])
    return (
        anchors.join(chosen, same_look, "left")
        .drop(*keys)
        .withColumns(
            {
                "match_method": F.coalesce("match_method", F.lit("no_match")),
                "match_score": round4(F.coalesce("match_score", F.lit(0.0))),
            }
        )
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank_as: str | None = None) -> DataFrame:
    """First ``n`` rows of each key in a total order (partial top-n runs before the shuffle)."""
    from pyspark.sql import Window

    name = rank_as or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank_as else ranked.drop(name)


def first_per_key(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """Earliest whole row per key by aggregation, so a hot key is combined before the shuffle."""
    names = [f"_k{i}" for i in range(len(keys))]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    picked = df.select(*[k.alias(n) for k, n in zip(keys, names)], row.alias("_row"), order.alias("_ord"))
    return picked.groupBy(*names).agg(F.min_by("_row", "_ord").alias("_row")).select("_row.*")
