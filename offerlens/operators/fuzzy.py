"""Fuzzy lookup of names: a prefix join bounded by the score, with falling bounds.

The score of a pair is bounded by what its sizes allow: the share of common tokens, their characters
against the shorter name, and the lengths of the texts.  For a bound and two sizes this gives the least
number of tokens a pair must share.  Tokens stand by rising frequency, so sets that share so many share
two among the first of each, and only pairs of such tokens are joined; the contact counts at the first
two common tokens, once.

Bounds fall from round to round and a target leaves as soon as its outcome is known: everything that
could beat or challenge its best row has been seen.  A target left below the score gate can only win by
a name that holds nearly all of another one, so a containment join follows, and only targets that it
finds go on to the lowest bounds.  No limit changes the plan, and no token is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.similarity import SEQUENCE_WEIGHT, SET_WEIGHT, TOKEN_WEIGHT, similarity_columns
from offerlens.functions.text import canonical_key, extract_year, let, tokens
from offerlens.operators.linkage import top_per_key
from offerlens.operators.prefixjoin import EPS, frequencies, with_ordered
from offerlens.session import materialize, widen

# --- fixed values: gates of the fuzzy tier ------------------------------------------
MIN_OVERLAP, MIN_COMBINED, MIN_TOKEN, STRONG_SET, LEAD, LEAD_EXEMPT_SET = 2, 0.60, 0.35, 0.85, 0.02, 0.88
# -------------------------------------------------------------------------------------

#: An accepted row scores at least the weight of its set ratio; no other pair below this can stand within the lead of it.
SCORE_FLOOR = SET_WEIGHT * STRONG_SET - LEAD
#: Bounds above the score gate, and below it for names that hold another one.
UPPER = (0.95, 0.85, 0.70, MIN_COMBINED - LEAD)
LOWER = (0.45, SCORE_FLOOR)


def candidate_name() -> Column:
    return F.coalesce(F.nullif(F.col("match_name"), F.lit("")), F.col("wine_name"))


def _gates(overlap: Column, combined: Column, token: Column, set_ratio: Column) -> Column:
    return (
        (overlap >= MIN_OVERLAP)
        & ((combined >= MIN_COMBINED) | (set_ratio >= STRONG_SET))
        & ((token >= MIN_TOKEN) | (set_ratio >= STRONG_SET))
    )


def _with_tokens(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Token set, its size, the characters of its longest tokens, and the lengths of text and set."""
    own = F.col(f"{prefix}set")
    df = df.withColumn(f"{prefix}set", tokens(F.col(key)))
    longest = F.reverse(F.sort_array(F.transform(own, F.length)))
    grown = F.aggregate(longest, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + 1, F.lit(0)) + n))
    return df.withColumns({f"{prefix}chars": grown, f"{prefix}len": F.length(key), f"{prefix}slen": F.length(F.array_join(own, " "))})


def least_shared(size: Column, chars: Column, set_length: Column, other: Column, bound: float) -> Column:
    """Fewest tokens a set must share with one of ``other`` tokens to reach the bound; null if it cannot.

    ``chars`` holds the characters of its 1, 2, ... longest tokens with the blanks between.  The set ratio
    is taken against the shorter side: this one, or another whose further tokens have a letter and a blank each.
    """

    def reaches(o: Column) -> Column:
        c = F.element_at(chars, o)
        set_bound = F.greatest(2 * c / (c + set_length), c / (c + other - o))
        return o / F.greatest(size, other) * TOKEN_WEIGHT + SEQUENCE_WEIGHT + set_bound * SET_WEIGHT >= bound - EPS

    return F.try_element_at(F.filter(F.sequence(F.lit(1), F.least(size, other)), reaches), F.lit(1))


def least_contained(chars: Column, set_length: Column) -> Column:
    """Fewest common tokens with which a set can reach the strong set ratio as the shorter side."""
    needed = STRONG_SET / (2 - STRONG_SET) * set_length - EPS
    return F.greatest(F.try_element_at(F.filter(F.sequence(F.lit(1), F.size(chars)), lambda o: F.element_at(chars, o) >= needed), F.lit(1)), F.lit(MIN_OVERLAP))


def _prefix_pairs(toks: Column) -> Column:
    """Hashes of all pairs of tokens, those of the first two, three, ... tokens in front."""
    hashed = F.transform(toks, lambda x: F.xxhash64(x))

    def ending_at(y: Column, i: Column) -> Column:
        return F.transform(F.slice(hashed, F.lit(1), i), lambda x: F.xxhash64(x, y))

    return F.flatten(F.transform(hashed, ending_at))


def _n_pairs(tokens_in_front: Column) -> Column:
    return (tokens_in_front * (tokens_in_front - 1) / 2).cast("int")


def _front(size: Column, shared: Column) -> Column:
    """How many tokens in front hold two common ones, if sets share ``shared`` or more."""
    return F.least(size, size - F.greatest(shared, F.lit(2)) + 2)


def sized_keys(df: DataFrame, prefix: str, sizes: list[int], bound: float, mine_first: bool) -> DataFrame:
    """(kind, key, id) of a set for every partner size with which it can reach the bound.

    Sets that may share a single token also emit their tokens alone.
    """
    size, pairs = F.size(f"{prefix}toks"), F.col(f"{prefix}pairs")
    own = df.withColumns({"_n": size, "_m": F.explode(F.array(*map(F.lit, sizes)))})
    own = own.withColumn("_o", least_shared(F.col("_n"), F.col(f"{prefix}chars"), F.col(f"{prefix}slen"), F.col("_m"), bound)).filter("_o is not null")
    kind = F.concat_ws("|", "blk", *(["_n", "_m"] if mine_first else ["_m", "_n"]))
    shared = F.slice(pairs, F.lit(1), _n_pairs(_front(F.col("_n"), F.col("_o"))))
    alone = F.when(F.col("_o") == 1, F.transform(f"{prefix}toks", lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
    return own.select(F.xxhash64(kind).alias("kind"), F.explode(F.concat(shared, alone)).alias("key"), f"{prefix}id")


def containment_keys(df: DataFrame, prefix: str, mine_first: bool) -> DataFrame:
    """(kind, key, id) of a set as the one that is held, by its front, and as the one that holds, by all pairs."""
    pairs, size = F.col(f"{prefix}pairs"), F.size(f"{prefix}toks")
    held, holds = ("t", "e") if mine_first else ("e", "t")
    front = F.slice(pairs, F.lit(1), _n_pairs(_front(size, least_contained(F.col(f"{prefix}chars"), F.col(f"{prefix}slen")))))
    parts = [(held, front), (holds, pairs)]
    return reduce(DataFrame.union, [df.select(F.xxhash64("blk", F.lit(k)).alias("kind"), F.explode(p).alias("key"), f"{prefix}id") for k, p in parts])


def _bounded(pairs: DataFrame, t: DataFrame, e: DataFrame) -> DataFrame:
    """Pairs (tid, eid) with their sides and the upper bound of their score.

    A matching-block ratio of two texts is at most twice the shorter length over the sum.
    """
    df = pairs.join(t.drop("tpairs", "tchars"), "tid").join(e.drop("blk", "epairs", "echars"), "eid")
    shared = let(F.array_intersect("ttoks", "etoks"), lambda s: F.struct(F.size(s).alias("_both"), F.length(F.array_join(s, " ")).alias("_chars")))
    # A generated row is computed once, however often the filters below look at it.
    df = df.select("*", F.inline(F.array(shared)))
    set_bound = 2 * F.col("_chars") / (F.col("_chars") + F.least("tslen", "eslen"))
    seq_bound = 2 * F.least("tlen", "elen") / (F.col("tlen") + F.col("elen"))
    df = df.withColumns({"_tok": F.col("_both") / F.greatest(F.size("ttoks"), F.size("etoks")), "_set": set_bound})
    df = df.withColumn("bound", F.col("_tok") * TOKEN_WEIGHT + seq_bound * SEQUENCE_WEIGHT + F.col("_set") * SET_WEIGHT)
    return df.withColumn("can_win", _gates(F.col("_both"), F.col("bound"), F.col("_tok"), F.col("_set")))


def round_contacts(t: DataFrame, e: DataFrame, bound: float) -> DataFrame:
    """(tid, eid) of all contacts of one round, before anything is compared; a pair can meet more than once."""
    t_sizes, e_sizes = (sorted(r["n"] for r in df.select(F.size(c).alias("n")).distinct().collect()) for df, c in ((t, "ttoks"), (e, "etoks")))
    left, right = sized_keys(t, "t", e_sizes, bound, True), sized_keys(e, "e", t_sizes, bound, False)
    return left.join(right, ["kind", "key"]).select("tid", "eid")


def candidates(t: DataFrame, e: DataFrame, bound: float) -> DataFrame:
    """Pairs whose score could reach the bound, each once, with the bound of its own score."""
    pairs = _bounded(round_contacts(t, e, bound).distinct(), t, e)
    return pairs.filter(F.col("bound") >= bound - EPS).select("tid", "ckey", "eid", "ekey", "first", "copies", "bound")


def containment(t: DataFrame, e: DataFrame) -> DataFrame:
    """Targets (``tid``) that some entry could win below the score gate, by a strong set ratio."""
    met = containment_keys(t, "t", True).join(containment_keys(e, "e", False), ["kind", "key"]).select("tid", "eid").distinct()
    return _bounded(met, t, e).filter("can_win").select("tid").distinct()


def best_two(pairs: DataFrame) -> DataFrame:
    """Exact scores of each target's best pair, and the score next to it.

    The most promising pair of a target is scored first; then only pairs that could still matter beside it.
    """
    lead = pairs.groupBy("tid").agg(F.max_by(F.struct("ckey", "ekey"), F.struct("bound", -F.col("first"))).alias("p"))
    lead = similarity_columns(lead.select("tid", "p.ckey", "p.ekey"), "ckey", "ekey").select("tid", (F.col("combined") - LEAD - EPS).alias("need"))
    wanted = materialize(pairs.join(lead, "tid").filter("bound > need"), "fuzzy-pairs")
    scored = similarity_columns(wanted, "ckey", "ekey").filter("combined > 0")
    top = top_per_key(scored, ["tid"], [F.col("combined").desc(), F.col("first").asc()], n=2, rank_as="rk")
    pick = lambda c, k: F.max(F.when(F.col("rk") == k, F.col(c)))
    return top.groupBy("tid").agg(
        *[pick(c, 1).alias(c) for c in ("combined", "token_ratio", "set_ratio", "overlap", "first", "copies")], pick("combined", 2).alias("next")
    )


def _blocks(targets: DataFrame, rows: DataFrame, dedupe_candidates: bool) -> tuple[DataFrame, DataFrame]:
    """Targets with the block they look into, and distinct entries of all blocks."""
    # A row whose two names carry a year enters the block once per name.
    # Rows with the same names share their keys and years, so these are made once.
    named = rows.groupBy("wine_name", "match_name").agg(F.min("ord").alias("ord"), F.count("*").alias("rows")).select(
        "ord",
        "rows",
        canonical_key(candidate_name()).alias("ekey"),
        F.array_compact(F.array(extract_year(F.col("wine_name")), extract_year(F.col("match_name")))).alias("years"),
    )
    if dedupe_candidates:
        named = named.withColumn("years", F.array_distinct("years"))
    # The steps below read this narrow table several times.
    named = materialize(named, "rating-keys")
    by_year = named.select(F.explode("years").alias("blk"), "ord", "rows", "ekey").withColumn("blk", F.col("blk").cast("string"))
    # At most 200 distinct years exist, so this side is always small.
    years = by_year.select("blk").distinct()
    entries = (
        by_year.unionByName(named.select(F.lit("*").alias("blk"), "ord", "rows", "ekey"))
        .filter("ekey != ''")
        .groupBy("blk", "ekey")
        .agg(F.min("ord").alias("first"), F.sum("rows").alias("copies"))
    )
    blocked = (
        targets.filter("ckey != ''")
        .withColumn("ystr", F.col("year").cast("string"))
        .join(F.broadcast(years.withColumnRenamed("blk", "ystr").withColumn("found", F.lit(True))), "ystr", "left")
        .select("ckey", "year", F.when(F.col("found"), F.col("ystr")).otherwise("*").alias("blk"))
    )
    return materialize(blocked, "target-blocks"), entries


def token_tables(blocked: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets and entries, numbered, with their tokens by rising frequency and the pairs of these."""
    t = materialize(_with_tokens(blocked.select("blk", "ckey").distinct(), "ckey", "t").withColumn("tid", F.monotonically_increasing_id()), "fuzzy-targets")
    e = materialize(_with_tokens(entries, "ekey", "e").withColumn("eid", F.monotonically_increasing_id()), "fuzzy-entries")
    freq = frequencies((t, "tset"), (e, "eset"))
    t = with_ordered(t, "tid", "tset", freq, "ttoks").drop("tset").withColumn("tpairs", _prefix_pairs(F.col("ttoks")))
    e = with_ordered(e, "eid", "eset", freq, "etoks").drop("eset").withColumn("epairs", _prefix_pairs(F.col("etoks")))
    return widen(materialize(t, "target-tokens")), widen(materialize(e, "entry-tokens"))


def within(e: DataFrame, left: DataFrame) -> DataFrame:
    """Entries of the blocks that targets still look into."""
    return e.join(left.select("blk").distinct(), "blk", "left_semi")


def fuzzy_match(
    targets: DataFrame, rows: DataFrame, *, upper: tuple[float, ...] = UPPER, lower: tuple[float, ...] = LOWER, dedupe_candidates: bool = False
) -> DataFrame:
    """Accepted fuzzy row per target as (ckey, year, ord, fuzzy_score).

    ``targets`` holds distinct (ckey, year); candidates come from the target's year block, or
    from all rows where that block is empty.  The result is exact for every target.
    """
    blocked, entries = _blocks(targets, rows, dedupe_candidates)
    t, e = token_tables(blocked, entries)
    left, settled = t, []
    for bound in (*upper, None, *lower):
        if bound is None:
            left = materialize(left.join(containment(left, within(e, left)), "tid", "left_semi"), "fuzzy-left")
        else:
            best = materialize(best_two(materialize(candidates(left, within(e, left), bound), "fuzzy-candidates")), "fuzzy-best")
            # A clear best score needs its lead seen; one that needs none, or shares its row, only itself.
            alone = (F.col("set_ratio") >= LEAD_EXEMPT_SET) | (F.col("copies") > 1)
            known = F.col("combined") >= bound + F.when(alone, 0.0).otherwise(LEAD) + EPS
            done = best.filter(known) if bound != lower[-1] else best
            settled.append(done)
            left = materialize(left.join(done.select("tid"), "tid", "left_anti"), "fuzzy-left")
        if left.isEmpty():
            break
    winner = reduce(DataFrame.unionByName, settled)
    runner_up = F.when(F.col("copies") > 1, F.col("combined")).otherwise(F.col("next"))
    clear = runner_up.isNull() | (F.col("combined") - runner_up >= LEAD) | (F.col("set_ratio") >= LEAD_EXEMPT_SET)
    accepted = winner.filter(
        _gates(F.col("overlap"), F.col("combined"), F.col("token_ratio"), F.col("set_ratio")) & clear
    ).select("tid", F.col("first").alias("ord"), F.col("combined").alias("fuzzy_score"))
    named = t.select("tid", "blk", "ckey").join(accepted, "tid").drop("tid")
    return blocked.join(named, ["blk", "ckey"]).select("ckey", "year", "ord", "fuzzy_score")
