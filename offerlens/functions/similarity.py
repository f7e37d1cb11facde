"""Name similarity: token overlap in the JVM, sequence ratios in one Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.functions.numbers import let
from offerlens.functions.text import canonical_key, squeeze, tokens

# --- fixed values -----------------------------------------------------------------
TOKEN_WEIGHT, SEQUENCE_WEIGHT, SET_WEIGHT = 0.45, 0.20, 0.35
SIGNATURE_MARKERS = (
    "chardonnay", "pinot noir", "cabernet sauvignon", "sauvignon blanc", "pinot grigio",
    "pinot gris", "barolo", "barbera", "nebbiolo", "shiraz", "syrah", "primitivo",
    "pecorino", "rose", "brut", "champagne",
)
# -------------------------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    """Token-set overlap of two arrays; two empty sets give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def listing_similarity(name_a: Column, name_b: Column, label_a: Column, label_b: Column) -> Column:
    """Whole-name Jaccard, capped by the label Jaccard where both labels exist."""
    full = jaccard(name_a, name_b)
    both = (F.size(label_a) > 0) & (F.size(label_b) > 0)
    return F.when(both, F.least(full, jaccard(label_a, label_b))).otherwise(full)


def counted_similarity(both_names: Column, both_labels: Column, name_a: Column, name_b: Column, label_a: Column, label_b: Column) -> Column:
    """``listing_similarity`` from the tokens that both sides share and the sizes of their sets."""
    share = lambda both, a, b: F.when(a + b == 0, 0.0).otherwise(both / (a + b - both))
    full = share(both_names, name_a, name_b)
    return F.when((label_a > 0) & (label_b > 0), F.least(full, share(both_labels, label_a, label_b))).otherwise(full)


#: Results of distinct pairs that one task keeps.
MEMO_SIZE = 200_000
#: From this length of the second text on, ``SequenceMatcher`` passes over its frequent characters.
FREQUENT_FROM = 200


def ratio_function():
    """``SequenceMatcher(None, a, b).ratio()`` as a function that remembers; null if a side is.

    Everything stands inside, so a task gets it whole and with an empty memory.
    """
    memo: dict[tuple[str, str], int] = {}

    def longest_match(a: str, b: str) -> tuple[int, int, int]:
        """Start in ``a``, start in ``b`` and length of the longest common run; the earliest in ``a``, then in ``b``.

        All pairs of places stand in one number, a row of bytes for each place of ``a`` with a bit for each place
        of ``b``.  Shifting it by a row and a bit follows all runs at once; doubled steps find the longest.
        """
        width = len(b) // 8 + 1
        rows = {c: sum(1 << j for j, d in enumerate(b) if d == c).to_bytes(width, "little") for c in set(a)}
        step = 8 * width + 1
        runs = [int.from_bytes(b"".join([rows[c] for c in a]), "little")]
        if not runs[0]:
            return 0, 0, 0
        while longer := runs[-1] & (runs[-1] >> (step << (len(runs) - 1))):
            runs.append(longer)
        best, size = runs[-1], 1 << (len(runs) - 1)
        for k in range(len(runs) - 2, -1, -1):
            if longer := best & (runs[k] >> (step * size)):
                best, size = longer, size + (1 << k)
        i, j = divmod((best & -best).bit_length() - 1, 8 * width)
        return i, j, size

    def matched(a: str, b: str) -> int:
        """Characters in matching blocks.

        What stands before and after the longest one are texts of their own, and names made of the same words
        have many of them in common, so these are remembered too.
        """
        if not a or not b:
            return 0
        if a == b:
            return len(a)
        found = memo.get((a, b))
        if found is None:
            i, j, size = longest_match(a, b)
            found = size and size + matched(a[:i], b[:j]) + matched(a[i + size :], b[j + size :])
            if len(memo) >= MEMO_SIZE:
                memo.clear()
            memo[(a, b)] = found
        return found

    def ratio(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        if a == b:
            return 1.0
        if max(len(a), len(b)) >= FREQUENT_FROM:
            return SequenceMatcher(None, a, b).ratio()
        return 2.0 * matched(a, b) / (len(a) + len(b))

    return ratio


_ratio = ratio_function()


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-block ratio; several of one row are found in one pass through Python."""
    return pd.Series([_ratio(left, right) for left, right in zip(a, b)], dtype="float64")


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the sorted common tokens against either sorted token set."""
    common = F.array_join(F.sort_array(F.array_intersect(a, b)), " ")
    left = F.array_join(F.sort_array(a), " ")
    right = F.array_join(F.sort_array(b), " ")
    return F.when(common == "", 0.0).otherwise(F.greatest(seq_ratio(common, left), seq_ratio(common, right)))


def seq_bound(a: Column, b: Column) -> Column:
    """No less than ``seq_ratio`` of two keys: the letters, digits and blanks that both hold, wherever they stand."""
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    shared = sum((F.least(count(a, x), count(b, x)) for x in "abcdefghijklmnopqrstuvwxyz0123456789 "), F.lit(0))
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * shared / both)


def token_set_bound(common: Column, width_a: Column, width_b: Column) -> Column:
    """No less than ``token_set_ratio``, from the joined lengths of the common tokens and of both sets: all of them may match."""
    return F.when(common == 0, 0.0).otherwise(2.0 * common / (common + F.least(width_a, width_b)))


def similarity_columns(df, a: str, b: str, prefix: str = "", ordered: bool = True, sets: tuple[str, str] | None = None):
    """Add overlap, token, sequence, set and combined similarity of two key columns.

    ``ordered`` compares the keys as written; otherwise their sorted token sets.  ``sets`` names columns that
    already hold the tokens of the keys.
    """
    ta, tb = map(F.col, sets) if sets else (tokens(F.col(a)), tokens(F.col(b)))
    df = df.withColumns({"_ta": ta, "_tb": tb})
    ta, tb = F.col("_ta"), F.col("_tb")
    left = F.col(a) if ordered else F.array_join(ta, " ")
    right = F.col(b) if ordered else F.array_join(tb, " ")
    df = df.withColumns(
        {
            f"{prefix}overlap": F.size(F.array_intersect(ta, tb)),
            f"{prefix}token_ratio": F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(ta), F.size(tb), F.lit(1)),
            f"{prefix}seq_ratio": seq_ratio(left, right),
            f"{prefix}set_ratio": token_set_ratio(ta, tb),
        }
    )
    either_empty = (F.size("_ta") == 0) | (F.size("_tb") == 0)
    combined = (
        F.col(f"{prefix}token_ratio") * TOKEN_WEIGHT
        + F.col(f"{prefix}seq_ratio") * SEQUENCE_WEIGHT
        + F.col(f"{prefix}set_ratio") * SET_WEIGHT
    )
    return df.withColumn(f"{prefix}combined", F.when(either_empty, 0.0).otherwise(combined)).drop("_ta", "_tb")


def validation_name(c: Column) -> Column:
    """Canonical key without vintage, NV and the word "base"."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*(?:19|20)\d{2}\s+", "")
    out = F.regexp_replace(out, r"(?i)^\s*nv\s+", "")
    return squeeze(F.regexp_replace(canonical_key(out), r"\bbase\b", " "))


def _marker_keys() -> list[str]:
    """Canonical form of the markers; those made only of stop words vanish."""
    from offerlens.functions.text import DROP_TOKENS

    keys = [" ".join(w for w in m.split() if w not in DROP_TOKENS) for m in SIGNATURE_MARKERS]
    return [k for k in keys if k]


def _markers_in(norm: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(k)), F.lit(k)) for k in dict.fromkeys(_marker_keys())]))


def signature_tokens(c: Column) -> Column:
    return let(validation_name(c), _markers_in)


def page_match_confident(expected: Column, candidate: Column, context: Column) -> Column:
    """Does a page name plausibly belong to the expected listing?  Blank sides pass.

    The keys are costly, so they are bound once and everything else reads them.
    """
    e, c = validation_name(expected), validation_name(candidate)
    shown = validation_name(F.concat_ws(" ", F.nullif(candidate, F.lit("")), F.nullif(context, F.lit(""))))
    keys = F.struct(e.alias("e"), c.alias("c"), shown.alias("shown"), seq_ratio(e, c).alias("seq"))

    def judge(k: Column) -> Column:
        sets = F.struct(
            tokens(k["e"]).alias("te"), tokens(k["c"]).alias("tc"), _markers_in(k["e"]).alias("se"), _markers_in(k["shown"]).alias("sc")
        )

        def by_words(s: Column) -> Column:
            clash = (F.size(s["se"]) > 0) & (F.size(s["sc"]) > 0) & ~F.arrays_overlap(s["se"], s["sc"])
            size = F.greatest(F.size(s["te"]), F.size(s["tc"]), F.lit(1))
            return let(
                F.size(F.array_intersect(s["te"], s["tc"])),
                lambda n: F.when(n < 2, False).when((n / size < 0.70) & (k["seq"] < 0.72), False).otherwise(~clash),
            )

        return F.when((k["e"] == "") | (k["c"] == ""), True).otherwise(let(sets, by_words))

    return let(keys, judge)


def core_name(c: Column) -> Column:
    """Core words of a listing used to compare it with a page name."""
    out = F.regexp_replace(c, r"(?i)^\d{4}\s+|^nv\s+", "")
    out = F.regexp_replace(
        out, r"(?i)\b(?:red|white|rose|750\s*ml|1\.5\s*l|standard\s*bottle|magnum|bundle\s*of\s*\d+)\b", ""
    )
    return squeeze(F.regexp_replace(F.lower(out), r"[^a-z0-9\s]", ""))


def page_name_similarity(expected: Column, found: Column) -> Column:
    e, f = core_name(expected), core_name(found)
    return F.when((F.coalesce(e, F.lit("")) == "") | (F.coalesce(f, F.lit("")) == ""), 0.0).otherwise(seq_ratio(e, f))


@F.pandas_udf(T.BooleanType())
def fuzzy_any_in(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """True where some needle is a substring of the text or close to one of its words."""
    memo: dict[tuple[str, str, float], bool] = {}

    def alike(needle, word, limit):
        key = (needle, word, limit)
        found = memo.get(key)
        if found is None:
            if len(memo) >= MEMO_SIZE:
                memo.clear()
            m = SequenceMatcher(None, needle, word)
            # The first two are upper bounds of the ratio.
            found = memo[key] = m.real_quick_ratio() >= limit and m.quick_ratio() >= limit and m.ratio() >= limit
        return found

    def close(needle, text, limit):
        return needle in text or any(alike(needle, w, limit) for w in text.split())

    for needles, haystack, threshold in batches:
        yield pd.Series(
            [
                None if terms is None or text is None else any(close(t, text, limit) for t in terms)
                for terms, text, limit in zip(needles, haystack, threshold)
            ]
        )


def fuzzy_in(needle: Column, haystack: Column, threshold: float = 0.75) -> Column:
    return fuzzy_any_in(F.array(needle), haystack, F.lit(threshold))
