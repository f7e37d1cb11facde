"""Rating lookup for listing names: exact key, canonical key, then fuzzy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.numbers import has_value, parse_float, parse_int, blank_to_null
from offerlens.functions.text import canonical_key, extract_year, normalize_key
from offerlens.functions.urls import clean_url, normalize_item_url, search_url
from offerlens.operators.fuzzy import candidate_name, fuzzy_match
from offerlens.session import materialize


def tag_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def row_quality(order: str = "ord") -> Column:
    """Rows with a rating first, then count, address, price; the later row wins ties."""
    count = F.coalesce(blank_to_null(F.col("num_ratings")), blank_to_null(F.col("alt_num_ratings")))
    return F.struct(
        has_value(F.col("rating")).alias("q1"),
        count.isNotNull().alias("q2"),
        has_value(F.col("url")).alias("q3"),
        has_value(F.col("price")).alias("q4"),
        F.col(order).alias("q5"),
    )


def best_row_per_key(rows: DataFrame, text: str, key: Callable[[Column], Column], order: str = "ord") -> DataFrame:
    """(key, ord) of the best row per non-blank ``key`` of the column ``text``.

    Keys are costly and rows repeat their texts, so rows come down to the last of each text and quality
    first, by a hash aggregation that combines before it shuffles.
    """
    marks = ["q1", "q2", "q3", "q4"]
    last = (
        rows.filter(F.col(text).isNotNull())
        .select(F.col(text).alias("_text"), row_quality(order).alias("_q"))
        .groupBy("_text", *[F.col(f"_q.{m}").alias(m) for m in marks])
        .agg(F.max("_q.q5").alias("_o"))
    )
    # Written, as the filter on the key would be taken below the aggregation and make it for every row again.
    last = materialize(last, "texts")
    return (
        last.select(key(F.col("_text")).alias("key"), F.struct(*marks, "_o").alias("_q"), "_o")
        .filter(F.coalesce(F.col("key"), F.lit("")) != "")
        .groupBy("key")
        .agg(F.max_by("_o", "_q").alias("ord"))
    )


def exact_index(rows: DataFrame) -> DataFrame:
    """Best row per normalised name, keyed by both name columns."""
    both = rows.withColumn("_name", F.explode(F.array("wine_name", "match_name")))
    return best_row_per_key(both, "_name", normalize_key)


def url_index(rows: DataFrame) -> DataFrame:
    return best_row_per_key(rows, "url", normalize_item_url)


def canonical_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earliest row per canonical key, and per (canonical key, year)."""
    # Rows with the same names share their keys and years.
    names = rows.groupBy("wine_name", "match_name").agg(F.min("ord").alias("ord"))
    keyed = names.select(
        "ord",
        extract_year(candidate_name()).alias("cyear"),
        F.explode(F.array("wine_name", "match_name")).alias("_name"),
    ).select("ord", "cyear", canonical_key(F.col("_name")).alias("ckey")).filter("ckey != ''")
    any_year = keyed.groupBy("ckey").agg(F.min("ord").alias("any_ord"))
    by_year = keyed.filter("cyear is not null").groupBy("ckey", "cyear").agg(F.min("ord").alias("year_ord"))
    return any_year, by_year


def match_names(names: DataFrame, rows: DataFrame, *, name: str = "offer_name", fuzzy: bool = True, dedupe_candidates: bool = False) -> DataFrame:
    """Distinct names with their ``match_method`` and the ``ord`` of the matched rating row.

    Tiers run cheapest first and each sees only what the earlier ones left over; a canonical
    hit never falls through to the fuzzy tier, which is left out without ``fuzzy``.
    """
    t = (
        names.select(name)
        .distinct()
        .withColumns(
            {
                "nkey": normalize_key(F.col(name)),
                "ckey": canonical_key(F.col(name)),
                "year": extract_year(F.col(name)),
            }
        )
    )
    # Written once: the tiers below each read both sides.
    t = materialize(t, "target-keys")
    rows = materialize(rows.select("ord", "wine_name", "match_name", "rating", "num_ratings", "alt_num_ratings", "url", "price"), "rating-rows")
    any_year, by_year = canonical_index(rows)
    keyed = (
        t.join(exact_index(rows).withColumnsRenamed({"key": "nkey", "ord": "exact_ord"}), "nkey", "left")
        .join(any_year, "ckey", "left")
        .join(by_year.withColumnRenamed("cyear", "year"), ["ckey", "year"], "left")
    )
    settled = keyed.select(
        name,
        "ckey",
        "year",
        F.coalesce("exact_ord", "year_ord", "any_ord").alias("ord"),
        F.when(F.col("exact_ord").isNotNull(), "exact").when(F.col("any_ord").isNotNull(), "canonical").alias("match_method"),
    )
    if not fuzzy:
        return settled.select(name, F.coalesce("match_method", F.lit("none")).alias("match_method"), "ord", F.lit(None).cast("double").alias("fuzzy_score"))
    settled = materialize(settled, "settled-names")
    rest = settled.filter("match_method is null and ckey != ''").select("ckey", "year").distinct()
    found = fuzzy_match(rest, rows, dedupe_candidates=dedupe_candidates).select(
        "ckey", F.coalesce("year", F.lit(-1)).alias("ykey"), F.col("ord").alias("fuzzy_ord"), "fuzzy_score"
    )
    return (
        settled.withColumn("ykey", F.coalesce("year", F.lit(-1)))
        .join(found, ["ckey", "ykey"], "left")
        .select(
            name,
            F.coalesce("match_method", F.when(F.col("fuzzy_ord").isNotNull(), "fuzzy"), F.lit("none")).alias("match_method"),
            F.coalesce("ord", "fuzzy_ord").alias("ord"),
            F.when(F.col("match_method").isNull(), F.col("fuzzy_score")).alias("fuzzy_score"),
        )
    )


RATING_FIELDS = [
    "wine_name", "match_name", "rating", "num_ratings", "alt_num_ratings", "price", "url", "description", "grapes", "region", "source",
]


def attach_ratings(offers: DataFrame, rows: DataFrame, *, name: str = "offer_name", fuzzy: bool = True) -> DataFrame:
    """Offers with the matched rating row (``r_`` columns), hydrated metrics and final method.

    Steps: cascade; a match without rating, count and address counts as none; a matched address
    without metrics takes those of the best row with that address; then ``url_only`` and
    ``catalogue`` (the listing's own rating) labels and a search address where only that is missing.
    """
    matched = materialize(match_names(offers, rows, name=name, fuzzy=fuzzy), "matched-names")
    picked = matched.join(rows.select("ord", *[F.col(c).alias(f"r_{c}") for c in RATING_FIELDS]), "ord", "left").drop("ord")
    # Metrics are resolved per distinct name, before copies of a listing come back in.
    picked = picked.withColumns(
        {
            "rating": parse_float(F.col("r_rating")),
            "num_ratings": F.coalesce(
                F.nullif(parse_int(F.col("r_num_ratings")), F.lit(0)), parse_int(F.col("r_alt_num_ratings"))
            ),
            "rating_url": normalize_item_url(F.col("r_url")),
        }
    )
    empty = F.col("rating").isNull() & F.col("num_ratings").isNull() & F.col("rating_url").isNull()
    picked = picked.withColumn("match_method", F.when(empty, "none").otherwise(F.col("match_method")))
    picked = picked.withColumns(
        {f"r_{c}": F.when(F.col("match_method") != "none", F.col(f"r_{c}")) for c in RATING_FIELDS}
    )
    by_url = (
        url_index(rows)
        .join(rows.select("ord", "rating", "num_ratings", "alt_num_ratings"), "ord")
        .select(
            F.col("key").alias("rating_url"),
            parse_float(F.col("rating")).alias("u_rating"),
            F.coalesce(F.nullif(parse_int(F.col("num_ratings")), F.lit(0)), parse_int(F.col("alt_num_ratings"))).alias("u_num"),
        )
    )
    bare = F.col("rating").isNull() & F.col("num_ratings").isNull()
    picked = (
        picked.join(by_url, "rating_url", "left")
        .withColumns(
            {
                "rating": F.when(bare, F.col("u_rating")).otherwise(F.col("rating")),
                "num_ratings": F.when(bare, F.col("u_num")).otherwise(F.col("num_ratings")),
            }
        )
        .drop("u_rating", "u_num")
    )
    picked = picked.withColumn(
        "match_method",
        F.when((F.col("match_method") != "none") & F.col("rating_url").isNotNull() & F.col("rating").isNull() & F.col("num_ratings").isNull(), "url_only")
        .otherwise(F.col("match_method")),
    )
    return relabel(offers.join(picked, name, "left"), name)


def relabel(df: DataFrame, name: str) -> DataFrame:
    """Catalogue fallback and generated search address."""
    own = parse_float(F.col("cat_rating"))
    fallback = (F.col("match_method") == "none") & own.isNotNull()
    df = df.withColumn("_fallback", fallback).withColumns(
        {
            "rating": F.when(fallback, own).otherwise(F.col("rating")),
            "num_ratings": F.when(fallback, parse_int(F.col("cat_num_ratings"))).otherwise(F.col("num_ratings")),
            "rating_url": F.when(fallback, clean_url(F.col("cat_url"))).otherwise(F.col("rating_url")),
            "match_method": F.when(fallback, "catalogue").otherwise(F.col("match_method")),
        }
    ).drop("_fallback")
    query = F.coalesce(F.nullif(F.col("r_wine_name"), F.lit("")), F.nullif(F.col("r_match_name"), F.lit("")), F.col(name))
    return df.withColumn(
        "rating_url",
        F.when(F.col("rating_url").isNull() & F.col("rating").isNotNull(), search_url(query)).otherwise(F.col("rating_url")),
    )


def market_lookup(market: DataFrame, order: str = "ord") -> DataFrame:
    """Last market row per canonical key among rows with a name and a price."""
    return (
        market.filter(has_value(F.col("match_name")) & (F.coalesce(F.col("price"), F.lit("")) != ""))
        .select(canonical_key(F.col("match_name")).alias("mkey"), F.struct("price", "retailer_name", "retailer_url").alias("m"), F.col(order).alias("_o"))
        .filter("mkey != ''")
        .groupBy("mkey")
        .agg(F.max_by("m", "_o").alias("m"))
        .select("mkey", "m.*")
    )


def attach_market_price(offers: DataFrame, market: DataFrame, *, name: str = "offer_name", order: str = "ord") -> DataFrame:
    """Market price scaled to the listing, with retailer name and address."""
    from offerlens.functions.pricing import scale_to_listing

    found = market_lookup(market, order).withColumnsRenamed({"price": "_mp", "retailer_name": "_mn", "retailer_url": "_mu"})
    raw = parse_float(F.col("_mp"))
    return (
        offers.withColumn("mkey", canonical_key(F.col(name)))
        .join(found, "mkey", "left")
        .withColumns(
            {
                "price_market": scale_to_listing(raw, F.col("quantity"), F.col("volume")),
                "market_retailer_name": F.nullif(F.col("_mn"), F.lit("")),
                "market_retailer_url": F.nullif(F.col("_mu"), F.lit("")),
            }
        )
        .drop("mkey", "_mp", "_mn", "_mu")
    )
