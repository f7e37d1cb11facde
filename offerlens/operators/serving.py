"""Filtered listings, facets, statistics, map points, families and style groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens import settings
from offerlens.functions.metadata import METADATA_COLOURS, continent_of
from offerlens.functions.numbers import blank_to_null, mean2, round2, strip, text, weighted_mean
from offerlens.functions.pricing import recommendation_score, verdict
from offerlens.operators.linkage import top_per_key
from offerlens.settings import SIDES, SideLabels

# --- fixed values -----------------------------------------------------------------
SORT_ALIASES = {
    "score": "deal_score",
    "price_diff_percent": "price_diff_pct",
    "price_difference_pct": "price_diff_pct",
    "difference_pct": "price_diff_pct",
    "price_gap_pct": "price_diff_pct_abs",
    "percent_difference": "price_diff_pct_abs",
    "percent_gap": "price_diff_pct_abs",
    "price_diff_pct_abs": "price_diff_pct_abs",
    "ratings": "num_ratings",
    "price": "anchor_price",
    "name": "offer_name",
}
# Secondary keys per primary key; "-" sorts descending.
SORT_TIES = {
    "deal_score": ["price_diff_pct", "-rating", "-num_ratings", "offer_name", "offer_id"],
    "price_diff_pct": ["-deal_score", "-rating", "-num_ratings", "offer_name", "offer_id"],
    "price_diff_pct_abs": ["-deal_score", "price_diff_pct", "-rating", "offer_name", "offer_id"],
    "rating": ["-num_ratings", "-deal_score", "price_diff_pct", "offer_name", "offer_id"],
    "num_ratings": ["-rating", "-deal_score", "price_diff_pct", "offer_name", "offer_id"],
    "anchor_price": ["-deal_score", "-rating", "offer_name", "offer_id"],
    "offer_name": ["-deal_score", "-rating", "offer_id"],
}
EXACT_FILTERS = ("country", "region", "wine_type", "style_family", "offering_type", "producer")
SEARCH_COLUMNS = ("offer_name", "rating_description", "grapes", "region", "producer")
FACETS = ("country", "region", "wine_type", "style_family", "offering_type", "producer")
STYLE_GROUP_ORDER = ("Red", "White", "Champagne", "Sparkling", "Rose", "Sweet / Dessert", "Orange", "Unclassified")
STYLE_BUTTON_ORDER = ("Red", "White", "Sparkling", "Champagne", "Sweet / Dessert", "Rose", "Orange")
# -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class OfferFilter:
    """What a listing request may restrict; blank or None means no restriction."""

    min_score: float = 0.0
    only_anchor_cheaper: bool = False
    comparable_only: bool = False
    search: str | None = None
    cheaper_side: str | None = None
    min_rating: float | None = None
    min_num_ratings: int | None = None
    max_anchor_price: float | None = None
    country: str | None = None
    region: str | None = None
    wine_type: str | None = None
    style_family: str | None = None
    grape: str | None = None
    offering_type: str | None = None
    producer: str | None = None


def _listed(raw: str | None) -> list[str]:
    return [p.strip() for p in (raw or "").split(",") if p.strip()]


def any_of(column: str, raw: str | None) -> Column | None:
    """Comma-separated values, compared without case."""
    values = [v.lower() for v in _listed(raw)]
    return F.lower(F.col(column)).isin(values) if values else None


def contains_any_of(column: str, raw: str | None) -> Column | None:
    """Comma-separated substrings, compared without case; % and _ are plain characters."""
    hit = None
    for value in _listed(raw):
        one = F.contains(F.lower(F.col(column)), F.lit(value.lower()))
        hit = one if hit is None else hit | one
    return hit


def search_predicate(phrase: str | None, columns=SEARCH_COLUMNS) -> Column | None:
    if not phrase:
        return None
    needle = F.lit(phrase.strip().lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
    return hit


def filter_offers(df: DataFrame, f: OfferFilter, sides: SideLabels = SIDES) -> DataFrame:
    """Apply a request; simple comparisons reach the Parquet scan as pushed filters."""
    wanted: list[Column | None] = [F.col("deal_score") >= f.min_score]
    side = f.cheaper_side or (sides.anchor if f.only_anchor_cheaper else None)
    if side and side.lower() != "all":
        wanted.append(F.col("cheaper_side") == side)
    if f.comparable_only:
        wanted.append(F.col("price_diff_pct").isNotNull() & (F.col("rating").isNotNull() | F.col("num_ratings").isNotNull()))
    if f.search:
        wanted.append(search_predicate(f.search, [c for c in SEARCH_COLUMNS if c in df.columns]))
    if f.min_rating is not None:
        wanted.append(F.col("rating") >= f.min_rating)
    if f.min_num_ratings is not None:
        wanted.append(F.col("num_ratings") >= f.min_num_ratings)
    if f.max_anchor_price is not None:
        wanted.append(F.col("anchor_price") <= f.max_anchor_price)
    wanted += [any_of(c, getattr(f, c)) for c in EXACT_FILTERS]
    wanted.append(contains_any_of("grapes", f.grape))
    for predicate in wanted:
        if predicate is not None:
            df = df.filter(predicate)
    return df


def sort_keys(sort_by: str | None, direction: str | None) -> list[Column]:
    """Primary key in the asked direction, then the fixed ties; NULLs always last."""
    name = (sort_by or "deal_score").lower()
    name = SORT_ALIASES.get(name, name)
    if name not in SORT_TIES:
        name = "deal_score"
    primary = F.abs(F.col("price_diff_pct")) if name == "price_diff_pct_abs" else F.col(name)
    ascending = (direction or "").lower() == "asc"
    keys = [primary.asc_nulls_last() if ascending else primary.desc_nulls_last()]
    for tie in SORT_TIES[name]:
        keys.append(F.col(tie[1:]).desc_nulls_last() if tie[0] == "-" else F.col(tie).asc_nulls_last())
    return keys


def page(df: DataFrame, keys: list[Column], *, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of at most 500 rows (a top-n, not a full sort)."""
    return df.orderBy(*keys).offset(offset).limit(min(limit, settings.PAGE_LIMIT))


def add_insights(df: DataFrame, sides: SideLabels = SIDES) -> DataFrame:
    """Response columns derived per row."""
    return df.withColumns(
        {
            "price_diff_pct_abs": round2(F.abs(F.col("price_diff_pct"))),
            "has_competitor_match": F.col("price_diff_pct").isNotNull(),
            "is_anchor_cheaper": F.coalesce(F.col("cheaper_side") == sides.anchor, F.lit(False)),
            "is_good_wine": F.coalesce(F.col("rating") >= 4.0, F.lit(False)),
            "is_high_confidence": F.coalesce(F.col("num_ratings") >= 100, F.lit(False)),
            **verdict(F.col("cheaper_side"), F.col("rating"), F.col("num_ratings"), sides),
        }
    )


def unresolved_export(df: DataFrame, locked: DataFrame | None = None, *, limit: int = 500, include_locked: bool = False) -> DataFrame:
    """Unrated offers as text columns, best score first; locked names left out by an anti join."""
    open_rows = df.filter(F.col("rating").isNull() & F.col("num_ratings").isNull())
    if locked is not None and not include_locked:
        names = locked.select(blank_to_null(F.col("offer_name")).alias("offer_name")).filter("offer_name is not null")
        open_rows = open_rows.join(names, "offer_name", "left_anti")
    top = open_rows.orderBy(F.col("deal_score").desc_nulls_last(), "offer_name", "offer_id").limit(limit)
    money = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))).otherwise("")
    whole = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit(""))
    return top.select(
        F.coalesce("offer_name", F.lit("")).alias("offer_name"),
        whole("vintage").alias("vintage"),
        whole("quantity").alias("quantity"),
        F.coalesce("volume", F.lit("")).alias("volume"),
        whole("quantity").alias("rival_quantity"),
        *[money(c).alias(c) for c in ("anchor_price", "rival_price", "price_diff", "price_diff_pct")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("cheaper_side", "anchor_url", "rival_url")],
        *[F.lit("").alias(c) for c in ("cat_rating", "cat_num_ratings", "cat_url")],
    )


# ---- facets and statistics --------------------------------------------------------------


def facet_counts(df: DataFrame, columns=FACETS, multi: tuple[str, ...] = ("grapes",)) -> DataFrame:
    """(facet, value, count) of all facets in one pass and one small shuffle.

    Every row is unpivoted once; comma-separated columns are split and trimmed first.
    """
    single = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]
    pairs = F.array(*single)
    for c in multi:
        label = F.lit(c).alias("facet")
        parts = F.split(F.coalesce(F.col(c), F.lit("")), ",")
        pairs = F.concat(pairs, F.transform(parts, lambda v: F.struct(label, strip(v).alias("value"))))
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .filter(F.coalesce("value", F.lit("")) != "")
        .groupBy("facet", "value")
        .agg(F.count("*").alias("count"))
    )


def by_count() -> list[Column]:
    """Largest first, then label without case."""
    return [F.col("count").desc(), F.lower(F.col("value")).asc(), F.col("value").asc()]


def offering_stats(df: DataFrame, sides: SideLabels = SIDES) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col("offering_type"), F.lit("")), F.lit("Unknown")).alias("value")).agg(
        F.count("*").alias("count"),
        F.count_if(F.col("cheaper_side") == sides.anchor).alias("anchor_cheaper_count"),
        F.count_if(F.col("cheaper_side") == sides.rival).alias("rival_cheaper_count"),
        mean2(F.col("anchor_price")).alias("average_anchor_price"),
        mean2(F.col("price_diff_pct")).alias("average_price_diff_pct"),
    )


def preferred_order(column: Column, order=STYLE_BUTTON_ORDER) -> Column:
    """Position in a fixed list; values outside it come last."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), column)
    return F.when(F.coalesce(rank, F.lit(0)) > 0, rank - 1).otherwise(len(order)).cast("int")


def headline(df: DataFrame, sides: SideLabels = SIDES) -> DataFrame:
    """One row of key figures."""
    v = verdict(F.col("cheaper_side"), F.col("rating"), F.col("num_ratings"), sides)["value_verdict"]
    return df.agg(
        F.count_if(F.col("price_diff_pct").isNotNull()).alias("comparable"),
        F.count_if(F.col("cheaper_side") == sides.anchor).alias("anchor_cheaper"),
        F.count_if(v == "Strong Credit Spend").alias("strong"),
        F.count_distinct(F.when(F.col("origin_label").isNotNull(), F.nullif(F.col("country"), F.lit("")))).alias("countries"),
        mean2(F.col("price_diff_pct")).alias("average_gap"),
    )


def region_guide(df: DataFrame, sides: SideLabels = SIDES) -> DataFrame:
    """Counts per country and per (country, region); an unknown region is its own group."""
    known = df.filter(F.coalesce("country", F.lit("")) != "").withColumn("region", F.coalesce("region", F.lit("")))
    return known.groupingSets([["country"], ["country", "region"]], "country", "region").agg(
        F.when(F.grouping("region") == 1, "country").otherwise("region").alias("level"),
        F.count("*").alias("offers"),
        F.count_if(F.col("cheaper_side") == sides.anchor).alias("anchor_cheaper"),
        F.count_distinct("region").alias("regions"),
    )


# ---- map --------------------------------------------------------------------------------


def map_points(df: DataFrame, sides: SideLabels = SIDES, *, samples: int = 5) -> DataFrame:
    """One point per (label, latitude, longitude) with counts, mean gap and five sample names.

    Samples come from a top-n per point that is pruned before the shuffle, never from a full
    list of the group.
    """
    keys = ["origin_label", "origin_latitude", "origin_longitude"]
    placed = df.filter((F.coalesce("origin_label", F.lit("")) != "") & F.col("origin_latitude").isNotNull() & F.col("origin_longitude").isNotNull())
    stats = placed.groupBy(*keys).agg(
        F.count("*").alias("offer_count"),
        F.count_if(F.col("cheaper_side") == sides.anchor).alias("anchor_cheaper_count"),
        mean2(F.col("price_diff_pct")).alias("average_price_diff_pct"),
        F.min_by(F.struct("country", "region", "origin_precision"), F.struct("offer_name", "offer_id")).alias("first"),
    )
    top = top_per_key(placed.select(*keys, "offer_name", "offer_id"), keys, [F.col("offer_name").asc_nulls_first(), F.col("offer_id").asc()], samples, rank_as="rk")
    names = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "offer_name"))), lambda s: s["offer_name"]).alias("sample_names"))
    return stats.join(names, keys).select(
        *keys, "first.*", "offer_count", "anchor_cheaper_count", "average_price_diff_pct", "sample_names"
    )


def country_rollup(points: DataFrame) -> DataFrame:
    """Weighted centre, counts, mean gap, samples, regions and continent per country."""
    w = F.greatest(F.coalesce("offer_count", F.lit(0)), F.lit(1))
    gap_w = F.when(F.col("average_price_diff_pct").isNotNull(), w)
    # Points arrive largest first (count, then label); samples keep that order.
    row = F.struct(
        (-F.col("offer_count")).alias("o1"), F.lower("origin_label").alias("o2"), F.col("origin_label").alias("o3"), F.col("sample_names").alias("s")
    )
    rows = points.withColumn("country", blank_to_null(F.col("country"))).filter("country is not null").withColumn("_r", row)
    per_country = rows.groupBy("country").agg(
        weighted_mean(F.col("origin_latitude"), w).alias("latitude"),
        weighted_mean(F.col("origin_longitude"), w).alias("longitude"),
        F.sum("offer_count").alias("offer_count"),
        F.sum("anchor_cheaper_count").alias("anchor_cheaper_count"),
        weighted_mean(F.col("average_price_diff_pct"), gap_w).alias("average_price_diff_pct"),
        F.array_sort(F.collect_set(F.nullif(F.col("region"), F.lit("")))).alias("regions"),
    )
    # Five distinct samples lie within the first five points that add a new name.
    named = rows.select("country", "_r", F.posexplode("_r.s").alias("pos", "name")).groupBy("country", "name").agg(
        F.min(F.struct("_r.o1", "_r.o2", "_r.o3", "pos")).alias("at")
    )
    top = top_per_key(named, ["country"], [F.col("at").asc()], 5, rank_as="rk")
    samples = top.groupBy("country").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "name"))), lambda s: s["name"]).alias("sample_names"))
    return per_country.join(samples, "country", "left").withColumn("continent", continent_of(F.col("country")))


# ---- product families ---------------------------------------------------------------------


def fallback_label(name: Column, producer: Column) -> Column:
    """Label of an offer without one, from its name parts."""
    from offerlens.functions.listing import YEAR_PREFIX, _first_index, listing_parts

    parts = listing_parts(name)
    at = _first_index(parts, lambda p: F.lower(p).isin(*METADATA_COLOURS))
    body = F.when(at > 0, F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(parts)
    body = F.transform(body, lambda p, i: F.when(i == 0, strip(F.regexp_replace(p, YEAR_PREFIX, ""))).otherwise(p))
    whole = F.coalesce(F.nullif(name, F.lit("")), F.lit("Wine"))
    first = F.try_element_at(body, F.lit(1))
    return (
        F.when(F.size(body) == 0, whole)
        .when(F.size(body) >= 2, F.try_element_at(body, F.lit(-1)))
        .when((F.coalesce(producer, F.lit("")) != "") & (F.lower(first) == F.lower(strip(producer))), whole)
        .otherwise(first)
    )


def family_columns(df: DataFrame, sides: SideLabels = SIDES) -> DataFrame:
    """Family key and title, style label and recommendation score of each offer."""
    producer = text(F.col("producer"))
    label = strip(F.coalesce(F.nullif(F.col("label_name"), F.lit("")), fallback_label(F.col("offer_name"), F.col("producer"))))
    region, country = F.coalesce("region", F.lit("")), F.coalesce("country", F.lit(""))
    title = F.trim(F.concat_ws(" ", F.nullif(producer, F.lit("")), F.nullif(label, F.lit(""))))
    return df.withColumns(
        {
            "family_key": F.concat_ws("|", F.lower(producer), F.lower(label), F.lower(region), F.lower(country)),
            "family_title": F.when(title != "", title).otherwise(F.col("offer_name")),
            "style_label": F.coalesce(F.nullif(F.col("style_family"), F.lit("")), F.nullif(F.col("wine_type"), F.lit("")), F.lit("Unclassified")),
            "recommendation": recommendation_score(F.col("deal_score"), F.col("cheaper_side"), F.col("rating"), F.col("num_ratings"), F.col("offering_type"), sides),
        }
    )


def _offer_order() -> Column:
    """Best offer first: recommendation, price (none last), gap size (none first), type, id."""
    return F.struct(
        (-F.col("recommendation")).alias("a"),
        F.coalesce("anchor_price", F.lit(float("inf"))).alias("b"),
        F.coalesce(-round2(F.abs(F.col("price_diff_pct"))), F.lit(float("-inf"))).alias("c"),
        F.coalesce("offering_type", F.lit("")).alias("d"),
        F.col("offer_id").alias("e"),
    )


def families(df: DataFrame, sides: SideLabels = SIDES, *, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per product family: best offer, counts, price band, vintages and score."""
    keyed = df if "family_key" in df.columns else family_columns(df, sides)
    best = F.struct("offer_id", "offer_name", "anchor_price", "price_diff_pct", "country", "region", "recommendation", "family_title")
    out = keyed.groupBy(*extra_keys, "family_key").agg(
        F.min_by(best, _offer_order()).alias("best"),
        F.count("*").alias("offers"),
        F.count_if(F.col("cheaper_side") == sides.anchor).alias("anchor_cheaper"),
        F.count_if(F.col("price_diff_pct").isNotNull()).alias("comparable"),
        F.min("anchor_price").alias("min_price"),
        F.max("anchor_price").alias("max_price"),
        # Distinct vintages are years, so this set has at most a few hundred members.
        F.array_sort(F.collect_set(F.coalesce(F.col("vintage").cast("string"), F.lit("NV")))).alias("vintages"),
    )
    return out.select(
        *extra_keys, "family_key", F.col("best.family_title").alias("title"), F.col("best.offer_id").alias("best_offer_id"),
        F.col("best.offer_name").alias("best_offer"), F.col("best.anchor_price").alias("best_price"),
        F.col("best.price_diff_pct").alias("best_price_diff_pct"),
        F.col("best.country").alias("country"), F.col("best.region").alias("region"),
        "offers", "anchor_cheaper", "comparable", "min_price", "max_price", "vintages",
        (F.col("best.recommendation") + F.least("offers", F.lit(4))).alias("family_score"),
    )


def top_families(fams: DataFrame, n: int = 3) -> DataFrame:
    return fams.orderBy(F.col("family_score").desc(), F.col("title").asc(), F.col("family_key").asc()).limit(n)


def _top_labels(fams: DataFrame, column: str, unknown: str, n: int, out: str, *, with_count: bool = True) -> DataFrame:
    """Most frequent labels per style as a short array, each with its count where asked for."""
    shown = lambda s: F.concat(s["label"], F.lit(" ("), s["n"].cast("string"), F.lit(")")) if with_count else s["label"]
    counted = fams.groupBy("style_label", F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown)).alias("label")).agg(F.count("*").alias("n"))
    sizes = counted.groupBy("style_label").agg(F.count("*").alias(f"{out}_total"))
    top = top_per_key(counted, ["style_label"], [F.col("n").desc(), F.col("label").asc()], n, rank_as="rk")
    listed = top.groupBy("style_label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "label", "n"))), shown).alias(out)
    )
    return listed.join(sizes, "style_label")


def style_groups(df: DataFrame, sides: SideLabels = SIDES) -> DataFrame:
    """One row per style: its families, best three offers, leading countries and regions, fixed order."""
    fams = families(family_columns(df, sides), sides, extra_keys=("style_label",))
    base = fams.groupBy("style_label").agg(
        F.count("*").alias("family_count"),
        F.count_if(F.col("anchor_cheaper") > 0).alias("anchor_cheaper_families"),
        F.sum("offers").alias("offers"),
    )
    order = [F.col("family_score").desc(), F.col("title").asc(), F.col("family_key").asc()]
    top = top_per_key(fams, ["style_label"], order, 3, rank_as="rk").groupBy("style_label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "best_offer"))), lambda s: s["best_offer"]).alias("top_offers")
    )
    return (
        base.join(top, "style_label")
        .join(_top_labels(fams, "country", "Unknown", 3, "top_countries", with_count=False), "style_label")
        .join(_top_labels(fams, "region", "Unknown region", 4, "top_regions").drop("top_regions_total"), "style_label")
        .withColumnRenamed("top_countries_total", "country_count")
        .withColumn("style_rank", preferred_order(F.col("style_label"), STYLE_GROUP_ORDER))
    )
