"""Listing queries: filters, orders, facets, statistics, map, families."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions.metadata import continent_of
from offerlens.functions.pricing import tone_for_mix, tone_for_side
from offerlens.operators import serving as S
from offerlens.operators.serving import OfferFilter
from offerlens.plans.listing import list_offers
from offerlens.registry import sqltext as Q
from offerlens.registry.base import query

_VIEW = ["offer_id", "offer_name", "deal_score", "cheaper_side", "anchor_price"]
_COLS = ", ".join(_VIEW)


def _filter_query(name: str, where: str, **restrictions):
    query(name, f"SELECT {_COLS} FROM @offers@ WHERE {where}")(
        lambda i: S.filter_offers(i.offers, OfferFilter(**restrictions)).select(*_VIEW)
    )


_filter_query("f1_score_floor", "deal_score >= 14.5", min_score=14.5)
_filter_query("f2_side_shortcut", "cheaper_side = 'Anchor Cheaper' AND deal_score >= 0", only_anchor_cheaper=True)
_filter_query("f2_side_explicit", "cheaper_side = 'Rival Cheaper' AND deal_score >= 0", only_anchor_cheaper=True, cheaper_side="Rival Cheaper")
_filter_query("f2_side_all", "deal_score >= 0", cheaper_side="ALL", only_anchor_cheaper=True)
_filter_query("f3_comparable", "price_diff_pct IS NOT NULL AND (rating IS NOT NULL OR num_ratings IS NOT NULL) AND deal_score >= 0", comparable_only=True)
_filter_query(
    "f4_search",
    "deal_score >= 0 AND (contains(lower(offer_name), 'réserve') OR contains(lower(coalesce(rating_description, '')), 'réserve') OR contains(lower(coalesce(grapes, '')), 'réserve') OR contains(lower(coalesce(region, '')), 'réserve') OR contains(lower(producer), 'réserve'))",
    search="  RÉSERVE ",
)


@query(
    "f4_search_escaped",
    f"""SELECT {_COLS} FROM (SELECT * REPLACE (offer_name || CASE WHEN anchor_price > 950 THEN ' 50%_ Off' ELSE ' 50 x Off' END AS offer_name) FROM @offers@)
WHERE deal_score >= 0 AND contains(lower(offer_name), '50%_ off')""",
)
def f4_escaped(i):
    """Search marks of LIKE are plain characters; names with and without them."""
    told = F.when(F.col("anchor_price") > 950, " 50%_ Off").otherwise(" 50 x Off")
    return S.filter_offers(i.offers.withColumn("offer_name", F.concat("offer_name", told)), OfferFilter(search="50%_ OFF")).select(*_VIEW)


_filter_query("f5_ranges", "rating >= 2.5 AND num_ratings >= 500 AND anchor_price <= 950 AND deal_score >= 0", min_rating=2.5, min_num_ratings=500, max_anchor_price=950.0)
_filter_query("f6_exact_any_of", "lower(country) IN ('france', 'new zealand') AND lower(wine_type) IN ('red', 'rose') AND deal_score >= 0", country="france, New Zealand,,", wine_type="RED,rose")
_filter_query("f7_contains_any_of", "(contains(lower(grapes), 'pinot') OR contains(lower(grapes), 'syrah')) AND deal_score >= 0", grape=" Pinot , SYRAH")


@query("f8_unresolved", f"SELECT {_COLS} FROM @offers@ WHERE rating IS NULL AND num_ratings IS NULL")
def f8(i):
    return i.offers.filter(F.col("rating").isNull() & F.col("num_ratings").isNull()).select(*_VIEW)


_EXPORT = """SELECT offer_name, coalesce(CAST(vintage AS STRING), '') AS vintage, CAST(quantity AS STRING) AS quantity, volume, CAST(quantity AS STRING) AS rival_quantity,
 coalesce(printf('%.2f', anchor_price), '') AS anchor_price, coalesce(printf('%.2f', rival_price), '') AS rival_price, coalesce(printf('%.2f', price_diff), '') AS price_diff, coalesce(printf('%.2f', price_diff_pct), '') AS price_diff_pct,
 cheaper_side, anchor_url, rival_url, '' AS cat_rating, '' AS cat_num_ratings, '' AS cat_url
FROM @offers@ WHERE rating IS NULL AND num_ratings IS NULL {} ORDER BY deal_score DESC NULLS LAST, offer_name, offer_id LIMIT 500"""


@query("f9_s14_unresolved_export", _EXPORT.format("AND offer_name NOT IN (SELECT name FROM @listings@ WHERE kind = 'PROMO')"))
def s14(i):
    return S.unresolved_export(i.offers, i.listings.filter("kind = 'PROMO'").select(F.col("name").alias("offer_name")))


@query("s14_export_with_locked", _EXPORT.format(""))
def s14_all(i):
    return S.unresolved_export(i.offers, i.listings.select(F.col("name").alias("offer_name")), include_locked=True)


@query("f15_point_lookup", f"SELECT {_COLS} FROM @offers@ WHERE offer_id = 42")
def f15(i):
    return i.offers.filter("offer_id = 42").select(*_VIEW)


_VERDICTS = """CASE WHEN cheaper_side = 'Anchor Cheaper' AND coalesce(rating, 0) >= 4.0 AND coalesce(num_ratings, 0) >= 100 THEN 'Strong Credit Spend'
 WHEN cheaper_side = 'Anchor Cheaper' THEN 'Solid Value' WHEN cheaper_side = 'Same Price' AND coalesce(rating, 0) >= 4.1 THEN 'Quality Buy' WHEN cheaper_side = 'Same Price' THEN 'Retail Match'
 WHEN cheaper_side = 'Rival Cheaper' THEN 'Anchor Markup' WHEN cheaper_side = 'No Match' THEN 'Quality Only' ELSE 'Needs Review' END"""


@query(
    "f14_x52_insights",
    f"""SELECT offer_id, {Q.r2('abs(price_diff_pct)')} AS price_diff_pct_abs, price_diff_pct IS NOT NULL AS has_competitor_match, cheaper_side = 'Anchor Cheaper' AS is_anchor_cheaper,
 coalesce(rating >= 4.0, false) AS is_good_wine, coalesce(num_ratings >= 100, false) AS is_high_confidence, {_VERDICTS} AS value_verdict,
 CASE WHEN cheaper_side = 'Anchor Cheaper' THEN 'good' WHEN cheaper_side = 'Same Price' THEN 'calm' WHEN cheaper_side = 'Rival Cheaper' THEN 'warn' ELSE 'ghost' END AS value_verdict_tone FROM @offers@""",
)
def f14(i):
    return S.add_insights(i.offers).select(
        "offer_id", "price_diff_pct_abs", "has_competitor_match", "is_anchor_cheaper", "is_good_wine", "is_high_confidence", "value_verdict", "value_verdict_tone"
    )


# ---- orders -----------------------------------------------------------------------------

_TIE_SQL = {
    "deal_score": "price_diff_pct ASC NULLS LAST, rating DESC NULLS LAST, num_ratings DESC NULLS LAST, offer_name, offer_id",
    "price_diff_pct": "deal_score DESC NULLS LAST, rating DESC NULLS LAST, num_ratings DESC NULLS LAST, offer_name, offer_id",
    "abs(price_diff_pct)": "deal_score DESC NULLS LAST, price_diff_pct ASC NULLS LAST, rating DESC NULLS LAST, offer_name, offer_id",
    "rating": "num_ratings DESC NULLS LAST, deal_score DESC NULLS LAST, price_diff_pct ASC NULLS LAST, offer_name, offer_id",
    "num_ratings": "rating DESC NULLS LAST, deal_score DESC NULLS LAST, price_diff_pct ASC NULLS LAST, offer_name, offer_id",
    "anchor_price": "deal_score DESC NULLS LAST, rating DESC NULLS LAST, offer_name, offer_id",
    "offer_name": "deal_score DESC NULLS LAST, rating DESC NULLS LAST, offer_id",
}


def _sort_query(name: str, primary: str, alias: str, direction: str, offset: int = 0, limit: int = 60):
    ties = _TIE_SQL[primary]
    query(name, f"SELECT {_COLS} FROM @offers@ ORDER BY {primary} {direction} NULLS LAST, {ties} LIMIT {min(limit, 500)} OFFSET {offset}")(
        lambda i: S.page(i.offers, S.sort_keys(alias, direction), offset=offset, limit=limit).select(*_VIEW)
    )


_sort_query("l1_by_score", "deal_score", "score", "desc")
_sort_query("l1_unknown_key", "deal_score", "no_such_key", "desc", offset=10)
_sort_query("l1_by_pct", "price_diff_pct", "difference_pct", "asc")
_sort_query("l2_by_absolute_gap", "abs(price_diff_pct)", "percent_gap", "desc")
_sort_query("l1_by_rating", "rating", "rating", "desc")
_sort_query("l1_by_count", "num_ratings", "ratings", "asc")
_sort_query("l1_by_price", "anchor_price", "price", "asc")
_sort_query("l1_by_name", "offer_name", "name", "asc")
_sort_query("l3_page_cap", "anchor_price", "price", "desc", offset=25, limit=9000)


@query(
    "list_offers_with_history",
    f"""WITH page AS (SELECT * FROM (SELECT 'offer ' || CAST(1 + offer_id % 150 AS STRING) AS offer_name, offer_id, deal_score, anchor_price, rival_price, price_diff_pct, rating, num_ratings, cheaper_side
   FROM @offers@ WHERE cheaper_side = 'Anchor Cheaper' AND deal_score >= 0) ORDER BY deal_score DESC NULLS LAST, price_diff_pct ASC NULLS LAST, rating DESC NULLS LAST, num_ratings DESC NULLS LAST, offer_name, offer_id LIMIT 50),
h AS (SELECT offer_name, arg_max(anchor_price, captured_at) FILTER (WHERE captured_at <= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS ago7,
   arg_max(anchor_price, captured_at) FILTER (WHERE captured_at <= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY) AS ago30 FROM @snapshots@ WHERE captured_at >= TIMESTAMP '2024-01-31' - INTERVAL 45 DAY GROUP BY 1)
SELECT p.offer_id, ago7 AS anchor_price_7d_ago, {Q.r2('p.anchor_price - ago7')} AS anchor_price_change_7d, ago30 AS anchor_price_30d_ago,
  CASE WHEN ago7 IS NULL THEN 'unknown' WHEN {Q.r2('p.anchor_price - ago7')} <= -0.01 THEN 'down' WHEN {Q.r2('p.anchor_price - ago7')} >= 0.01 THEN 'up' ELSE 'flat' END AS anchor_price_trend_7d, {_VERDICTS} AS value_verdict
FROM page p LEFT JOIN h ON h.offer_name = p.offer_name""",
)
def list_with_history(i):
    offers = i.offers.withColumn("offer_name", F.concat(F.lit("offer "), (1 + F.col("offer_id") % 150).cast("string")))
    rows = list_offers(offers, i.snapshots, now=F.lit("2024-01-31").cast("timestamp"), request=OfferFilter(only_anchor_cheaper=True))
    return rows.select("offer_id", "anchor_price_7d_ago", "anchor_price_change_7d", "anchor_price_30d_ago", "anchor_price_trend_7d", "value_verdict")


# ---- facets and statistics --------------------------------------------------------------

_FACETS = ("country", "region", "wine_type", "style_family", "offering_type", "producer")
_FACET_SQL = (
    " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS count FROM @offers@ WHERE coalesce({c}, '') <> '' AND deal_score >= 12 GROUP BY {c}" for c in _FACETS)
    + " UNION ALL SELECT 'grapes', trim(g), count(*) FROM (SELECT unnest(string_split(grapes, ',')) AS g FROM @offers@ WHERE deal_score >= 12) WHERE trim(g) <> '' GROUP BY trim(g)"
)


@query("a2_a3_facets", _FACET_SQL)
def a2(i):
    return S.facet_counts(S.filter_offers(i.offers, OfferFilter(min_score=12.0)))


@query("l5_largest_labels", f"SELECT facet, value, count FROM ({_FACET_SQL}) ORDER BY facet, count DESC, lower(value), value")
def l5(i):
    counts = S.facet_counts(S.filter_offers(i.offers, OfferFilter(min_score=12.0)))
    return counts.orderBy("facet", *S.by_count())


@query(
    "a4_stats_counts",
    "SELECT 'total' AS facet, 'all' AS value, count(*) AS count FROM @offers@ UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', {c}, count(*) FROM @offers@ WHERE coalesce({c}, '') <> '' GROUP BY {c}" for c in ("cheaper_side", "wine_type", "style_family", "country")),
)
def a4(i):
    return S.facet_counts(i.offers.withColumn("total", F.lit("all")), ("total", "cheaper_side", "wine_type", "style_family", "country"), ())


@query(
    "a5_a6_offering_stats",
    f"SELECT coalesce(offering_type, 'Unknown') AS value, count(*) AS count, count(*) FILTER (WHERE cheaper_side = 'Anchor Cheaper') AS anchor_cheaper_count, count(*) FILTER (WHERE cheaper_side = 'Rival Cheaper') AS rival_cheaper_count, {Q.mean2('anchor_price')} AS average_anchor_price, {Q.mean2('price_diff_pct')} AS average_price_diff_pct FROM @offers@ GROUP BY 1",
)
def a5(i):
    return S.offering_stats(i.offers)


@query("x58_tones", "SELECT value, count, CASE WHEN a > r THEN 'gain' WHEN r > 0 THEN 'loss' ELSE 'flat' END AS mix_tone, CASE WHEN m <= -3 THEN 'gain' WHEN m >= 3 THEN 'loss' ELSE 'flat' END AS mean_tone FROM (SELECT coalesce(offering_type, 'Unknown') AS value, count(*) AS count, count(*) FILTER (WHERE cheaper_side = 'Anchor Cheaper') AS a, count(*) FILTER (WHERE cheaper_side = 'Rival Cheaper') AS r, " + Q.mean2("price_diff_pct") + " AS m FROM @offers@ GROUP BY 1)")
def x58(i):
    from offerlens.functions.pricing import tone_for_mean

    s = S.offering_stats(i.offers)
    return s.select("value", "count", tone_for_mix(F.col("anchor_cheaper_count"), F.col("rival_cheaper_count")).alias("mix_tone"), tone_for_mean(F.col("average_price_diff_pct")).alias("mean_tone"))


@query("x58_side_tone_and_short_verdict", f"SELECT offer_id, CASE cheaper_side WHEN 'Anchor Cheaper' THEN 'gain' WHEN 'Rival Cheaper' THEN 'loss' ELSE 'flat' END AS tone, CASE ({_VERDICTS}) WHEN 'Strong Credit Spend' THEN 'Top Value' WHEN 'Solid Value' THEN 'Good Value' WHEN 'Quality Buy' THEN 'Worth A Look' WHEN 'Retail Match' THEN 'Match' WHEN 'Anchor Markup' THEN 'Markup' WHEN 'Quality Only' THEN 'No Comp' ELSE 'Review' END AS short FROM @offers@")
def x58b(i):
    from offerlens.functions.pricing import short_verdict

    return S.add_insights(i.offers).select("offer_id", tone_for_side(F.col("cheaper_side")).alias("tone"), short_verdict(F.col("value_verdict")).alias("short"))


@query("a1_counts", "SELECT (SELECT count(*) FROM @offers@) AS offers, (SELECT count(*) FROM @snapshots@) AS snapshots")
def a1(i):
    return i.offers.agg(F.count("*").alias("offers")).withColumn("snapshots", i.snapshots.agg(F.count("*").alias("n")).scalar())


@query(
    "a9_headline",
    f"SELECT count(price_diff_pct) AS comparable, count(*) FILTER (WHERE cheaper_side = 'Anchor Cheaper') AS anchor_cheaper, count(*) FILTER (WHERE ({_VERDICTS}) = 'Strong Credit Spend') AS strong, count(DISTINCT CASE WHEN origin_label IS NOT NULL THEN country END) AS countries, {Q.mean2('price_diff_pct')} AS average_gap FROM @offers@",
)
def a9(i):
    return S.headline(i.offers)


@query(
    "a10_region_guide",
    """SELECT country, NULL AS region, 'country' AS level, count(*) AS offers, count(*) FILTER (WHERE cheaper_side = 'Anchor Cheaper') AS anchor_cheaper, count(DISTINCT coalesce(region, '')) AS regions FROM @offers@ WHERE coalesce(country, '') <> '' GROUP BY country
 UNION ALL SELECT country, coalesce(region, ''), 'region', count(*), count(*) FILTER (WHERE cheaper_side = 'Anchor Cheaper'), 1 FROM @offers@ WHERE coalesce(country, '') <> '' GROUP BY 1, 2""",
)
def a10(i):
    return S.region_guide(i.offers)


_POINTS = f"""SELECT origin_label, origin_latitude, origin_longitude, arg_min(country, k) AS country, arg_min(region, k) AS region, 'region' AS origin_precision, count(*) AS offer_count,
 count(*) FILTER (WHERE cheaper_side = 'Anchor Cheaper') AS anchor_cheaper_count, {Q.mean2('price_diff_pct')} AS average_price_diff_pct, (list(offer_name ORDER BY offer_name, offer_id))[1:5] AS sample_names
 FROM (SELECT *, ROW(offer_name, offer_id) AS k FROM @offers@ WHERE coalesce(origin_label, '') <> '' AND origin_latitude IS NOT NULL AND origin_longitude IS NOT NULL) GROUP BY 1, 2, 3"""


@query("a7_map_points", _POINTS)
def a7(i):
    return S.map_points(i.offers)


@query(
    "a8_x57_country_rollup",
    f"""WITH p AS ({_POINTS}), q AS (SELECT *, row_number() OVER (ORDER BY offer_count DESC, lower(origin_label), origin_label) AS o FROM p),
s AS (SELECT country, name, min(o * 10 + pos) AS place FROM (SELECT country, o, unnest(sample_names) AS name, generate_subscripts(sample_names, 1) AS pos FROM q) GROUP BY 1, 2),
s5 AS (SELECT country, (list(name ORDER BY place))[1:5] AS sample_names FROM s GROUP BY 1),
w AS (SELECT country, CAST(sum(CAST(origin_latitude * 100 AS DECIMAL(26, 8)) * CAST(offer_count AS DECIMAL(12, 0))) AS DOUBLE) / sum(offer_count) / 100 AS latitude,
  CAST(sum(CAST(origin_longitude * 100 AS DECIMAL(26, 8)) * CAST(offer_count AS DECIMAL(12, 0))) AS DOUBLE) / sum(offer_count) / 100 AS longitude, CAST(sum(offer_count) AS BIGINT) AS offer_count, CAST(sum(anchor_cheaper_count) AS BIGINT) AS anchor_cheaper_count,
  CAST(sum(CAST(average_price_diff_pct * 100 AS DECIMAL(26, 8)) * CAST(offer_count AS DECIMAL(12, 0))) AS DOUBLE) / sum(CASE WHEN average_price_diff_pct IS NOT NULL THEN offer_count END) / 100 AS average_price_diff_pct,
  list_sort(list_distinct(list(region) FILTER (WHERE region IS NOT NULL))) AS regions FROM q GROUP BY country)
SELECT w.country, latitude, longitude, offer_count, anchor_cheaper_count, average_price_diff_pct, regions, sample_names,
 CASE w.country WHEN 'New Zealand' THEN 'Oceania' WHEN 'Chile' THEN 'South America' WHEN 'South Africa' THEN 'Africa' ELSE 'Europe' END AS continent FROM w JOIN s5 ON s5.country = w.country""",
)
def a8(i):
    return S.country_rollup(S.map_points(i.offers))


@query("x57_continents", "SELECT n_name, CASE n_regionkey WHEN 0 THEN 'Asia' WHEN 1 THEN 'North America' WHEN 2 THEN 'Africa' ELSE 'Europe' END AS continent FROM @nation@")
def x57(i):
    names = F.when(F.col("n_regionkey") == 0, "Japan").when(F.col("n_regionkey") == 1, "Canada").when(F.col("n_regionkey") == 2, "South Africa").otherwise(F.col("n_name"))
    return i.nation.select("n_name", continent_of(names).alias("continent"))


@query("l6_preferred_order", "SELECT style_family AS value, count(*) AS count, CASE style_family WHEN 'Red' THEN 0 WHEN 'White' THEN 1 WHEN 'Champagne' THEN 3 WHEN 'Sweet / Dessert' THEN 4 ELSE 7 END AS rank FROM @offers@ WHERE style_family IS NOT NULL GROUP BY 1")
def l6(i):
    c = S.facet_counts(i.offers, ("style_family",), ()).select("value", "count")
    return c.withColumn("rank", S.preferred_order(F.col("value"))).orderBy("rank", F.col("count").desc(), "value")


# ---- families ---------------------------------------------------------------------------

_REC = """coalesce(deal_score, 0.0) + (CASE WHEN cheaper_side = 'Anchor Cheaper' THEN 20.0 ELSE 0.0 END) - (CASE WHEN cheaper_side = 'Rival Cheaper' THEN 18.0 ELSE 0.0 END)
 + (CASE WHEN rating >= 4.2 THEN 8.0 ELSE 0.0 END) + (CASE WHEN num_ratings >= 500 THEN 4.0 ELSE 0.0 END) + (CASE WHEN offering_type = 'Magnum' THEN 2.0 ELSE 0.0 END)"""
# Offers without a label take the last part of the listing before the colour.
_LABEL = """coalesce(label_name, list_filter(string_split(offer_name, ' - '), lambda p: lower(p) NOT IN ('red', 'white', 'rose', 'orange') AND NOT regexp_matches(p, '^(1\\.5 L|375 ml|750 ml|Magnum|Half Bottle|Standard Bottle)'))[-1])"""
_FAM = f"""keyed AS (SELECT *, lower(producer) || '|' || lower({_LABEL}) || '|' || lower(coalesce(region, '')) || '|' || lower(coalesce(country, '')) AS family_key, producer || ' ' || {_LABEL} AS family_title,
  coalesce(style_family, wine_type, 'Unclassified') AS style_label, {_REC} AS rec FROM @offers@)"""


def _fam_sql(keys: str) -> str:
    order = f"rec DESC, anchor_price ASC NULLS LAST, floor(abs(price_diff_pct) * 100 + 0.5) DESC NULLS FIRST, coalesce(offering_type, ''), offer_id"
    return f"""SELECT {keys}, family_key, max(CASE WHEN rn = 1 THEN family_title END) AS title, max(CASE WHEN rn = 1 THEN offer_id END) AS best_offer_id, max(CASE WHEN rn = 1 THEN offer_name END) AS best_offer, max(CASE WHEN rn = 1 THEN country END) AS country, max(CASE WHEN rn = 1 THEN region END) AS region,
  count(*) AS offers, count(*) FILTER (WHERE cheaper_side = 'Anchor Cheaper') AS anchor_cheaper, count(price_diff_pct) AS comparable, min(anchor_price) AS min_price, max(anchor_price) AS max_price,
  list_sort(list_distinct(list(coalesce(CAST(vintage AS STRING), 'NV')))) AS vintages, max(CASE WHEN rn = 1 THEN rec END) + least(count(*), 4) AS family_score
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, family_key ORDER BY {order}) AS rn FROM keyed) GROUP BY {keys}, family_key"""


@query("a11_x54_families", f"WITH {_FAM} SELECT family_key, title, best_offer_id, offers, anchor_cheaper, comparable, min_price, max_price, vintages, family_score FROM ({_fam_sql('1=1 AS one').replace('PARTITION BY 1=1 AS one, ', 'PARTITION BY ').replace('GROUP BY 1=1 AS one, ', 'GROUP BY ')})")
def a11(i):
    return S.families(S.family_columns(i.offers)).select(
        "family_key", "title", "best_offer_id", "offers", "anchor_cheaper", "comparable", "min_price", "max_price", "vintages", "family_score"
    )


_FAM_BY_STYLE = _fam_sql("style_label")


@query(
    "a12_style_groups",
    f"""WITH {_FAM}, fams AS ({_FAM_BY_STYLE}),
b AS (SELECT style_label, count(*) AS family_count, count(*) FILTER (WHERE anchor_cheaper > 0) AS anchor_cheaper_families, CAST(sum(offers) AS BIGINT) AS offers, (list(best_offer ORDER BY family_score DESC, title, family_key))[1:3] AS top_offers FROM fams GROUP BY 1),
c AS (SELECT style_label, coalesce(country, 'Unknown') AS label, count(*) AS n FROM fams GROUP BY 1, 2), r AS (SELECT style_label, coalesce(region, 'Unknown region') AS label, count(*) AS n FROM fams GROUP BY 1, 2),
tc AS (SELECT style_label, count(*) AS country_count, (list(label ORDER BY n DESC, label))[1:3] AS top_countries FROM c GROUP BY 1), tr AS (SELECT style_label, (list(label || ' (' || CAST(n AS STRING) || ')' ORDER BY n DESC, label))[1:4] AS top_regions FROM r GROUP BY 1)
SELECT b.style_label, family_count, anchor_cheaper_families, offers, top_offers, top_countries, country_count, top_regions,
 CASE b.style_label WHEN 'Red' THEN 0 WHEN 'White' THEN 1 WHEN 'Champagne' THEN 2 WHEN 'Rose' THEN 4 WHEN 'Sweet / Dessert' THEN 5 WHEN 'Orange' THEN 6 ELSE 7 END AS style_rank
FROM b JOIN tc USING (style_label) JOIN tr USING (style_label)""",
)
def a12(i):
    return S.style_groups(i.offers)


@query("w6_top_families", f"WITH {_FAM}, fams AS ({_FAM_BY_STYLE}) SELECT title, family_score FROM (SELECT * FROM fams WHERE true) ORDER BY family_score DESC, title, family_key, style_label LIMIT 3")
def w6(i):
    fams = S.families(S.family_columns(i.offers), extra_keys=("style_label",))
    return fams.orderBy(F.col("family_score").desc(), "title", "family_key", "style_label").limit(3).select("title", "family_score")
