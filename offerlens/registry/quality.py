"""Quality queries: completeness, coverage, profiles and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.operators import quality as K
from offerlens.registry import sqltext as Q
from offerlens.registry.base import query

c = F.col

_MISSING = " UNION ALL ".join(
    f"SELECT '{f}' AS field, offer_name AS name FROM @offers@ WHERE {'coalesce(trim(' + f + '), chr(32)) = chr(32) OR trim(' + f + ') = chr(32) OR trim(' + f + ') = ' + repr('') if f in ('wine_type', 'country', 'grapes', 'match_method', 'rating_url') else f + ' IS NULL'}"
    for f in ("anchor_price", "wine_type", "country", "grapes", "match_method", "rating_url", "rating", "rating_price")
)
_ALLOWED = "SELECT 'rating_url' AS field, name FROM @listings@ WHERE kind = 'PROMO' UNION ALL SELECT 'rating', name FROM @listings@ WHERE kind = 'PROMO' UNION ALL SELECT 'rating_price', name FROM @listings@ WHERE size > 20"
_REPORT = f"""SELECT field, severity, count(*) AS gaps FROM (SELECT m.field, CASE WHEN a.name IS NOT NULL THEN 'warning' ELSE 'error' END AS severity FROM ({_MISSING}) m LEFT JOIN (SELECT DISTINCT * FROM ({_ALLOWED})) a ON a.field = m.field AND a.name = m.name) GROUP BY 1, 2"""


@query("j18_split_known_gaps", f"SELECT m.field, m.name, CASE WHEN a.name IS NOT NULL THEN 'warning' ELSE 'error' END AS severity FROM ({_MISSING}) m LEFT JOIN (SELECT DISTINCT * FROM ({_ALLOWED})) a ON a.field = m.field AND a.name = m.name WHERE m.field IN ('rating_url', 'rating', 'rating_price')")
def j18(i):
    return K.split_known_gaps(K.missing_fields(i.offers, K.GATED_FIELDS), i.sql(_ALLOWED))


@query("a13_completeness_report", _REPORT)
def a13(i):
    return K.completeness_report(i.offers, i.sql(_ALLOWED))


def _share(cond: str) -> str:
    return f"printf('%.1f', floor(count(*) FILTER (WHERE {cond}) * 1000 / count(*) + 0.5) / 10) || '%'"


@query("a13_coverage_texts", f"SELECT count(*) AS total, {_share('rating IS NOT NULL')} AS rating_coverage, {_share('rating_url IS NOT NULL')} AS rating_url_coverage, {_share('rating_price IS NOT NULL')} AS rating_price_coverage, {_share('country IS NOT NULL')} AS country_coverage, {_share('grapes IS NOT NULL AND grapes <> ' + repr(''))} AS grapes_coverage FROM @offers@")
def a13b(i):
    return K.coverage_row(i.offers)


@query("a22_gate", f"SELECT CAST(coalesce(sum(gaps) FILTER (WHERE severity = 'error'), 0) AS BIGINT) AS errors, CAST(coalesce(sum(gaps) FILTER (WHERE severity = 'warning'), 0) AS BIGINT) AS warnings, coalesce(sum(gaps) FILTER (WHERE severity = 'error'), 0) = 0 AS passed FROM ({_REPORT})")
def a22(i):
    return K.gate(K.completeness_report(i.offers, i.sql(_ALLOWED)))


@query("a14_rating_coverage", "SELECT count(*) AS total, count(*) FILTER (WHERE rating IS NOT NULL OR num_ratings IS NOT NULL) AS rated, count(*) FILTER (WHERE rating IS NULL AND rating_url IS NOT NULL) AS unrated_with_url, count(*) FILTER (WHERE rating IS NULL AND rating_url IS NULL) AS unrated_without_url, CAST(count(*) FILTER (WHERE rating IS NOT NULL OR num_ratings IS NOT NULL) AS DOUBLE) / count(*) AS coverage FROM @offers@")
def a14(i):
    return K.rating_coverage(i.offers)


@query("a15_raw_coverage")
def a15(i):
    from offerlens.registry.linkage import _attached

    return K.raw_coverage(_attached(i), min_coverage=0.5, max_unrated=1000)


_CAT = "SELECT doc_id AS ord, CASE WHEN n_chars % 9 = 0 THEN '' ELSE text END AS name, CASE WHEN n_chars % 5 = 0 THEN 'n/a' ELSE '$' || CAST(n_chars AS STRING) END AS price, CASE WHEN n_chars % 11 = 0 THEN ' ' ELSE 'https://' || source || '.example/' || lang || '/' || CAST(n_chars AS STRING) END AS url, CASE n_chars % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN '' ELSE 'maybe' END AS in_stock FROM @documents@"


@query(
    "a16_catalogue_profile",
    f"""WITH d AS ({_CAT}) SELECT count(*) AS rows, count(*) FILTER (WHERE trim(name) = '') AS missing_name, count(*) FILTER (WHERE trim(url) = '') AS missing_url, count(*) FILTER (WHERE price = 'n/a') AS missing_price,
 count(*) FILTER (WHERE in_stock = 'Yes') AS stock_true, count(*) FILTER (WHERE in_stock = 'no') AS stock_false, count(*) FILTER (WHERE in_stock IN ('', 'maybe')) AS stock_unknown,
 (SELECT count(*) FROM (SELECT 1 FROM d WHERE trim(name) <> '' GROUP BY lower(trim(name, chr(32) || chr(10) || chr(9))) HAVING count(*) > 1)) AS duplicate_names, (SELECT count(*) FROM (SELECT url FROM d WHERE trim(url) <> '' GROUP BY url HAVING count(*) > 1)) AS duplicate_urls FROM d""",
)
def a16(i):
    return K.catalogue_profile(i.sql(_CAT))


@query("a16_host_histogram", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS rows FROM @pages@ GROUP BY 1")
def a16b(i):
    return K.host_histogram(i.pages)


@query("a16_bad_rows", f"SELECT ord FROM ({_CAT}) WHERE trim(name) = '' OR trim(url) = '' ORDER BY ord LIMIT 10")
def a16c(i):
    return K.bad_rows(i.sql(_CAT)).select("ord")


@query("a21_totals", "SELECT count(*) AS resolved, count(*) FILTER (WHERE trim(rating) <> '') AS with_rating, count(*) FILTER (WHERE coalesce(trim(url), '') <> '') AS with_url FROM @ratings@")
def a21(i):
    return i.ratings.agg(F.count("*").alias("resolved"), F.count_if(F.trim("rating") != "").alias("with_rating"), F.count_if(F.trim(F.coalesce("url", F.lit(""))) != "").alias("with_url"))


@query(
    "a24_integrity_checks",
    """SELECT 'blank_name' AS "check", count(*) FILTER (WHERE trim(offer_name) = '') AS failures FROM @offers@ UNION ALL SELECT 'foreign_url', count(*) FILTER (WHERE NOT contains(rating_url, 'vivino.com')) FROM @offers@
 UNION ALL SELECT 'comparable_without_price', count(*) FILTER (WHERE price_diff_pct IS NOT NULL AND (anchor_price IS NULL OR rival_price IS NULL)) FROM @offers@ UNION ALL SELECT 'rating_not_numeric', count(*) FILTER (WHERE rating > 5) FROM @offers@
 UNION ALL SELECT 'missing_columns', 1 UNION ALL SELECT 'too_few_rows', CASE WHEN count(*) < 40 THEN 1 ELSE 0 END FROM @offers@ UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT 1 FROM @offers@ GROUP BY lower(offer_name) HAVING count(*) > 1)""",
)
def a24(i):
    df = i.offers
    checks = {
        "blank_name": F.trim("offer_name") == "",
        "foreign_url": ~F.contains(c("rating_url"), F.lit("vivino.com")),
        "comparable_without_price": c("price_diff_pct").isNotNull() & (c("anchor_price").isNull() | c("rival_price").isNull()),
        "rating_not_numeric": c("rating") > 5,
    }
    return K.integrity_checks(df, checks, key=F.lower("offer_name"), required=["offer_name", "anchor_price", "no_such_column"], min_rows=40)
