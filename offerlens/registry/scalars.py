"""Per-row queries: numbers, listing parts, metadata, prices, addresses, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import listing as L
from offerlens.functions import metadata as M
from offerlens.functions import numbers as N
from offerlens.functions import pages as P
from offerlens.functions import pricing as R
from offerlens.functions import text as X
from offerlens.functions import urls as U
from offerlens.operators.merge import has_metrics, is_locked, needs_enrichment
from offerlens.registry import sqltext as Q
from offerlens.registry.base import query
from offerlens.sources.feeds import first_by_name, flatten_feed

c = F.col

# ---- numbers ----------------------------------------------------------------------------

_NUM = """SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN ' $' || CAST(o_custkey AS STRING) || ',500.25 ' WHEN 1 THEN 'about -' || CAST(o_custkey AS STRING) || '.5 each' WHEN 2 THEN 'N/A' WHEN 3 THEN '' WHEN 4 THEN CAST(o_custkey AS STRING) || '.75k'
  WHEN 5 THEN '1' || CAST(o_custkey AS STRING) || 'M' ELSE '1,2' || CAST(o_custkey AS STRING) END AS t FROM @orders@"""


@query(
    "x1_x2_x3_x4_number_parsing",
    rf"""SELECT k, CASE WHEN regexp_full_match(trim(replace(replace(trim(t), '$', ''), ',', '')), '[+-]?(\d+\.?\d*|\.\d+)') THEN TRY_CAST(replace(replace(trim(t), '$', ''), ',', '') AS DOUBLE) END AS price,
 CASE WHEN lower(trim(t)) NOT IN ('', 'n/a', 'none', 'nan') THEN TRY_CAST({Q.ext("replace(trim(t), ',', '')", r'-?\d+(?:\.\d+)?', 0)} AS DOUBLE) END AS number,
 CASE WHEN lower(trim(t)) NOT IN ('', 'n/a', 'none', 'nan') THEN TRY_CAST(replace({Q.ext('trim(t)', r'\d[\d,]*', 0)}, ',', '') AS BIGINT) END AS whole,
 CAST(trunc(CASE WHEN lower(trim(t)) LIKE '%k' THEN TRY_CAST(replace(trim(t), ',', '')[:-2] AS DOUBLE) * 1000.0 WHEN lower(trim(t)) LIKE '%m' THEN TRY_CAST(replace(trim(t), ',', '')[:-2] AS DOUBLE) * 1000000.0 ELSE TRY_CAST(replace(trim(t), ',', '') AS DOUBLE) END) AS BIGINT) AS compact
 FROM ({_NUM})""",
)
def x1(i):
    t = c("t")
    return i.sql(_NUM).select(
        "k", N.parse_price(t).alias("price"), N.parse_float(t).alias("number"), N.parse_int(t).alias("whole"), N.parse_compact_count(t).alias("compact")
    )


# ---- listing parts ----------------------------------------------------------------------


@query(
    "x5_to_x11_listing_parts",
    f"SELECT ord, quantity, volume, year, package_type, name_clean, label_clean FROM {Q.prepared('@listings@')}",
)
def x5(i):
    return L.prepare_listings(i.listings, only_in_stock=False).select("ord", "quantity", "volume", "year", "package_type", "name_clean", "label_clean")


@query("f10_in_stock", f"SELECT ord FROM @listings@ WHERE {Q.STOCK}")
def f10(i):
    return i.listings.filter(L.in_stock(c("in_stock"))).select("ord")


@query("f16_named_rows", "SELECT doc_id FROM @documents@ WHERE trim(text) <> ''")
def f16(i):
    return i.documents.filter(N.has_value(c("text"))).select("doc_id")


@query("x8_extract_year", f"SELECT ord, {Q.year_of('name')} AS year FROM @listings@")
def x8(i):
    return i.listings.select("ord", X.extract_year(c("name")).alias("year"))


@query("x9_gift_listing", "SELECT ord, contains(lower(name), 'gift box') OR contains(lower(name), 'gift-box') OR contains(lower(url), 'gift') AS gift FROM @listings@")
def x9(i):
    return i.listings.select("ord", L.is_gift_listing(c("name"), c("url")).alias("gift"))


@query("x12_x13_x14_lookup_keys", f"SELECT ord, {Q.nkey('name')} AS plain_key, {Q.ckey('name')} AS canonical_key, {Q.ntext('name')} AS text_key FROM @listings@")
def x12(i):
    return i.listings.select("ord", X.normalize_key(c("name")).alias("plain_key"), X.canonical_key(c("name")).alias("canonical_key"), X.normalize_text(c("name")).alias("text_key"))


@query("x12_document_keys", f"SELECT doc_id, md5({Q.nkey('text')}) AS key_hash, len({Q.toks(Q.ckey('text'))}) AS words FROM @documents@")
def x12_docs(i):
    """Keys over whole document texts in four languages."""
    keys = i.documents.select("doc_id", X.normalize_key(c("text")).alias("key"))  # each text is folded once
    return keys.select("doc_id", F.md5("key").alias("key_hash"), F.size(X.tokens(X.drop_key_tokens(c("key")))).cast("long").alias("words"))


_SPLIT = """(SELECT *, CASE WHEN pos > 0 THEN parts[:pos - 1] ELSE parts END AS body FROM (SELECT *, coalesce(list_position(list_transform(parts, lambda p: lower(strip_accents(p)) IN ('red', 'white', 'rose', 'orange')), true), 0) AS pos
  FROM (SELECT *, string_split(name, ' - ') AS parts FROM @listings@)))"""


@query(
    "x15_split_listing",
    f"""SELECT ord, regexp_replace(array_to_string(CASE WHEN len(body) >= 2 THEN body[:-2] ELSE body[:1] END, ' - '), '^((19|20)\\d{{2}}\\s+|NV\\s+)', '') AS producer, CASE WHEN len(body) >= 2 THEN body[-1] END AS label_name,
 CASE WHEN pos > 0 THEN parts[pos] END AS color, CASE WHEN pos > 0 THEN parts[pos + 1] END AS volume_label, CASE WHEN pos > 0 THEN parts[pos + 2] END AS packaging FROM {_SPLIT}""",
)
def x15(i):
    return i.listings.select("ord", M.split_struct(c("name")).alias("s")).select("ord", "s.*")


_TEXT = Q.ntext("offer_name")
_SPARK = "(contains(t, 'prosecco') OR contains(t, 'champagne') OR contains(t, 'brut'))"
_KIND = f"""CASE WHEN {_SPARK} AND colour = 'rose' THEN 'Sparkling Rose' WHEN {_SPARK} THEN 'Sparkling' WHEN colour <> '' THEN upper(colour[1]) || colour[2:] END"""


@query(
    "j16_j17_x16_to_x22_metadata",
    f"""SELECT offer_id, country, region, wine_type, style_family, grapes, origin_label, CAST(origin_latitude AS DOUBLE) AS origin_latitude, CAST(origin_longitude AS DOUBLE) AS origin_longitude, grape_confidence,
 CASE WHEN (CASE WHEN country IS NULL THEN 0 ELSE 2 END) + w >= 5 THEN 'high' WHEN (CASE WHEN country IS NULL THEN 0 ELSE 2 END) + w >= 3 THEN 'medium' WHEN (CASE WHEN country IS NULL THEN 0 ELSE 2 END) + w > 0 THEN 'low' END AS metadata_confidence, offering_type FROM (
SELECT *, CASE grape_confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS w, CASE WHEN country IS NULL THEN NULL ELSE region || ', ' || country END AS origin_label FROM (
SELECT offer_id, CASE WHEN contains(t, 'champagne') THEN 'France' WHEN contains(t, 'gattinara') OR contains(t, 'barbera d alba') OR contains(t, 'prosecco') THEN 'Italy' END AS country,
 CASE WHEN contains(t, 'champagne') THEN 'Champagne' WHEN contains(t, 'gattinara') OR contains(t, 'barbera d alba') THEN 'Piedmont' WHEN contains(t, 'prosecco') THEN 'Veneto' END AS region,
 CASE WHEN contains(t, 'champagne') THEN 49.05 WHEN contains(t, 'gattinara') OR contains(t, 'barbera d alba') THEN 44.7 WHEN contains(t, 'prosecco') THEN 45.44 END AS origin_latitude,
 CASE WHEN contains(t, 'champagne') THEN 4.03 WHEN contains(t, 'gattinara') OR contains(t, 'barbera d alba') THEN 8.04 WHEN contains(t, 'prosecco') THEN 11.0 END AS origin_longitude,
 {_KIND} AS wine_type, CASE WHEN contains(t, 'champagne') THEN 'Champagne' WHEN contains(t, 'late harvest') THEN 'Sweet / Dessert' WHEN {_SPARK} THEN 'Sparkling' WHEN colour <> '' THEN upper(colour[1]) || colour[2:] END AS style_family,
 CASE WHEN contains(t, 'pinot noir') THEN 'Pinot Noir' WHEN contains(t, 'chardonnay') THEN 'Chardonnay' WHEN contains(t, 'barbera') THEN 'Barbera' WHEN contains(t, 'prosecco') THEN 'Glera' WHEN contains(t, 'gattinara') THEN 'Nebbiolo'
   WHEN {_SPARK} AND colour = 'rose' THEN 'Sparkling Rose Blend' WHEN colour = 'rose' THEN 'Rose Blend' WHEN contains(t, 'champagne') THEN 'Pinot Noir, Chardonnay, Pinot Meunier' END AS grapes,
 CASE WHEN contains(t, 'pinot noir') OR contains(t, 'chardonnay') OR contains(t, 'barbera') THEN 'high' WHEN contains(t, 'prosecco') OR contains(t, 'gattinara') OR colour = 'rose' THEN 'medium' WHEN contains(t, 'champagne') THEN 'low' END AS grape_confidence,
 CASE WHEN quantity >= 6 THEN 'Case' WHEN quantity > 1 THEN 'Bundle' WHEN contains(t, 'magnum') THEN 'Magnum' WHEN contains(t, 'half bottle') OR volume = '375ml' THEN 'Half Bottle' ELSE 'Single Bottle' END AS offering_type
 FROM (SELECT *, {_TEXT} AS t, CASE WHEN contains(offer_name, ' - Red') THEN 'red' WHEN contains(offer_name, ' - White') THEN 'white' WHEN contains(offer_name, ' - Rose') THEN 'rose' WHEN contains(offer_name, ' - Orange') THEN 'orange' ELSE '' END AS colour FROM @offers@)))""",
)
def x22(i):
    base = i.offers.select("offer_id", "offer_name", "quantity", "volume")
    return M.derive_metadata(base).select(
        "offer_id", "country", "region", "wine_type", "style_family", "grapes", "origin_label", "origin_latitude", "origin_longitude",
        "grape_confidence", "metadata_confidence", "offering_type",
    )


_DOC_RULES = (M.Rule(("the",), ("english", 1)), M.Rule(("und", "der"), ("german", 2)), M.Rule(("que", "los"), ("romance", 3)), M.Rule(("et",), ("french", 4)))


@query(
    "j16_ordered_rules_documents",
    "SELECT doc_id, CASE WHEN contains(t, 'the') THEN 'english' WHEN contains(t, 'und') OR contains(t, 'der') THEN 'german' WHEN contains(t, 'que') OR contains(t, 'los') THEN 'romance' WHEN contains(t, 'et') THEN 'french' END AS label FROM (SELECT doc_id, lower(text) AS t FROM @documents@)",
)
def j16_docs(i):
    return i.documents.select("doc_id", M.apply_rules(F.lower("text"), _DOC_RULES, ("label", "n"))["label"].alias("label"))


@query(
    "x23_gap_fill",
    "SELECT ord, coalesce(g0, nullif(trim(grapes), '')) AS grapes, CASE WHEN c0 IS NULL AND contains(region, '/') THEN trim(string_split(region, '/')[1]) ELSE c0 END AS country, CASE WHEN r0 IS NULL AND contains(region, '/') THEN trim(string_split(region, '/')[2]) ELSE r0 END AS region FROM (SELECT *, CASE WHEN length(wine_name) % 2 = 0 THEN 'Syrah' END AS g0, CASE WHEN length(wine_name) % 3 = 0 THEN 'Spain' END AS c0, CASE WHEN length(wine_name) % 5 = 0 THEN 'Rioja' END AS r0 FROM @rating_base@)",
)
def x23(i):
    n = F.length("wine_name")
    rows = i.rating_base.select(
        "ord", c("grapes").alias("r_grapes"), c("region").alias("r_region"), F.when(n % 2 == 0, "Syrah").alias("grapes"),
        F.when(n % 3 == 0, "Spain").alias("country"), F.when(n % 5 == 0, "Rioja").alias("region"), F.lit(None).cast("string").alias("grape_source"),
    )
    return M.gap_fill(rows, "r_grapes", "r_region").select("ord", "grapes", "country", "region")


@query("x25_search_names", rf"""SELECT ord, regexp_replace(regexp_replace(name, '\s*-\s*(Red|White|Rose|Rosé|Sparkling)\s*-.*$', ''), '^(?:NV|\d{{4}})\s+', '') AS simple FROM @listings@ WHERE contains(name, '') """)
def x25(i):
    return i.listings.select("ord", L.simplified_name(c("name")).alias("simple"))


@query("x25_clean_query", rf"""SELECT ord, {Q.squeeze(r"replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\(bundle of\s+\d+\)', ' ', 'g'), '(?i)\b(red|white|rose)\b', ' ', 'g'), '(?i)\bstandard bottle\b', ' ', 'g'), '(?i)\b\d+(?:\.\d+)?\s*(?:ml|l)\b', ' ', 'g'), ' - ', ' ')")} AS cleaned FROM @listings@""")
def x25b(i):
    return i.listings.select("ord", L.clean_query(c("name")).alias("cleaned"))


@query("x25_market_and_retry_queries")
def x25c(i):
    return i.listings.select("ord", L.market_search_name(c("name")).alias("market_name"), L.retry_query(c("name"), "wine-searcher.com").alias("retry"))


@query("x26_key_terms", "SELECT ord, list_filter(regexp_split_to_array(lower(name), '[\\s\\-]+'), lambda t: length(t) > 2 AND t NOT IN ('les','le','la','de','du','des','en','aux','et','clos','cru','premier','grand','1er','domaine','dom','chateau','château','maison','tenuta','cave')) AS terms FROM @listings@")
def x26(i):
    return i.listings.select("ord", L.key_terms(c("name")).alias("terms"))


@query("x27_validation_parts", f"""SELECT ord, lower(regexp_replace(CASE WHEN p >= 3 THEN array_to_string(parts[:p - 2], ' ') ELSE parts[1] END, '^(NV|\\d{{4}})\\s+', '')) AS producer, lower(CASE WHEN p >= 3 THEN parts[p - 1] WHEN len(parts) >= 2 AND lower(parts[2]) NOT IN ('red','white','rose','rosé') THEN parts[2] END) AS label,
 contains(lower(name), 'grand cru') AS has_grand_cru FROM (SELECT *, coalesce(list_position(list_transform(parts, lambda q: lower(q) IN ('red','white','rose','rosé')), true), 0) AS p FROM (SELECT *, string_split(name, ' - ') AS parts FROM @listings@))""")
def x27(i):
    v = L.validation_parts(c("name"))
    return i.listings.select("ord", v["producer"].alias("producer"), v["label"].alias("label"), v["has_grand_cru"].alias("has_grand_cru"))


# ---- prices -----------------------------------------------------------------------------

_LISTED = """SELECT l_orderkey * 10 + l_linenumber AS k, l_extendedprice AS p, CAST(l_quantity AS INT) AS q, l_tax, p_retailprice AS shop, l_discount, l_returnflag AS flag, p_size AS size,
 CASE l_linenumber % 5 WHEN 0 THEN '1.5l' WHEN 1 THEN '750ml' WHEN 2 THEN '3L' WHEN 3 THEN NULL ELSE 'Magnum' END AS volume FROM @lineitem@ JOIN @part@ ON p_partkey = l_partkey"""
_FACTOR = "(CASE WHEN lower(volume) IN ('1.5l', '1500ml', 'magnum') THEN 2 WHEN lower(volume) IN ('3l', '3000ml', 'double magnum', 'jeroboam') THEN 4 ELSE 1 END)"


@query("x48_scale_to_listing", f"SELECT k, CASE WHEN p > 30000 THEN {Q.r2(f'p * {_FACTOR} * greatest(q % 4, 1)')} END AS scaled FROM ({_LISTED})")
def x48(i):
    price = F.when(c("p") > 30000, c("p")).otherwise(-c("p"))
    return i.sql(_LISTED).select("k", R.scale_to_listing(price, c("q") % 4, c("volume")).alias("scaled"))


@query(
    "x49_resolve_rating_price",
    f"""SELECT k, CASE WHEN flag = 'N' AND size % 9 = 0 THEN NULL WHEN flag <> 'R' THEN scaled WHEN chosen / ref < 0.40 OR chosen / ref > 2.0 THEN NULL ELSE chosen END AS price FROM (
 SELECT *, CASE WHEN raw <> scaled AND abs(raw - ref) <= abs(scaled - ref) THEN raw ELSE scaled END AS chosen FROM (
 SELECT *, {Q.r2('p / 40')} AS raw, {Q.r2(f'p / 40 * {_FACTOR} * greatest(q % 4, 1)')} AS scaled, CASE WHEN size % 5 = 0 THEN shop ELSE (shop + shop * 1.25) / 2 END AS ref FROM ({_LISTED})))""",
)
def x49(i):
    rival = F.when(c("size") % 5 != 0, c("shop") * 1.25)
    url = F.when((c("flag") == "N") & (c("size") % 9 == 0), "").otherwise("u")
    source = F.when(c("flag") == "R", "override").otherwise("base")
    return i.sql(_LISTED).select("k", R.resolve_rating_price(c("p") / 40, c("q") % 4, c("volume"), c("shop"), rival, source, url).alias("price"))


_SHOP_GAP = "shop - p"


@query("x50_backfill_gap", f"SELECT k, coalesce(d0, {Q.r2('shop - p')}) AS diff, coalesce(p0, {Q.r2(f'coalesce(d0, {Q.r2(_SHOP_GAP)}) / p * 100.0')}) AS pct FROM (SELECT *, CASE WHEN flag = 'A' THEN 1.5 END AS d0, CASE WHEN flag = 'N' THEN 7.0 END AS p0 FROM ({_LISTED}))")
def x50(i):
    d, p = R.backfill_gap(c("shop"), c("p"), F.when(c("flag") == "A", 1.5), F.when(c("flag") == "N", 7.0))
    return i.sql(_LISTED).select("k", d.alias("diff"), p.alias("pct"))


@query(
    "x51_deal_score",
    f"""SELECT offer_id, {Q.r2('s + m + coalesce(rating, 0.0) / 5.0 * 25.0 + least(log10(CAST(coalesce(num_ratings, 0) + 1 AS DOUBLE)) / 3.0, 1.0) * 10.0 + (CASE WHEN s > 5 AND m > 5 THEN 5.0 ELSE 0.0 END)')} AS score FROM (
 SELECT *, least(greatest(-coalesce(price_diff_pct, 0.0), 0.0), 30.0) AS s, CASE WHEN rating_price > 0 THEN least(greatest((rating_price - anchor_price) / rating_price * 100.0, 0.0), 30.0) ELSE 0.0 END AS m FROM @offers@)""",
)
def x51(i):
    return i.offers.select("offer_id", R.deal_score(c("price_diff_pct"), c("rating"), c("num_ratings"), c("anchor_price"), c("rating_price")).alias("score"))


@query("x55_unit_price", f"SELECT offer_id, CASE WHEN d > 1 THEN anchor_price / d END AS unit_price, CASE WHEN d > 1 THEN (CASE WHEN f > 1 THEN '/750ml' ELSE '/btl' END) END AS basis FROM (SELECT *, f * greatest(quantity, 1) AS d FROM (SELECT *, {_FACTOR} AS f FROM @offers@))")
def x55(i):
    return i.offers.select("offer_id", R.unit_price(c("anchor_price"), c("quantity"), c("volume")).alias("unit_price"), R.unit_basis(c("quantity"), c("volume")).alias("basis"))


_WHOLE = "CAST(CAST(floor({} + 0.5) AS BIGINT) AS STRING) || '%'"


@query(
    "x56_market_gap_and_signals",
    f"""SELECT offer_id, CASE WHEN rating_price IS NULL THEN '' WHEN mp < 1 THEN 'Market price' WHEN anchor_price < rating_price THEN {_WHOLE.format('mp')} || ' below market' ELSE {_WHOLE.format('mp')} || ' above market' END AS gap_label,
 list_filter([CASE WHEN cheaper_side = 'Anchor Cheaper' AND abs(price_diff_pct) >= 5 THEN {_WHOLE.format('abs(price_diff_pct)')} || ' cheaper' WHEN cheaper_side = 'Rival Cheaper' AND abs(price_diff_pct) >= 5 THEN {_WHOLE.format('abs(price_diff_pct)')} || ' more vs rival' END,
  CASE WHEN mp < 3 THEN 'At market price' WHEN anchor_price < rating_price THEN {_WHOLE.format('mp')} || ' below mkt' WHEN mp IS NOT NULL THEN {_WHOLE.format('mp')} || ' above mkt' END,
  CASE WHEN rating >= 4.0 AND num_ratings >= 100 THEN printf('%.1f', floor(rating * 10 + 0.5) / 10) || ' (' || CAST(num_ratings AS STRING) || ')' END], lambda s: s IS NOT NULL) AS signals
 FROM (SELECT *, abs((anchor_price - rating_price) / rating_price * 100) AS mp FROM @offers@)""",
)
def x56(i):
    return i.offers.select(
        "offer_id", R.market_gap_label(c("anchor_price"), c("rating_price")).alias("gap_label"),
        R.deal_signals(c("price_diff_pct"), c("cheaper_side"), c("anchor_price"), c("rating_price"), c("rating"), c("num_ratings")).alias("signals"),
    )


# ---- addresses --------------------------------------------------------------------------


@query(
    "x37_normalize_urls",
    r"""SELECT page_id, CASE WHEN contains(h, 'example.com') AND contains(p, '/en') THEN s || '://' || h || rtrim(p, '/') ELSE url END AS passed, CASE WHEN contains(h, 'example.com') AND contains(p, '/en') THEN s || '://' || h || rtrim(p, '/') ELSE '' END AS strict
 FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM (SELECT page_id, url FROM @pages@))""".replace("'/en'", "'/w/'"),
)
def x37(i):
    return i.pages.select("page_id", U.normalize_item_url(c("url"), "example.com").alias("passed"), U.strict_item_url(c("url"), "example.com").alias("strict"))


@query("x37_rating_urls", f"SELECT ord, {Q.rating_url('url')} AS passed, coalesce({Q.rating_url('url')}, '') AS strict, coalesce({Q.rating_url('url')}, '') AS found FROM @ratings@")
def x37b(i):
    return i.ratings.select("ord", U.normalize_item_url(c("url")).alias("passed"), U.strict_item_url(c("url")).alias("strict"), U.first_item_url(F.concat(F.lit("see "), c("url"), F.lit(" there"))).alias("_f"), c("url")).select(
        "ord", "passed", "strict", F.when(c("url").isNull(), "").otherwise(c("_f")).alias("found")
    )


@query(
    "x38_url_parts",
    r"""SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'https://new.example' || substr(url, length('http://') + 1) ELSE url END AS moved, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
 replace(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), '-', ' ') AS slug FROM @pages@""",
)
def x38(i):
    return i.pages.select("page_id", U.rewrite_host(c("url"), ["http://"], "https://new.example/").alias("moved"), U.url_host(c("url")).alias("host"), U.slug_text(c("url")).alias("slug"))


@query("x38_item_ids_and_locale", "SELECT page_id, CASE WHEN url IS NOT NULL THEN CAST(page_id AS STRING) END AS item, CASE WHEN url IS NOT NULL THEN 'https://www.vivino.com/DE/de/x/w/' || CAST(page_id AS STRING) END AS moved, CASE WHEN url IS NOT NULL THEN 'x' ELSE '' END AS slug FROM @item_pages@")
def x38b(i):
    return i.item_pages.select("page_id", U.item_id(c("url")).alias("item"), U.force_locale(c("url"), locale="DE/de").alias("moved"), U.slug_text(c("url")).alias("slug"))


@query("x38_find_text", "SELECT c_custkey, lower(replace(c_name, '#', ' ')) || ' ' || lower(c_mktsegment) AS words FROM @customer@")
def x38c(i):
    url = F.concat(F.lit("https://x.example/find/"), F.replace("c_name", F.lit("#"), F.lit("+")), F.lit("%20"), c("c_mktsegment"), F.lit("/1999"))
    return i.customer.select("c_custkey", U.find_text(url).alias("words"))


# ---- pages ------------------------------------------------------------------------------


@query("x39_page_ratings", "SELECT page_id, CAST(1 + size % 4 AS STRING) || '.' || CAST(size % 10 AS STRING) AS rating, '1' || lpad(CAST(size AS STRING), 3, '0') AS num_ratings FROM @item_pages@")
def x39(i):
    return i.item_pages.select("page_id", *[v.alias(k) for k, v in P.rating_from_page(c("html")).items()])


@query(
    "x39_text_ratings",
    """SELECT o_orderkey, CAST(o_custkey % 6 AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING) AS rating, CASE WHEN o_orderkey % 3 = 0 THEN 'based on all vintages' ELSE CAST(o_custkey AS STRING) || '000' END AS num_ratings,
 CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE printf('%.2f', o_totalprice) END AS price FROM @orders@""",
)
def x39_text(i):
    """Visible text of a page, told from orders: rating, count with thousands mark or words, price if any."""
    count = F.when(c("o_orderkey") % 3 == 0, "Based on all vintages").otherwise(F.concat(c("o_custkey").cast("string"), F.lit(",000 ratings")))
    mark = F.concat_ws(".", (c("o_custkey") % 6).cast("string"), (c("o_orderkey") % 10).cast("string"))
    tail = F.when(c("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("from $ "), c("o_totalprice").cast("decimal(12,2)").cast("string")))
    text = F.concat(F.lit("Some wine\n"), mark, F.lit("\n"), F.lower(count), F.lit("\n"), tail)
    return i.orders.select("o_orderkey", *[v.alias(k) for k, v in P.rating_from_text(text).items()])


@query(
    "x40_page_facts",
    """SELECT page_id, offer_name AS page_name, CASE WHEN size % 3 = 0 THEN 'Bold ' || kind ELSE 'A full description of ' || kind END AS page_description,
 CASE WHEN size % 4 = 0 AND size >= 5 THEN CAST(size AS STRING) WHEN size % 4 = 1 AND size + 1 >= 5 THEN CAST(size + 1 AS STRING) WHEN size % 4 = 2 AND size + 2 >= 5 THEN CAST(size + 2 AS STRING) WHEN size * 3 >= 5 THEN CAST(size * 3 AS STRING) || '.0' END AS page_price,
 CASE WHEN size % 5 = 0 THEN NULL ELSE 'Merlot & ' || kind END AS page_grapes, concat_ws(chr(10), 'France / ' || kind, '', '1', 'Wine style', '', 'Bold ' || kind, CASE WHEN size % 14 = 0 THEN chr(10) || 'Access denied by Cloudflare' END) AS page_region, 'Bold ' || kind AS page_style FROM @item_pages@""",
)
def x40(i):
    facts = P.page_facts(i.item_pages.select("page_id", "html"), "html").drop("html")
    return facts


@query(
    "x40_page_facts_rich",
    "SELECT page_id, CASE WHEN size % 3 = 0 THEN 'Bold ' || kind ELSE 'A full description of ' || kind END AS page_description, 'Bold ' || kind AS page_style FROM @item_pages@",
)
def x40b(i):
    return P.page_facts_rich(i.item_pages.select("page_id", "html"), "html").select("page_id", "page_description", "page_style")


@query(
    "x41_html_to_text",
    r"SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n ', chr(10), 'g')) AS text_hash FROM @pages@",
)
def x41(i):
    return i.pages.select("page_id", F.md5(P.html_to_text(c("html"))).alias("text_hash"))


@query("x42_card_fields", "SELECT offer_id, CASE WHEN size % 3 = 0 THEN '' ELSE CAST(1 + size % 4 AS STRING) || CASE WHEN size % 10 = 0 THEN '' ELSE '.' || CAST(size % 10 AS STRING) END END AS card_rating, CASE WHEN size % 3 = 0 THEN '' ELSE CAST(size * 100 AS STRING) END AS card_num_ratings, size % 7 <> 0 AS card_in_stock FROM @offers@")
def x42(i):
    stars = F.concat((1 + c("size") % 4).cast("string"), F.lit("."), (c("size") % 10).cast("string"))
    html = F.when(c("size") % 3 == 0, F.lit("<div>plain</div>")).otherwise(F.concat(F.lit('<div data-vivino-rating="'), stars, F.lit('">x</div>')))
    text = F.concat(F.when(c("size") % 7 == 0, "Sold out ").otherwise("Add "), (c("size") / 10).cast("decimal(6,1)").cast("string"), F.lit("k ratings"))
    f = P.card_fields(html, text)
    return i.offers.select("offer_id", *[f[k].alias(k) for k in ("card_rating", "card_num_ratings", "card_in_stock")])


@query("x63_page_links", r"""SELECT page_id, pos - 1 AS pos, url, title FROM (SELECT page_id, pos, url, title, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS rn FROM
 (SELECT page_id, generate_subscripts(u, 1) AS p0, unnest(u) AS url, unnest(t) AS title, generate_subscripts(u, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS u, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM @pages@)) WHERE contains(url, '/') AND NOT contains(url, '/search/')) WHERE rn = 1""".replace("pos - 1 AS pos", "row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos"))
def x63(i):
    return P.page_links(i.pages, "html", ["page_id"], marker="/")


@query("x63_item_links", "SELECT page_id, '/en/winery-one/w/' || CAST(page_id AS STRING) || '?x=1' AS url, 'First &amp; best' AS title FROM @item_pages@ UNION ALL SELECT page_id, '/en/winery-two/w/7', 'winery two' FROM @item_pages@")
def x63b(i):
    return P.page_links(i.item_pages, "html", ["page_id"]).drop("pos")


@query("f18_block_pages", "SELECT page_id, CASE WHEN contains(lower(html), 'access denied') THEN 'access denied' ELSE 'cloudflare' END AS marker FROM @item_pages@ WHERE contains(lower(html), 'access denied') OR contains(lower(html), 'cloudflare') OR contains(lower(html), 'captcha') OR contains(lower(html), 'attention required')")
def f18(i):
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    return i.item_pages.filter(P.is_block_page(title, c("html"))).select("page_id", P.block_marker(title, c("html")).alias("marker"))


@query("f17_clean_descriptions", "SELECT doc_id, CASE WHEN length(text) < 20 OR contains(lower(text), 'mineur') OR contains(lower(text), 'verboten') OR contains(lower(text), 'forbidden') OR contains(lower(text), 'underage') OR contains(lower(text), 'interdit') OR contains(lower(text), 'yikes') OR contains(lower(text), 'fantastisk') OR contains(lower(text), 'try searching') OR contains(lower(text), 'alternative great wines') OR contains(lower(text), 'minderårig') OR contains(lower(text), 'minderjährig') OR contains(lower(text), 'förbjuden') OR contains(lower(text), 'sidan är') THEN '' ELSE md5(text) END AS kept FROM @documents@")
def f17(i):
    clean = P.clean_description(c("text"))
    return i.documents.select("doc_id", F.when(clean == "", "").otherwise(F.md5(clean)).alias("kept"))


@query("x44_lenient_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM @events@""")
def x44(i):
    """Fenced, cut-off and plain forms of every event's properties read the same."""
    fenced = F.when(c("event_id") % 3 == 0, F.concat(F.lit("```json\n"), c("props"), F.lit("\n```"))).when(
        c("event_id") % 3 == 1, F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(", "))
    ).otherwise(c("props"))
    return i.events.select("event_id", F.get_json_object(P.lenient_json(fenced), "$.k").cast("long").alias("k"))


@query("x43_snippet_prices", f"""SELECT offer_id AS item, floor(size * 2.5 * 100 + 0.5) / 100 AS price_foreign, {Q.r2('size * 2.5 * 1.3')} AS price, size AS stores FROM @offers@ WHERE size * 2.5 <= 500""")
def x43(i):
    """Three stored snippets per offer: another host, a wrong wine, and the right one."""
    price = (c("size") * 2.5).cast("decimal(8,2)").cast("string")
    right = F.concat(c("offer_name"), F.lit(" Avg Price (ex-tax) $ "), price, F.lit(" from "), c("size").cast("string"), F.lit(" stores"))
    snippet = lambda rank, url, title, text: F.struct(
        F.lit(rank).alias("rank"), F.lit(url).alias("url"), title.alias("title"), text.alias("description")
    )
    snippets = F.array(
        snippet(1, "https://elsewhere.example/1", c("offer_name"), F.lit("$ 9")),
        snippet(2, "https://www.wine-searcher.com/find/other", F.lit("zzz"), F.lit("Avg Price $ 50")),
        snippet(3, "https://www.wine-searcher.com/find/this", F.lit("page"), right),
    )
    rows = i.offers.select(c("offer_id").alias("item"), "offer_name", F.explode(snippets).alias("s")).select("item", "offer_name", "s.*")
    from offerlens.operators.resolve import snippet_prices

    found = snippet_prices(rows, item="item", name="offer_name")
    return found.select("item", "price_foreign", "price", "stores")


_FOUND_PRICE = "floor((5 + size * 2.5) * 100 + 0.5) / 100"


@query(
    "x43_market_outcome",
    f"""SELECT offer_id, CASE WHEN size % 3 = 0 AND size * 2.5 <= 495 THEN 'passed' WHEN size % 3 < 2 THEN 'passed_retry' ELSE 'tried_failed' END AS validation,
  CASE WHEN size % 3 = 0 AND size * 2.5 <= 495 THEN size WHEN size % 3 < 2 THEN size + 1 WHEN size * 2.5 <= 495 THEN size END AS stores,
  CASE WHEN size % 3 = 1 OR (size % 3 = 0 AND size * 2.5 > 495) THEN floor((7 + size * 2.5) * 100 + 0.5) / 100 WHEN size * 2.5 <= 495 THEN {_FOUND_PRICE} END AS price_foreign
FROM @offers@""",
)
def x43_outcome(i):
    """A first search whose address fits every third offer, and a retry whose address fits another third."""
    from offerlens.operators.resolve import resolve_market

    fits = F.concat(F.lit("https://www.wine-searcher.com/find/"), F.replace(F.lower("offer_name"), F.lit(" "), F.lit("+")))
    other = F.lit("https://www.wine-searcher.com/find/qqq+zzz")

    def found(address, more: int, stores):
        price = (c("size") * 2.5 + more).cast("decimal(8,2)").cast("string")
        text = F.concat(c("offer_name"), F.lit(" Avg Price (ex-tax) $ "), price, F.lit(" from "), stores.cast("string"), F.lit(" stores"))
        return i.offers.select(c("offer_id").alias("item"), "offer_name", F.lit(1).alias("rank"), address.alias("url"), F.lit("page").alias("title"), text.alias("description"))

    first = found(F.when(c("size") % 3 == 0, fits).otherwise(other), 5, c("size"))
    retry = found(F.when(c("size") % 3 < 2, fits).otherwise(other), 7, c("size") + 1)
    out = resolve_market(i.offers.select(c("offer_id").alias("item"), "offer_name"), first, retry, item="item", name="offer_name")
    return out.select(c("item").alias("offer_id"), "validation", "stores", "price_foreign")


@query("x45_tasting_summary", "SELECT c_custkey, lower(c_mktsegment) || ', oak, cherry. ' || repeat('good ', 39) || 'go...' AS summary FROM @customer@")
def x45(i):
    tastes = F.concat(F.lit('{"tastes":{"flavor":[{"primary_keywords":[{"name":"'), F.lower("c_mktsegment"), F.lit('"},{"name":"oak"},{"name":"third"}]},{"primary_keywords":[{"name":"oak"},{"name":"cherry"}]},{},{"primary_keywords":[]},{"primary_keywords":[{"name":"late"}]}]}}'))
    return i.customer.select("c_custkey", P.tasting_summary(tastes, F.lit("good \n " * 60)).alias("summary"))


@query(
    "x46_descriptions",
    "SELECT offer_id, concat_ws(' · ', nullif(grapes, ''), coalesce(style_family, nullif(region, '')), 'cherry, oak. Nice wine') AS description, CASE WHEN coalesce(nullif(grapes, ''), style_family, region) IS NOT NULL THEN 'cherry, oak' ELSE '' END AS notes_tasting, CASE WHEN coalesce(nullif(grapes, ''), style_family, region) IS NOT NULL THEN 'Nice wine' ELSE '' END AS notes_community FROM @offers@",
)
def x46(i):
    d = P.compose_description(c("grapes"), c("style_family"), c("region"), F.lit("cherry, oak. Nice wine"))
    parts = P.split_description(c("description"))
    return i.offers.select("offer_id", d.alias("description")).select("offer_id", "description", parts["notes_tasting"].alias("notes_tasting"), parts["notes_community"].alias("notes_community"))


@query("s17_search_responses", """SELECT item, 0 AS rank, 'https://a.example/w/' || CAST(item AS STRING) AS url, title FROM (SELECT c_custkey AS item, c_name AS title FROM @customer@) UNION ALL SELECT c_custkey, 2, 'https://b.example/' || c_mktsegment, c_mktsegment FROM @customer@
 UNION ALL SELECT c_custkey, 0, 'https://c.example/' || CAST(c_custkey AS STRING), c_name FROM @customer@ UNION ALL SELECT c_custkey, 0, 'https://d.example/' || CAST(c_nationkey AS STRING), c_mktsegment FROM @customer@""")
def s17(i):
    r = i.responses
    parts = [P.search_results(r, shape, ["item"], shape) for shape in ("organic", "items", "web")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FEED = """SELECT p_partkey AS ord, 0 AS pos, p_name || ' ' || p_brand AS name, CASE WHEN p_size % 3 = 0 OR p_size % 4 <> 0 THEN CAST(p_size AS STRING) ELSE CAST(p_size + 100 AS STRING) END || '.00' AS price, CASE WHEN p_size % 3 = 0 OR p_size % 4 = 0 THEN 'true' ELSE 'false' END AS in_stock, 'https://shop.example/products/h' || CAST(p_partkey AS STRING) AS url FROM @part@
 UNION ALL SELECT p_partkey, 2, p_type || ' ' || p_brand, 'N/A', 'false', 'https://shop.example/products/b' || CAST(p_partkey AS STRING) FROM @part@"""


@query("s7_product_feed", _FEED)
def s7(i):
    return flatten_feed(i.feed_pages, "payload", base_url="https://shop.example", keep=["ord"])


@query("w4_first_by_name", f"SELECT ord, pos, name, price, in_stock, url FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY ord, pos) AS rn FROM ({_FEED})) WHERE rn = 1")
def w4(i):
    return first_by_name(flatten_feed(i.feed_pages, "payload", base_url="https://shop.example", keep=["ord"]), order=("ord", "pos"))


@query("w4_first_by_text", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM @documents@ GROUP BY lower(trim(text, ' ' || chr(9) || chr(10) || chr(13)))")
def w4_docs(i):
    """First document per text; the copies are counted in the same aggregation."""
    return i.documents.groupBy(F.md5(F.lower(N.strip(c("text"))))).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


# ---- row predicates ---------------------------------------------------------------------


@query("f11_f12_f13_row_predicates", """SELECT ord, coalesce(trim(rating), '') <> '' OR coalesce(trim(num_ratings), '') <> '' OR coalesce(trim(alt_num_ratings), '') <> '' AS has_metrics,
 NOT ((coalesce(trim(rating), '') <> '' OR coalesce(trim(num_ratings), '') <> '') AND coalesce(trim(price), '') <> '' AND trim(description) <> '' AND trim(grapes) <> '' AND trim(region) <> '') AS needs_enrichment FROM @ratings@""")
def f11(i):
    return i.ratings.select(
        "ord", has_metrics(c("rating"), c("num_ratings"), c("alt_num_ratings")).alias("has_metrics"),
        needs_enrichment(c("rating"), c("num_ratings"), c("price"), c("description"), c("grapes"), c("region")).alias("needs_enrichment"),
    )


@query("f13_locked_rows", "SELECT match_name, lower(trim(locked)) IN ('1','true','yes','y','locked') OR starts_with(lower(trim(notes)), 'manual') AS is_locked FROM @override_rows@")
def f13(i):
    return i.override_rows.select("match_name", is_locked(c("locked"), c("notes")).alias("is_locked"))
