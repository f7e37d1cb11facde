"""Inputs derived from the given tables (plain SQL that both engines run)."""

from __future__ import annotations

from offerlens.registry.base import STANDINS

# One listing per part: name, address, price text and stock flag in catalogue style.
STANDINS["listings"] = """
SELECT p_partkey AS ord, p_brand AS brand, p_type AS kind, p_size AS size,
  (CASE WHEN p_size % 9 = 0 THEN 'NV' ELSE CAST(1995 + p_size % 6 AS STRING) END)
    || ' ' || (CASE p_type WHEN 'ECONOMY' THEN 'Château' WHEN 'LARGE' THEN 'Domaine' WHEN 'MEDIUM' THEN 'Cantina'
                 WHEN 'PROMO' THEN 'Bodega' WHEN 'SMALL' THEN 'Weingut' ELSE 'Vina' END)
    || ' ' || replace(p_brand, '#', ' ') || ' - ' || p_name || ' '
    || (CASE p_size % 8 WHEN 0 THEN 'Chardonnay' WHEN 1 THEN 'Pinot Noir' WHEN 2 THEN 'Prosecco Brut' WHEN 3 THEN 'Gattinara'
          WHEN 4 THEN 'Champagne Brut Réserve' WHEN 5 THEN 'Barbera d' || chr(39) || 'Alba' WHEN 6 THEN 'Late Harvest & Sweet' ELSE 'Cuvée' END)
    || (CASE p_size % 5 WHEN 0 THEN ' - Red' WHEN 1 THEN ' - White' WHEN 2 THEN ' - Rose' WHEN 3 THEN ' - Orange' ELSE '' END)
    || (CASE WHEN p_size % 5 = 4 THEN '' WHEN p_size % 7 = 0 THEN ' - 1.5 L - Magnum' WHEN p_size % 7 = 1 THEN ' - 375 ml - Half Bottle'
          ELSE ' - 750 ml - Standard Bottle' END)
    || (CASE WHEN p_size % 11 = 0 THEN ' (Bundle of 3)' WHEN p_size % 11 = 1 THEN ' w/ Gift Box' ELSE '' END) AS name,
  'https://shop.example/products/item-' || CAST(p_partkey AS STRING)
    || (CASE WHEN p_size % 6 = 0 THEN '-case-of-6' WHEN p_size % 6 = 1 THEN '-1-5-l' WHEN p_size % 6 = 2 THEN '-magnum' ELSE '' END) AS url,
  '$' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || '.'
    || lpad(CAST(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) % 100 AS STRING), 2, '0') AS price,
  (CASE WHEN p_size % 10 = 3 THEN 'false' WHEN p_size % 10 = 4 THEN '' WHEN p_size % 10 = 5 THEN 'Sold out' ELSE 'In Stock' END) AS in_stock
FROM @part@
"""

# The two shops stock different brands; together they are the whole table.
STANDINS["anchors"] = "SELECT * FROM @listings@ WHERE brand < 'Brand#2'"
STANDINS["rivals"] = "SELECT * FROM @listings@ WHERE brand >= 'Brand#2'"

# Order lines per part: exact whole-number aggregates.
STANDINS["line_facts"] = """
SELECT l_partkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS qty,
  max(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS max_cents,
  min(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS min_cents
FROM @lineitem@ GROUP BY l_partkey
"""

# One served offer per part with every column the listing queries use.
STANDINS["offer_base"] = """
SELECT ord AS offer_id, name AS offer_name, brand, kind, size,
  CASE WHEN size % 9 = 0 THEN NULL ELSE 1995 + size % 6 END AS vintage,
  CASE WHEN size % 6 = 0 THEN 6 WHEN size % 11 = 0 THEN 3 ELSE 1 END AS quantity,
  CASE WHEN size % 7 = 0 THEN '1.5l' WHEN size % 7 = 1 THEN '375ml' ELSE '750ml' END AS volume,
  p_retailprice AS anchor_price,
  CASE WHEN size % 4 = 0 THEN NULL WHEN size % 4 = 1 THEN p_retailprice
       ELSE floor((CAST(min_cents AS DOUBLE) / 100 + p_retailprice) / 2 * 100 + 0.5) / 100 END AS rival_price,
  CASE WHEN size % 13 = 0 THEN NULL ELSE floor(CAST(qty AS DOUBLE) / n / 10 * 100 + 0.5) / 100 END AS rating,
  CASE WHEN size % 13 = 0 OR size % 17 = 0 THEN NULL ELSE n * 20 END AS num_ratings,
  CASE WHEN size % 5 = 1 THEN NULL ELSE CAST(max_cents AS DOUBLE) / 100 / 50 END AS rating_price,
  CASE WHEN size % 10 = 0 THEN NULL ELSE 'https://www.vivino.com/SG/en/x/w/' || CAST(ord AS STRING) END AS rating_url,
  CASE WHEN size % 3 = 0 THEN '' ELSE 'Notes on ' || name END AS rating_description,
  url AS anchor_url, 'https://rival.example/products/' || CAST(ord AS STRING) AS rival_url,
  CASE size % 7 WHEN 0 THEN 'France' WHEN 1 THEN 'Italy' WHEN 2 THEN 'Spain' WHEN 3 THEN 'Chile' WHEN 4 THEN 'New Zealand' WHEN 5 THEN NULL ELSE 'South Africa' END AS country,
  CASE WHEN size % 7 = 5 OR size % 12 = 0 THEN NULL ELSE 'Region ' || kind END AS region,
  CASE size % 5 WHEN 0 THEN 'Red' WHEN 1 THEN 'White' WHEN 2 THEN 'Rose' WHEN 3 THEN 'Orange' ELSE NULL END AS wine_type,
  CASE WHEN size % 8 = 4 THEN 'Champagne' WHEN size % 8 = 6 THEN 'Sweet / Dessert' WHEN size % 5 = 0 THEN 'Red' WHEN size % 5 = 1 THEN 'White' ELSE NULL END AS style_family,
  CASE size % 6 WHEN 0 THEN 'Chardonnay' WHEN 1 THEN 'Pinot Noir, Chardonnay' WHEN 2 THEN 'Syrah,  Merlot , Pinot Noir' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'Merlot' END AS grapes,
  CASE WHEN size % 6 = 0 THEN 'Case' WHEN size % 11 = 0 THEN 'Bundle' WHEN size % 7 = 0 THEN 'Magnum' WHEN size % 19 = 0 THEN NULL ELSE 'Single Bottle' END AS offering_type,
  kind || ' ' || brand AS producer,
  CASE WHEN size % 15 = 0 THEN NULL ELSE p_name END AS label_name,
  CASE WHEN size % 13 = 0 THEN 'none' WHEN size % 3 = 0 THEN 'exact' WHEN size % 3 = 1 THEN 'canonical' ELSE 'fuzzy' END AS match_method
FROM @listings@ JOIN @part@ ON ord = p_partkey JOIN @line_facts@ ON l_partkey = ord
"""

STANDINS["offers"] = """
SELECT b.*, pd AS price_diff, pct AS price_diff_pct,
  CASE WHEN rival_price IS NULL THEN 'No Match' WHEN pd = 0 THEN 'Same Price' WHEN pd < 0 THEN 'Anchor Cheaper' ELSE 'Rival Cheaper' END AS cheaper_side,
  CASE WHEN country IS NULL THEN NULL ELSE coalesce(region || ', ', '') || country END AS origin_label,
  CASE WHEN country IS NULL THEN NULL ELSE 40.25 + size % 7 END AS origin_latitude,
  CASE WHEN country IS NULL OR region IS NULL THEN NULL ELSE 2.5 - size % 7 END AS origin_longitude,
  'region' AS origin_precision,
  floor(((CASE WHEN pct < 0 THEN -pct ELSE 0.0 END) / 2 + coalesce(rating, 0.0) * 5) * 100 + 0.5) / 100 AS deal_score
FROM (SELECT c.*, floor(pd / rival_price * 100 * 100 + 0.5) / 100 AS pct
      FROM (SELECT offer_base.*, floor((anchor_price - rival_price) * 100 + 0.5) / 100 AS pd FROM @offer_base@) AS c) AS b
"""

# Price snapshots: events of a user are the history of one offer.
STANDINS["snapshots"] = """
SELECT 'offer ' || CAST(user_id AS STRING) AS offer_name, ts AS captured_at, event_id,
  value AS anchor_price, floor(value * 110 + 0.5) / 100 AS rival_price
FROM @events@
"""

# Current offers of the same names: the last price seen, one cent and a half later.
STANDINS["current_offers"] = """
SELECT 'offer ' || CAST(user_id AS STRING) AS offer_name, max(value) AS anchor_price, min(value) AS rival_price
FROM @events@ GROUP BY user_id
"""

# Rating rows: base rows spell the listing differently, override rows add a second source.
STANDINS["rating_base"] = """
SELECT ord, 'base' AS source,
  CASE WHEN size % 5 = 0 THEN upper(name) WHEN size % 5 = 1 THEN replace(name, ' - ', ' & ') WHEN size % 5 = 2 THEN replace(replace(name, ' - Rose', ''), 'Standard Bottle', '')
       WHEN size % 5 = 3 THEN 'The ' || name || ' estate' ELSE kind || ' unknown ' || CAST(size AS STRING) END AS wine_name,
  CASE WHEN size % 4 = 0 THEN name ELSE NULL END AS match_name,
  CASE WHEN size % 6 = 0 THEN '' ELSE CAST(1 + size % 4 AS STRING) || '.' || CAST(size % 10 AS STRING) END AS rating,
  CASE WHEN size % 6 = 0 THEN '' WHEN size % 6 = 1 THEN '0' ELSE CAST(size * 37 AS STRING) END AS num_ratings,
  CASE WHEN size % 6 = 1 THEN '1,' || lpad(CAST(size AS STRING), 3, '0') ELSE NULL END AS alt_num_ratings,
  CAST(20 + size AS STRING) AS price,
  CASE WHEN size % 8 = 7 THEN NULL ELSE 'https://www.vivino.com/SG/en/x/w/' || CAST(1000 + ord % 97 AS STRING) || '/?year=1999' END AS url,
  CASE WHEN size % 3 = 0 THEN 'Long notes for ' || name ELSE '' END AS description,
  CASE WHEN size % 4 = 1 THEN 'Nebbiolo' ELSE '' END AS grapes,
  CASE WHEN size % 4 = 1 THEN 'Italy / Piedmont' WHEN size % 4 = 2 THEN 'Chile' ELSE '' END AS region
FROM @listings@
"""

STANDINS["rating_override"] = """
SELECT 1000000000 + ord AS ord, 'override' AS source, CAST(NULL AS STRING) AS wine_name, name AS match_name,
  CASE WHEN size % 2 = 0 THEN '4.5' ELSE '' END AS rating, CASE WHEN size % 2 = 0 THEN '250' ELSE '' END AS num_ratings,
  CAST(NULL AS STRING) AS alt_num_ratings, CAST(900 + size AS STRING) AS price,
  CASE WHEN size % 12 = 3 THEN NULL ELSE 'https://www.vivino.com/SG/en/x/w/' || CAST(1000 + ord % 97 AS STRING) END AS url,
  'Reviewed' AS description, '' AS grapes, '' AS region
FROM @rivals@ WHERE size >= 30
"""

STANDINS["ratings"] = "SELECT * FROM @rating_base@ UNION ALL SELECT * FROM @rating_override@"

# Market rows: two spellings per listing, later rows win.
STANDINS["market"] = """
SELECT ord, name AS match_name, CASE WHEN size % 9 = 2 THEN '' ELSE CAST(10 + size AS STRING) || '.50' END AS price,
  'Market avg (' || CAST(size AS STRING) || ' stores)' AS retailer_name, 'https://www.wine-searcher.com/find/' || CAST(ord AS STRING) AS retailer_url
FROM @listings@
UNION ALL
SELECT 1000000000 + ord, upper(name), CAST(15 + size AS STRING), 'Second', ''
FROM @listings@ WHERE kind = 'PROMO'
"""

# Stored item pages with embedded data and visible marks.
STANDINS["item_pages"] = """
SELECT offer_id AS page_id, rating_url AS url,
  '<html><head><title>' || offer_name || '</title><script type="application/ld+json">{"name":"' || offer_name || '","description":"'
    || (CASE WHEN size % 3 = 0 THEN 'short' ELSE 'A full description of ' || kind END) || '","offers":['
    || '{"price":"' || CAST(size AS STRING) || '","priceCurrency":"USD"},{"lowPrice":' || CAST(size * 3 AS STRING) || ',"priceCurrency":"SGD"}],'
    || '"aggregateRating":{"ratingValue":"' || CAST(1 + size % 4 AS STRING) || '.' || CAST(size % 10 AS STRING) || '","ratingCount":"1,' || lpad(CAST(size AS STRING), 3, '0') || '"}}</script></head><body>'
    || '<a href="/en/winery-one/w/' || CAST(offer_id AS STRING) || '?x=1">First &amp; best</a><a href="/search/w/9">no</a><a href="/en/winery-two/w/7"></a>'
    || (CASE WHEN size % 4 = 0 THEN '<b>$' || CAST(size AS STRING) || '</b><i>Price is per bottle</i>' WHEN size % 4 = 1 THEN '<b>$' || CAST(size + 1 AS STRING) || '</b><i>Average online price</i>'
          WHEN size % 4 = 2 THEN '<b>$' || CAST(size + 2 AS STRING) || '</b><b>Add to cart</b>' ELSE '' END)
    || '<h3>Grapes</h3><p>' || (CASE WHEN size % 5 = 0 THEN 'Contains sulfites' ELSE 'Merlot &amp; ' || kind END) || '</p><h3>Region</h3><p>France / ' || kind || '</p><hr>1'
    || '<h3>Wine style</h3><p>Bold ' || kind || '</p>'
    || (CASE WHEN size % 14 = 0 THEN '<p>Access denied by Cloudflare</p>' ELSE '' END) || '</body></html>' AS html,
  offer_name, size, kind
FROM @offers@
"""

# Search responses in three shapes.
STANDINS["responses"] = """
SELECT c_custkey AS item, c_nationkey AS nation,
  '{"organic":[{"link":"https://a.example/w/' || CAST(c_custkey AS STRING) || '","title":"' || c_name || '"},{"link":" ","title":"blank"},{"link":"https://b.example/' || c_mktsegment || '","title":" ' || c_mktsegment || ' "}]}' AS organic,
  '{"items":[{"link":"https://c.example/' || CAST(c_custkey AS STRING) || '","title":"' || c_name || '"}]}' AS items,
  '{"web":{"results":[{"url":"https://d.example/' || CAST(c_nationkey AS STRING) || '","title":"' || c_mktsegment || '"},{"title":"no address"}]}}' AS web
FROM @customer@
"""

# Product feed pages: each part lists itself in two variants and a second product by brand.
STANDINS["feed_pages"] = """
SELECT p_partkey AS ord,
  '{"products":[{"title":" ' || p_name || ' ' || p_brand || '","handle":"h' || CAST(p_partkey AS STRING) || '","variants":[{"price":"'
    || CAST(p_size AS STRING) || '.00","available":' || (CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END) || '},{"price":"' || CAST(p_size + 100 AS STRING)
    || '.00","available":' || (CASE WHEN p_size % 4 = 0 THEN 'true' ELSE 'false' END) || '}]},{"title":"","handle":"x","variants":[]},{"title":"'
    || p_type || ' ' || p_brand || '","handle":"b' || CAST(p_partkey AS STRING) || '","variants":[]}]}' AS payload
FROM @part@
"""

# Reviewed overrides and incoming updates, keyed by part name; several incoming rows per key.
STANDINS["override_rows"] = """
SELECT p_name AS match_name, min(p_partkey) AS ord, min(p_brand) AS wine_name,
  CASE WHEN min(p_size) % 2 = 0 THEN '3.9' ELSE '' END AS rating, '' AS num_ratings, '10' AS price, 'old text' AS description, '' AS url,
  CASE WHEN min(p_size) % 3 = 0 THEN 'Yes' ELSE '' END AS locked, CASE WHEN max(p_size) % 4 = 0 THEN 'Manual check' ELSE 'auto' END AS notes
FROM @part@ GROUP BY p_name
"""

STANDINS["incoming_rows"] = """
SELECT p_name || (CASE WHEN p_size = 50 THEN ' new' ELSE '' END) AS match_name, p_partkey AS ord, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS wine_name,
  CASE WHEN p_size % 4 = 0 THEN '4.' || CAST(p_size % 10 AS STRING) ELSE ' ' END AS rating, CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS STRING) ELSE '' END AS num_ratings,
  '' AS price, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS description, 'https://x.example/' || CAST(p_size AS STRING) AS url,
  CASE WHEN p_size = 41 THEN 'locked' ELSE '' END AS locked, CASE WHEN p_size = 43 THEN 'manual fix' ELSE '' END AS notes
FROM @part@
"""

# Cached results of earlier requests.
STANDINS["query_cache"] = """
SELECT 'p' || CAST(user_id % 3 AS STRING) || '|8|' || event_type || ' ' || CAST(user_id AS STRING) AS cache_key,
  max(CAST(floor(value * 1000) AS BIGINT)) AS stamp, count(*) AS hits
FROM @events@ GROUP BY user_id, event_type
"""

STANDINS["identities"] = """
SELECT ord, name, 'https://www.vivino.com/w/' || CAST(ord AS STRING) AS url, size, kind, CASE WHEN size % 4 = 0 THEN '' ELSE '4.1' END AS rating FROM @listings@
"""
