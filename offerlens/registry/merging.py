"""Merge queries: upserts, enrichment, descriptions, identities, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions.text import canonical_key
from offerlens.operators import merge as G
from offerlens.registry import sqltext as Q
from offerlens.registry.base import query
from offerlens.session import scratch_path
from offerlens.sources import files

c = F.col

_FIELDS = ("wine_name", "rating", "num_ratings", "price", "description", "url", "locked", "notes")
_LOCKED = "(lower(trim({0}locked)) IN ('1','true','yes','y','locked') OR starts_with(lower(trim({0}notes)), 'manual'))"


def _upsert_sql(old: str, new: str) -> str:
    last = ", ".join(f"arg_max(trim({f}), ord) FILTER (WHERE trim({f}) <> '') AS {f}" for f in _FIELDS)
    pick = ", ".join(f"CASE WHEN o.lk THEN trim(o.{f}) ELSE coalesce(n.{f}, trim(o.{f}), '') END AS {f}" for f in _FIELDS)
    shown = ", ".join(f for f in _FIELDS if f != "locked")
    return f"""SELECT match_name, {shown}, CASE WHEN {_LOCKED.format('')} THEN '1' ELSE locked END AS locked FROM (
 SELECT coalesce(o.match_name, n.match_name) AS match_name, {pick} FROM (SELECT *, {_LOCKED.format('')} AS lk FROM {old}) o
 FULL JOIN (SELECT i.match_name, {last} FROM {new} i LEFT JOIN (SELECT match_name, min(ord) AS stop FROM {new} WHERE {_LOCKED.format('')} GROUP BY 1) s ON s.match_name = i.match_name WHERE s.stop IS NULL OR i.ord <= s.stop GROUP BY 1) n ON n.match_name = o.match_name)"""


@query("j21_l9_upsert_with_locks", _upsert_sql("@override_rows@ AS ov", "@incoming_rows@").replace("@incoming_rows@ i ", "@incoming_rows@ AS i "))
def j21(i):
    return G.upsert_with_locks(i.override_rows, i.incoming_rows).orderBy("match_name")


@query(
    "j22_last_wins_upsert",
    """SELECT match_name, wine_name, rating FROM (SELECT *, row_number() OVER (PARTITION BY match_name ORDER BY rk DESC, ord DESC) AS rn FROM (
 SELECT match_name, wine_name, rating, ord, 0 AS rk FROM @override_rows@ UNION ALL SELECT match_name, wine_name, rating, ord, 1 FROM @incoming_rows@)) WHERE rn = 1""",
)
def j22(i):
    cols = ["match_name", "wine_name", "rating", "ord"]
    return G.last_wins_upsert(i.override_rows.select(cols), i.incoming_rows.select(cols), key="match_name").select("match_name", "wine_name", "rating")


_ENR_OLD = f"(SELECT ord, wine_name, rating, num_ratings, price, description, grapes, region, coalesce({Q.rating_url('url')}, '') AS url FROM @rating_base@)"
_ENR_NEW = f"(SELECT ord, match_name AS wine_name, rating, num_ratings, price, description, 'Merlot' AS grapes, region, {Q.rating_url('url')} AS url FROM @rating_override@ WHERE url IS NOT NULL UNION ALL SELECT ord + 5, 'new item', '3.3', '', '', 'text', '', 'Chile', 'https://new.example/w/' || CAST(ord % 50 AS STRING) FROM @rating_override@)"


def _enr_sql() -> str:
    fold = ", ".join([f"arg_max({f}, ord) FILTER (WHERE trim({f}) <> '') AS {f}" for f in ("rating", "num_ratings")] + [f"arg_min({f}, ord) FILTER (WHERE trim({f}) <> '') AS {f}" for f in ("price", "description", "grapes", "region")])
    return f"""WITH o AS (SELECT *, ord = max(ord) OVER (PARTITION BY url) AS takes FROM {_ENR_OLD}), f AS (SELECT url, {fold}, arg_min(wine_name, ord) AS wine_name, min(ord) AS ord FROM {_ENR_NEW} GROUP BY url)
SELECT coalesce(o.ord, f.ord) AS ord, coalesce(o.url, f.url) AS url, coalesce(o.wine_name, f.wine_name) AS wine_name, coalesce(f.rating, o.rating, '') AS rating, coalesce(f.num_ratings, o.num_ratings, '') AS num_ratings,
 coalesce(nullif(trim(o.price), ''), f.price, '') AS price, coalesce(nullif(trim(o.description), ''), f.description, '') AS description, coalesce(nullif(trim(o.grapes), ''), f.grapes, '') AS grapes, coalesce(nullif(trim(o.region), ''), f.region, '') AS region
FROM (SELECT * FROM o WHERE takes) o FULL JOIN f ON f.url = o.url
UNION ALL SELECT ord, url, wine_name, rating, num_ratings, price, description, grapes, region FROM o WHERE NOT takes"""


@query("j29_enrichment_merge", _enr_sql())
def j29(i):
    return G.merge_enrichment(i.sql(f"SELECT * FROM {_ENR_OLD}"), i.sql(f"SELECT * FROM {_ENR_NEW}")).select(
        "ord", "url", "wine_name", "rating", "num_ratings", "price", "description", "grapes", "region"
    )


@query(
    "f12_enrichment_targets",
    f"""WITH r AS (SELECT * FROM (SELECT *, {Q.rating_url('url')} AS u, row_number() OVER (PARTITION BY {Q.rating_url('url')} ORDER BY ord DESC) AS rn FROM @rating_base@ WHERE url IS NOT NULL) WHERE rn = 1)
SELECT o.ord FROM @rating_override@ AS o LEFT JOIN r ON r.u = {Q.rating_url('o.url')} WHERE o.url IS NOT NULL AND (r.u IS NULL OR NOT ((trim(r.rating) <> '' OR trim(r.num_ratings) <> '') AND trim(r.price) <> '' AND trim(r.description) <> '' AND trim(r.grapes) <> '' AND trim(r.region) <> ''))""",
)
def f12(i):
    return G.enrichment_targets(i.rating_override, i.rating_base).select("ord")


@query(
    "a19_unambiguous_values",
    "SELECT source AS key, min(v) AS value FROM (SELECT p_name AS source, p_type AS v FROM @part@ UNION ALL SELECT p_brand || ' ' || p_name, p_type FROM @part@) GROUP BY 1 HAVING count(DISTINCT v) = 1",
)
def a19(i):
    both = i.part.select(c("p_name").alias("k"), "p_type").unionByName(i.part.select(F.concat_ws(" ", "p_brand", "p_name").alias("k"), "p_type"))
    return G.unambiguous_values(both, c("k"), c("p_type"))


@query(
    "j12_preserved_descriptions",
    f"""WITH prev AS (SELECT {Q.ckey('offer_name')} AS nk, 'https://www.vivino.com/w/' || CAST(offer_id % 400 AS STRING) AS u, nullif(rating_description, '') AS d FROM @offers@),
bu AS (SELECT u, min(d) AS d FROM prev WHERE d IS NOT NULL GROUP BY u HAVING count(DISTINCT d) = 1), bn AS (SELECT nk, min(d) AS d FROM prev WHERE d IS NOT NULL AND nk <> '' GROUP BY nk HAVING count(DISTINCT d) = 1)
SELECT o.offer_id, coalesce(CASE WHEN size % 5 = 0 THEN 'fresh' END, bu.d, bn.d) AS rating_description FROM @offers@ AS o LEFT JOIN bu ON bu.u = 'https://www.vivino.com/w/' || CAST(o.offer_id % 500 AS STRING) LEFT JOIN bn ON bn.nk = {Q.ckey('o.offer_name')}""",
)
def j12(i):
    url = lambda n: F.concat(F.lit("https://www.vivino.com/w/"), (c("offer_id") % n).cast("string"))
    previous = i.offers.select("offer_name", url(400).alias("rating_url"), "rating_description")
    now = i.offers.select("offer_id", "offer_name", url(500).alias("rating_url"), F.when(c("size") % 5 == 0, " fresh ").otherwise("").alias("r_description"))
    return G.preserve_descriptions(now, previous).select("offer_id", "rating_description")


# ---- identities -------------------------------------------------------------------------

_IDS = f"""WITH l AS (SELECT *, {Q.ckey('name')} AS ikey FROM @identities@),
u AS (SELECT ikey, name, url AS a, CAST(NULL AS STRING) AS b, 1 AS rk, ord, 'overrides' AS source FROM l WHERE kind IN ('ECONOMY', 'LARGE')
 UNION ALL SELECT ikey, name, url || '/c', NULL, 2, ord, 'rating_cache' FROM l WHERE kind IN ('MEDIUM', 'PROMO') AND rating <> ''
 UNION ALL SELECT ikey, name, NULL, url || '/m', 3, ord, 'market_cache' FROM l WHERE kind IN ('SMALL', 'LARGE')),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ikey ORDER BY rk, ord) AS rn FROM u) WHERE rn = 1),
lb AS (SELECT ikey, arg_max(b, ord) AS b FROM u WHERE rk = 3 GROUP BY 1), fb AS (SELECT ikey, arg_min(url || '/t', ord) AS b FROM l WHERE kind <> 'PROMO' GROUP BY 1)"""
_IDS_OUT = f"{_IDS} SELECT e.ikey, e.name, e.a AS url_a, coalesce(lb.b, e.b, fb.b) AS url_b, e.source FROM e LEFT JOIN lb ON lb.ikey = e.ikey LEFT JOIN fb ON fb.ikey = e.ikey"


def _identities(i):
    l = i.identities
    tail = lambda t: F.concat(c("url"), F.lit(t)).alias("url")
    return G.build_identities(
        l.filter("kind IN ('ECONOMY', 'LARGE')").select("name", "url", "ord"),
        l.filter("kind IN ('MEDIUM', 'PROMO')").select("name", tail("/c"), "ord", "rating"),
        l.filter("kind IN ('SMALL', 'LARGE')").select("name", tail("/m"), "ord"),
        l.filter("kind <> 'PROMO'").select("name", tail("/t"), "ord"),
    )


@query("u2_identity_union", _IDS_OUT)
def u2(i):
    return _identities(i)


@query("a20_identity_totals", f"SELECT count(*) AS entries, count(url_a) AS with_a, count(url_b) AS with_b FROM ({_IDS_OUT})")
def a20(i):
    return _identities(i).agg(F.count("*").alias("entries"), F.count("url_a").alias("with_a"), F.count("url_b").alias("with_b"))


@query(
    "x62_set_and_flag_identities",
    f"""WITH l AS (SELECT *, {Q.ckey('name')} AS ikey FROM @identities@), s AS (SELECT ikey, min(name) AS name, min(url) AS url_a FROM l WHERE size < 35 GROUP BY 1),
n AS (SELECT ikey, arg_max(name, ord) AS name, arg_max(url || '/b', ord) AS b FROM l WHERE size > 20 GROUP BY 1), f AS (SELECT ikey, list_sort(list_distinct(list('flag ' || CAST(size % 2 AS STRING)))) AS flags FROM l WHERE kind = 'PROMO' GROUP BY 1),
m AS (SELECT coalesce(s.ikey, n.ikey) AS ikey, coalesce(n.name, s.name) AS name, s.url_a, n.b AS url_b, CASE WHEN n.ikey IS NULL THEN ['old'] ELSE [] END AS base, n.ikey IS NOT NULL AS upd FROM s FULL JOIN n ON n.ikey = s.ikey)
SELECT m.ikey, m.name, m.url_a, m.url_b, list_concat(base, coalesce(f.flags, [])) AS flags, CASE WHEN upd THEN 99 ELSE 1 END AS resolved_at FROM m LEFT JOIN f ON f.ikey = m.ikey""",
)
def x62(i):
    l = i.identities
    store = l.filter("size < 35").groupBy(canonical_key(c("name")).alias("ikey")).agg(F.min("name").alias("name"), F.min("url").alias("url_a")).withColumns(
        {"url_b": F.lit(None).cast("string"), "source": F.lit("x"), "validated": F.lit(True), "flags": F.array(F.lit("old")), "resolved_at": F.lit(1)}
    )
    updates = l.filter("size > 20").select(
        "name", F.lit("").alias("url_a"), F.concat(c("url"), F.lit("/b")).alias("url_b"), F.lit("").alias("source"), F.lit(True).alias("validated"), "ord"
    )
    merged = G.set_identities(store, updates, now=F.lit(99))
    flags = l.filter("kind = 'PROMO'").select("name", F.concat(F.lit("flag "), (c("size") % 2).cast("string")).alias("flag"))
    return G.flag_identities(merged, flags).select("ikey", "name", "url_a", "url_b", "flags", "resolved_at")


_INC = "(SELECT *, 0 AS s FROM @incoming_rows@ WHERE description <> '' UNION ALL SELECT *, 1 AS s FROM @incoming_rows@ WHERE description = '')"
_U3_NEW = "(SELECT match_name, s * 10000000000 + ord AS ord, wine_name, rating, num_ratings, price, description, url, locked, notes FROM (SELECT * FROM " + _INC + " AS inc) WHERE trim(rating) <> '' OR trim(num_ratings) <> '')"


@query("u3_merge_resolved", _upsert_sql("@override_rows@ AS ov", "(SELECT * FROM " + _U3_NEW + ")"))
def u3(i):
    new = i.incoming_rows
    return G.merge_resolved(i.override_rows, new.filter("description <> ''"), new.filter("description = ''"))


@query("u5_ordered_distinct", "SELECT o_custkey, (list(DISTINCT o_orderpriority ORDER BY o_orderpriority))[1:3] AS first_three FROM @orders@ GROUP BY 1")
def u5(i):
    """First three distinct values in order; the set is bounded by the few priorities that exist."""
    return i.orders.groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 3).alias("first_three"))


# ---- files ------------------------------------------------------------------------------


@query("s1_s3_csv_round_trip", "SELECT CAST(offer_id AS STRING) AS offer_id, offer_name, anchor_url, nullif(rating_description, '') AS rating_description, CAST(NULL AS STRING) AS absent FROM @offers@")
def s1(i):
    path = scratch_path(i.spark, "csv")
    files.write_csv(i.offers, path, ["offer_id", "offer_name", "anchor_url", "rating_description"])
    return files.read_csv(i.spark, path, ["offer_id", "offer_name", "anchor_url", "rating_description", "absent"])


@query("s2_optional_csv", "SELECT CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS url, count(*) AS parts FROM @part@ GROUP BY 1, 2")
def s2(i):
    """An absent file adds no rows: the union with it counts the parts alone."""
    none = files.read_optional_csv(i.spark, scratch_path(i.spark, "absent"), ["name", "url"])
    parts = i.part.select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("url"))
    return parts.unionByName(none).groupBy("name", "url").agg(F.count("*").alias("parts"))


@query("s1_mixed_headers", "SELECT name, price, url FROM @listings@ WHERE ord % 2 = 0 UNION ALL SELECT name, CAST(NULL AS STRING), url FROM @listings@ WHERE ord % 2 = 1")
def s1_mixed(i):
    """One folder whose files order and omit columns differently."""
    path = scratch_path(i.spark, "mixed")
    files.write_csv(i.listings.filter("ord % 2 = 0"), f"{path}/a", ["name", "price", "url"])
    files.write_csv(i.listings.filter("ord % 2 = 1"), f"{path}/b", ["url", "name"])
    return files.read_csv(i.spark, f"{path}/*", ["name", "price", "url"])


@query("s6_cache_last_wins", "SELECT o_custkey AS cache_key, max(o_orderkey) AS stamp, arg_max(o_orderpriority, o_orderkey) AS entry FROM @orders@ GROUP BY o_custkey")
def s6_last(i):
    path = scratch_path(i.spark, "cache")
    files.write_cache(i.orders.select(c("o_custkey").alias("cache_key"), c("o_orderkey").alias("stamp"), c("o_orderpriority").alias("entry")), path)
    return i.spark.read.parquet(path)


@query("s4_optional_columns", "SELECT name, price, url, in_stock FROM @listings@")
def s4(i):
    path = scratch_path(i.spark, "catalogue")
    rows = i.listings.withColumns({"in_stock": F.nullif("in_stock", F.lit("")), "cat_rating": F.lit(None).cast("string")})
    files.write_catalogue(rows, path)
    got = i.spark.read.option("header", True).csv(path)
    return got.select(*[F.coalesce(x, F.lit("")).alias(x) if x == "in_stock" else x for x in got.columns])


@query("s5_json_cache_import", "SELECT 'k' || CAST(user_id AS STRING) AS cache_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM @events@ WHERE event_type <> 'error'")
def s5(i):
    """Cache documents by event; the error ones are broken JSON and have no entries."""
    doc = F.concat(F.lit('{"k'), c("user_id").cast("string"), F.lit('": {"k": '), F.get_json_object("props", "$.k"), F.lit(', "kind": "'), c("event_type"), F.lit('"}'), F.when(c("event_type") == "error", "").otherwise("}"))
    return files.import_json_cache(i.events.select(doc.alias("doc")), "doc", "struct<k: bigint, kind: string>")


@query("s6_cache_write", "SELECT cache_key, hits FROM @query_cache@")
def s6(i):
    path = scratch_path(i.spark, "cache")
    files.write_cache(i.query_cache, path)
    return files.read_cache(i.spark, path, "cache_key string, stamp long, hits long").select("cache_key", "hits")


@query("s12_add_missing_columns", "SELECT p_partkey, p_brand, CAST(NULL AS DOUBLE) AS price_market, CAST(NULL AS STRING) AS market_retailer_name FROM @part@")
def s12(i):
    wanted = {"p_brand": "string", "price_market": "double", "market_retailer_name": "string"}
    return G.add_missing_columns(i.part.select("p_partkey", "p_brand"), wanted, set(wanted))


@query("s15_s16_input_inventory", " UNION ALL ".join(f"SELECT '{t}' AS input, true AS present, count(*) AS rows FROM @{t}@" for t in ("part", "offers", "documents", "pages")) + " UNION ALL SELECT 'absent', false, 0")
def s16(i):
    from offerlens.operators.quality import input_inventory

    return input_inventory({"part": i.part, "offers": i.offers, "documents": i.documents, "pages": i.pages, "absent": None})
