"""Merging reviewed, cached and freshly extracted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.numbers import blank_to_null, has_value, text
from offerlens.functions.text import canonical_key, description_key
from offerlens.functions.urls import normalize_item_url

# --- fixed values -----------------------------------------------------------------
OVERRIDE_FIELDS = ["match_name", "wine_name", "rating", "num_ratings", "price", "description", "url", "locked", "notes"]
LOCK_WORDS = ("1", "true", "yes", "y", "locked")
# -------------------------------------------------------------------------------------


def is_locked(locked: Column, notes: Column) -> Column:
    """A lock word, or notes that start with "manual"."""
    return F.lower(text(locked)).isin(*LOCK_WORDS) | F.startswith(F.lower(text(notes)), F.lit("manual"))


def has_metrics(rating: Column, count: Column, alt_count: Column) -> Column:
    return has_value(rating) | has_value(count) | has_value(alt_count)


def needs_enrichment(rating, count, price, description, grapes, region) -> Column:
    """Something publication needs is still missing."""
    full = (has_value(rating) | has_value(count)) & has_value(price) & has_value(description) & has_value(grapes) & has_value(region)
    return ~full


def upsert_with_locks(
    existing: DataFrame, incoming: DataFrame, *, key: str = "match_name", fields: list[str] = OVERRIDE_FIELDS,
    locked: str = "locked", notes: str = "notes", order: str = "ord",
) -> DataFrame:
    """Merge incoming rows into existing ones; locked rows never change.

    Non-blank incoming values win, blanks keep the old value, rows of one key apply in order
    and stop after the first one that locks the row.  Everything is aggregation by key, so a
    key with very many incoming rows is combined before the shuffle.
    """
    rest = [f for f in fields if f != key]
    trimmed = lambda df: df.select(blank_to_null(F.col(key)).alias(key), *[text(F.col(f)).alias(f) for f in rest], order).filter(F.col(key).isNotNull())
    old = (
        trimmed(existing)
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("o"))
        .withColumn("is_locked", is_locked(F.col(f"o.{locked}"), F.col(f"o.{notes}")))
    )
    new = trimmed(incoming)
    stop = new.groupBy(key).agg(
        F.min(F.when(is_locked(F.col(locked), F.col(notes)), F.col(order))).alias("stop")
    )
    applied = (
        new.join(stop, key)
        .filter(F.col("stop").isNull() | (F.col(order) <= F.col("stop")))
        .groupBy(key)
        .agg(*[F.max_by(F.col(f), F.when(F.col(f) != "", F.col(order))).alias(f"n_{f}") for f in rest])
    )
    merged = old.join(applied, key, "full_outer")
    pick = lambda f: F.when(F.coalesce("is_locked", F.lit(False)), F.col(f"o.{f}")).otherwise(
        F.coalesce(F.nullif(F.col(f"n_{f}"), F.lit("")), F.col(f"o.{f}"), F.lit(""))
    )
    out = merged.select(key, *[pick(f).alias(f) for f in rest])
    return out.withColumn(locked, F.when(is_locked(F.col(locked), F.col(notes)), "1").otherwise(F.col(locked)))


def last_wins_upsert(existing: DataFrame, incoming: DataFrame, *, key: str, order: str = "ord") -> DataFrame:
    """Whole-row replacement by key; incoming beats existing, later beats earlier."""
    both = existing.withColumn("_rank", F.lit(0)).unionByName(incoming.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("_rank", key)]
    return (
        both.withColumn(key, blank_to_null(F.col(key)))
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*cols), F.struct("_rank", order)).alias("r"))
        .select(key, "r.*")
    )


def enrichment_targets(overrides: DataFrame, ratings: DataFrame, *, order: str = "ord") -> DataFrame:
    """Override rows whose address has no complete rating row yet."""
    latest = (
        ratings.select(normalize_item_url(F.col("url")).alias("ukey"), F.struct(*ratings.columns).alias("r"), F.col(order).alias("_o"))
        .filter("ukey is not null")
        .groupBy("ukey")
        .agg(F.max_by("r", "_o").alias("r"))
    )
    r = lambda c: F.col(f"r.{c}")
    return (
        overrides.withColumn("ukey", normalize_item_url(F.col("url")))
        .filter("ukey is not null")
        .join(latest, "ukey", "left")
        .filter(r("url").isNull() | needs_enrichment(r("rating"), r("num_ratings"), r("price"), r("description"), r("grapes"), r("region")))
        .drop("r", "ukey")
    )


def merge_enrichment(ratings: DataFrame, facts: DataFrame, *, key: str = "url", order: str = "ord",
                     overwrite: tuple[str, ...] = ("rating", "num_ratings"),
                     fill: tuple[str, ...] = ("price", "description", "grapes", "region")) -> DataFrame:
    """Add page facts by address: metrics overwrite, other fields only fill blanks, new addresses insert.

    Only the last rating row of an address takes facts; earlier rows pass through.
    """
    latest = ratings.groupBy(key).agg(F.max(order).alias("_last"))
    base = ratings.join(latest, key, "left").withColumn("_takes", F.col(order) == F.col("_last")).drop("_last")
    folded = facts.groupBy(key).agg(
        *[F.max_by(F.col(c), F.when(has_value(F.col(c)), F.col(order))).alias(f"f_{c}") for c in overwrite],
        *[F.min_by(F.col(c), F.when(has_value(F.col(c)), F.col(order))).alias(f"f_{c}") for c in fill],
        F.min_by(F.col("wine_name"), F.col(order)).alias("f_name"),
        F.min(order).alias("f_ord"),
    )
    taking = base.filter("_takes").join(folded, key, "full_outer")
    out = taking.withColumns(
        {
            **{c: F.coalesce(blank_to_null(F.col(f"f_{c}")), F.col(c), F.lit("")) for c in overwrite},
            **{c: F.coalesce(blank_to_null(F.col(c)), blank_to_null(F.col(f"f_{c}")), F.lit("")) for c in fill},
            "wine_name": F.coalesce("wine_name", "f_name"),
            order: F.coalesce(F.col(order), F.col("f_ord")),
        }
    ).select(*ratings.columns)
    return out.unionByName(base.filter(~F.coalesce("_takes", F.lit(False))).select(*ratings.columns))


def unambiguous_values(df: DataFrame, key: Column, value: Column, *, key_as: str = "key", value_as: str = "value") -> DataFrame:
    """Keys with exactly one distinct non-blank value (least equals greatest)."""
    return (
        df.select(key.alias(key_as), blank_to_null(value).alias("_v"))
        .filter(F.col("_v").isNotNull() & (F.coalesce(F.col(key_as), F.lit("")) != ""))
        .groupBy(key_as)
        .agg(F.min("_v").alias(value_as), F.max("_v").alias("_hi"))
        .filter(F.col(value_as) == F.col("_hi"))
        .drop("_hi")
    )


def preserve_descriptions(offers: DataFrame, previous: DataFrame, *, name: str = "offer_name", url: str = "rating_url",
                          new: str = "r_description", out: str = "rating_description") -> DataFrame:
    """New text, else the previous one by address, else by name, if that is unambiguous."""
    by_url = unambiguous_values(previous, normalize_item_url(F.col(url)), F.col(out), key_as="_ukey", value_as="_by_url")
    by_name = unambiguous_values(previous, description_key(F.col(name)), F.col(out), key_as="_nkey", value_as="_by_name")
    return (
        offers.withColumns({"_ukey": normalize_item_url(F.col(url)), "_nkey": description_key(F.col(name))})
        .join(by_url, "_ukey", "left")
        .join(by_name, "_nkey", "left")
        .withColumn(out, F.coalesce(blank_to_null(F.col(new)), F.col("_by_url"), F.col("_by_name")))
        .drop("_ukey", "_nkey", "_by_url", "_by_name")
    )


# ---- identities -----------------------------------------------------------------------


def build_identities(overrides: DataFrame, rating_cache: DataFrame, market_cache: DataFrame, market_table: DataFrame,
                     existing: DataFrame | None = None, *, order: str = "ord") -> DataFrame:
    """Trust-ordered union: existing, overrides, cached ratings, validated market addresses.

    Inputs: (name, url, ord) each; the rating cache also has ``rating`` and the market cache is
    already validated.  A market address becomes the second address of a known key or a new
    entry; the market table only fills a missing second address of a known key.
    """
    shape = lambda df, rank, source, a, b: df.filter(has_value(F.col("name")) & has_value(F.col("url"))).select(
        canonical_key(F.col("name")).alias("ikey"), F.trim("name").alias("name"), F.trim(a).alias("url_a"), F.trim(b).alias("url_b"),
        F.lit(source).alias("source"), F.lit(rank).alias("rank"), F.col(order).alias("ord"),
    )
    none, url = F.lit(None).cast("string"), F.col("url")
    layers = [
        shape(overrides, 1, "overrides", url, none),
        shape(rating_cache.filter(has_value(F.col("rating"))), 2, "rating_cache", url, none),
        shape(market_cache, 3, "market_cache", none, url),
    ]
    if existing is not None:
        layers.append(existing.select("ikey", "name", "url_a", "url_b", "source", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("ord")))
    both = layers[0]
    for layer in layers[1:]:
        both = both.unionByName(layer)
    base = both.groupBy("ikey").agg(
        F.min_by(F.struct("name", "url_a", "url_b", "source"), F.struct("rank", "ord")).alias("e"),
        F.max_by("url_b", F.when(F.col("rank") == 3, F.col("ord"))).alias("late_b"),
    )
    fill = (
        shape(market_table, 4, "market_table", none, url)
        .groupBy("ikey").agg(F.min_by("url_b", "ord").alias("fill_b"))
    )
    return base.join(fill, "ikey", "left").select(
        "ikey", "e.name", "e.url_a", F.coalesce("late_b", "e.url_b", "fill_b").alias("url_b"), "e.source"
    )


def set_identities(store: DataFrame, updates: DataFrame, *, now, order: str = "ord") -> DataFrame:
    """Upsert identities: an address is never replaced by NULL, flags are cleared."""
    last = lambda c: F.max_by(F.col(c), F.when(has_value(F.col(c)), F.col(order)))
    new = (
        updates.withColumn("ikey", canonical_key(F.col("name")))
        .groupBy("ikey")
        .agg(
            F.max_by("name", order).alias("n_name"), last("url_a").alias("n_a"), last("url_b").alias("n_b"),
            last("source").alias("n_source"), F.max_by("validated", order).alias("n_validated"),
        )
    )
    hit = F.col("n_name").isNotNull()
    return store.join(new, "ikey", "full_outer").select(
        "ikey",
        F.coalesce("n_name", "name").alias("name"),
        F.coalesce(blank_to_null(F.col("n_a")), F.col("url_a")).alias("url_a"),
        F.coalesce(blank_to_null(F.col("n_b")), F.col("url_b")).alias("url_b"),
        F.coalesce(blank_to_null(F.col("n_source")), F.col("source"), F.lit("")).alias("source"),
        F.coalesce("n_validated", "validated").alias("validated"),
        F.when(hit, F.array().cast("array<string>")).otherwise(F.col("flags")).alias("flags"),
        F.when(hit, now).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )


def flag_identities(store: DataFrame, flags: DataFrame) -> DataFrame:
    """Add distinct flags (name, flag) to known identities."""
    new = flags.withColumn("ikey", canonical_key(F.col("name"))).groupBy("ikey").agg(F.array_sort(F.collect_set("flag")).alias("n_flags"))
    return store.join(new, "ikey", "left").withColumn(
        "flags", F.array_union(F.coalesce("flags", F.array().cast("array<string>")), F.coalesce("n_flags", F.array().cast("array<string>")))
    ).drop("n_flags")


def usable_identities(store: DataFrame) -> DataFrame:
    return store.filter(F.coalesce("validated", F.lit(False)) & (F.coalesce(F.size("flags"), F.lit(0)) <= 0))


def without_identity(items: DataFrame, store: DataFrame, *, name: str) -> DataFrame:
    """Items whose canonical name has no validated, unflagged identity."""
    return items.withColumn("ikey", canonical_key(F.col(name))).join(usable_identities(store).select("ikey"), "ikey", "left_anti").drop("ikey")


def merge_resolved(overrides: DataFrame, resolved: DataFrame, cached: DataFrame, *, order: str = "ord") -> DataFrame:
    """Resolved rows then cached ones, kept if they carry a rating or count, upserted into the overrides."""
    fields = [*OVERRIDE_FIELDS, order]
    both = resolved.select(*fields, F.lit(0).alias("_s")).unionByName(cached.select(*fields, F.lit(1).alias("_s")))
    rated = both.filter(has_value(F.col("rating")) | has_value(F.col("num_ratings")))
    # Cached rows follow the resolved ones: the source leads the order, kept as one sortable value.
    ordered = rated.withColumn(order, F.struct("_s", order)).drop("_s")
    return upsert_with_locks(overrides.withColumn(order, F.struct(F.lit(0).alias("_s"), F.col(order))), ordered, order=order)


def add_missing_columns(df: DataFrame, wanted: dict[str, str], allowed: set[str]) -> DataFrame:
    """Append absent columns as typed NULLs; a column outside the allow-list is refused."""
    refused = sorted(set(wanted) - allowed)
    if refused:
        raise ValueError(f"columns not allowed: {refused}")
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})
