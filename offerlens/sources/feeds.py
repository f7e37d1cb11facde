"""Product feeds: nested JSON documents to catalogue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions.numbers import strip, text
from offerlens.operators.linkage import first_per_key

FEED_TYPE = "struct<products array<struct<title string, handle string, variants array<struct<price string, available boolean>>>>>"


def flatten_feed(df: DataFrame, payload: str, *, base_url: str, keep: list[str]) -> DataFrame:
    """One row per product: price and stock of the first available variant, else of the first.

    Products without title or handle are skipped.  ``pos`` is the product's place in its page.
    """
    feed = F.from_json(F.col(payload), FEED_TYPE)
    p = df.select(*keep, F.posexplode(feed["products"]).alias("pos", "p"))
    variants = F.coalesce(F.col("p.variants"), F.array().cast("array<struct<price string, available boolean>>"))
    open_variants = F.filter(variants, lambda v: F.coalesce(v["available"], F.lit(False)))
    chosen = F.coalesce(F.try_element_at(open_variants, F.lit(1)), F.try_element_at(variants, F.lit(1)))
    return (
        p.select(
            *keep,
            "pos",
            text(F.col("p.title")).alias("name"),
            F.coalesce(F.nullif(chosen["price"], F.lit("")), F.lit("N/A")).alias("price"),
            text(F.col("p.handle")).alias("_handle"),
            F.when(F.size(open_variants) > 0, "true").otherwise("false").alias("in_stock"),
        )
        .filter((F.col("name") != "") & (F.col("_handle") != ""))
        .withColumn("url", F.concat(F.lit(base_url.rstrip("/") + "/products/"), F.col("_handle")))
        .drop("_handle")
    )


def first_by_name(df: DataFrame, *, name: str = "name", order=("ord",)) -> DataFrame:
    """First row per name without case; the order is explicit, so a rerun picks the same row."""
    return first_per_key(df, [F.lower(strip(F.col(name)))], F.struct(*order))
