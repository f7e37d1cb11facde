"""Refresh: comparison rows, rating rows and market rows to published offers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens import settings
from offerlens.functions.listing import is_gift_listing
from offerlens.functions.metadata import derive_metadata, gap_fill
from offerlens.functions.numbers import blank_to_null, parse_float, parse_int, strip
from offerlens.functions.pricing import backfill_gap, deal_score, resolve_rating_price
from offerlens.functions.urls import clean_url
from offerlens.operators.cascade import attach_market_price, attach_ratings
from offerlens.operators.merge import preserve_descriptions
from offerlens.sources import tables


def comparison_offers(comparison: DataFrame) -> DataFrame:
    """Typed comparison rows; rows without a name are skipped."""
    named = comparison.withColumn("offer_name", blank_to_null(F.col("offer_name"))).filter("offer_name is not null")
    number = lambda c: parse_float(F.col(c).cast("string"))
    anchor, rival = number("anchor_price"), number("rival_price")
    diff, pct = backfill_gap(anchor, rival, number("price_diff"), number("price_diff_pct"))
    return named.withColumns(
        {
            "vintage": parse_int(F.col("year").cast("string")).cast("int"),
            "quantity": parse_int(F.col("quantity").cast("string")).cast("int"),
            "volume": blank_to_null(F.col("volume")),
            "anchor_price": anchor,
            "rival_price": rival,
            "price_diff": diff,
            "price_diff_pct": pct,
            "cheaper_side": blank_to_null(F.col("cheaper_side")),
            "anchor_url": clean_url(F.col("anchor_url")),
            "rival_url": F.when(rival.isNotNull(), clean_url(F.col("rival_url"))),
        }
    )


def build_offers(comparison: DataFrame, ratings: DataFrame, market: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """All derived columns of the current table, one row per comparison row."""
    offers = attach_ratings(comparison_offers(comparison), ratings)
    offers = attach_market_price(offers, market)
    offers = derive_metadata(offers)
    offers = gap_fill(offers, "r_grapes", "r_region")
    offers = offers.withColumn(
        "rating_price",
        resolve_rating_price(
            parse_float(F.col("r_price")), F.col("quantity"), F.col("volume"), F.col("anchor_price"), F.col("rival_price"),
            F.lower(strip(F.col("r_source"))), F.col("rating_url"),
        ),
    )
    if previous is not None:
        offers = preserve_descriptions(offers, previous)
    else:
        offers = offers.withColumn("rating_description", blank_to_null(F.col("r_description")))
    return offers.withColumns(
        {
            "offer_id": tables.offer_key(F.col("offer_name"), F.col("anchor_url")),
            "is_gift_set": is_gift_listing(F.col("offer_name"), F.col("rival_url")),
            "deal_score": deal_score(
                F.col("price_diff_pct"), F.col("rating"), F.col("num_ratings"), F.col("anchor_price"), F.col("rating_price")
            ),
        }
    ).drop(*[c for c in offers.columns if c.startswith("r_") or c == "fuzzy_score"])


def match_method_counts(offers: DataFrame) -> DataFrame:
    return offers.groupBy("match_method").agg(F.count("*").alias("offers"))


def run_refresh(spark: SparkSession, root: str, comparison: DataFrame, ratings: DataFrame, market: DataFrame, *, run_id: str, now: datetime,
                retention_days: int = settings.RETENTION_DAYS, fresh_hours: float = 0) -> str:
    """Build, check, write offers and snapshots, publish both by one manifest, prune, and keep the ledger.

    Returns "skipped" or "success".  Until the manifest moves, readers see the old offers, the old history
    and the old pruning; on an error before that the ledger says "failed" and the error is raised again.
    What comes after only tidies up: files that the manifest no longer names are deleted, and a failure
    there is told in the details of a run that has succeeded.
    """
    ledger, root_offers, snapshots = f"{root}/runs", f"{root}/offers", f"{root}/snapshots"
    if fresh_hours > 0 and tables.has_fresh_run(spark, ledger, now, fresh_hours):
        return "skipped"
    state = {"run_id": run_id, "started_at": now, "status": "running", "comparison_rows": comparison.count(), "rating_rows": ratings.count(), "merged_rows": 0}
    tables.append_run(spark, ledger, state)
    try:
        before = tables.manifest(spark, root_offers) or {"runs": []}
        built = build_offers(comparison, ratings, market, tables.read_published(spark, root_offers))
        path = f"{root_offers}/version={run_id}"
        built.write.mode("overwrite").parquet(path)
        offers = spark.read.parquet(path)
        tables.assert_unique(offers, ["offer_name", "anchor_url"])
        counts = ", ".join(f"{r['match_method']}={r['offers']}" for r in match_method_counts(offers).orderBy("match_method").collect())
        state["merged_rows"] = offers.count()
        tables.append_snapshots(tables.snapshot_rows(offers, run_id, now), snapshots)
        cutoff = now - timedelta(days=retention_days)
        earlier = [(r["run_id"], r["captured_at"]) for r in before["runs"] or [] if r["run_id"] != run_id and r["captured_at"] >= cutoff]
        tables.move_pointer(spark, root_offers, run_id, now, [*earlier, (run_id, now)], cutoff)
    except Exception as error:
        tables.append_run(spark, ledger, state | {"status": "failed", "finished_at": now, "details": f"failed: {error}"[:2000]})
        raise
    try:
        tidied = f"pruned {tables.prune_snapshots(spark, snapshots, now, retention_days)}"
    except Exception as error:
        tidied = f"old snapshots stay on disk: {error}"
    tables.append_run(spark, ledger, state | {"status": "success", "finished_at": now, "details": f"methods: {counts}; {tidied}"[:2000]})
    return "success"
