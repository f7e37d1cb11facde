"""One page of offers: filter, sort, page, then as-of prices and insights for that page only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from offerlens.operators.history import as_of_prices
from offerlens.operators.serving import OfferFilter, add_insights, filter_offers, page, sort_keys


def list_offers(offers: DataFrame, snapshots: DataFrame | None, *, now: Column | None = None, request: OfferFilter = OfferFilter(),
                sort_by: str = "deal_score", direction: str = "desc", offset: int = 0, limit: int = 50) -> DataFrame:
    """The page is cut before history is joined, so only its few names reach the snapshots."""
    keys = sort_keys(sort_by, direction)
    rows = page(filter_offers(offers, request), keys, offset=offset, limit=limit)
    if snapshots is not None:
        wanted = rows.select("offer_name").distinct()
        history = snapshots.join(wanted, "offer_name", "left_semi")
        rows = as_of_prices(rows, history, now=now, key="offer_name", prices=["anchor_price", "rival_price"])
    return add_insights(rows)
