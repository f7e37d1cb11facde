"""Two catalogues to one scored, ordered comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions.listing import prepare_listings
from offerlens.functions.numbers import parse_price
from offerlens.functions.pricing import compare_prices
from offerlens.operators.linkage import match_listings
from offerlens.session import materialize
from offerlens.settings import SIDES, SideLabels

BLOCK = ["year", "volume", "package_type"]


def summary_order(sides: SideLabels = SIDES, price: str = "anchor_price") -> list[Column]:
    """Side priority, then the negated per cent, then the anchor price; missing values last."""
    rank = F.when(F.col("cheaper_side") == sides.anchor, 0).when(F.col("cheaper_side") == sides.rival, 1).when(
        F.col("cheaper_side") == sides.same, 2).when(F.col("cheaper_side") == sides.none, 3).otherwise(99)
    return [rank.asc(), (-F.col("price_diff_pct")).asc_nulls_last(), F.col(price).asc_nulls_last()]


def summarise(matched: DataFrame, sides: SideLabels = SIDES) -> DataFrame:
    """Pack-normalised comparison of matched rows (price and m_price are texts or numbers)."""
    anchor = parse_price(F.col("price").cast("string"))
    rival = parse_price(F.col("m_price").cast("string"))
    return matched.withColumns(
        {"anchor_price": anchor, **compare_prices(anchor, rival, F.col("quantity"), F.col("m_quantity"), sides)}
    )


def compare_catalogues(anchors: DataFrame, rivals: DataFrame, *, threshold: float = 0.6, order: str = "ord", sides: SideLabels = SIDES) -> DataFrame:
    """In-stock listings of both shops, matched and compared (unordered; see ``summary_order``)."""
    a = prepare_listings(anchors)
    r = prepare_listings(rivals)
    matched = match_listings(
        a, r, block=BLOCK, order=order, payload=[order, "name", "year", "quantity", "volume", "price", "url"], threshold=threshold
    )
    return summarise(matched, sides)


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Every row with its place in a total order.

    Rows are sorted over range partitions and numbered inside each; the counts of the partitions, one
    number each, give what stands before them.  The sorted rows are written once, so both reads agree.
    """
    ordered = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    rows = materialize(ordered, "ordered")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = counts.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = rows.join(F.broadcast(before), "_part")  # as many rows as partitions
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")
