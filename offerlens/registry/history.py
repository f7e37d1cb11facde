"""History queries: as-of prices, trends, history pages, retention and run state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from offerlens.operators import history as H
from offerlens.registry import sqltext as Q
from offerlens.registry.base import query
from offerlens.session import scratch_path
from offerlens.sources import tables

_NOW = "TIMESTAMP '2024-01-31'"


def _now(text: str = "2024-01-31"):
    return F.lit(text).cast("timestamp")


def _ago(days: int, col: str) -> str:
    return f"arg_max({col}, captured_at) FILTER (WHERE captured_at <= {_NOW} - INTERVAL {days} DAY)"


def _trend(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} <= -0.01 THEN 'down' WHEN {x} >= 0.01 THEN 'up' ELSE 'flat' END"


@query(
    "j11_w7_x53_as_of_prices",
    f"""WITH h AS (SELECT offer_name, {_ago(2, 'anchor_price')} AS a2, {_ago(2, 'rival_price')} AS r2, {_ago(7, 'anchor_price')} AS a7, {_ago(7, 'rival_price')} AS r7 FROM @snapshots@ WHERE captured_at >= {_NOW} - INTERVAL 14 DAY GROUP BY 1)
SELECT o.offer_name, a2 AS anchor_price_2d_ago, a7 AS anchor_price_7d_ago, {Q.r2('o.anchor_price - a2')} AS anchor_price_change_2d, {Q.r2('o.anchor_price - a7')} AS anchor_price_change_7d,
 {Q.r2('o.rival_price - r2')} AS rival_price_change_2d, {Q.r2('o.rival_price - r7')} AS rival_price_change_7d, {_trend(Q.r2('o.anchor_price - a2'))} AS anchor_price_trend_2d, {_trend(Q.r2('o.rival_price - r7'))} AS rival_price_trend_7d
FROM @current_offers@ AS o LEFT JOIN h ON h.offer_name = o.offer_name""",
)
def j11(i):
    out = H.as_of_prices(
        i.current_offers, i.snapshots, now=_now(), key="offer_name", prices=["anchor_price", "rival_price"], cuts={"2d": 2, "7d": 7}, lookback_days=14
    )
    return out.select(
        "offer_name", "anchor_price_2d_ago", "anchor_price_7d_ago", "anchor_price_change_2d", "anchor_price_change_7d",
        "rival_price_change_2d", "rival_price_change_7d", "anchor_price_trend_2d", "rival_price_trend_7d",
    )


@query(
    "j11_as_of_orders",
    f"""WITH h AS (SELECT o_custkey, arg_max(o_totalprice, k) FILTER (WHERE o_orderdate <= TIMESTAMP '1998-08-01' - INTERVAL 30 DAY) AS a30, arg_max(o_totalprice, k) FILTER (WHERE o_orderdate <= TIMESTAMP '1998-08-01' - INTERVAL 365 DAY) AS a365
  FROM (SELECT *, ROW(o_orderdate, o_orderkey) AS k FROM @orders@) WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 900 DAY GROUP BY 1)
SELECT c_custkey, a30 AS o_totalprice_30d_ago, a365 AS o_totalprice_365d_ago, {_trend(Q.r2('c_acctbal - a30'))} AS o_totalprice_trend_30d FROM @customer@ LEFT JOIN h ON o_custkey = c_custkey""",
)
def j11_orders(i):
    c = i.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("o_totalprice"))
    out = H.as_of_prices(
        c, i.orders, now=_now("1998-08-01"), key="o_custkey", prices=["o_totalprice"], captured="o_orderdate",
        cuts={"30d": 30, "365d": 365}, lookback_days=900, tie="o_orderkey",
    )
    return out.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice_30d_ago", "o_totalprice_365d_ago", "o_totalprice_trend_30d")


@query("j20_l7_history_ascending", f"SELECT event_id, captured_at, anchor_price FROM @snapshots@ WHERE offer_name = 'offer 7' AND captured_at >= {_NOW} - INTERVAL 10 DAY ORDER BY captured_at LIMIT 15")
def j20(i):
    return H.offer_history(i.snapshots, key="offer_name", value="offer 7", now=_now(), days=10, limit=15).select("event_id", "captured_at", "anchor_price")


@query("j20_l7_history_descending", f"SELECT event_id, captured_at, anchor_price FROM @snapshots@ WHERE offer_name = 'offer 3' AND captured_at >= {_NOW} - INTERVAL 1 DAY ORDER BY captured_at DESC LIMIT 3650")
def j20d(i):
    return H.offer_history(i.snapshots, key="offer_name", value="offer 3", now=_now(), days=0, limit=9999, descending=True).select("event_id", "captured_at", "anchor_price")


@query("s10_retained", f"SELECT event_id FROM @snapshots@ WHERE captured_at >= {_NOW} - INTERVAL 20 DAY")
def s10(i):
    return H.retained(i.snapshots, now=_now(), days=20).select("event_id")


@query("s10_prune_report", f"SELECT count(*) FILTER (WHERE captured_at >= {_NOW} - INTERVAL 20 DAY) AS kept, count(*) FILTER (WHERE captured_at < {_NOW} - INTERVAL 20 DAY) AS dropped FROM @snapshots@")
def s10r(i):
    return H.prune_report(i.snapshots, now=_now(), days=20)


_SNAP = "SELECT offer_name, anchor_price, rival_price, cheaper_side, deal_score FROM @offers@"


@query("s9_s10_snapshot_append_and_prune", f"SELECT 'new' AS run_id, offer_name, deal_score FROM @offers@ UNION ALL SELECT 'edge', offer_name, deal_score FROM @offers@ WHERE deal_score > 12")
def s9(i):
    """Append three runs by day, prune at 90 days, read back: the oldest run is gone, and one of the two on the boundary day."""
    path = scratch_path(i.spark, "snapshots")
    # A retry of the newest run replaces its own rows.
    runs = [("old", datetime(2023, 10, 1), i.offers), ("eve", datetime(2023, 11, 2, 3), i.offers), ("edge", datetime(2023, 11, 2, 12), i.offers.filter("deal_score > 12")), ("new", datetime(2024, 1, 31), i.offers), ("new", datetime(2024, 1, 31), i.offers)]
    for run_id, at, df in runs:
        tables.append_snapshots(tables.snapshot_rows(df, run_id, at), path)
    tables.prune_snapshots(i.spark, path, datetime(2024, 1, 31, 6))
    return i.spark.read.parquet(path).select("run_id", "offer_name", "deal_score")


@query("s5_s6_s8_full_refresh", "SELECT offer_id, offer_name, deal_score FROM @offers@ WHERE cheaper_side <> 'No Match'")
def s8(i):
    """Two versions are published; readers see the second."""
    root = scratch_path(i.spark, "offers")
    tables.publish(i.offers, root, "v1", datetime(2024, 1, 1))
    tables.publish(i.offers.filter("cheaper_side <> 'No Match'"), root, "v2", datetime(2024, 1, 2))
    return tables.read_published(i.spark, root).select("offer_id", "offer_name", "deal_score")


_RUNS = "SELECT o_orderkey AS run_id, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 2 HOUR END AS finished_at, o_orderstatus AS status FROM @orders@"


@query("w3_latest_run", f"SELECT run_id, started_at, status FROM ({_RUNS}) ORDER BY started_at DESC, run_id DESC LIMIT 1")
def w3(i):
    runs = i.sql(_RUNS).withColumn("at", F.struct("started_at", "run_id"))
    return H.latest_run(runs, started="at").select("run_id", "started_at", "status")


@query("x60_x61_staleness", f"SELECT run_id, finished_at IS NULL OR epoch(TIMESTAMP '1998-08-02') - epoch(finished_at) > 24 * 3600 AS stale, coalesce(epoch(TIMESTAMP '1998-08-02') - epoch(finished_at) < 720 * 3600, false) AS recent FROM ({_RUNS})")
def x60(i):
    now = _now("1998-08-02")
    return i.sql(_RUNS).select("run_id", H.is_stale(F.col("finished_at"), now).alias("stale"), H.is_recent(F.col("finished_at"), now, 720).alias("recent"))


@query("x59_utc", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM @events@")
def x59(i):
    return i.events.select("event_id", F.unix_timestamp(H.as_utc(F.col("ts"))).alias("seconds"))


@query(
    "s11_run_ledger",
    "SELECT run_id, status, n AS comparison_rows FROM (SELECT count(*) AS n FROM @offers@), (VALUES ('r1', 'success'), ('r2', 'failed'), ('r3', 'running'), ('r4', 'success')) AS v(run_id, status)",
)
def s11(i):
    """A run that succeeds, one that fails, one still running, and a failed one whose retry succeeds."""
    path, n = scratch_path(i.spark, "ledger"), i.offers.count()
    for run_id, states in (("r1", ("running", "success")), ("r2", ("running", "failed")), ("r3", ("running",)), ("r4", ("running", "failed", "running", "success"))):
        for at, status in enumerate(states):
            done = None if status == "running" else datetime(2024, 1, 1, at + 1)
            tables.append_run(i.spark, path, {"run_id": run_id, "started_at": datetime(2024, 1, 1, at), "finished_at": done, "status": status, "comparison_rows": n})
    return tables.run_ledger(i.spark, path).select("run_id", "status", "comparison_rows")
