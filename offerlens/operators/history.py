"""Price history: as-of prices, trends, history pages, retention and run state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens import settings
from offerlens.functions.numbers import round2
from offerlens.functions.pricing import trend


def as_utc(c: Column) -> Column:
    """Timestamps without zone are taken as UTC (the session zone is UTC)."""
    return c.cast("timestamp")


def safe_diff(current: Column, previous: Column) -> Column:
    return round2(current - previous)


def as_of_prices(
    offers: DataFrame, snapshots: DataFrame, *, now: Column, key: str, prices: list[str], captured: str = "captured_at",
    cuts: dict[str, int] | None = None, lookback_days: int = 45, tie: str | None = None,
) -> DataFrame:
    """Latest snapshot prices at or before each cut (7 and 30 days ago), with changes and trends.

    One aggregation over the look-back window serves all cuts: the last price per cut is a
    ``max_by`` whose order is NULL for later rows, so it combines before the shuffle and a key
    with a third of all snapshots costs no more than any other.
    """
    cuts = cuts or {"7d": 7, "30d": 30}
    t = F.col(captured)
    order = F.struct(t, F.col(tie)) if tie else F.struct(t)
    recent = snapshots.filter(t >= now - F.expr(f"interval {lookback_days} days"))
    at = {
        name: F.max_by(F.struct(*prices), F.when(t <= now - F.expr(f"interval {days} days"), order)).alias(f"_{name}")
        for name, days in cuts.items()
    }
    past = recent.groupBy(key).agg(*at.values())
    out = offers.join(past, key, "left")
    new = {}
    for name in cuts:
        for p in prices:
            before = F.col(f"_{name}.{p}")
            new[f"{p}_{name}_ago"] = before
            new[f"{p}_change_{name}"] = safe_diff(F.col(p), before)
            new[f"{p}_trend_{name}"] = trend(safe_diff(F.col(p), before))
    return out.withColumns(new).drop(*[f"_{name}" for name in cuts])


def offer_history(snapshots: DataFrame, *, key: str, value, now: Column, days: int = 90, limit: int = 30,
                  descending: bool = False, captured: str = "captured_at", tie: list[str] | None = None) -> DataFrame:
    """Snapshots of one offer in the last ``days`` days in time order."""
    t = F.col(captured)
    since = now - F.expr(f"interval {max(days, 1)} days")
    order = [t.desc() if descending else t.asc(), *[F.col(c) for c in tie or []]]
    return snapshots.filter((F.col(key) == value) & (t >= since)).orderBy(*order).limit(min(limit, settings.HISTORY_LIMIT))


def retained(snapshots: DataFrame, *, now: Column, days: int = settings.RETENTION_DAYS, captured: str = "captured_at") -> DataFrame:
    return snapshots.filter(F.col(captured) >= now - F.expr(f"interval {days} days"))


def prune_report(snapshots: DataFrame, *, now: Column, days: int = settings.RETENTION_DAYS, captured: str = "captured_at") -> DataFrame:
    """How many snapshots a prune keeps and drops."""
    old = F.col(captured) < now - F.expr(f"interval {days} days")
    return snapshots.agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("dropped"))


def latest_run(runs: DataFrame, *, started: str = "started_at") -> DataFrame:
    row = F.struct(*runs.columns)
    return runs.agg(F.max_by(row, started).alias("r")).filter("r is not null").select("r.*")


def is_stale(finished_at: Column, now: Column, hours: float = settings.STALE_HOURS) -> Column:
    """No finished run, or one older than the limit."""
    age = F.unix_timestamp(now) - F.unix_timestamp(finished_at)
    return finished_at.isNull() | (age > hours * 3600)


def is_recent(last: Column, now: Column, hours: float) -> Column:
    """A run within the last ``hours``; zero or unknown never counts."""
    if hours <= 0:
        return F.lit(False)
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last) < hours * 3600, F.lit(False))
