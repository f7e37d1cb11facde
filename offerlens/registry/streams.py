"""Admission and snapshot-feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.operators.history import as_of_prices
from offerlens.registry import sqltext as Q
from offerlens.registry.base import query
from offerlens.session import scratch_path
from offerlens.streaming.admission import admission_batch, admission_stream
from offerlens.streaming.snapshots import snapshot_feed


def _admitted(key: str, id: str, limit: int, seconds: int) -> str:
    """The rule as a walk over each key's requests that carries the list of admitted times."""
    window = seconds * 1_000_000
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM @events@),
 walk AS (SELECT user_id, event_id, n, t, true AS allowed, [t] AS b FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, t, len(k) < {limit}, CASE WHEN len(k) < {limit} THEN list_append(k, t) ELSE k END
  FROM (SELECT e.user_id, e.event_id, e.n, e.t, list_filter(w.b, lambda x: x >= e.t - {window}) AS k FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT {key}, event_id AS {id}, allowed, CASE WHEN allowed THEN {limit} - len(b) ELSE 0 END AS remaining, greatest(({window} - (t - b[1])) // 1000000, 1) AS reset_seconds FROM walk"""


@query("t1_admission_batch", _admitted("user_id", "event_id", 2, 36000))
def t1(i):
    return admission_batch(i.events, key="user_id", ts="ts", order="event_id", limit=2, window_seconds=36000)


@query(
    "t1_admission_limit_one",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM @events@),
 walk AS (SELECT user_id, event_id, n, ts AS last, true AS allowed FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN w.last < e.ts - INTERVAL 6 HOUR THEN e.ts ELSE w.last END, w.last < e.ts - INTERVAL 6 HOUR FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, allowed FROM walk""",
)
def t1_one(i):
    """With a limit of one the rule is a simple walk that SQL can state."""
    return admission_batch(i.events, key="user_id", ts="ts", order="event_id", limit=1, window_seconds=21600).select("user_id", "event_id", "allowed")


@query("t1_admission_stream", _admitted("CAST(user_id AS STRING) AS key", "id", 2, 36000))
def t1_stream(i):
    """The stateful form over the whole events table as one finished stream."""
    source = f"{scratch_path(i.spark, 'stream-in')}"
    i.events.select("event_id", "user_id", "ts").write.parquet(source)
    own = i.spark.newSession()  # the state store is set for this stream only
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = own.readStream.schema("event_id long, user_id long, ts timestamp").parquet(source)
    out, check = scratch_path(i.spark, "stream-out"), scratch_path(i.spark, "stream-check")
    decided = admission_stream(stream, key="user_id", ts="ts", id="event_id", limit=2, window_seconds=36000)
    q = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return i.spark.read.schema("key string, id long, allowed boolean, remaining int, reset_seconds int").parquet(out)


@query(
    "t2_snapshot_feed_trends",
    f"SELECT o.offer_name, h.a7 AS anchor_price_7d_ago, {Q.r2('o.anchor_price - h.a7')} AS anchor_price_change_7d FROM @current_offers@ AS o LEFT JOIN (SELECT offer_name, arg_max(anchor_price, captured_at) FILTER (WHERE captured_at <= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS a7 FROM @snapshots@ WHERE captured_at >= TIMESTAMP '2024-01-31' - INTERVAL 45 DAY GROUP BY 1) h ON h.offer_name = o.offer_name",
)
def t2(i):
    """Snapshots arrive as a stream, land by day, and serve the as-of prices."""
    source = scratch_path(i.spark, "feed-in")
    i.snapshots.write.parquet(source)
    stream = i.spark.readStream.schema(i.snapshots.schema).parquet(source)
    table = scratch_path(i.spark, "feed-table")
    snapshot_feed(stream, table, scratch_path(i.spark, "feed-check")).awaitTermination()
    out = as_of_prices(
        i.current_offers, i.spark.read.parquet(table), now=F.lit("2024-01-31").cast("timestamp"), key="offer_name", prices=["anchor_price"], cuts={"7d": 7}
    )
    return out.select("offer_name", "anchor_price_7d_ago", "anchor_price_change_7d")
