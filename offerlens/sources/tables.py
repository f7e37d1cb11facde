"""Published tables: current offers, snapshots by day, and the run ledger.

A table is a folder of versions.  A run writes its version beside the old one and then moves
a small pointer row, so readers see either the old or the new state and a failed run leaves
nothing behind that anyone reads.

The pointer row is a manifest of the whole state: the version of the offers, the runs whose
snapshots belong to the history, and the time before which the history is pruned.  One append
moves all three.  Snapshot files of a run count only once a manifest names it; pruned ones are
deleted afterwards, which nobody sees.  The list of runs is as long as the retention has runs.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens import settings
from offerlens.operators.history import latest_run
from offerlens.sources.files import path_exists

SNAPSHOT_FIELDS = [
    "offer_name", "vintage", "quantity", "volume", "anchor_price", "rival_price", "price_diff", "price_diff_pct",
    "cheaper_side", "anchor_url", "rival_url", "rating_url", "rating", "num_ratings", "match_method", "deal_score",
]
LEDGER_SCHEMA = (
    "run_id string, started_at timestamp, finished_at timestamp, status string, comparison_rows long, "
    "rating_rows long, merged_rows long, details string"
)
POINTER_SCHEMA = "version string, published_at timestamp, runs array<struct<run_id: string, captured_at: timestamp>>, cutoff timestamp"


def offer_key(name, url):
    """Stable row key, the same in every refresh."""
    return F.sha2(F.concat_ws("␟", F.coalesce(name, F.lit("")), F.coalesce(url, F.lit(""))), 256)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Refuse to publish two rows of one (name, address)."""
    clash = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"duplicate key: {clash[0].asDict()}")


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The state that the latest pointer row names."""
    pointer = f"{root}/_pointer"
    if not path_exists(spark, pointer):
        return None
    rows = spark.read.schema(POINTER_SCHEMA).json(pointer)
    row = rows.agg(F.max_by(F.struct(*rows.columns), F.struct("published_at", "version")).alias("m")).first()["m"]
    return row.asDict(recursive=True) if row else None


def current_version(spark: SparkSession, root: str) -> str | None:
    state = manifest(spark, root)
    return state["version"] if state else None


def publish(df: DataFrame, root: str, version: str, published_at: datetime) -> str:
    """Full refresh: write a new version, then append the pointer that makes it current."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    move_pointer(df.sparkSession, root, version, published_at)
    return path


def move_pointer(
    spark: SparkSession, root: str, version: str, published_at: datetime, runs: list[tuple[str, datetime]] = (), cutoff: datetime | None = None
) -> None:
    """The single step that changes what readers see."""
    spark.createDataFrame([(version, published_at, list(runs), cutoff)], POINTER_SCHEMA).coalesce(1).write.mode("append").json(f"{root}/_pointer")


def read_published(spark: SparkSession, root: str) -> DataFrame | None:
    version = current_version(spark, root)
    return spark.read.parquet(f"{root}/version={version}") if version else None


def read_history(spark: SparkSession, root: str, snapshots: str) -> DataFrame | None:
    """Snapshots of the runs that the manifest below ``root`` names, not older than its cut-off."""
    state = manifest(spark, root)
    if not state or not state["runs"]:
        return None
    rows = spark.read.parquet(snapshots).filter(F.col("run_id").isin([r["run_id"] for r in state["runs"]]))
    return rows.filter(F.col("captured_at") >= F.lit(state["cutoff"])) if state["cutoff"] else rows


def snapshot_rows(df: DataFrame, run_id: str, captured_at: datetime) -> DataFrame:
    """Snapshot projection stamped with the run and one capture time."""
    return df.select(
        F.lit(run_id).alias("run_id"), F.lit(captured_at).cast("timestamp").alias("captured_at"), *SNAPSHOT_FIELDS,
        F.lit(captured_at.date()).alias("captured_date"),
    )


def append_snapshots(df: DataFrame, path: str) -> None:
    """Append by day; each run has its own partition, so a retried run replaces only itself."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("captured_date", "run_id").parquet(path)
    )


def prune_snapshots(spark: SparkSession, path: str, now: datetime, days: int = settings.RETENTION_DAYS) -> int:
    """Drop snapshots older than ``days`` and return how many rows went.

    Days wholly before the cut-off go as folders; only the boundary day is rewritten.
    """
    cutoff = now - timedelta(days=days)
    table = spark.read.parquet(path)
    old = table.filter(F.col("captured_date") <= F.lit(cutoff.date()))
    dropped = old.filter(F.col("captured_at") < F.lit(cutoff)).count()
    if not dropped:
        return 0
    boundary = old.filter((F.col("captured_date") == F.lit(cutoff.date())))
    stale_days = [r[0] for r in old.filter(F.col("captured_date") < F.lit(cutoff.date())).select("captured_date").distinct().collect()]
    runs = {r["run_id"]: r["kept"] for r in boundary.groupBy("run_id").agg(F.count_if(F.col("captured_at") >= F.lit(cutoff)).alias("kept")).collect()}
    split = boundary.agg(F.count_if(F.col("captured_at") < F.lit(cutoff)).alias("gone")).first()["gone"]
    if split:
        from offerlens.session import materialize

        # Runs with rows left are replaced by the writer's commit before any folder goes: a failure loses nothing.
        if any(runs.values()):
            append_snapshots(materialize(boundary.filter(F.col("captured_at") >= F.lit(cutoff)), "boundary"), path)
        for run_id, kept in runs.items():
            if not kept:
                _delete(spark, f"{path}/captured_date={cutoff.date()}/run_id={run_id}")
    for day in stale_days:
        _delete(spark, f"{path}/captured_date={day}")
    spark.catalog.refreshByPath(path)
    return dropped


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def append_run(spark: SparkSession, path: str, row: dict) -> None:
    """One ledger row; a finished run is a second row with the same id."""
    order = [c.split()[0] for c in LEDGER_SCHEMA.split(", ")]
    spark.createDataFrame([tuple(row.get(c) for c in order)], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of each run: the finished row wins over the started one."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    cols = [c for c in rows.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(
        F.max_by(F.struct(*cols), F.struct(F.col("finished_at").isNotNull(), F.col("finished_at"))).alias("r")
    ).select("run_id", "r.*")


def has_fresh_run(spark: SparkSession, path: str, now: datetime, hours: float) -> bool:
    """Did a successful run finish within the last ``hours``?"""
    done = latest_run(run_ledger(spark, path).filter("status = 'success'"), started="finished_at")
    row = done.first()
    return bool(row and row["finished_at"] and (now - row["finished_at"]).total_seconds() < hours * 3600)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))
