"""CSV and keyed-cache files as all-string or typed DataFrames."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files whose first line is fetched at the same time.
HEADERS_AT_ONCE = 32

CATALOGUE_FIELDS = ["name", "price", "url"]
CATALOGUE_OPTIONAL = ["in_stock", "cat_rating", "cat_num_ratings", "cat_url"]


def text_schema(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system of the path (local, HDFS or object store)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _csv_files(spark: SparkSession, path: str) -> list[str]:
    """Data files of a path, asked of its own file system; names only, at most one for each file written."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(root) or []
    out = []
    for status in found:
        inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [f.getPath().toString() for f in inside if f.isFile() and f.getPath().getName()[0] not in "._" and f.getLen() > 0]
    return sorted(out)


def _first_line(spark: SparkSession, file: str) -> str:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"), 4096).readLine() or ""
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str, fields: list[str], *, multi_line: bool = False) -> DataFrame:
    """Header CSV, every field text; a column the file lacks is NULL.

    Columns are matched by header name: files with the same header are read together, each group with
    its own schema, and the groups are united by name.  Files are split over tasks; only
    ``multi_line`` (fields with line breaks) makes each file one task.
    """
    paths = _csv_files(spark, path)
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    if not paths:
        return spark.createDataFrame([], text_schema(fields))
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:  # only the first line of each file is read here
        for file, head in zip(paths, pool.map(partial(_first_line, spark), paths)):
            groups.setdefault(head, []).append(file)
    parts = []
    for head in sorted(groups):
        raw = spark.read.options(**options).csv(sorted(groups[head]))
        parts.append(raw.select(*[F.col(f"`{f}`") if f in raw.columns else F.lit(None).cast("string").alias(f) for f in fields]))
    return union_all(parts)


def read_optional_csv(spark: SparkSession, path: str | None, fields: list[str]) -> DataFrame:
    """``read_csv``, or no rows where the file is absent."""
    if not path or not path_exists(spark, path):
        return spark.createDataFrame([], text_schema(fields))
    return read_csv(spark, path, fields)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Header CSV with a fixed column order, one file per partition."""
    df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def present_optional(df: DataFrame, optional: list[str]) -> list[str]:
    """Optional columns that at least one row fills, found in one aggregation."""
    known = [c for c in optional if c in df.columns]
    if not known:
        return []
    row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in known]).first()
    return [c for c in known if row[c]]


def write_catalogue(df: DataFrame, path: str) -> None:
    """Catalogue CSV; an optional column is written only if some row has it."""
    write_csv(df, path, CATALOGUE_FIELDS + present_optional(df, CATALOGUE_OPTIONAL))


def read_cache(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Keyed Parquet cache; an absent one has no entries."""
    if not path_exists(spark, path):
        shape = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        return spark.createDataFrame([], shape)
    return spark.read.parquet(path)


def write_cache(df: DataFrame, path: str, key: str = "cache_key", order: str = "stamp") -> None:
    """Replace a keyed cache; the entry latest by ``order`` stays, of equal ones the largest.  ``path`` must not be an input of ``df``."""
    rest = [c for c in df.columns if c != key]
    value = F.struct(*rest)
    one = df.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias("v")).select(key, "v.*")
    one.write.mode("overwrite").parquet(path)


def import_json_cache(df: DataFrame, text_column: str, value_type: str, key_as: str = "cache_key") -> DataFrame:
    """Rows of ``{key: {…}}`` JSON documents; an unreadable document has no entries."""
    entries = F.from_json(F.col(text_column), f"map<string,{value_type}>")
    return df.select(F.explode(F.map_entries(entries)).alias("e")).select(F.col("e.key").alias(key_as), "e.value.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
