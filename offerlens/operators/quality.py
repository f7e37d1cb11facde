"""Completeness, coverage and integrity reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.numbers import has_value, parse_money, text
from offerlens.functions.urls import url_host

# --- fixed values -----------------------------------------------------------------
CRITICAL_FIELDS = ("anchor_price", "wine_type", "country", "grapes", "match_method")
GATED_FIELDS = {"rating_url": "url", "rating": "url", "rating_price": "price"}
COVERAGE_FIELDS = ("rating", "rating_url", "rating_price", "country", "grapes")
STOCK_TRUE, STOCK_FALSE = ("1", "true", "yes", "y"), ("0", "false", "no", "n")
# -------------------------------------------------------------------------------------


def is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or blank for text columns."""
    kind = dict(df.dtypes)[c]
    return ~has_value(F.col(c)) if kind == "string" else F.col(c).isNull()


def missing_fields(df: DataFrame, fields, name: str = "offer_name") -> DataFrame:
    """(field, name) of every gap, from one narrow pass."""
    hits = F.array_compact(F.array(*[F.when(is_missing(df, f), F.lit(f)) for f in fields]))
    return df.select(F.explode(hits).alias("field"), F.col(name).alias("name"))


def split_known_gaps(missing: DataFrame, allowed: DataFrame) -> DataFrame:
    """Mark gaps (field, name) that an allow-list accepts as warnings, the others as errors."""
    marked = allowed.select("field", "name").distinct().withColumn("_known", F.lit(True))
    return missing.join(marked, ["field", "name"], "left").select(
        "field", "name", F.when(F.col("_known"), "warning").otherwise("error").alias("severity")
    )


def percent_text(part: Column, total: Column) -> Column:
    """"93.3%" or "N/A" on an empty table."""
    tenths = F.floor(part * 1000 / total + 0.5)
    return F.when(total == 0, "N/A").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")))


def coverage_row(df: DataFrame, fields=COVERAGE_FIELDS) -> DataFrame:
    """Total and share of rows with a value for each field, in one aggregation."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(~is_missing(df, f)).alias(f"_{f}") for f in fields])
    return counts.select("total", *[percent_text(F.col(f"_{f}"), F.col("total")).alias(f"{f}_coverage") for f in fields])


def completeness_report(df: DataFrame, allowed: DataFrame, *, name: str = "offer_name") -> DataFrame:
    """Gap counts per field and severity (critical fields never have an allow-list)."""
    fields = [*CRITICAL_FIELDS, *GATED_FIELDS]
    gated = allowed.filter(F.col("field").isin(*GATED_FIELDS))
    return split_known_gaps(missing_fields(df, fields, name), gated).groupBy("field", "severity").agg(F.count("*").alias("gaps"))


def rating_coverage(df: DataFrame) -> DataFrame:
    rated = F.col("rating").isNotNull() | F.col("num_ratings").isNotNull()
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(rated).alias("rated"),
        F.count_if(F.col("rating").isNull() & F.col("rating_url").isNotNull()).alias("unrated_with_url"),
        F.count_if(F.col("rating").isNull() & F.col("rating_url").isNull()).alias("unrated_without_url"),
    ).withColumn("coverage", F.when(F.col("total") > 0, F.col("rated") / F.col("total")).otherwise(0.0))


def raw_coverage(attached: DataFrame, *, min_coverage: float = 0.9, max_unrated: int = 0) -> DataFrame:
    """Coverage on raw inputs after lookup, address hydration and catalogue fallback, with the verdict."""
    rating = F.coalesce(F.col("rating").cast("string"), F.nullif(text(F.col("cat_rating")), F.lit("")))
    count = F.coalesce(F.col("num_ratings").cast("string"), F.nullif(text(F.col("cat_num_ratings")), F.lit("")))
    row = attached.agg(F.count("*").alias("total"), F.count_if(rating.isNotNull() | count.isNotNull()).alias("rated"))
    return row.withColumns(
        {
            "unrated": F.col("total") - F.col("rated"),
            "coverage": F.when(F.col("total") > 0, F.col("rated") / F.col("total")).otherwise(0.0),
        }
    ).withColumn("passed", (F.col("coverage") >= min_coverage) & (F.col("unrated") <= max_unrated))


def catalogue_profile(df: DataFrame, *, name: str = "name", price: str = "price", url: str = "url", stock: str = "in_stock") -> DataFrame:
    """Counts of rows, gaps, duplicates and stock states of one catalogue, as one row."""
    flag = F.lower(text(F.col(stock)))
    base = df.agg(
        F.count("*").alias("rows"),
        F.count_if(~has_value(F.col(name))).alias("missing_name"),
        F.count_if(~has_value(F.col(url))).alias("missing_url"),
        F.count_if(parse_money(F.col(price).cast("string")).isNull()).alias("missing_price"),
        F.count_if(flag.isin(*STOCK_TRUE)).alias("stock_true"),
        F.count_if(flag.isin(*STOCK_FALSE)).alias("stock_false"),
    ).withColumn("stock_unknown", F.col("rows") - F.col("stock_true") - F.col("stock_false"))
    dup_name = duplicate_keys(df, F.lower(text(F.col(name)))).agg(F.count("*").alias("n"))
    dup_url = duplicate_keys(df, text(F.col(url))).agg(F.count("*").alias("n"))
    return base.withColumns({"duplicate_names": dup_name.scalar(), "duplicate_urls": dup_url.scalar()})


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """Keys with more than one row."""
    return df.select(key.alias("key")).filter(F.coalesce("key", F.lit("")) != "").groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")


def host_histogram(df: DataFrame, url: str = "url") -> DataFrame:
    return df.filter(has_value(F.col(url))).groupBy(url_host(text(F.col(url))).alias("host")).agg(F.count("*").alias("rows"))


def bad_rows(df: DataFrame, *, name: str = "name", url: str = "url", order: str = "ord", n: int = 10) -> DataFrame:
    """First rows without name or address."""
    return df.filter(~has_value(F.col(name)) | ~has_value(F.col(url))).orderBy(order).limit(n)


def integrity_checks(df: DataFrame, checks: dict[str, Column], *, key: Column | None = None, required: list[str] | None = None,
                     min_rows: int = 0) -> DataFrame:
    """(check, failures) rows: each check counts the rows that violate it.

    ``required`` columns are tested on the schema, ``key`` adds a duplicate count and
    ``min_rows`` a floor; everything else is one aggregation.
    """
    missing = [c for c in required or [] if c not in df.columns]
    row = df.agg(F.count("*").alias("_rows"), *[F.count_if(cond).alias(label) for label, cond in checks.items()])
    labels = {label: F.col(label) for label in checks}
    labels["missing_columns"] = F.lit(len(missing)).cast("long")
    labels["too_few_rows"] = (F.col("_rows") < min_rows).cast("long")
    if key is not None:
        row = row.withColumn("duplicate_keys", duplicate_keys(df, key).agg(F.count("*").alias("n")).scalar())
        labels["duplicate_keys"] = F.col("duplicate_keys")
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), v.cast("long").alias("failures")) for k, v in labels.items()])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def gate(report: DataFrame, *, strict: bool = False) -> DataFrame:
    """One row: does the completeness report (field, severity, gaps) let the run pass?"""
    totals = report.agg(
        F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("gaps"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("gaps"))), F.lit(0)).alias("warnings"),
    )
    ok = (F.col("errors") == 0) & ((F.col("warnings") == 0) if strict else F.lit(True))
    return totals.withColumn("passed", ok)


def input_inventory(inputs: dict[str, DataFrame | None]) -> DataFrame:
    """(input, present, rows) for every named input; absent ones count zero rows."""
    spark = next(df for df in inputs.values() if df is not None).sparkSession
    parts = []
    for name, df in inputs.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("input"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("rows")))
        else:
            parts.append(df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("input"), F.lit(True).alias("present"), "rows"))
    return reduce(DataFrame.unionByName, parts)
