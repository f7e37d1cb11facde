"""Registered queries of the operators in this package, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import decontaminate, merkle, oracles, pieces, quality_rules, quotes, runs, secrets, simhash, token_blocks, token_counts, topk, toxicity, url_filter
from offerlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_token_blocks")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "token-pages")
    token_blocks.write_tokens(table(spark, folder, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_blocks.read_tokens(spark, out)


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train_on_labels(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_url_reputation", oracles.OP3)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of pages are the labels with the same id: good if of quality and not toxic."""
    labels = table(spark, folder, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return url_filter.judge(table(spark, folder, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


@query("op4_quality_rules", oracles.OP4)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_quotation_links")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations(table(spark, folder, "conversations"))


@query("op6_section_tokens")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_by_section(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    linked = simhash.fingerprint_components(table(spark, folder, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_decontamination", oracles.OP8)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op9_secret_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda x: x["kind"] != "crf")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query("op10_pieces")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    model = pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(table(spark, folder, "documents"), model, ids=False, decoded=False)


def with_planted_repeats(text: Column, doc_id: Column) -> Column:
    """In a tenth of the texts, chosen by id, all words from one on repeat the first few of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        places = F.sequence(F.lit(0), n - 1)
        return F.array_join(F.transform(places, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), 0)
    return F.when(h % 10 == 0, F.coalesce(changed, text)).otherwise(text)


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = runs.collapse_runs(docs.select("doc_id", with_planted_repeats(F.col("text"), F.col("doc_id")).alias("text")))
    best = runs.longest_run(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        "best.length",
        (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_merkle_manifest", oracles.OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    own = merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    tampered = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long") + 1, F.col("text"))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    shown = F.when(chosen, tampered).otherwise(own).alias("shown")
    leaves = merkle.placed_leaves(docs, F.col("lang"), F.col("doc_id"), own, F.col("doc_id"), shown)
    found = merkle.manifest(leaves, "doc_id", "shown").withColumn("folded_root", merkle.folded(F.col("shown"), F.col("steps")))
    return found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op13_exact_top_k", oracles.OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)
