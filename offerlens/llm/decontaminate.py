"""Benchmark decontamination: windows of benchmark words looked up in every training text.

Item windows are normalised into a set of distinct windows, looked up by the hash of their first
words.  Each training text hashes its own word runs in one array; a flag table over hash slots drops
the runs that cannot be in the set, the few left are exploded, meet the set in one join and are
compared word by word, so a hash collision is no hit.  One scan of the texts, one narrow shuffle by
row.  The set is broadcast only while its measured row count stays below ``broadcast_rows``; a larger
one is joined by a shuffle on the hash, with the same comparison.

Defined results: a null text has no words and is clean; an item without words has no window; items
with a null id mark words but are not listed; repeated rows are judged alike, each in its own row;
an empty benchmark leaves every text clean; other columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever is neither a digit, a letter A-Z or a-z, nor beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window that its hash covers; the rest is compared.
PREFIX = 3


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def words(text: Column) -> Column:
    """Words with A-Z in lower case and all other characters as they are."""
    plain = lambda w: F.octet_length(w) == F.char_length(w)
    return F.transform(raw_words(text), lambda w: F.when(plain(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def run_hashes(ws: Column, size: int) -> Column:
    """One hash for each run of ``size`` words, in order of its start."""
    shifted = F.arrays_zip(*[(F.slice(ws, k + 1, F.size(ws)) if k else ws).alias(f"w{k}") for k in range(size)])
    runs = F.slice(shifted, F.lit(1), F.greatest(F.size(ws) - (size - 1), F.lit(0)))
    return F.transform(runs, lambda w: F.xxhash64(w))


def benchmark_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of all items: length, words and the ids of the items that hold them."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(size))
    placed = own.select("item", "ws", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("i"))
    return placed.select("item", "len", F.slice("ws", F.col("i"), F.col("len")).alias("w")).groupBy("len", "w").agg(F.collect_set("item").alias("items"))


def flag_slots(hashes: DataFrame, count: int, most_bits: int = 24) -> tuple[bytes, int]:
    """One byte for each of 2^bits hash slots, 1 where a hash of the set falls; 16 slots for each hash, up to a fixed size."""
    bits = min(max((16 * count).bit_length(), 10), most_bits)
    flags = bytearray(1 << bits)
    for row in hashes.select(F.col("h").bitwiseAND((1 << bits) - 1).cast("int").alias("slot")).distinct().toLocalIterator():
        flags[row["slot"]] = 1
    return bytes(flags), bits


def hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """Row, doc_id, text_hash, n_words and, for each verified occurrence, start (word), len, items; rows without any have nulls.

    The driver learns how many windows there are, which of the at most ``PREFIX`` prefix lengths occur,
    and the slots of their hashes (a table of fixed size); not the windows.
    """
    windows = windows.withColumn("prefix", F.least(F.col("len"), F.lit(PREFIX)))
    counts = {r["prefix"]: (r["n"], r["longest"]) for r in windows.groupBy("prefix").agg(F.count("*").alias("n"), F.max("len").alias("longest")).collect()}
    total, longest = sum(n for n, _ in counts.values()), max([1, *(x for _, x in counts.values())])
    keyed = None
    for size in sorted(counts) or [1]:
        first = F.struct(*[F.get("w", k).alias(f"w{k}") for k in range(size)])
        part = windows.filter(F.col("prefix") == size).select(F.xxhash64(first).alias("h"), "len", "w", "items")
        keyed = part if keyed is None else keyed.unionByName(part)
    flags, bits = flag_slots(keyed, total)
    table, mask = F.lit(bytearray(flags)), (1 << bits) - 1
    key = F.xxhash64(F.col(text_col)).alias("text_hash")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), key, words(F.col(text_col)).alias("ws"))

    def candidates(size: int) -> Column:
        placed = F.transform(run_hashes(F.col("ws"), size), lambda h, i: F.struct(i.alias("start"), h.alias("h")))
        return F.filter(placed, lambda x: F.substr(table, x["h"].bitwiseAND(mask).cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01")))

    at = base.select("row", "doc_id", "text_hash", "ws", F.explode_outer(F.concat(*[candidates(s) for s in sorted(counts) or [1]])).alias("c"))
    at = at.select(
        "row",
        "doc_id",
        "text_hash",
        F.size("ws").alias("n_words"),
        F.col("c.start").alias("start"),
        F.coalesce("c.h", F.xxhash64("row")).alias("h"),  # rows without a candidate must not meet in one task
        F.when(F.col("c").isNotNull(), F.slice("ws", F.col("c.start") + 1, longest)).alias("run"),
    )
    k = (F.broadcast(keyed) if total <= broadcast_rows else keyed).alias("k")
    # coalesce() keeps the comparison of words out of the join's keys: only rows whose hash meets pay for it.
    same = F.coalesce(F.slice("run", F.lit(1), F.col("k.len")) == F.col("k.w"), F.lit(False))
    return at.alias("d").join(k, (F.col("d.h") == F.col("k.h")) & same, "left").select("row", "doc_id", "text_hash", "n_words", "start", "len", "items")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, n_words, n_hit, n_items, items (sorted), spans (hit word ranges), contaminated."""
    found = hits(docs, benchmark_windows(items, size), id_col, text_col)
    per = found.groupBy("row", "doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("len").isNotNull(), F.struct("start", "len")))).alias("at"),
        F.flatten(F.collect_set("items")).alias("items"),
    )
    # Occurrences in order of their start; each adds the words beyond the furthest end so far.
    spans = F.aggregate(
        "at",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["start"] + x["len"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), (x["start"] + x["len"]).alias("end"))))),
    )
    per = per.select("doc_id", "text_hash", "n_words", spans.alias("spans"), F.sort_array(F.array_distinct("items")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return per.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` (start, end by word) and what stands between them."""
    tokens = F.regexp_extract_all(text, F.lit(NOT_WORD + "|" + NOT_WORD.replace("[", "[^")), F.lit(0))
    lead = F.when(text.rlike("^" + NOT_WORD), 1).otherwise(0)

    def rest(parts):
        def stays(token, i):
            word = F.floor((i - parts["lead"]) / 2)  # a separator has the number of the word before it
            inside = lambda s: (word >= s["start"]) & (word < s["end"] - (i - parts["lead"]) % 2)
            return (i < parts["lead"]) | ~F.exists(parts["spans"], inside)

        return F.array_join(F.filter(parts["tokens"], stays), "")

    # Bound as one value, so that nothing of the text is computed again for each token.
    return F.get(F.transform(F.array(F.struct(tokens.alias("tokens"), lead.alias("lead"), spans.alias("spans"))), rest), F.lit(0))


def remove_spans(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with hit words cut out of their texts; texts whose words are all hit go."""
    found = contamination(docs, items, size, id_col, text_col).filter("contaminated")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans", (F.col("n_hit") == F.col("n_words")).alias("all_hit"))
    found = found.dropDuplicates(["_id", "_hash"]).withColumnsRenamed({"spans": "_spans", "all_hit": "_all"})
    same = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    rows = docs.join(found, same, "left").filter(F.coalesce(~F.col("_all"), F.lit(True)))
    text = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(without_spans(F.col(text_col), F.col("_spans")))
    return rows.withColumn(text_col, text).select(*docs.columns)
