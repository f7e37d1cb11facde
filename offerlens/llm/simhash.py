"""SimHash near-duplicates by multi-index hashing.

Fingerprints come from one pass over whole texts (numpy inside tasks).  Copies collapse to distinct
fingerprints before anything is linked.  For linking, a small Hamming ball is enumerated within each
segment of a fingerprint and every element becomes a key of the table of that segment; rows that meet
in a table are verified over their complete distance.

``fingerprint_components`` links whole 64-bit fingerprints at distance two exactly: one of their two
32-bit segments differs in one bit at most, so its table finds the pair.  Families of near copies crowd
single buckets; their fingerprints meet in whole elements one bit from both instead, which at most 65
distinct fingerprints share, so no group can grow hot and no pair is lost.

``near_duplicates`` finds all groups of texts whose word shingles overlap by a given similarity, in two
passes.  Both verify candidates by the exact similarity of their shingle sets, a slice of the hashes
at a time, so that the sets of all pairs are never on the way together.

* Fingerprints of distinct long words are cut into 32-bit segments; texts within two bits in any
  segment share a key.  Texts also share a key for each shingle of their prefixes (see
  ``operators/prefixjoin``).  A key compares its texts with its best connected one and its smallest
  one, which joins large groups without pairing all with all.
* Texts at the bound always share a prefix shingle, so every pair that shares one and is not yet in one
  group is compared, whatever the size of the key; pairs inside the largest group of a key are spared.
  Sizes, positions and a bitmap of shingle parities rule out most pairs before the sets are read.

The order of shingles puts those first that are rare in a bounded sample; any order is exact.

Defined results: null and empty texts have no words and fingerprint zero; texts under the shingle
size are one shingle; repeated rows are copies; null ids are kept and never smallest; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.components import components
from offerlens.operators.prefixjoin import EPS, close_sizes
from offerlens.session import materialize

CHUNK = 1 << 15
#: Copies of a component's smallest id when it is joined back.
SALTS = 16
#: Texts whose shingle arrays a Python worker holds at once.
TEXTS_AT_ONCE = 500
#: Parts of a shingle set, by hash; pairs are compared on one after another.
SLICES = 4
#: Longs in the bitmap of shingle parities.
PARITY = 8


def shingles(text: str | None, size: int) -> list[bytes]:
    """Runs of ``size`` words (A-Z lower-cased, split at ASCII white space), repeats included; fewer words: the whole sequence."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return []
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(ws))
    return [joined[i:j] for i, j in zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist())]


def hashes(features: list[bytes], seed: int = 42) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, features, repeat(seed)), dtype=np.uint64, count=len(features))


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half the hashes; as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), CHUNK):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, size: int = 3, seed: int = 42) -> Column:
    """SimHash of the word shingles of a text as a long."""

    @F.pandas_udf("long")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([majority(hashes(shingles(t, size), seed)) for t in batch], dtype="int64")

    return udf(text)


def signed(bit: int) -> int:
    return (1 << bit) - (1 << 64 if bit == 63 else 0)


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _segments(fp: Column, widths: tuple[int, ...]) -> list[tuple[Column, int, int]]:
    """Value, first bit and width of each segment of a fingerprint."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    return [(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1).cast("long")), at, w) for at, w in zip(starts, widths)]


def _elements(prints: DataFrame) -> DataFrame:
    """Links that connect all pairs at distance two or less: they meet in an element one bit from both, which at most 65 share."""
    ball = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(signed(bit)).cast("long")) for bit in range(64)]
    met = prints.select("fp", F.explode(F.array(*ball)).alias("key")).groupBy("key").agg(F.collect_set("fp").alias("fps"))
    return met.filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))


def fingerprint_links(prints: DataFrame, segments: tuple[int, ...] = (32, 32), bucket: int = 64) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect all pairs at distance two or less.

    Of two such fingerprints, some segment differs in one bit at most: of two segments, one does; of three
    or more, one is equal.  Each segment has a table of its values.  A fingerprint asks every table for its
    own value and, with two segments, for those with one more bit set (the other side of a pair asks where
    a bit is less).  All matches are verified over the whole distance.  Fingerprints that are in a bucket
    of more than ``bucket``, or ask for one, are linked through whole elements instead.
    """
    if sum(segments) != 64 or len(segments) < 2 or max(segments) > 56:
        raise ValueError("segments must be at least two, of at most 56 bits, and 64 bits together")
    tag = lambda value, i: F.struct(F.lit(i).alias("segment"), value.alias("value"))
    parts = _segments(F.col("fp"), segments)
    stored = prints.select("fp", F.explode(F.array(*[tag(v, i) for i, (v, *_) in enumerate(parts)])).alias("key"))
    asked = [tag(v, i) for i, (v, *_) in enumerate(parts)]
    if len(segments) == 2:
        asked += [F.when(v.bitwiseAND(F.lit(1 << b)) == 0, tag(v.bitwiseOR(F.lit(1 << b)), i)) for i, (v, _, w) in enumerate(parts) for b in range(w)]
    asked = prints.select("fp", F.explode(F.array_compact(F.array(*asked))).alias("key"))
    crowded = materialize(stored.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("key"), "crowded")
    small = stored.join(crowded, "key", "left_anti").withColumnRenamed("fp", "b")
    met = asked.withColumnRenamed("fp", "a").join(small, "key").select("a", "b")
    links = met.filter((F.col("a") != F.col("b")) & (distance("a", "b") <= 2)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not crowded.isEmpty():
        links = links.union(_elements(asked.join(crowded, "key", "left_semi").select("fp").distinct()))
    return links.filter((F.col("a") != F.col("b")) & (distance("a", "b") <= 2)).distinct()


def fingerprint_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Per row: doc_id, fp and component_id, the smallest doc_id reachable over fingerprints at distance two or less."""
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), size).alias("fp")), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprints")
    found = components(fingerprint_links(distinct))
    own = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.col("root").isNull().alias("alone"), "root")
    # A component may hold a third of all fingerprints: its smallest id is given out in salted copies.
    own = own.withColumn("salt", F.pmod("fp", F.lit(SALTS)).cast("int"))
    smallest = own.filter("not alone").groupBy("root").agg(F.min("id").alias("least"))
    smallest = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = own.join(smallest, ["root", "salt"], "left").select("fp", F.when(F.col("alone"), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), TEXTS_AT_ONCE):
            yield batch.iloc[lo : lo + TEXTS_AT_ONCE]


def _sampled_shingles(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for batch in _portions(batches):
        sets = [np.unique(hashes(shingles(t, size))) for t in batch["text"]]
        yield pd.DataFrame({"gram": np.concatenate([np.empty(0, dtype=np.uint64), *sets]).view(np.int64)})


def common_shingles(own: DataFrame, size: int, sample: int = 10_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes that at least three of the ``sample`` texts with the smallest hashes hold, and how many do."""
    chosen = F.broadcast(own.select("th").distinct().orderBy("th").limit(sample))
    texts = own.join(chosen, "th").dropDuplicates(["th"]).select("text")
    seen = texts.mapInPandas(partial(_sampled_shingles, size=size), "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 2")
    rows = seen.orderBy(F.desc("n"), "gram").limit(most).toPandas()
    grams, n = rows["gram"].to_numpy(dtype=np.int64).view(np.uint64), rows["n"].to_numpy(dtype=np.int64)
    order = np.argsort(grams)
    return grams[order], n[order]


def prefix(grams: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest of distinct shingle hashes, so many that sets of the given similarity share one."""
    known, n = common
    weight = np.zeros(len(grams), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        weight = np.where(known[at] == grams, n[at], 0)
    least = math.ceil(similarity * len(grams) - EPS)
    return grams[np.lexsort((grams, weight))][: len(grams) - least + 1]


def parities(grams: np.ndarray) -> np.ndarray:
    """One bit per slot, set if an odd number of shingles falls there: sets differ in no fewer shingles than bits."""
    odd = np.bincount((grams % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


PROFILE = "doc_id string, th long, content binary, fps array<long>, size int, bits array<long>, rare array<long>"


def _profile(
    batches: Iterator[pd.DataFrame], seeds: tuple[int, ...], least_chars: int, size: int, similarity: float, common: tuple[np.ndarray, np.ndarray]
) -> Iterator[pd.DataFrame]:
    for batch in _portions(batches):
        content, prints, sizes, bits, rare = [], [], [], [], []
        for t in batch["text"]:
            ws = (t or "").encode("utf-8", "surrogatepass").lower().split()
            content.append(xxhash.xxh128_digest(b" ".join(ws)))
            distinct = dict.fromkeys(ws)
            features = [w for w in distinct if len(w) >= least_chars] or list(distinct)
            prints.append([majority(hashes(features, s)) for s in seeds])
            grams = np.unique(hashes(shingles(t, size)))
            sizes.append(len(grams))
            bits.append(parities(grams))
            rare.append(prefix(grams, similarity, common).view(np.int64))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "content": content, "fps": prints, "size": sizes, "bits": bits, "rare": rare})


GRAMS = ", ".join(["node long", "size int", *(f"grams{i} array<long>" for i in range(SLICES))])


def _shingle_sets(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Distinct shingles of each node, cut into slices by hash, and how many there are."""
    for batch in _portions(batches):
        sizes, slices = [], [[] for _ in range(SLICES)]
        for t in batch["text"]:
            grams = np.unique(hashes(shingles(t, size)))
            of = grams % np.uint64(SLICES)
            sizes.append(len(grams))
            for i, part in enumerate(slices):
                part.append(grams[of == i].view(np.int64))
        yield pd.DataFrame({"node": batch["node"], "size": sizes, **{f"grams{i}": part for i, part in enumerate(slices)}})


def similar_pairs(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` whose sets have at least the given Jaccard similarity.

    A pair meets its sets slice by slice: only one slice is on the way at a time, and a pair goes as soon as what
    is common so far and all that is left cannot reach the similarity.
    """
    met = pairs.select("a", "b")
    for i in range(SLICES):
        side = lambda k: grams.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col(f"grams{i}").alias(f"grams_{k}"))
        left = [F.col(f"left_{k}" if i else f"size_{k}") - F.size(f"grams_{k}") for k in ("a", "b")]
        both = F.size(F.array_intersect("grams_a", "grams_b")) + (F.col("both") if i else 0)
        total = F.col("size_a") + F.col("size_b")
        step = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", total.alias("total"), both.alias("both"), left[0].alias("left_a"), left[1].alias("left_b"))
        most = F.col("both") + F.least("left_a", "left_b")
        found = materialize(step.filter(most >= similarity * (F.col("total") - most)).drop("total"), "similar")
        release(pairs.sparkSession, *([met] if i else []))  # the shuffles of a slice go before those of the next one come
        met = found
    return met.select("a", "b")


def release(spark, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files of finished jobs.

    Spark deletes a shuffle once the driver's garbage collector has found it unused; without a hint that
    may be long after the disks are full.
    """
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def _shared(entries: DataFrame, name: str) -> DataFrame:
    """``entries`` of keys with several nodes, with the number ``n`` and the ``least`` of them."""
    spark = entries.sparkSession
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    shared = materialize(shared, "shared-keys")
    release(spark)  # the shuffle of all keys goes before the next one comes
    found = materialize(entries.join(shared, "key"), name)
    release(spark, shared)
    return found


def _spokes(entries: DataFrame) -> DataFrame:
    """Pairs of each node with the smallest and the best connected node of its keys."""
    degree = entries.groupBy("node").agg(F.sum("n").alias("degree"))
    hub = entries.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"))
    met = entries.join(hub, "key").select("node", F.explode(F.array("least", "hub")).alias("other")).filter("node != other")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _few_differ(a: str, b: str, na: str, nb: str, similarity: float) -> Column:
    """Do the parities of two sets allow the similarity?  Sets that have it differ in few shingles."""
    differ = sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(PARITY)), F.lit(0))
    return differ * (1 + similarity) <= (1 - similarity) * (F.col(na) + F.col(nb)) + EPS


def _across(entries: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different groups that share a key and whose sizes, positions and parities allow the similarity; repeats are left.

    Parities are part of the join, so that it makes no row for two texts that only share a key.
    """
    sizes = entries.groupBy("key", "group").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("group", F.struct("c", "group")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    mixed = entries.join(main, "key").select("key", "node", "size", "pos", "group", (F.col("group") == F.col("main")).alias("inner"))
    # Both sides read it, and the prefixes it comes from can go.
    mixed = materialize(mixed.join(nodes.select("node", "bits"), "node"), "mixed")
    one, two = mixed.filter("not inner").alias("one"), mixed.alias("two")
    once = F.col("two.inner") | (F.col("one.node") < F.col("two.node"))
    both = F.lit(1) + F.least(F.col("one.size") - F.col("one.pos"), F.col("two.size") - F.col("two.pos")) - 1
    enough = both * (1 + similarity) >= similarity * (F.col("one.size") + F.col("two.size")) - EPS
    met = one.join(two, F.col("one.key") == F.col("two.key")).filter(once & (F.col("one.group") != F.col("two.group")))
    met = met.filter(close_sizes("one.size", "two.size", similarity) & enough & _few_differ("one.bits", "two.bits", "one.size", "two.size", similarity))
    return met.select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"))


def _plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs that sizes and parities leave: sets of this similarity differ in few shingles."""
    one = nodes.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("bits").alias("ba"))
    two = nodes.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("bb"))
    few = _few_differ("ba", "bb", "na", "nb", similarity)
    return pairs.join(one, "a").join(two, "b").filter(close_sizes("na", "nb", similarity) & few).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, seeds: tuple[int, ...] = (42,), least_chars: int = 5
) -> DataFrame:
    """Groups of near-duplicates: ``doc_id, th, first, n``.

    One row per distinct (doc_id, xxhash64 of the text ``th``) with the number ``n`` of such rows and
    whether it is the ``first`` of its group, the smallest doc_id (nulls last) with the smallest hash.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    id_type = own.schema["doc_id"].dataType
    profile = partial(_profile, seeds=seeds, least_chars=least_chars, size=size, similarity=similarity, common=common_shingles(own, size))
    # Ids travel as text: beside a null, pandas would read long ones as floats.
    prints = own.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(profile, PROFILE)
    prints = materialize(prints.withColumn("doc_id", F.col("doc_id").cast(id_type)), "profiles")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    nodes = prints.groupBy("content").agg(F.min(rank).alias("rank"), *[F.any_value(c).alias(c) for c in ("fps", "size", "bits", "rare")])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = materialize(prints.select("content", "doc_id", "th"), "members")
    spark = docs.sparkSession
    release(spark, prints)

    parts = [(i, half, F.shiftrightunsigned(F.get("fps", i), 32 * half).bitwiseAND(0xFFFFFFFF)) for i in range(len(seeds)) for half in (0, 1)]
    keys = []
    for i, half, value in parts:
        tag = F.lit((2 * i + half) << 32)
        keys += [value.bitwiseXOR(F.lit(flip).cast("long")).bitwiseOR(tag) for flip in (0, *(1 << bit for bit in range(32)))]
    by_print = _shared(nodes.select("node", F.explode(F.array(*keys)).alias("key")), "entries")
    by_gram = _shared(nodes.select("node", "size", F.posexplode("rare").alias("pos", "key")), "prefixes")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = materialize(_plausible(pairs.distinct(), nodes, similarity), "pairs")
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node")
        needed = needed.select("node", F.col("rank.doc_id").alias("id"), F.col("rank.th").alias("h"))
        texts = own.join(needed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).select("node", "text")
        # Repeated rows go as texts, which are smaller than their shingles and compress.
        grams = texts.dropDuplicates(["node"]).mapInPandas(partial(_shingle_sets, size=size), GRAMS)
        grams = materialize(grams, "grams")
        release(spark)  # the shuffles of the texts go before those of the shingles come
        found = similar_pairs(pairs, grams, similarity)
        release(spark, pairs, grams)
        return found

    alone = F.struct(F.lit(0).alias("kind"), F.col("node").alias("name"))
    group = F.when(F.col("root").isNull(), alone).otherwise(F.struct(F.lit(1).alias("kind"), F.col("root").alias("name")))
    near = links(_spokes(by_print).union(_spokes(by_gram)))
    release(spark, by_print)
    rest = by_gram.join(components(near), "node", "left").withColumn("group", group)
    across = _across(rest, nodes, similarity)
    release(spark, by_gram)
    found = components(near.union(links(across)))

    placed = nodes.join(found, "node", "left").withColumn("group", group)
    first = placed.groupBy("group").agg(F.min("rank").alias("first"))
    placed = placed.join(first, "group").select("content", "first", "group")
    rows = members.groupBy("content", "doc_id", "th").agg(F.count("*").alias("n")).join(placed, "content")
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    return rows.select("doc_id", "th", mine.alias("first"), "n", F.col("first.doc_id").alias("first_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: the first of each group stays, once, with all its columns."""
    kept = near_duplicates(docs, id_col, text_col, **settings).filter("first").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("n").alias("_n"))
    same = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_th"))
    rows = docs.join(kept, same).drop("_id")
    many = rows.filter("_n > 1").dropDuplicates([id_col, "_th"])
    return rows.filter("_n = 1").unionByName(many).drop("_n", "_th")
