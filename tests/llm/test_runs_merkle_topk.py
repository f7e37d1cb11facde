"""Periodic runs, Merkle manifest and exact top-k search against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from cases import EDGE, SCHEMA, with_columns
from pyspark.sql import functions as F

from offerlens.llm import merkle, queries, runs, topk


def all_runs(words):
    """Every run by walking each period."""
    found = {}
    for q in range(1, len(words) // runs.TIMES + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(runs.LEAST, runs.TIMES * q):
                found.setdefault((i, j + q - i), q)
            i = j + (j == i)
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        for i in range(a, rng.randint(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


def test_correlation():
    rng = np.random.default_rng(3)
    for prime in runs.PRIMES:
        for block in (1, 2, 4, 16, 64):
            blocks, at = rng.integers(0, prime[0], (block, 7), dtype=np.uint64), np.array([0, 1, 4])
            text = blocks.T.reshape(-1).tolist()
            want = [[sum(text[i * block + j] * text[(i + 1) * block + k + j] for j in range(block)) % prime[0] for i in at] for k in range(block)]
            assert runs.correlate(blocks, at, *prime).tolist() == want


@pytest.mark.parametrize("hash_prime", [None, 5])
def test_runs(monkeypatch, hash_prime):
    if hash_prime:  # hashes that deceive all the time: stretches are walked
        monkeypatch.setattr(runs, "HASH_PRIME", hash_prime)
    rng = random.Random(9)
    for _ in range(60):
        texts = [repetitive(rng, rng.choice([1, 5, 6, 7, rng.randint(8, 60), rng.randint(60, 400)]), rng.choice([1, 2, 3, 60])) for _ in range(12)]
        texts.insert(rng.randrange(len(texts)), [])
        assert runs.find_runs(texts) == [all_runs(t) for t in texts]


def test_large_codes_and_long_texts():
    rng = random.Random(2)
    distinct = list(range(70_000))
    assert runs.find_runs([distinct, [1] * 30_000]) == [[], [(0, 30_000, 1)]]
    period = [rng.randrange(50_000) for _ in range(9_000)]
    assert runs.find_runs([[-1] + period * 5 + [-2]]) == [[(1, 45_000, 9_000)]]


def planted(i, text):
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if i is not None and words and zlib.crc32(str(i).encode()) % 10 == 0:
        g, n = zlib.crc32(str(i).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def digests(i, text):
    words = planted(i, text)
    found = all_runs(words)
    kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in found)]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    milli = best[1] and 1000 * best[1] // best[2]
    return i, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def test_run_query(spark, tmp_path):
    rng = random.Random(4)
    made = [(i, " ".join(f"w{x}" for x in repetitive(rng, rng.randint(1, 200), rng.choice([2, 40])))) for i in range(100, 260)]
    edge = [(i, t if len(t or "") < 50_000 else t[:4_000]) for i, t in EDGE] + [((1 << 60) + 1, "a b c d " * 5)]
    spark.createDataFrame(with_columns(made + edge), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((digests(*r) for r in made + edge), key=repr)
    assert any(r[1] > 1 for r in got) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in made) > 5


def test_run_operator_edges(spark, edge, empty):
    assert runs.collapse_runs(empty).count() == 0
    clash = edge.withColumn("n_words", F.lit("x")).withColumn("runs", F.lit(1))
    out = runs.collapse_runs(clash)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "h", "row", "w", "n_words", "runs", "collapsed"]
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(EDGE) and rows[9].collapsed == "lorem ipsum" and rows[9].runs[0].asDict() == {"start": 0, "length": 18_000, "period": 2}
    assert rows[1].n_words == 0 and rows[1].collapsed == "" and rows[8].n_words == 7


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def tree_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else ""))
        i //= 2
    return out


def manifest_rows(rows):
    """The contract's rows of (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, text, lang, source, n in rows:
        leaf, other = (sha("".join(map(field, (i, source, lang, m, text)))) for m in (n, n if n is None else n + 1))
        groups.setdefault(lang, []).append((i, leaf, other if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else leaf))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    trees = [tree_levels([m[1] for m in groups[k]]) for k in order]
    top = tree_levels([t[-1][0] for t in trees])
    for g, k in enumerate(order):
        for at, (i, leaf, shown) in enumerate(groups[k]):
            steps = path(trees[g], at) + path(top, g)
            for before, after in steps:
                shown = sha(before + shown + after)
            yield i, leaf, trees[g][-1][0], top[-1][0], sha("".join(b + a for b, a in steps)), shown, shown == top[-1][0]


@pytest.mark.parametrize("n", [0, 1, 2, 70])
def test_manifest(spark, tmp_path, n):
    """Group sizes around powers of the stride, null and odd groups, repeated rows, tampered leaves."""
    langs = [None, "", "en", "é", "z"] + [f"l{k}" for k in range(40)] if n == 70 else ["en"]
    rows = [(i, f"text {i} é", langs[i % len(langs)] if i % 3 else "en", None if i % 5 else "s", i or None) for i in range(n)]
    rows += [(i, f"t{i}", f"size{k}", "s", 1) for k in (31, 32, 33, 65, 129) for i in range(k)] if n == 70 else []
    rows += [(None, None, None, None, None), (None, "x", "en", "s", 2), (5, "r", "en", "s", 1), (5, "r", "en", "s", 1), ((1 << 60) + 1, "big", "en", "s", 3)] if n == 70 else []
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.withColumn("idx", F.lit(1)).withColumn("digest", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(manifest_rows(rows), key=repr)
    assert got == want and (n < 70 or {r[-1] for r in got} == {True, False})


def test_strides_agree(spark, tmp_path):
    rows = spark.range(200).select(F.col("id"), F.when(F.col("id") < 150, "a").otherwise("b").alias("lang"))
    found = []
    for stride in (1, 3, 8):
        leaves = merkle.placed_leaves(rows, F.col("lang"), F.col("id"), merkle.leaf(F.col("id")), F.col("id").alias("doc"))
        out = merkle.manifest(leaves, "doc", stride=stride)
        assert out.filter(merkle.folded(F.col("digest"), F.col("steps")) != F.col("root")).count() == 0
        found.append(sorted(map(repr, out.select("doc", "digest", "steps", "subroot", "root").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 200


def best_rows(vectors, k, every):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    for a, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, v)))), j) for b, (j, v) in enumerate(kept) if a != b]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for rank, (score, j) in enumerate(scored[:k], 1):
            yield i, rank, j, score


VECTORS = "vec_id long, embedding array<double>, score string, row int"


@pytest.mark.parametrize("block", [16, topk.BLOCK])
def test_top_k(spark, block):
    rng = random.Random(6)
    vectors = [(i, [rng.choice([0.0, 0.0, rng.uniform(-2, 2), 0.5]) for _ in range(rng.choice([6, 6, 6, 3, 9]))]) for i in range(150)]
    vectors += [(7, None), (10, [1.0, None]), (20, [float("nan")]), (30, [float("inf")]), (40, []), (None, [1.0] * 6), (50, [1.0] * 6), (50, [1.0] * 6)]
    vectors += [(60, [1e12] * 4), (61, [-1e12] * 4), (70, [1e300, 1.0]), (1 << 60, [0.25] * 6), ((1 << 60) + 10, [0.25] * 6), (80, [1e307])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], VECTORS)
    got = topk.search(frame, F.col("vec_id") % 10 == 0, k=5, scale=256, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(best_rows(vectors, 5, 10), key=repr)


def test_top_k_small(spark):
    """No rows, no queries, fewer rows than asked for, many equal vectors."""
    for vectors in ([], [(1, [1.0])], [(10, [1.0])], [(10, [1.0]), (3, [2.0])], [(i, [0.5, 0.5]) for i in range(40)]):
        got = topk.search(spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], VECTORS), F.col("vec_id") % 10 == 0, k=5, scale=256)
        assert sorted(map(tuple, got.collect())) == sorted(best_rows(vectors, 5, 10))
