"""Operators that look across rows: url reputation, toxicity, quotations, SimHash, and the pipeline."""

import random
import re

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
import xxhash
from cases import EDGE, SCHEMA, with_columns

from offerlens.llm import components, queries, quotes, simhash, toxicity, url_filter


def groups(ids, pairs):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(60)]
    pairs = chain + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, i) for i in range(200, 260)] + [(7, 7), (300, 301)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups({x for p in pairs for x in p}, pairs)
    linked = [i for i in want if sum(want[i] == j for j in want.values()) > 1]
    assert all((roots[a] == roots[b]) == (want[a] == want[b]) for a in linked for b in linked[::7])


def test_fingerprint_links(spark, empty):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4) for _ in range(12)} | {0, 3, 1 << 63}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    want = groups(signed, near)
    for segments, bucket in (((32, 32), 64), ((32, 32), 10_000), ((20, 22, 22), 10_000), ((24, 40), 1)):
        links = {(r.a, r.b) for r in simhash.fingerprint_links(table, segments, bucket).collect()}
        assert links <= near and groups(signed, links) == want
        assert bucket < 10_000 or links == near  # the tables alone find every pair
    assert simhash.fingerprint_components(empty).count() == 0


def test_fingerprints(spark, edge):
    for i, text in EDGE:
        ws = (text or "").encode().lower().split()
        grams = [b" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
        ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)] if len(grams) < 2000 else None
        if ones is not None:
            want = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
            assert simhash.majority(simhash.hashes(simhash.shingles(text, 3))) % (1 << 64) == want
    rows = simhash.fingerprint_components(edge).collect()
    assert len(rows) == len(EDGE) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}


def test_near_duplicates(spark, edge, empty, prose):
    rows = list(EDGE)
    for n in range(12):
        ws = prose(300, 40 + n).split()
        rows.append((1000 + 10 * n, " ".join(ws)))
        rows.append((1001 + 10 * n, "  ".join(ws).upper()))
        for k in (1, 2, 3):
            other = list(ws)
            for i in range(k):
                other[50 + 60 * i] = "changed"
            rows.append((1001 + 10 * n + k, " ".join(other)))
    docs = spark.createDataFrame(with_columns(rows), SCHEMA)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i and i >= 1000) == [1000 + 10 * n for n in range(12)]
    assert sorted(i for i in ids if i and i < 1000) == [1, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert simhash.deduplicate(empty).count() == 0


def brute_kept(rows, size=5, similarity=0.8):
    """Smallest ids of the groups that all pairs of texts at the similarity make."""
    sets = {i: set(simhash.shingles(t, size)) for i, t in rows}
    ids = sorted(sets)
    near = lambda a, b: len(a & b) >= similarity * len(a | b)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(sets[a], sets[b])]
    return sorted(set(groups(ids, pairs).values())), len(pairs)


def test_near_duplicates_exact(spark, prose):
    """Appended passages and short texts, whose prints differ, against all pairs."""
    rng, texts = random.Random(12), []
    for n in range(30):  # new words appended, J about 0.75 to 0.9
        base = prose(rng.randint(150, 300), 2000 + n)
        texts += [base] + [base + " " + prose(int(len(base.split()) * x), 3000 + 10 * n + k) for k, x in enumerate((0.1, 0.18, 0.24, 0.3))]
    for n in range(60):  # 13 to 40 words, the last or another one replaced
        ws = prose(rng.randint(13, 40), 4000 + n).split()
        texts += [" ".join(ws), " ".join([*ws[:-1], "changed"]), " ".join(["changed", *ws[1:]]), " ".join([*ws[:6], "changed", *ws[7:]])]
    footer = prose(40, 1)  # a passage that most of these texts hold, so one key has many texts
    texts += [prose(rng.randint(1, 14), 5000 + n) + " " + footer for n in range(80)]
    chain = prose(120, 2).split()  # neighbours are near, the ends are not
    texts += [" ".join(chain[9 * n :] + prose(9 * n, 3).split()) for n in range(9)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    kept, pairs = brute_kept(rows)
    assert pairs > 400 and len(kept) < len(rows) - 150
    assert sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == kept


def test_repeats_under_one_id(spark, prose):
    """Different texts that repeat under one id, or without an id, all stay once."""
    texts = [prose(40, 6000 + n) for n in range(5)]
    rows = [(i, t) for i, ts in ((None, texts[:2]), (5, texts[2:4]), (6, texts[4:])) for t in ts for _ in range(3)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted({(i or 0, t) for i, t in rows})


def test_prefix_and_parities():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, len(a) - int(rng.integers(0, 8)))], rng.integers(0, 1 << 62, int(rng.integers(0, 8))).astype(np.uint64)]))
        known = np.sort(rng.choice(a, min(len(a), 5), replace=False))
        common = (known, np.full(len(known), 7))
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            assert len(np.intersect1d(simhash.prefix(a, 0.8, common), simhash.prefix(b, 0.8, common)))
        bits = sum(int(x).bit_count() for x in (simhash.parities(a) ^ simhash.parities(b)).view(np.uint64))
        assert bits <= len(a) + len(b) - 2 * both


def test_url_rules(spark):
    urls = [
        "https://Www.Example.ORG/es/1", "http://example.org/en/12?x", "https://a.com/fr/", "https://a.com/de/x", "http://b.org", "nothing", None, "://",
        "http://b.com/#/fr/", "http://x.org?u=http://c.com/de/", "http://notexample.org/es/", "http://ÀB.com/de/é",
    ]
    pages = spark.createDataFrame([(i, u, "p", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    good = spark.createDataFrame([(i, 1) for i in range(12)] + [(3, None), (None, 1), (5, 0)], "page_id long, good int")
    rows = {r.page_id: r for r in url_filter.judge(pages, good).collect()}
    want = ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None, None, "org/", "com/de/"]
    assert [rows[i].rule for i in range(12)] == want
    assert (rows[0].host, rows[0].path) == ("www.example.org", "/es/1") and (rows[8].host, rows[8].path) == ("b.com", "/") and rows[11].host == "Àb.com"
    assert (rows[9].host, rows[9].path) == ("x.org", "") and (rows[5].host, rows[6].host) == ("", "")
    assert rows[0].verdict == "block" and rows[10].verdict == "allow"
    assert url_filter.judge(pages.limit(0), good).count() == 0 and url_filter.judge(pages, good.limit(0)).count() == 12


def test_reputation_shrinks(spark):
    hosts = [(f"h{i}.good.net", 50, 49) for i in range(20)] + [(f"h{i}.bad.net", 50, 3) for i in range(20)] + [("new.good.net", 0, 0), ("new.bad.net", 0, 0)]
    r = {x.host: x for x in url_filter.reputation(spark.createDataFrame(hosts, "host string, n long, k long")).collect()}
    assert r["new.good.net"].mean > 0.8 > 0.3 > r["new.bad.net"].mean
    assert r["new.good.net"].bound < r["h1.good.net"].bound < r["h1.good.net"].mean


def test_toxicity(spark, edge, empty, prose):
    bad = ["vilekin", "grotash", "scumel"]
    rng = random.Random(2)
    rows, labels = list(EDGE), []
    for n in range(300):
        ws = prose(80, n).split()
        if n % 6 == 0:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad) + rng.choice(["", "um", "ix", "ort"]))
        rows.append((100 + n, " ".join(ws)))
        labels.append((100 + n, int(n % 6 == 0), "x"))
    docs = spark.createDataFrame(with_columns(rows), SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, "x"), (100, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train_on_labels(docs, marks)
    got = {r[0]: r[1] for r in docs.select("doc_id", toxicity.score(docs["text"], model)).collect()}
    out = [i for i, *_ in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == dict((a, b) for a, b, _ in labels)[i] for i in out) / len(out) >= 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
    blank = toxicity.train_on_labels(empty, marks.limit(0))
    assert empty.select(toxicity.score(empty["text"], blank)).count() == 0


@pytest.mark.parametrize("told", [[], [0], [1], [None]])
def test_toxicity_without_labels_of_both_classes(spark, data, tmp_path, prose, told):
    """The fixed list and the patterns decide alone; plain texts stay."""
    insults = ["you are a moron", "you pathetic loser", "such scum", "what a clown you idiot"]
    rows = [(n, prose(60, 8000 + n)) for n in range(200)]
    rows += [(1000 + n, prose(40, 9000 + n) + f" {insults[n % 4]}!!! sh*t {insults[(n + 1) % 4]}") for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for t in told for i, _ in rows if t is not None and (i < 40 if t == 0 else 1000 <= i < 1010)], "doc_id long, toxic int")
    model = toxicity.train_on_labels(docs, labels)
    got = {i: model.score(t) for i, t in rows}
    assert all((got[i] >= 0.5) == (i >= 1000) for i in got)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 200
    nothing = toxicity.train_on_labels(docs.limit(0), labels.limit(0))
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0 and nothing.score(rows[0][1]) < 0.5


def test_fixed_voters_reach_the_score(spark, prose):
    """An insult that was not mined raises the score over that of a plain text."""
    rows = [(n, prose(60, n) + (" vilekin" * (n % 12 == 6)) + (f" you are a {toxicity.INSULTS[n % 29]}!!" if n % 12 == 0 else "")) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(n, int(n % 6 == 0)) for n, _ in rows], "doc_id long, toxic int"))
    assert "fool" not in model.voters.words and model.score("plain text here") < model.score("plain fool here")
    assert model.score("you are a fool!! here") >= 0.5


def test_label_model_discounts_copies():
    rng = np.random.default_rng(4)
    y = rng.random(20000) < 0.2
    fires = [rng.random(20000) < np.where(y, 0.7, 0.05), rng.random(20000) < np.where(y, 0.6, 0.1)]
    fires.append(fires[0].copy())
    patterns, counts = np.unique(sum(f.astype(int) << i for i, f in enumerate(fires)), return_counts=True)
    model = toxicity.fit_label_model(patterns, np.full(len(patterns), -1), counts, 3)
    assert model.rates[1, 0] > 0.5 > 0.2 > model.rates[0, 0]
    assert model.weights[1] > model.weights[0] == pytest.approx(model.weights[2], rel=1e-6)


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there my friend\nhow are you today ok"),
        (1, 1, "assistant", "> how are you today ok\nFine thanks a lot"),
        (1, 2, "user", "On Monday A wrote:\n> > how are you today ok\n>Fine  thanks a LOT\nGood to hear that"),
        (1, 3, "user", "> Good to hear that\n> how are you today ok\n> Hello there my friend"),
        (2, 0, "user", None), (None, 1, "x", "> how are you today ok"), (3, 0, "user", "> how are you today ok"), (1, 3, "user", "again"),
    ]
    msgs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, h string, level int")
    got = {(r.conv_id, r.turn, r.text): r for r in quotes.conversations(msgs).collect()}
    assert len(got) == len(rows)
    assert got[1, 1, "Fine thanks a lot"].parent_turn == 0
    second = got[1, 2, "Good to hear that"]
    assert (second.parent_turn, second.root_turn, second.depth, second.max_level, second.n_quoted) == (1, 0, 2, 2, 2)
    assert got[1, 3, ""].parent_turn == 0 and got[1, 3, "again"].depth == 1
    assert got[3, 0, ""].parent_turn is None and got[2, 0, None].depth == 0 and got[None, 1, ""].parent_turn is None
    assert quotes.conversations(msgs.limit(0)).count() == 0


def test_quotations_of_every_kind(spark):
    """Deeper levels, short lines, passages wrapped again, and a phrase of many messages."""
    rows = [
        (1, 0, "The plan for the spring is ready. Please read the second\npart with care before we meet on Friday."),
        (1, 1, ">> unknown to all of us here\nyes please"),
        (1, 2, "> The plan for the\n> spring is ready. Please read\n> the second part with care\n> before we meet on Friday.\nI did read it"),
        (1, 3, ">>> nothing at all there\n>> please read the second part with care before\n>> we meet on friday.\nA late answer"),
        (1, 4, "> yes please\nThanks"),
        (1, 5, "> yes please\n> I did read it\nBoth of you"),
        (1, 6, ">> yes please\nShort and deep"),
        (2, 0, "> yes please\nno one said that here"),
        (2, 1, "same words for all\nfirst"), (2, 2, "same words for all\nsecond"), (2, 3, "> same words for all\nok"),
    ]
    msgs = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(msgs).collect()}
    parents = {k: r.parent_turn for k, r in got.items()}
    assert parents == {
        (1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 2, (1, 4): 1, (1, 5): 2, (1, 6): 4,
        (2, 0): None, (2, 1): None, (2, 2): None, (2, 3): 1,
    }
    assert (got[1, 3].root_turn, got[1, 3].depth, got[1, 6].depth) == (0, 2, 2) and got[1, 2].text == "I did read it"


def links_by_hand(rows, least=3):
    """Parent of each message by comparing every unit with every message."""
    def told(text):
        lines = []
        for x in text.split("\n"):
            mark = re.match(r"(?:[ \t]*>)+[ \t]?", x)
            lines.append((mark[0].count(">") if mark else 0, " ".join(x[mark.end() if mark else 0 :].split()).lower()))
        passages = []
        for i, (k, b) in enumerate(lines):
            if i and lines[i - 1][0] == k and lines[i - 1][1] and b:
                passages[-1] = (k, passages[-1][1] + " " + b)
            else:
                passages.append((k, b))
        return {u for u in lines + passages + [(k, s) for k, b in passages for s in re.split(r"(?<=[.!?]) ", b)] if u[1]}

    sets, out = {(c, t): told(x) for c, t, x in rows}, {}
    for (c, t), own in sets.items():
        votes = {}
        for k, b in own:
            for at in {k - 1, 0} if k else ():
                holders = [t2 for (c2, t2), theirs in sets.items() if c2 == c and (at, b) in theirs]
                if holders and min(holders) < t:
                    n = len(b.split(" "))
                    rank = (0 if k == 1 else 1 if at == k - 1 else 2) + (3 if n < least else 0)
                    votes[rank, min(holders)] = votes.get((rank, min(holders)), 0) + n
        if votes:
            out[c, t] = max(votes, key=lambda v: (-v[0], votes[v], -v[1]))[1]
    return out


def test_quotations_by_hand(spark):
    """Random conversations whose messages quote, nest, shorten and wrap earlier ones again."""
    rng, rows = random.Random(31), []
    words = ["red", "tree", "lake", "stone", "wind", "late"]
    for c in range(12):
        texts = []
        for t in range(14):
            own = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) + rng.choice(["", ".", "!"]) for _ in range(rng.randint(1, 3)))
            if texts and rng.random() < 0.8:
                old = rng.choice(texts).split("\n")[: rng.randint(1, 6)]
                if rng.random() < 0.4 and not any(x.startswith(">") for x in old):
                    ws = " ".join(old).split()
                    cut = rng.randint(1, 5)
                    old = [" ".join(ws[i : i + cut]) for i in range(0, len(ws), cut)]
                own = "\n".join(">" * rng.choice([1, 1, 1, 2]) + rng.choice(["", " "]) + x for x in old) + "\n" + own
            texts.append(own)
        rows += [(c, t, x) for t, x in enumerate(texts)]
    want = links_by_hand(rows)
    got = {(r.conv_id, r.turn): r.parent_turn for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got == want and len(want) > 60


BIG = (1 << 60) + 1


def test_large_ids_beside_nulls(spark, tmp_path, prose):
    """A long id above 2 ** 53 keeps all its digits in a batch that also holds a null id, and no row is lost."""
    docs = spark.createDataFrame(with_columns([(BIG, prose(80, 1) + " password=abcdefgh12"), (None, prose(80, 2)), (BIG + 1, prose(80, 3))]), SCHEMA).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", prose(20, 9))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(BIG, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {BIG, BIG + 1, None}
    for name in ("op1_token_blocks", "op2_toxicity", "op4_quality_rules", "op6_section_tokens", "op7_simhash", "op8_decontamination", "op9_secret_scan", "op10_pieces"):
        assert {r["doc_id"] for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} == want, name
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r["doc_id"] for r in kept.collect()} == want, name


def test_registered(spark, data):
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in queries.QUERIES) == 1
    for name in ("op3_url_reputation", "op5_quotation_links", "op8_decontamination"):
        assert queries.QUERIES[name](spark, data).count() > 0


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    last = corpus_pipeline.run(spark, data)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark_decontamination", "secret_scan", "pieces"]
    n = last.count()
    assert 0.6 * docs.count() < n < docs.count() and last.filter("not round_trip").isEmpty()


def test_stages_on_edges(spark, data, edge, empty):
    for name, stage in corpus_pipeline.STAGES:
        for table in (edge, empty):
            out = stage(spark, table, data)
            assert name == "pieces" or out.columns == table.columns
            out.collect()


def test_texts_that_only_share_a_key_make_no_pair(spark):
    """Parities are looked at before a pair is made: of 20 texts with one shingle in common, only the like ones meet."""
    bits = lambda k: [0] * simhash.PARITY if k < 2 else [(0x5DEECE66D * (k + 1) * (i + 3)) & (2**62 - 1) for i in range(simhash.PARITY)]
    nodes = spark.createDataFrame([(k, bits(k)) for k in range(20)], "node long, bits array<long>")
    entries = spark.createDataFrame([(7, k, 100, 0, (0, k)) for k in range(20)], "key long, node long, size int, pos int, group struct<kind int, name long>")
    assert [tuple(r) for r in simhash._across(entries, nodes, 0.8).collect()] == [(0, 1)]


def test_shingle_sets_are_compared_slice_by_slice(spark):
    """The same pairs as whole sets give, and no step carries more than a slice of a set."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 120))] for _ in range(30)]
    texts = [" ".join(ws[: len(ws) - cut] + [f"new{cut}"] * (cut > 0)) for ws in base for cut in (0, 1, 3, 9) if len(ws) >= cut]
    sets = [set(simhash.hashes(simhash.shingles(t, 5)).tolist()) for t in texts]
    frame = pd.concat(simhash._shingle_sets(iter([pd.DataFrame({"node": range(len(texts)), "text": texts})]), 5))
    slices = [c for c in frame.columns if c.startswith("grams")]
    assert len(slices) == simhash.SLICES and all(sum(len(row[c]) for c in slices) == row["size"] == len(sets[row["node"]]) for _, row in frame.iterrows())
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, min(i + 9, len(texts)))]
    found = simhash.similar_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(frame, simhash.GRAMS), 0.8)
    both = lambda i, j: len(sets[i] & sets[j])
    want = [(i, j) for i, j in pairs if both(i, j) >= 0.8 * (len(sets[i]) + len(sets[j]) - both(i, j))]
    assert sorted(map(tuple, found.collect())) == want and 0 < len(want) < len(pairs)
