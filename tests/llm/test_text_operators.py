"""Row operators against plain Python: quality rules, decontamination, secrets, sections, pieces, token blocks."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from cases import EDGE, SCHEMA, with_columns

from offerlens.llm import decontaminate, pieces, quality_rules, queries, secrets, token_blocks, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def base_counts(text):
    t = text or ""
    ws = WORD.findall(t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    counts = len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)
    return *counts, len(ws) < 50 or 100 * len(hit) > 50 * len(ws)


def test_quality_counts(spark, edge, empty, prose):
    rows = [*EDGE, (20, prose(400, 1)), (21, prose(60, 2) + "\n" + prose(60, 2)), (22, " ".join(w + "%%%" for w in prose(200, 3).split()))]
    judged = quality_rules.judge(spark.createDataFrame(with_columns(rows), SCHEMA)).collect()
    got = sorted(tuple(r)[:7] for r in judged if r.doc_id is not None)
    assert got == sorted((i, *base_counts(t)) for i, t in rows if i is not None)
    assert len(judged) == len(rows)
    assert not any(r.kept for r in judged if r.doc_id in (21, 22)) and quality_rules.judge(empty).count() == 0


def test_clean_prose_is_kept(spark, prose):
    ws = prose(300, 5).split()
    text = ". ".join(f"The {a} of {b} is in {c}, and {d} was by the {e}" for a, b, c, d, e in zip(*[iter(ws)] * 5))
    assert quality_rules.judge(spark.createDataFrame(with_columns([(1, text)]), SCHEMA)).first().kept


def found_by_hand(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[k]
        out.append((doc, len(w), len(hit), tuple(sorted(own)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_decontamination(spark, edge, empty, prose, broadcast_rows, monkeypatch):
    monkeypatch.setattr(decontaminate.hits, "__defaults__", ("doc_id", "text", broadcast_rows))
    items = [(1, prose(30, 11)), (2, prose(12, 12) + " " + prose(10, 11)), (3, "Two WORDS"), (4, None), (None, prose(15, 14)), (5, "日本語 🙂"), (1, "word")]
    docs = [*EDGE, (30, prose(50, 20) + ". " + prose(30, 11).upper() + "! " + prose(20, 21)), (31, prose(9, 11)), (32, prose(15, 14)), (33, prose(300, 22))]
    table = spark.createDataFrame(with_columns(docs), SCHEMA)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, h int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(table, bench).collect()), key=str)
    assert got == found_by_hand(docs, items)
    assert not any(r.contaminated for r in decontaminate.contamination(table, bench.limit(0)).collect())
    assert decontaminate.contamination(empty, bench).count() == 0
    left = decontaminate.remove_spans(table, bench)
    assert left.columns == table.columns
    assert not any(r.contaminated for r in decontaminate.contamination(left.filter("doc_id in (30, 33)"), bench).collect())
    assert {r.doc_id for r in left.collect()} >= {1, 2, 3, 30, 33} and left.filter("doc_id in (4, 32)").isEmpty()
    assert left.filter("doc_id = 33").first().text == docs[-1][1]
    assert left.filter("doc_id = 30").first().text == prose(50, 20) + ". ! " + prose(20, 21)


def test_base_secrets():
    text = 'x token: token: abcdefgh12 and API_KEY = "aaaa.bbbb/cc" AKIAABCDEFGHIJKL AKIA12 ' + "f" * 31 + " " + "0" * 32
    got = [(k, text[a:b]) for k, a, b, *_ in secrets.base_spans(text)]
    assert got == [("assign", 'API_KEY = "aaaa.bbbb/cc'), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0" * 32)]
    assert secrets.base_spans("toKen = abcdefgh1") == []


def test_secret_field(spark, edge, empty, prose):
    key = lambda n: hashlib.sha1(str(n).encode()).hexdigest()
    rows = [(100 + n, f'{prose(40, n)} token = "{key(n)}" {prose(20, n + 500)} on 2024-01-{n % 28 + 1:02d} at 10.0.0.{n}') for n in range(120)]
    docs = spark.createDataFrame(with_columns([*EDGE, *rows]), SCHEMA)
    field = secrets.train(docs, sample=80)
    spans = {r.doc_id: r.spans for r in secrets.scan(docs, field).collect()}
    assert [s.kind for s in spans[100]] == ["assign", "hex"] and spans[1] == [] and spans[9] == []
    assert not any(s.kind == "crf" for i in range(100, 220) for s in spans[i])
    assert [s[0] for s in secrets.find(f"the word is {key(999).upper()} here", field)] == ["crf"]
    cut = {r.doc_id: r.text for r in secrets.redact(docs, field).collect()}
    assert key(3) not in cut[103] and "[SECRET]" in cut[103] and cut[1] is None and cut[9] == EDGE[10][1]
    assert secrets.scan(empty, secrets.train(empty)).count() == 0


def test_field_keeps_what_base_spans_leave(spark, prose):
    """The rest of a secret whose head a pattern takes is found too, and so is one of letters alone."""
    key = lambda n: hashlib.sha1(str(n).encode()).hexdigest()
    rows = [(n, f'{prose(40, n)} token = "{key(n)[:24]}" {prose(20, n + 500)} on 2024-01-{n % 28 + 1:02d} at 10.0.0.{n}') for n in range(120)]
    field = secrets.train(spark.createDataFrame(with_columns(rows), SCHEMA), sample=80)
    covered = lambda text: "".join("*" if any(a <= i < b for _, a, b in secrets.find(text, field)) else c for i, c in enumerate(text))
    assert "Zx9Qw77Kp2" not in covered("so password=abcdefgh1!Zx9Qw77Kp2 it is")
    assert "ABCDEF99887766Zq" not in covered("so " + "0123456789abcdef" * 2 + "ABCDEF99887766Zq it is")
    assert covered("login pw aGhtYzzKqLpWsX here") == "login pw " + "*" * 14 + " here"
    assert list(secrets.without("ab cd ef gh", 0, 11, [(3, 5), (4, 8)])) == [(0, 2), (9, 11)] and list(secrets.without('ab"', 0, 3, [(0, 2)])) == []


def test_secret_query_columns(spark, edge, tmp_path, prose):
    """All columns of the registered query against the patterns, and added spans that leave base ones."""
    rows = [(200 + n, f"{prose(30, n)} api_key: {hashlib.md5(str(n).encode()).hexdigest()} AKIAABCDEFGHIJ{n:04d} {prose(9, n)}") for n in range(40)]
    spark.createDataFrame(with_columns([*EDGE, *rows]), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in queries.QUERIES["op9_secret_scan"](spark, str(tmp_path)).collect() if r.doc_id is not None]
    assert len(got) == len(EDGE) - 1 + 40
    texts = dict([*EDGE, *rows])
    for r in got:
        base = [x[:3] for x in secrets.base_spans(texts[r.doc_id] or "")]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == [s for s in told.split(",") if s]


def test_viterbi_is_the_best_path(prose):
    rng = np.random.default_rng(3)
    field = secrets.Field({"a": 0, "b": 1, "c": 2}, rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    import itertools

    for _ in range(20):
        seq = [[["a", "b", "c"][rng.integers(3)]] for _ in range(5)]
        value = lambda p: field.start[p[0]] + sum(field.emit[field.index[f[0]], t] for f, t in zip(seq, p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert value(field.tags(seq)) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=5)))


def test_sections(spark, edge, empty):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc, lengths = token_counts.encoding(path, pattern)
    counted = token_counts.count_by_section(edge, path, pattern).collect()
    for i, t in EDGE:
        if i not in (5, None):
            rows = sorted((r.section, r.start, r.end, r.n_tokens) for r in counted if r.doc_id == i)
            assert sum(r[3] for r in rows) == len(enc.encode_ordinary(t or "")) and rows[-1][2] == len(t or "")
            assert [(t or "")[r[1] : r[2]] for r in rows] == ((t or "").splitlines(keepends=True) if i == 8 else [t or ""] if i != 3 else [" \n", "\t "])
    assert token_counts.deal(np.array([2, 5, 6]), np.array([0, 3]), 6).tolist() == [1, 2]
    assert token_counts.deal(np.array([2, 5, 6]), np.array([0, 3]), 6, "start").tolist() == [2, 1]
    assert token_counts.deal(np.array([4]), np.array([0, 2]), 4).tolist() == [1, 0]
    assert token_counts.count_by_section(empty, path, pattern).count() == 0


def test_pieces_against_every_path():
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "▁a", "ba", "é", "aab", "▁ab"]
    kinds = ["other", *["byte"] * 256, *["normal"] * 9]
    scores = [0.0] * 257 + [-3.0, -2.0, -2.5, -3.9, -4.1, -4.2, -6.0, -5.0, -6.1]
    model = pieces.PieceModel(names, scores, kinds)
    score = dict(zip(names[257:], scores[257:]))

    def best(s):
        if not s:
            return 0.0
        ends = [k for k in range(1, len(s) + 1) if s[:k] in score]
        options = [score[s[:k]] + best(s[k:]) for k in ends]
        return max(options + ([model.unknown + best(s[1:])] if 1 not in ends else []))

    for text in ["ab", "aabba", "b a", "  ab", "éa\nb", "zz a", "abababab baab"]:
        ids = model.encode([text], {})[0].tolist()
        assert model.decode(ids) == text
        if all(c in "ab " for c in text):
            assert sum(scores[i] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))
    long = "ab" * 300
    assert model.solve([long])[0] == model._side_by_side([long.encode()])[0]


def test_pieces_round_trip(spark, edge, empty):
    model = pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    rows = pieces.encode(edge, model).collect()
    assert len(rows) == len(EDGE) and all(r.round_trip for r in rows)
    assert sorted((r.doc_id, r.decoded) for r in rows if r.doc_id) == sorted((i, t or "") for i, t in EDGE if i)
    assert pieces.encode(empty, model).count() == 0


def test_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        v = (rng.integers(0, 60, n) + rng.integers(0, 2, n) * rng.integers(0, 49000, n)).astype(np.uint32)
        page = token_blocks.pack(v)
        assert (token_blocks.unpack_blocks(page) == v).all()
        assert (token_blocks.unpack_blocks(page, 1, 2) == v[512:1024]).all()
    v = rng.integers(0, 2**32, 2000, dtype=np.uint32)
    assert (token_blocks.unpack_blocks(token_blocks.pack(v)) == v).all()


def test_token_pages(spark, edge, empty, prose, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    encode = token_blocks.ChunkEncoder(path, 50)
    odd = ["It's 'Tis you're.", ".,a. b, c..", "ΟΔΟΣ. Σ", "a\x1cb \x1d c", "é ́x\ń", "İstanbul I.", "<|endoftext|>a.", "x y z　w\u0085q", "ﬁ. ß. ǅ, Ÿ.", "한가. 日本。"]
    for t in [*odd, *(t for _, t in EDGE if t)]:
        assert encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids
    rows = [(i, t) for i, t in [*EDGE, *((50 - n, prose(30 + n, n)) for n in range(30))] if i is not None]
    out = str(tmp_path / "pages")
    token_blocks.write_tokens(spark.createDataFrame(with_columns(rows), SCHEMA), out, path, 2)
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_blocks.read_tokens(spark, out).collect()) == want
    token_blocks.write_tokens(empty, out + "0", path, 2)
    assert token_blocks.read_tokens(spark, out + "0").count() == 0


def test_training_sequences_are_bounded():
    """A line of very many numbers is cut into windows that keep its secrets, wherever they stand."""
    numbers = " ".join(str(i) for i in range(5000))
    text = f"{numbers} password=abcd.efgh.1234.zz99 {numbers}"
    (out,) = secrets._training(iter([pd.DataFrame({"text": [text]})]), most=12)
    assert len(out) == 2 * (12 + len(secrets.RECASTS) - 1) and max(map(len, out["tags"])) <= secrets.WINDOW
    with_secret = [t for t in out["tags"] if secrets.BEGIN in t]
    assert len(with_secret) == 2 * len(secrets.RECASTS) and all(t.count(secrets.BEGIN) == 1 for t in with_secret)
    assert sorted(t.count(secrets.INSIDE) for t in with_secret) == [0] * 16 + [6] * 6  # drawn keys are one token
    tags = [0] * 60 + [1] + [2] * 9 + [0] * 100 + [1] + [2] * 99
    ranges = list(secrets.windows(tags))
    assert ranges[0] == (0, 60) and [i for a, b in ranges for i in range(a, b)] == list(range(len(tags))) and max(b - a for a, b in ranges) <= 64


def test_training_holds_little_at_once():
    """The fit keeps its sample as numbers and looks at a part of it at a time; equal sequences count as often as they come."""
    make = lambda i: ([[f"f{(i * 31 + t * 7 + k) % 4000}.{k}" for k in range(12)] for t in range(12)], [1 if t == i % 12 else 0 for t in range(12)])
    tracemalloc.start()
    field = secrets.fit((make(i) for i in range(4000)), rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    few = [make(i) for i in range(40)]
    one, two = secrets.fit(few + few, rounds=20), secrets.fit([x for x in few for _ in range(2)], rounds=20)
    assert one.index == two.index and np.allclose(one.emit, two.emit) and np.allclose(one.move, two.move)
    assert len(field.index) == len({f for i in range(4000) for fs in make(i)[0] for f in fs})
