"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

Patterns give the base spans.  The field tags tokens as outside, secret begin or secret inside from
their shape, the words around them and features of the file, and is decoded by Viterbi.  It is trained
on base spans of a bounded sample of texts: each training sequence comes again with the words
around hidden and with its secrets in other cases, so that shape alone must do, which lets it find
secrets without a keyword.

A sequence is a maximal run of tokens of one line within ``REACH`` tokens of one that is no plain word: it
has a digit, a capital after a small letter, or ``LONG`` characters.  Lower-case, capitalised and
upper-case words of letters below that length, with none of these near, are outside by definition.  Only such lines are
tokenised, so most text costs three pattern searches.  Each row is scanned on its own, without a shuffle.

Where a find of the field overlaps a base span, the part outside the base span is added.

Defined results: a null or empty text has no spans; repeated rows are scanned alike; a sample without
any base span trains a field that tags nothing; an empty table gives an empty result; other columns
of the input pass through ``redact`` and are not read by ``scan``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"\w+|[^\w\s]")
DIGITS = re.compile(r"\b[^\W\d]*\d\w*")
LONG = 20
LONG_WORD = re.compile(r"\b\w{20,}")
INNER_CAPITAL = re.compile(r"[a-z][A-Z]")
REACH = 3
#: Most tokens of a training sequence; decoding works on whole sequences.
WINDOW = 64
#: Features of training sequences that a step holds as floating-point numbers at once.
CELLS = 1 << 17
OUT, BEGIN, INSIDE = 0, 1, 2

Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """Kind, start and end of each base match, then start and end of the secret in it."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                found.append(("assign", m.start(), m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def shape(word: str) -> str:
    kinds = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word[:64]]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)[:5]


def around(word: str) -> str:
    return word.lower() if len(word) <= 12 and not any(c.isdigit() for c in word) else shape(word)


def token_features(words: list[str], i: int, file: list[str]) -> tuple[list[str], list[str]]:
    """Features of a token itself (with those of its file) and of the words around it."""
    w = words[i]
    size = min(len(w), 64)
    digits, letters = sum(c.isdigit() for c in w), sum(c.isalpha() for c in w)
    own = ["bias", f"len{size.bit_length()}.{size // 8}", "shape" + shape(w), f"kinds{len(set(w.lower())) * 4 // max(size, 1)}.{size.bit_length()}"]
    if digits and letters:
        own.append(f"mixed{size.bit_length()}")
    if size >= 16 and all(c in "0123456789abcdefABCDEF" for c in w):
        own.append("hex")
    own += [f"{x}.{size.bit_length()}" for x in file]
    near = []
    for d in range(1, REACH + 1):
        near.append(f"before{d}" + (around(words[i - d]) if i >= d else "^"))
        near.append(f"after{d}" + (around(words[i + d]) if i + d < len(words) else "$"))
    return own, near


def sequences(text: str) -> Iterator[tuple[list[tuple[int, int]], list[list[str]], list[list[str]]]]:
    """Spans, own features and features around, for each sequence of a text."""
    places = sorted({m.start() for p in (DIGITS, LONG_WORD, INNER_CAPITAL) for m in p.finditer(text)})
    if not places:
        return
    share = sum(map(text.count, "0123456789")) / len(text)
    file = [f"digits{int(min(share, 0.5) * 20)}", f"equals{text.count('=').bit_length()}"]
    done = -1
    for place in places:
        if place < done:
            continue
        start = text.rfind("\n", 0, place) + 1
        end = text.find("\n", place)
        done = len(text) if end < 0 else end
        spans = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, done)]
        words = [text[a:b] for a, b in spans]
        near = np.zeros(len(words), dtype=bool)
        for i, w in enumerate(words):
            if len(w) >= LONG or any(c.isdigit() for c in w) or INNER_CAPITAL.search(w):
                near[max(0, i - REACH) : i + REACH + 1] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], near.view(np.int8), [0])))).reshape(-1, 2)
        for a, b in edges.tolist():
            both = [token_features(words, i, file) for i in range(a, b)]
            yield spans[a:b], [x[0] for x in both], [x[1] for x in both]


class Field:
    """Weights of features (rows) by tag, of moves between tags and of starts."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.index, self.emit, self.move, self.start = index, emit, move, start

    def tags(self, features: list[list[str]]) -> list[int]:
        """Viterbi: the best tag sequence."""
        score = np.array([self.emit[[self.index[f] for f in fs if f in self.index]].sum(axis=0) for fs in features])
        best, back = self.start + score[0], []
        for row in score[1:]:
            total = best[:, None] + self.move
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


def fit(samples: Iterable[tuple[list[list[str]], list[int]]], rounds: int = 80, rate: float = 0.3, keep: float = 1e-3) -> Field:
    """Maximum likelihood with forward and backward sums, by Adagrad; sequences are padded with others of about their length.

    ``samples`` are read once and kept as numbers, equal ones together with their count; a step looks at
    ``CELLS`` features at a time.  So what it holds is small beside the sample as text.
    """
    index: dict[str, int] = {}
    counts: dict[tuple[bytes, bytes], int] = {}
    wide = 1
    for features, tags in samples:
        wide = max([wide, *map(len, features)])
        coded = array("i", [x for fs in features for x in (len(fs), *(index.setdefault(f, len(index)) for f in fs))]).tobytes()
        counts[coded, bytes(tags)] = counts.get((coded, bytes(tags)), 0) + 1
    n, pad = sum(counts.values()), len(index)
    by_length: dict[int, list] = {}
    for sample in counts:
        by_length.setdefault(len(sample[1]).bit_length(), []).append(sample)
    batches = []
    for _, part in sorted(by_length.items()):
        most = max(1, max(len(t) for _, t in part))
        step = max(1, CELLS // (most * wide))
        for lo in range(0, len(part), step):
            some = part[lo : lo + step]
            at = np.full((len(some), most, wide), pad, dtype=np.int32)
            gold, mask = np.zeros((len(some), most), dtype=np.int8), np.zeros((len(some), most), dtype=bool)
            for i, (coded, tags) in enumerate(some):
                flat, place = array("i", coded), 0
                for t in range(len(tags)):
                    size = flat[place]
                    at[i, t, :size] = flat[place + 1 : place + 1 + size]
                    place += 1 + size
                gold[i, : len(tags)], mask[i, : len(tags)] = list(tags), True
            batches.append((at, mask, gold, np.array([counts[x] for x in some], dtype=np.float64)))
    counts.clear()
    by_length.clear()
    never = -1e4
    emit = np.zeros((pad + 1, 3))
    move, start = np.zeros((3, 3)), np.array([0.0, 0.0, never])
    move[OUT, INSIDE] = never
    free_move, free_start = move > never / 2, start > never / 2
    squares = [np.full(x.shape, 1e-6) for x in (emit, move, start)]

    def log_sum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    def gradient(at, mask, gold, times):
        one = np.eye(3)[gold] * mask[:, :, None]
        score = emit[at].sum(axis=2)
        most = at.shape[1]
        fore, back = np.zeros(score.shape), np.zeros(score.shape)
        fore[:, 0] = start + score[:, 0]
        for t in range(1, most):
            new = log_sum(fore[:, t - 1, :, None] + move, 1) + score[:, t]
            fore[:, t] = np.where(mask[:, t, None], new, fore[:, t - 1])
        whole = log_sum(fore[:, -1], 1)
        g_move = np.zeros((3, 3))
        for t in range(most - 1, 0, -1):
            new = log_sum(move + (score[:, t] + back[:, t])[:, None, :], 2)
            back[:, t - 1] = np.where(mask[:, t, None], new, 0.0)
            pair = np.exp(fore[:, t - 1, :, None] + move + (score[:, t] + back[:, t])[:, None, :] - whole[:, None, None])
            g_move += np.einsum("n,na,nb->ab", times, one[:, t - 1], one[:, t]) - (pair * (times[:, None] * mask[:, t, None])[:, :, None]).sum(axis=0)
        rest = (one - np.exp(fore + back - whole[:, None, None]) * mask[:, :, None]) * times[:, None, None]
        flat = at.reshape(-1)
        spread = np.repeat(rest.reshape(-1, 3), wide, axis=0)
        g_emit = np.stack([np.bincount(flat, weights=spread[:, k], minlength=pad + 1) for k in range(3)], axis=1)
        return g_emit, g_move, rest[:, 0].sum(axis=0)

    for _ in range(rounds if n else 0):
        g_emit, g_move, g_start = (sum(g) for g in zip(*(gradient(*batch) for batch in batches)))
        g_emit[pad] = 0.0
        grads = (g_emit - keep * n * emit / max(pad, 1), g_move * free_move, g_start * free_start)
        for x, g, q in zip((emit, move, start), grads, squares):
            q += g * g
            x += rate * g / np.sqrt(q)
    return Field(index, emit, move, start)


def mixed(word: str) -> str:
    return "".join(c.upper() if i % 3 else c for i, c in enumerate(word))


BASE_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def drawn_anew(word: str, first: int = 0, again: int = 0) -> str:
    """A key of 10 to 64 of the characters from ``first`` on, more often a short one, that depends on the word and ``again`` only."""
    draw = lambda i: xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1000 * again + i)
    return "".join(BASE_62[first + draw(i) % (62 - first)] for i in range(1, 11 + (draw(0) % 55) * (draw(100) % 55) // 54))


#: Training also sees the secrets in capitals, in mixed case, without digits, and of other lengths, which the patterns alone would miss.
RECASTS = (str, str.upper, mixed, *(partial(drawn_anew, first=first, again=again) for first in (0, 10) for again in range(4)))


def recast_text(text: str, secrets: list[tuple[int, int]], recast) -> tuple[str, list[tuple[int, int]]]:
    """The text with its secrets (sorted, apart) recast, and where they then are."""
    parts, moved, size, end = [], [], 0, 0
    for s, e in secrets:
        new = recast(text[s:e])
        size += s - end
        parts += [text[end:s], new]
        moved.append((size, size + len(new)))
        size, end = size + len(new), e
    return "".join([*parts, text[end:]]), moved


def windows(tags: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``WINDOW`` tokens that cover a sequence; only a secret of more tokens is cut."""
    at = 0
    while at < len(tags):
        end = cut = min(at + WINDOW, len(tags))
        while at < cut < len(tags) and tags[cut] == INSIDE:
            cut -= 1
        yield at, (end := cut if cut > at else end)
        at = end


def _training(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            found: list[tuple[int, int]] = []
            for s, e in sorted((s, e) for *_, s, e in base_spans(text)):
                if found and s < found[-1][1]:  # two patterns, one secret
                    found[-1] = found[-1][0], max(e, found[-1][1])
                else:
                    found.append((s, e))
            for recast in RECASTS if found else RECASTS[:1]:
                told, secrets = recast_text(text, found, recast)
                drawn = []
                for spans, own, near in sequences(told):
                    tags, held = [], None
                    for a, b in spans:
                        of = next((s for s in secrets if s[0] <= a and b <= s[1]), None)
                        tags.append(OUT if of is None else INSIDE if of == held else BEGIN)
                        held = of
                    for a, b in windows(tags):
                        part = [BEGIN if i == a and tags[i] == INSIDE else tags[i] for i in range(a, b)]
                        h = xxhash.xxh64_intdigest(told[spans[a][0] : spans[b - 1][1]].encode("utf-8", "surrogatepass"))
                        drawn.append((not any(part), h, len(drawn), own[a:b], near[a:b], part))
                if recast is not RECASTS[0]:  # what holds no secret is the same again
                    drawn = [x for x in drawn if not x[0]]
                for *_, own, near, tags in sorted(drawn, key=lambda x: x[:3])[:most]:
                    for hidden in (False, True):
                        rows.append(([o if hidden else o + x for o, x in zip(own, near)], tags))
        yield pd.DataFrame(rows, columns=["features", "tags"])


def _packed(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Training sequences as one text each, which is far smaller than its parts; tokens hold no white space, so neither separator."""
    for rows in _training(batches, most):
        told = ["\x1e".join(map("\x1f".join, features)) for features in rows["features"]]
        yield pd.DataFrame({"features": told, "tags": list(map(bytes, rows["tags"]))})


def _samples(rows: pa.Table) -> Iterator[tuple[list[list[str]], list[int]]]:
    for features, tags in zip(rows["features"], rows["tags"]):
        yield [fs.split("\x1f") for fs in features.as_py().split("\x1e")], list(tags.as_py())


def train(docs: DataFrame, text_col: str = "text", sample: int = 600, per_text: int = 12) -> Field:
    """Fit the field on a sample bounded by ``sample`` distinct texts with base spans and as many without, ``per_text`` windows of sequences of each (and as many with recast secrets per recast): at most ``WINDOW`` tokens, those with secrets first, then by hash.

    The sample are the texts with the smallest hashes among those with digits; the driver receives
    their sequences only.
    """
    text = F.col(text_col)
    likely = text.rlike(ASSIGN.pattern.replace("{", r"\{")) | text.rlike(r"AKIA[A-Z0-9]{12}") | text.rlike(HEX.pattern)
    own = docs.select(text.alias("text"), F.xxhash64(text).alias("h"), likely.alias("likely")).filter(text.rlike("[0-9]"))
    narrow = own.select("h", "likely").distinct()
    chosen = None
    for kind in (True, False):
        part = narrow.filter(F.col("likely") == kind).orderBy("h").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = own.join(F.broadcast(chosen.select("h")), "h").dropDuplicates(["h"]).select("text")
    rows = texts.mapInPandas(partial(_packed, most=per_text), "features string, tags binary").toArrow()
    return fit(_samples(rows.sort_by([("features", "ascending"), ("tags", "ascending")])))


def without(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a stretch outside the ``taken`` ones (sorted by start) that hold a letter or digit, trimmed of white space."""
    for a, b in [*((s, e) for s, e in taken if s < end and start < e), (end, end)]:
        part = text[start:a]
        if any(c.isalnum() for c in part):
            lead = len(part) - len(part.lstrip())
            yield start + lead, start + len(part.rstrip())
        start = max(start, b)


def field_spans(text: str, field: Field, taken: list[tuple[int, int]]) -> list[Span]:
    """Spans that the field adds to those already ``taken`` (sorted)."""
    found: list[Span] = []
    for spans, own, near in sequences(text):
        tags = field.tags([o + x for o, x in zip(own, near)])
        i = 0
        while i < len(tags):
            if tags[i] == OUT:
                i += 1
                continue
            j = i + 1
            while j < len(tags) and tags[j] == INSIDE:
                j += 1
            found += [("crf", a, b) for a, b in without(text, spans[i][0], spans[j - 1][1], taken)]
            i = j
    return found


def find(text: str | None, field: Field) -> list[Span]:
    """All spans: base ones and those the field adds, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    spans: list[Span] = [x[:3] for x in base] + field_spans(text, field, [x[1:3] for x in base])
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _find_all(batches: Iterator[pd.Series], field: Field) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(t, field)] for t in batch], dtype=object)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and its spans (kind, start, end in characters)."""

    @F.pandas_udf(SPANS)
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _find_all(texts, field)

    return docs.select(F.col(id_col).alias("doc_id"), udf(F.col(text_col)).alias("spans"))


def redact(docs: DataFrame, field: Field, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; texts without one stay as they are."""

    @F.pandas_udf("string")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                end, parts = 0, []
                for _, a, b in find(t, field):
                    if a >= end:
                        parts += [t[end:a], mark]
                    end = max(end, b)
                out.append(t if not parts else "".join([*parts, t[end:]]))
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text_col, udf(F.col(text_col)))
