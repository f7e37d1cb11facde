"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The trie walks UTF-8 bytes; the best path is the one with the largest sum of piece scores, ties going
to the piece that starts first.  Characters without a piece cost the smallest score less ten and
become byte pieces.  Paths never cross the points no piece spans, so texts are cut there and each
worker keeps the ids of chunks it has met (bounded); new chunks are solved side by side in numpy.

Space becomes the marker U+2581 and one marker precedes the text; decoding reverses both.  A U+2581
of the text itself goes to byte pieces, so decoding gives back every text exactly.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are
encoded alike, each in its own row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Stands for a U+2581 of the text inside chunks; no UTF-8 text has it.
OWN_MARK = b"\xff"
RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
LONG = 192


class DoubleArray:
    """Trie in two arrays: the child of state s for byte c is t = base[s] + c + 1, if check[t] = s."""

    def __init__(self, keys: list[bytes]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, key in enumerate(keys):
            at = 0
            for c in key:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                at = tree[at][c]
            ends[at] = number
        size = 4 * len(tree) + 1024
        base, check, key_of = [0] * size, [-1] * size, [-1] * size
        free, wide, todo = 258, 258, [(0, 0)]  # lower slots cannot be reached by every byte
        while todo:
            node, state = todo.pop()
            key_of[state] = ends.get(node, -1)
            children = sorted(tree[node])
            if not children:
                continue
            while check[free] != -1:
                free += 1
            # Single children fill holes; others search on from where the array is not yet crowded.
            start = tries = max(0, (free if len(children) == 1 else wide) - children[0] - 1)
            while True:
                if start + 258 >= len(check):
                    base += [0] * size
                    check += [-1] * size
                    key_of += [-1] * size
                if all(check[start + c + 1] == -1 for c in children):
                    break
                start += 1
            if len(children) > 1 and start - tries > 32:
                wide = start
            base[state] = start
            for c in children:
                check[start + c + 1] = state
                todo.append((tree[node][c], start + c + 1))
        self.base, self.check, self.key = (np.array(x, dtype=np.int32) for x in (base, check, key_of))

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and which of them exist."""
        to = self.base[states] + codes + 1
        return to, self.check[to] == states


class PieceModel:
    """Pieces, their scores and the trie; built once on the driver, a few megabytes."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.ids = np.array(normal, dtype=np.int64)
        self.scores = np.array([scores[i] for i in normal], dtype=np.float64)
        self.unknown = float(self.scores.min()) - 10.0
        self.trie = DoubleArray([pieces[i].encode() for i in normal])
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        self.raw: list[bytes] = [b""] * len(pieces)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                value = int(p[1:-1], 16)
                self.byte_ids[value], self.raw[i] = i, bytes([value])
            elif k == "normal":
                self.raw[i] = p.replace(MARK, " ").encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no piece for some byte")
        if any(MARK in pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece spans a space; texts cannot be cut at spaces")
        self.breaks_lines = not any("\n" in pieces[i] for i in normal)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        kind = lambda i: "byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal"
        return cls([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], [kind(i) for i in range(n)])

    def chunks(self, text: str) -> list[str]:
        """Pieces of the marked text between points that no piece spans; U+2581 of the text stands as a lone surrogate."""
        if MARK in text:
            text = text.replace(MARK, "\udcff")
        if not text:
            return []
        lines = text.split("\n") if self.breaks_lines else [text]
        out: list[str] = []
        for n, line in enumerate(lines):
            if n:
                out.append("\n")
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                out += RUNS.findall((MARK if n == 0 else "") + line.replace(" ", MARK))
            elif line or n == 0:
                words = line.split(" ")
                first = MARK + words[0] if n == 0 else words[0]
                out.append(first)
                out += [MARK + w for w in words[1:]]
        return out

    def solve(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit numbers."""
        raw = [c.encode("utf-8", "surrogateescape") for c in chunks]
        out: list[bytes] = [b""] * len(raw)
        short = sorted((i for i in range(len(raw)) if len(raw[i]) <= LONG), key=lambda i: len(raw[i]))
        for at in range(0, len(short), 4096):
            group = short[at : at + 4096]
            for i, ids in zip(group, self._side_by_side([raw[i] for i in group])):
                out[i] = ids
        for i in range(len(raw)):
            if len(raw[i]) > LONG:
                out[i] = self._alone(raw[i])
        return out

    @staticmethod
    def _char_bytes(lead: np.ndarray) -> np.ndarray:
        return np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead == 0xFF, 1, 4))))

    def _trace(self, word: bytes, back_from, back_key) -> bytes:
        ids: list[int] = []
        at = len(word)
        while at > 0:
            start, key = int(back_from[at]), int(back_key[at])
            if key >= 0:
                ids.append(int(self.ids[key]))
            else:
                part = word[start:at]
                ids += self.byte_ids[list(reversed(MARK_BYTES if part == OWN_MARK else part))].tolist()
            at = start
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def _side_by_side(self, words: list[bytes]) -> list[bytes]:
        lens = np.array([len(w) for w in words])
        most = int(lens.max()) if len(words) else 0
        codes = np.zeros((len(words), most + 5), dtype=np.int32)
        for i, w in enumerate(words):
            codes[i, : len(w)] = np.frombuffer(w, np.uint8)
        best = np.full((len(words), most + 5), -np.inf)
        best[:, 0] = 0.0
        back_from = np.zeros((len(words), most + 5), dtype=np.int32)
        back_key = np.full((len(words), most + 5), -1, dtype=np.int32)
        for i in range(most):
            rows = np.flatnonzero((lens > i) & np.isfinite(best[:, i]))
            size = self._char_bytes(codes[rows, i])
            covered = np.zeros(len(words), dtype=bool)
            cur, state, j = rows, np.zeros(len(rows), dtype=np.int32), i
            width = np.zeros(len(words), dtype=np.int32)
            width[rows] = size
            while len(cur):
                to, ok = self.trie.step(state, codes[cur, j])
                ok &= lens[cur] > j
                cur, state, j = cur[ok], to[ok], j + 1
                key = self.trie.key[state]
                at, k = cur[key >= 0], key[key >= 0]
                covered[at[width[at] == j - i]] = True
                score = best[at, i] + self.scores[k]
                up = score > best[at, j]
                at, k = at[up], k[up]
                best[at, j], back_from[at, j], back_key[at, j] = score[up], i, k
            bare = rows[~covered[rows]]
            j = i + width[bare]
            score = best[bare, i] + self.unknown
            up = score > best[bare, j]
            at, j = bare[up], j[up]
            best[at, j], back_from[at, j], back_key[at, j] = score[up], i, -1
        # Walk all paths back together; words with bare characters are traced one by one.
        at, rows = lens.copy(), np.arange(len(words))
        ids, steps = np.zeros((len(words), most), dtype="<u4"), np.zeros(len(words), dtype=np.int64)
        bare = np.zeros(len(words), dtype=bool)
        while len(rows):
            key = back_key[rows, at[rows]]
            bare[rows[key < 0]] = True
            ids[rows, most - 1 - steps[rows]] = self.ids[np.maximum(key, 0)]
            steps[rows] += 1
            at[rows] = back_from[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return [self._trace(w, back_from[i], back_key[i]) if bare[i] else ids[i, most - steps[i] :].tobytes() for i, w in enumerate(words)]

    def _alone(self, word: bytes) -> bytes:
        """The same recurrence for one long chunk."""
        base, check, key_of = self.trie.base, self.trie.check, self.trie.key
        n = len(word)
        best, back_from, back_key = [-np.inf] * (n + 5), [0] * (n + 5), [-1] * (n + 5)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            width = int(self._char_bytes(np.array([word[i]]))[0])
            state, covered = 0, False
            for j in range(i, n):
                to = int(base[state]) + word[j] + 1
                if check[to] != state:
                    break
                state, key = to, int(key_of[to])
                if key >= 0:
                    covered = covered or j + 1 - i == width
                    score = best[i] + float(self.scores[key])
                    if score > best[j + 1]:
                        best[j + 1], back_from[j + 1], back_key[j + 1] = score, i, key
            if not covered and best[i] + self.unknown > best[i + width]:
                best[i + width], back_from[i + width], back_key[i + width] = best[i] + self.unknown, i, -1
        return self._trace(word, back_from, back_key)

    def encode(self, texts: list[str | None], known: dict[str, bytes], most: int = 400_000) -> list[np.ndarray]:
        """Ids of each text; ``known`` keeps the ids of chunks and is emptied when it has ``most``."""
        parts = [self.chunks(t or "") for t in texts]
        missing = [c for c in dict.fromkeys(c for p in parts for c in p) if c not in known]
        if missing:
            if len(known) + len(missing) > most:
                known.clear()
                missing = list(dict.fromkeys(c for p in parts for c in p))
            known.update(zip(missing, self.solve(missing)))
        return [np.frombuffer(b"".join([known[c] for c in p]), dtype="<u4") for p in parts]

    def decode(self, ids) -> str:
        raw = b"".join([self.raw[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        return raw[1:].decode("utf-8") if raw[:1] == b" " else raw.decode("utf-8")


_KNOWN: dict[str, bytes] = {}


def _encoded(batches: Iterator[pd.DataFrame], model: PieceModel, ids_too: bool, decoded: bool) -> Iterator[pd.DataFrame]:
    in_bytes = np.zeros(len(model.raw), dtype=bool)
    in_bytes[model.byte_ids] = True
    for batch in batches:
        rows = []
        for lo in range(0, len(batch), 256):
            own = batch["text"].iloc[lo : lo + 256].tolist()
            for doc_id, text, ids in zip(batch["doc_id"].iloc[lo : lo + 256], own, model.encode(own, _KNOWN)):
                back = model.decode(ids)
                row = [doc_id, len(ids), zlib.crc32(ids.tobytes()), int(in_bytes[ids].sum()), back == (text or "")]
                rows.append([*row, *([ids.astype(np.int32)] if ids_too else []), *([back] if decoded else [])])
        names = ["doc_id", "n_tokens", "ids_crc32", "n_byte_ids", "round_trip", *(["ids"] if ids_too else []), *(["decoded"] if decoded else [])]
        yield pd.DataFrame(rows, columns=names)


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32, n_byte_ids, round_trip and, if asked for, ids and the decoded text."""
    # Ids travel as text: beside a null, pandas would read long ones as floats.
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id string, n_tokens long, ids_crc32 long, n_byte_ids long, round_trip boolean"
    schema += (", ids array<int>" if ids else "") + (", decoded string" if decoded else "")
    found = own.mapInPandas(partial(_encoded, model=model, ids_too=ids, decoded=decoded), schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
