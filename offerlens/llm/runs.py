"""Periodic runs of words, found by block convolution and cut down to one period.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) and
at least ``max(LEAST, TIMES * q)`` words that no neighbouring word extends.  ``TIMES`` is 4.

Words become numbers within their text.  For each power of two ``B``, texts of at least ``4 * B`` words
are cut into blocks of ``B`` words, aligned over all texts of a portion.  A run of a period from ``B`` to ``2 * B - 1`` holds a whole block
whose next occurrence is one period further on, so each block is looked for at exactly these distances
in the words that follow: the sum of squared differences at a distance is the squares of both sides less
twice their correlation, which a number-theoretic transform of ``2 * B`` points gives modulo a prime.
The sum is below the product of the primes used, so it is zero exactly where no word differs.

Distances of zero mismatch seed extensions to both sides, by binary search over hashes of prefixes; a
stretch that is long enough is compared word by word before it counts, and where hashes deceived it is
walked.  Scales rise, and a seed inside a run found before whose period divides its distance is spared,
so highly repetitive texts cost no more than others.  One stretch found at several multiples of its
period counts once, at the smallest.

Texts of an Arrow batch are handled together, in portions of about ``PORTION`` words; a longer text is a
portion of its own.  Ids never leave Arrow.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; further
columns pass through, and one named like a result is replaced; repeated rows and null ids are treated
like any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 6, 4
PORTION = 1 << 17
#: Cells of the matrix of one transform, which bounds memory and suits the processor's cache.
CELLS = 1 << 16
#: Primes with roots of unity for long transforms, each with a generator.
PRIMES = ((998244353, 3), (2013265921, 31), (469762049, 3))
#: Prime and base of the prefix hashes.
HASH_PRIME, HASH_BASE = (1 << 31) - 1, 1_000_003_579


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    """``x % p``; dividing by a scalar is much the faster operation."""
    return x - (x // np.uint64(p)) * np.uint64(p)


@lru_cache(maxsize=None)
def _roots(size: int, p: int, g: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order ``size``, as many as half of it."""
    root = pow(g, (p - 1) // size, p)
    root = pow(root, -1, p) if inverse else root
    out, step = np.ones(max(1, size // 2), dtype=np.uint64), root
    filled = 1
    while filled < len(out):
        more = min(filled, len(out) - filled)
        out[filled : filled + more] = _mod(out[:more] * np.uint64(step), p)
        step, filled = step * step % p, filled * 2
    return out


@lru_cache(maxsize=None)
def _negated(size: int) -> np.ndarray:
    """For each place of a transform in bit-reversed order, the place of the negated frequency."""
    turned = np.zeros(1, dtype=np.int64)
    while len(turned) < size:
        turned = np.concatenate((2 * turned, 2 * turned + 1))
    return turned[-turned % size]


def _forward(a: np.ndarray, p: int, g: int) -> np.ndarray:
    """Transforms of the columns, each followed by as many zeros, in bit-reversed order."""
    half, cols = a.shape
    prime = np.uint64(p)
    out = np.concatenate((a, _mod(a * _roots(2 * half, p, g, False)[:, None], p)))
    while half > 1:
        length, half = half, half // 2
        v = out.reshape(-1, 2, half, cols)
        lo, hi = v[:, 0], v[:, 1]
        rest = _mod((lo + (prime - hi)) * _roots(length, p, g, False)[:, None], p)
        total = lo + hi
        np.minimum(total, total - prime, out=v[:, 0])
        v[:, 1] = rest
    return out


def _backward(a: np.ndarray, p: int, g: int) -> np.ndarray:
    """The first half of each column's inverse transform; consumes its bit-reversed input."""
    size, cols = a.shape
    prime, half = np.uint64(p), 1
    while 2 * half < size:
        v = a.reshape(-1, 2, half, cols)
        hi = _mod(v[:, 1] * _roots(2 * half, p, g, True)[:, None], p)
        total, rest = v[:, 0] + hi, v[:, 0] + (prime - hi)
        np.minimum(total, total - prime, out=v[:, 0])
        np.minimum(rest, rest - prime, out=v[:, 1])
        half *= 2
    last = a[:half] + _mod(a[half:] * _roots(size, p, g, True)[:, None], p)
    return _mod(_mod(last, p) * np.uint64(pow(size, -1, p)), p)


def correlate(blocks: np.ndarray, at: np.ndarray, p: int, g: int) -> np.ndarray:
    """Correlations, modulo a prime, of the columns ``at`` of ``blocks`` with the two that follow each.

    Row ``k`` of the result is the sum over ``j`` of word ``j`` of the block times word ``k + j`` of what
    follows.  Every block is transformed once: the spectrum of two blocks in a row is the sum of theirs,
    the second with every odd frequency negated, and the turned block has its own with frequencies negated.
    """
    block, prime = len(blocks), np.uint64(p)
    spectra = _forward(blocks, p, g)
    one, two = spectra[:, at + 1], spectra[:, at + 2]
    one[:block] += two[:block]
    one[block:] += prime - two[block:]
    return _backward(_mod(_mod(one, p) * spectra[_negated(2 * block)][:, at], p), p, g)


def zero_mismatches(codes: np.ndarray, numbers: np.ndarray, block: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance (``block`` up to ``2 * block - 1``) of each exact further occurrence of the blocks asked for.

    Block ``i`` holds the codes from ``i * block`` on; two more follow every one asked for.  Codes are below ``most``.
    """
    rows = codes[: len(codes) // block * block].reshape(-1, block)
    found_row, found_k = [], []
    at_once = max(1, CELLS // (2 * block))
    for lo in range(0, len(numbers), at_once):
        own = numbers[lo : lo + at_once]
        needed = np.unique(np.concatenate((own, own + 1, own + 2)))
        at = np.searchsorted(needed, own)
        words = np.ascontiguousarray(rows[needed].T)
        zero, bound = np.ones((block, len(own)), dtype=bool), 1
        for p, g in PRIMES:
            x = _mod(words, p) if most >= p else words
            sums = np.cumsum(_mod(x * x, p), axis=0, dtype=np.uint64)
            whole = sums[-1]
            squares = (whole[at] + whole[at + 1])[None, :] + np.zeros((block, 1), dtype=np.uint64)
            squares[1:] += sums[:-1, at + 2] - sums[:-1, at + 1]  # the sum stays positive, so wrapping is harmless
            zero &= _mod(squares, p) == _mod(2 * correlate(x, at, p, g), p)
            bound *= p
            if bound > block * most * most:
                break
        k, row = np.nonzero(zero)
        found_row.append(own[row])
        found_k.append(k)
    return np.concatenate(found_row), np.concatenate(found_k) + block


class Portion:
    """Texts as one row of codes, each followed by codes that equal no other."""

    def __init__(self, texts: list[list[int]]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        longest = int(self.lengths.max(initial=0))
        self.begins = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        self.codes = np.zeros(int(self.lengths.sum()) + len(texts) + 3 * longest + 4, dtype=np.uint64)
        for b, t in zip(self.begins.tolist(), texts):
            self.codes[b : b + len(t)] = t
        self.text_of = np.repeat(np.arange(len(texts)), self.lengths + 1)
        self.most = int(self.codes.max(initial=0)) + 1
        self._hash: tuple[np.ndarray, np.ndarray] | None = None

    def prefix_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all prefixes and powers of the base, by doubling steps."""
        if self._hash is None:
            n, p = len(self.codes), HASH_PRIME
            power = np.ones(n + 1, dtype=np.uint64)
            step, filled = HASH_BASE, 1
            while filled <= n:
                more = min(filled, n + 1 - filled)
                power[filled : filled + more] = _mod(power[:more] * np.uint64(step), p)
                step, filled = step * step % p, filled * 2
            # Sum of code * base ** place: windows compare after scaling to one place.
            terms = _mod(_mod(self.codes * np.uint64(2_654_435_761) + np.uint64(12345), p) * power[:n], p)
            self._hash = np.concatenate((np.zeros(1, np.uint64), _mod(np.cumsum(terms, dtype=np.uint64), p))), power
        return self._hash

    def _same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the hashes of ``length`` words at ``i`` and at ``j > i`` agree."""
        sums, power = self.prefix_hash()
        p, prime = HASH_PRIME, np.uint64(HASH_PRIME)
        one = _mod(_mod(sums[i + length] + (prime - sums[i]), p) * power[j - i], p)
        return one == _mod(sums[j + length] + (prime - sums[j]), p)

    def stretches(self, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the longest stretch round each seed in which words ``distance`` apart agree."""
        t = self.text_of[at]
        lo_end, hi_end = self.begins[t], self.begins[t] + self.lengths[t]
        right, left = np.zeros_like(at), np.zeros_like(at)
        most_right, most_left = hi_end - at - distance, at - lo_end
        bit = 1 << max(int(max(most_right.max(initial=0), most_left.max(initial=0))).bit_length(), 1)
        while bit := bit >> 1:
            ok = np.flatnonzero(right + bit <= most_right)
            grow = ok[self._same(at[ok] + right[ok], at[ok] + right[ok] + distance[ok], np.full(len(ok), bit))]
            right[grow] += bit
            ok = np.flatnonzero(left + bit <= most_left)
            low = at[ok] - left[ok] - bit
            grow = ok[self._same(low, low + distance[ok], np.full(len(ok), bit))]
            left[grow] += bit
        return at - left, at + right + distance

    def walked(self, at: int, distance: int) -> tuple[int, int]:
        """The same stretch word by word."""
        t = int(self.text_of[at])
        lo, hi = int(self.begins[t]), int(self.begins[t] + self.lengths[t])
        same = self.codes[lo : hi - distance] == self.codes[lo + distance : hi]
        differ = np.flatnonzero(~same) + lo
        k = int(np.searchsorted(differ, at))
        start = int(differ[k - 1]) + 1 if k else lo
        return start, (int(differ[k]) if k < len(differ) else hi - distance) + distance

    def runs(self) -> list[list[tuple[int, int, int]]]:
        """Runs of every text as (start, length, period), by start and period."""
        found: list[dict[tuple[int, int], int]] = [{} for _ in self.lengths]
        covers = Covers()
        block = 1
        while len(long := np.flatnonzero(self.lengths >= max(TIMES * block, LEAST))):
            first = -(-self.begins[long] // block)
            per_text = np.maximum((self.begins[long] + self.lengths[long]) // block - 1 - first, 0)
            order = np.arange(int(per_text.sum())) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            number, distance = zero_mismatches(self.codes, np.repeat(first, per_text) + order, block, self.most)
            at = number * block
            inside = at + distance + block <= (self.begins + self.lengths)[self.text_of[at]]
            at, distance = at[inside], distance[inside]
            spare = covers.hold(at, at + distance + block, distance)
            at, distance = at[~spare], distance[~spare]
            if len(at):
                for start, end, d in self._confirmed(at, distance):
                    t = int(self.text_of[start])
                    found[t].setdefault((start - int(self.begins[t]), end - start), d)
                    covers.add(start, end, d)
            covers.settle()
            block *= 2
        return [sorted((s, n, q) for (s, n), q in f.items()) for f in found]

    def _confirmed(self, at: np.ndarray, distance: np.ndarray) -> list[tuple[int, int, int]]:
        """Distinct stretches of the seeds that are long enough, smallest distances first."""
        start, end = self.stretches(at, distance)
        enough = np.flatnonzero(end - start >= np.maximum(TIMES * distance, LEAST))
        rows = np.unique(np.stack((distance[enough], start[enough], end[enough], at[enough]), axis=1), axis=0)
        out, sound = [], None
        for d, s, e, a in rows.tolist():
            if (d, s, e) == sound:
                continue
            if s <= a and np.array_equal(self.codes[s : e - d], self.codes[s + d : e]):
                sound = (d, s, e)
            else:  # hashes deceived
                s, e = self.walked(a, d)
            if e - s >= max(TIMES * d, LEAST):
                out.append((s, e, d))
        return out


class Covers:
    """Runs found at smaller scales; a seed inside one at a multiple of its period tells nothing new."""

    def __init__(self):
        self.new: list[tuple[int, int, int]] = []
        self.by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        self.new.append((period, start, end))

    def settle(self) -> None:
        fresh: dict[int, list] = {}
        for period, start, end in self.new:
            fresh.setdefault(period, []).append((start, end))
        for period, spans in fresh.items():
            rows = np.array(sorted(spans), dtype=np.int64)
            self.by_period[period] = rows[:, 0], rows[:, 1]  # runs of one period share less than a period
        self.new = []

    def hold(self, start: np.ndarray, end: np.ndarray, distance: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), dtype=bool)
        for period, (lo, hi) in self.by_period.items():
            open_ = np.flatnonzero(~out & (distance % period == 0))
            i = np.searchsorted(lo, start[open_], "right") - 1
            out[open_] = (i >= 0) & (hi[np.maximum(i, 0)] >= end[open_])
        return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that no run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def find_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words."""
    coded = []
    for words in texts:
        seen: dict = {}
        coded.append([seen.setdefault(w, len(seen) + 1) for w in words])  # 0 stands between texts
    return Portion(coded).runs()


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(batches: Iterator[pa.RecordBatch], text_col: str, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(text_col).to_pylist()]
        runs: list[list[tuple[int, int, int]]] = []
        portion: list[list[bytes]] = []
        held = 0
        for w in words:
            if portion and held + len(w) > PORTION:
                runs += find_runs(portion)
                portion, held = [], 0
            portion.append(w)
            held += len(w)
        runs += find_runs(portion)
        texts = []
        for w, r in zip(words, runs):
            texts.append((b" ".join([w[i] for i in kept_words(len(w), r).tolist()]) if r else b" ".join(w)).decode("utf-8", "surrogatepass"))
        as_rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        made = dict(zip(names, (pa.array([len(w) for w in words], pa.int64()), pa.array(as_rows, RUNS), pa.array(texts, pa.string()))))
        rest = [c for c in batch.schema.names if c not in made and c != text_col]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made.values()], names=[*rest, *made])


def collapse_runs(docs: DataFrame, text_col: str = "text", n_words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` without the text, with its number of words, its runs ``(start, length, period)`` and the text cut down to one period of each."""
    names = (n_words, runs, collapsed)
    rest = [f for f in docs.schema.fields if f.name not in names and f.name != text_col]
    listed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    schema = f"{listed}`{n_words}` long, `{runs}` array<struct<start: long, length: long, period: long>>, `{collapsed}` string"
    return docs.mapInArrow(partial(_collapsed, text_col=text_col, names=names), schema)


def longest_run(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
