"""Token ids in patched frame-of-reference blocks, written and read by Spark.

Documents are sorted by id over range partitions and encoded there; each partition packs its ids into
pages of whole documents.  A page cuts its ids into blocks of ``BLOCK``; a block subtracts its minimum,
packs the rest at the width that holds ``percentile`` of its values and keeps the larger ones in an
exception list.  The page starts with the index of its block starts, so any block is read alone.

A page is one row of a Parquet table (``part``, ``page``, ``before`` ids of the part ahead of it,
``doc_ids``, ``lengths``, ``data``): Spark's writer makes it atomic and independent of lost executors,
and the table lies wherever Spark can write.  Global starts need one count per partition only.

Encoding: white space separates pre-tokens of the tokenizer, so the ids of a text are those of its
chunks between white space in order; each worker keeps the ids of chunks it has met (bounded) and
passes new ones to the tokenizers library.

Defined results: null and empty texts hold the end id alone; rows with equal ids follow in order of
their text hash; null ids come first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"PFR1"
BLOCK = 512
PAGE_IDS = 1 << 18
#: Separators of str.split() that are not white space to the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
PLAIN_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def pack(values: np.ndarray, percentile: float = 95.0) -> bytes:
    """Page bytes of an array of unsigned 32-bit ids: magic, counts, block starts, blocks."""
    n = len(values)
    blocks = -(-n // BLOCK)
    full = np.full(blocks * BLOCK, values[-1] if n else 0, dtype=np.uint32)
    full[:n] = values
    rows = full.reshape(blocks, BLOCK)
    least = rows.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = rows - least[:, None] if blocks else rows
    kth = min(BLOCK - 1, int(BLOCK * percentile / 100))
    level = np.partition(rest, kth, axis=1)[:, kth] if blocks else np.empty(0, np.uint32)
    width = np.ceil(np.log2(level.astype(np.float64) + 1)).astype(np.int64)
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        group = rest[at]
        high = (group >> np.uint32(w)) if w < 32 else np.zeros_like(group)
        bits = ((group[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
        odd_block, odd_at = np.nonzero(high)
        cuts = np.searchsorted(odd_block, np.arange(len(at) + 1))
        places, tops = odd_at.astype("<u2"), high[odd_block, odd_at].astype("<u4")
        for i, b in enumerate(at.tolist()):
            lo, hi = cuts[i], cuts[i + 1]
            head = struct.pack("<IBH", int(least[b]), w, int(hi - lo))
            parts[b] = head + packed[i].tobytes() + places[lo:hi].tobytes() + tops[lo:hi].tobytes()
    starts = np.zeros(blocks + 1, dtype="<u4")
    starts[1:] = np.cumsum([len(p) for p in parts]) if blocks else []
    return MAGIC + struct.pack("<II", n, blocks) + starts.tobytes() + b"".join(parts)


def unpack_blocks(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` up to ``last`` of a page, found through its index."""
    if data[:4] != MAGIC:
        raise ValueError("not a page of token blocks")
    n, blocks = struct.unpack_from("<II", data, 4)
    last = blocks if last is None else min(last, blocks)
    starts = np.frombuffer(data, "<u4", blocks + 1, 12).astype(np.int64) + 12 + 4 * (blocks + 1)
    out = np.zeros((max(0, last - first), BLOCK), dtype=np.uint32)
    heads = [struct.unpack_from("<IBH", data, starts[b]) for b in range(first, last)]
    by_width: dict[int, list[int]] = {}
    for i, (_, w, _) in enumerate(heads):
        by_width.setdefault(w, []).append(i)
    for w, at in by_width.items():
        size = BLOCK * w // 8
        packed = np.frombuffer(b"".join(data[starts[first + i] + 7 : starts[first + i] + 7 + size] for i in at), np.uint8)
        bits = np.unpackbits(packed.reshape(len(at), size), axis=1, bitorder="little").reshape(len(at), BLOCK, w)
        wide = np.zeros((len(at), BLOCK, 32), dtype=np.uint8)
        wide[:, :, :w] = bits
        out[at] = np.packbits(wide.reshape(len(at), -1), axis=1, bitorder="little").view("<u4")
    for i, (least, w, odd) in enumerate(heads):
        if odd:
            at = int(starts[first + i]) + 7 + BLOCK * w // 8
            places = np.frombuffer(data, "<u2", odd, at)
            out[i, places] |= np.frombuffer(data, "<u4", odd, at + 2 * odd) << np.uint32(w)
        out[i] += np.uint32(least)
    return out.reshape(-1)[: n - first * BLOCK]


class ChunkEncoder:
    """Ids of texts through the tokenizers library, with a bounded memory of chunks.

    Chunks of plain Latin letters (perhaps before one mark) skip the library's normaliser and splitter,
    which would leave their lower case as it is, and go to its BPE model directly.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The stand-in character of every byte, as the library's byte level gives it.
        self.stand_in: dict[int, str] = {}
        for code in range(0x21, 0x250):
            shown = "".join(part for part, _ in level.pre_tokenize_str(chr(code)))
            self.stand_in.update(zip(chr(code).encode(), shown))
        self.marks = {m: self._whole(m) for m in ".,"}
        self.known: dict[str, bytes] = {}

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunk: str) -> bytes:
        stem, end = (chunk[:-1], self.marks[chunk[-1]]) if chunk[-1] in self.marks else (chunk, b"")
        if not stem.isalpha():
            return self._whole(chunk)
        low = stem.lower()
        if not stem.isascii():
            if max(stem) >= "\u0250" or "\u0130" in stem:
                return self._whole(chunk)
            low = low.encode().decode("latin-1").translate(self.stand_in)
        return array("I", [t.id for t in self.model.tokenize(low)]).tobytes() + end

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        odd = any(c in text for c in ODD_SPACE)
        chunks = [c for c in PLAIN_SPACE.split(text) if c] if odd else text.split()
        known = self.known
        parts = list(map(known.get, chunks))
        if None in parts:
            if len(known) > self.most:
                known.clear()
            for i, part in enumerate(parts):
                if part is None:
                    chunk = chunks[i]
                    parts[i] = known[chunk] = known.get(chunk) or self._learn(chunk)
        return np.frombuffer(b"".join(parts), dtype="<u4")


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _pages(batches: Iterator[pd.DataFrame], path: str, end_id: int, percentile: float) -> Iterator[pd.DataFrame]:
    encode, part = encoder(path), TaskContext.get().partitionId()
    end, page, before = np.array([end_id], dtype="<u4"), 0, 0
    ids: list[np.ndarray] = []
    docs: list = []
    lengths: list[int] = []

    def flush() -> pd.DataFrame:
        nonlocal page, before
        row = {"part": part, "page": page, "before": before, "n_ids": sum(lengths), "doc_ids": list(docs), "lengths": list(lengths)}
        row["data"] = pack(np.concatenate(ids), percentile)
        page, before = page + 1, before + row["n_ids"]
        ids.clear(), docs.clear(), lengths.clear()
        return pd.DataFrame([row])

    held = 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            own = encode(text)
            ids += [own, end]
            docs.append(None if doc_id is None else int(doc_id))
            lengths.append(len(own) + 1)
            held += len(own) + 1
            if held >= PAGE_IDS:
                yield flush()
                held = 0
    if docs:
        yield flush()


PAGE_SCHEMA = "part int, page int, before long, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def write_tokens(
    docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", percentile: float = 95.0
) -> None:
    """Encode all texts and write the pages in ascending order of the id below ``out``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # beside a null, pandas would read long ids as floats
    ordered.mapInPandas(partial(_pages, path=tokenizer, end_id=end_id, percentile=percentile), PAGE_SCHEMA).write.parquet(out)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids = unpack_blocks(row.data).astype("<u4")
            ends = np.cumsum(np.asarray(row.lengths, dtype=np.int64))
            starts = ends - np.asarray(row.lengths, dtype=np.int64)
            raw = memoryview(ids).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            doc_ids = pd.array([None if x is None else int(x) for x in row.doc_ids], dtype="Int64")
            yield pd.DataFrame({"doc_id": doc_ids, "start": starts + row.before + row.ahead, "n_tokens": ends - starts, "ids_crc32": sums})


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the pages."""
    pages = spark.read.schema(PAGE_SCHEMA).parquet(path)
    totals = pages.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each partition written
    ahead = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    rows = pages.join(F.broadcast(ahead), "part").select("before", "ahead", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "lengths", "data")
    return rows.mapInPandas(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
