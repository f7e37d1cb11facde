"""Token counts by section: each document is encoded once and its tokens are dealt to sections.

Token spans follow from the byte lengths of the ids.  They are joined to the sorted section starts by
binary search inside the row, so nothing is encoded twice and nothing is shuffled.  A token that
crosses a boundary goes by an explicit rule:

* ``majority``: to the section that holds most of its bytes, the earlier one if equal;
* ``start``: to the section of its first byte.

Sections are the lines of a text, each with its line break; a text is covered by its sections without
gaps, so the counts of a document add up to the tokens of the whole text.

Defined results: a null or empty text has one empty section without tokens; repeated rows are counted
alike, each in its own rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENCODINGS: dict[str, tuple] = {}


def encoding(path: str, pattern: str):
    """Encoding of a rank file and the byte length of each id; one for each Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, i in ranks.items():
            lengths[i] = len(piece)
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _ENCODINGS[path]


def line_starts(raw: bytes) -> np.ndarray:
    """Byte at which each line starts."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate(([0], breaks[breaks < len(raw)])).astype(np.int64)


def deal(token_ends: np.ndarray, starts: np.ndarray, size: int, rule: str = "majority") -> np.ndarray:
    """Tokens of each section, from the byte ends of consecutive tokens and the sorted section starts."""
    if not len(token_ends):
        return np.zeros(len(starts), dtype=np.int64)
    token_starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(starts, token_starts, "right") - 1
    if rule == "majority":
        last = np.searchsorted(starts, token_ends - 1, "right") - 1
        ends = np.append(starts[1:], size)
        for t in np.flatnonzero(first != last).tolist():
            s = np.arange(first[t], last[t] + 1)
            shared = np.minimum(ends[s], token_ends[t]) - np.maximum(starts[s], token_starts[t])
            first[t] = s[int(np.argmax(shared))]
    elif rule != "start":
        raise ValueError(f"unknown rule: {rule}")
    return np.bincount(first, minlength=len(starts))


def _sections(batches: Iterator[pd.DataFrame], path: str, pattern: str, rule: str) -> Iterator[pd.DataFrame]:
    enc, lengths = encoding(path, pattern)
    for batch in batches:
        for lo in range(0, len(batch), 256):
            cols: dict[str, list] = {"doc_id": [], "section": [], "start": [], "end": [], "n_tokens": []}
            for doc_id, text in zip(batch["doc_id"].iloc[lo : lo + 256], batch["text"].iloc[lo : lo + 256]):
                raw = (text or "").encode()
                starts = line_starts(raw)
                ids = np.asarray(enc.encode_ordinary(text or ""), dtype=np.int64)
                counts = deal(np.cumsum(lengths[ids]), starts, len(raw), rule)
                # Characters before each byte boundary.
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                bounds = chars[np.append(starts, len(raw))]
                cols["doc_id"] += [doc_id] * len(starts)
                cols["section"] += range(len(starts))
                cols["start"] += bounds[:-1].tolist()
                cols["end"] += bounds[1:].tolist()
                cols["n_tokens"] += counts.tolist()
            yield pd.DataFrame(cols)


def count_by_section(docs: DataFrame, ranks: str, pattern: str, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per line of each text: doc_id, section, start and end (characters), n_tokens."""
    # Ids travel as text: beside a null, pandas would read long ones as floats.
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    run = partial(_sections, path=ranks, pattern=pattern, rule=rule)
    found = own.mapInPandas(run, "doc_id string, section int, start long, end long, n_tokens long")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
