"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Lexicon voters are mined from a bounded sample of labelled training texts: words and word starts
   that occur in toxic texts far above chance.  A fixed list and patterns vote beside them.
2. Every document of the corpus votes once; only counts of vote patterns (at most 2^voters) and the
   known training labels of each reach the driver.  Expectation maximisation estimates how often each
   voter fires in either class; the correlation of voters within a class lowers the weight of those
   that repeat each other.
3. A logistic classifier over the mined features and one feature per fixed voter is fitted to the
   posterior labels of a bounded sample and scores whole texts.

Labels come only from training rows; language, source and id are never inputs.

Defined results: null and empty texts have no features and get the score of the bias; repeated rows
score alike; a document with several labels counts as toxic if one says so; without labelled training
rows of both classes the fixed list and the patterns vote alone: the classifier is fitted to the
posteriors of a bounded sample of all documents, of which at most half count as toxic; where no
document is left to learn from, scores stand at ``UNKNOWN``; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
STARTS = (4, 5, 6, 7)
#: A fixed public list of insults.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "clowns",
    "imbecile", "dumb", "dumbass", "jerk", "bastard", "bitch", "asshole", "crap", "fool", "filth", "vermin", "retard", "freak", "pig", "garbage",
)
INSULT_SET = frozenset(INSULTS)
#: Features of the classifier for the fixed voters, in their order.
FIXED = ("#insult", "#address", "#shout", "#runs", "#masked")
#: Share of toxic texts where no label tells it.
UNKNOWN = 0.1
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
RUNS = re.compile(r"!{2,}|\?{2,}")
MASKED = re.compile(r"\b\w+[*@#$]+\w+\b")
ADDRESS = re.compile(r"\byou(?:'re| are)?\s+(?:an?\s+|all\s+|such\s+)?(\w+)")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words, and their starts marked by a hyphen."""
    words = set(WORD.findall((text or "").lower()))
    found = set(words)
    for k in STARTS:
        found.update({w[:k] + "-" for w in words if len(w) > k})
    return found


@dataclass
class Voters:
    """Lexicon voters (sets of features) followed by the fixed ones."""

    lexicons: list[frozenset] = field(default_factory=list)
    words: frozenset = frozenset()
    starts: dict[int, frozenset] = field(default_factory=dict)

    @classmethod
    def of(cls, mined: list[str]) -> Voters:
        words = [f for f in mined if not f.endswith("-")]
        lexicons = [frozenset(words[0::2]), frozenset(words[1::2])] + [frozenset(f for f in mined if f.endswith("-") and len(f) == k + 1) for k in STARTS]
        return cls(lexicons, frozenset(words), {k: frozenset(f[:-1] for f in lexicons[2 + i]) for i, k in enumerate(STARTS)})

    @property
    def size(self) -> int:
        return len(self.lexicons) + len(FIXED)

    def hits(self, words: set[str]) -> set[str]:
        """Mined features of the lower-case words of a text."""
        found = words & self.words
        for k, known in self.starts.items():
            if known:
                found |= {s + "-" for s in {w[:k] for w in words if len(w) > k} & known}
        return found

    def votes(self, text: str | None) -> tuple[int, set[str]]:
        """Bit pattern of the voters that fire, and the features: mined ones and those of the fixed voters."""
        text = text or ""
        low = text.lower()
        words = set(WORD.findall(low))
        hits = self.hits(words)
        insults = words & INSULT_SET
        fires = [bool(hits & x) for x in self.lexicons]
        fixed = [
            bool(insults),
            any(m[1] in insults for m in ADDRESS.finditer(low)) if insults else False,
            sum(1 for _ in SHOUT.finditer(text)) * 3 > text.count(" ") + 3,
            RUNS.search(text) is not None,
            any(c in text for c in "*@#$") and MASKED.search(text) is not None,
        ]
        return sum(1 << i for i, x in enumerate(fires + fixed) if x), hits.union(f for f, x in zip(FIXED, fixed) if x)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document counts of features, summed over what a task reads so far."""
    for batch in batches:
        n: Counter = Counter()
        t: Counter = Counter()
        for text, toxic in zip(batch["text"], batch["toxic"]):
            own = features(text)
            n.update(own)
            if toxic:
                t.update(own)
        yield pd.DataFrame({"feature": list(n), "n": list(n.values()), "t": [t[f] for f in n]})


def mine(sample: DataFrame, most: int = 2000, least_gain: float = 14.0) -> list[str]:
    """Features of the labelled sample (``text, toxic``) that mark toxic texts: by log-likelihood gain over the base rate."""
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not total["t"] or total["t"] == total["n"]:
        return []
    base = total["t"] / total["n"]
    counts = sample.select("text", "toxic").mapInPandas(_count, "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    share = F.col("t") / F.col("n")
    rest = F.col("n") - F.col("t")
    gain = F.col("t") * F.log(share / base) + F.when(rest > 0, rest * F.log((rest / F.col("n")) / (1 - base))).otherwise(0.0)
    chosen = counts.filter((F.col("t") >= 4) & (share >= 0.6)).withColumn("gain", gain).filter(F.col("gain") >= least_gain)
    return [r["feature"] for r in chosen.orderBy(F.desc("gain"), "feature").limit(most).collect()]


@dataclass
class LabelModel:
    """Class prior, fire rates of each voter by class, and weights that discount repetition."""

    prior: float
    rates: np.ndarray
    weights: np.ndarray
    correlation: np.ndarray

    def posterior(self, patterns: np.ndarray, gold: np.ndarray | None = None, trust: float = 4.0) -> np.ndarray:
        """Probability of the toxic class; a known label counts as one more voter of log odds ``trust``."""
        fires = (patterns[:, None] >> np.arange(self.rates.shape[1])) & 1
        gain = np.where(fires == 1, np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0])))
        told = 0.0 if gold is None else np.where(gold == 1, trust, np.where(gold == 0, -trust, 0.0))
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + gain @ self.weights + told, -40, 40)))


def fit_label_model(patterns: np.ndarray, gold: np.ndarray, counts: np.ndarray, voters: int, rounds: int = 30, discount: bool = True) -> LabelModel:
    """EM over counted vote patterns; ``gold`` is 0 or 1 where the label is known, else -1.

    With few voters and no labels the discount leaves too little to tell the classes apart; then voters count in full.
    """
    fires = ((patterns[:, None] >> np.arange(voters)) & 1).astype(float)
    counts = counts.astype(float)
    known = gold >= 0
    both = (gold == 0).any() and (gold == 1).any()
    prior = float(np.clip((counts * (gold == 1)).sum() / max(1.0, (counts * known).sum()), 0.01, 0.5)) if both else UNKNOWN
    model = LabelModel(prior, np.stack([np.full(voters, 0.05), np.full(voters, 0.5)]), np.ones(voters), np.eye(voters))
    y = np.where(known, gold == 1, model.posterior(patterns)).astype(float)
    for _ in range(rounds if counts.sum() else 0):
        mass = np.stack([counts * (1 - y), counts * y])
        rates = (mass @ fires + np.array([[0.5], [0.5]])) / (mass.sum(axis=1, keepdims=True) + 1.0)
        # Correlation of voters inside the classes; a voter that moves with others counts less.
        cov = np.zeros((voters, voters))
        for c in (0, 1):
            off = fires - rates[c]
            cov += (off * mass[c][:, None]).T @ off
        scale = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        corr = np.clip(cov / scale / scale[:, None], -1, 1)
        weights = 1 / np.clip(np.abs(corr).sum(axis=0), 1, None) if discount else np.ones(voters)
        prior = float(np.clip(mass[1].sum() / mass.sum(), 1e-4, 1 - 1e-4 if both else 0.5))
        model = LabelModel(prior, np.clip(rates, 1e-4, 1 - 1e-4), weights, corr)
        y = np.where(known, gold == 1, model.posterior(patterns)).astype(float)
    return model


def _vote(batches: Iterator[pd.DataFrame], voters: Voters, lists: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        votes = [voters.votes(t) for t in batch["text"]]
        out = {"pattern": [v for v, _ in votes], "gold": batch["gold"]}
        yield pd.DataFrame(out | {"hits": [sorted(h) for _, h in votes]} if lists else out)


@dataclass
class Classifier:
    voters: Voters
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(self.voters.votes(text)[1]))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit_classifier(rows: list[tuple[list[str], float]], voters: Voters, rounds: int = 2000, rate: float = 1.0, keep: float = 1e-3) -> Classifier:
    """Logistic regression on soft labels by Adagrad; features are present or not.  Without rows every text scores ``UNKNOWN``."""
    if not rows:
        return Classifier(voters, {}, float(np.log(UNKNOWN / (1 - UNKNOWN))))
    index = {f: i for i, f in enumerate(sorted({f for hits, _ in rows for f in hits}))}
    owner = np.array([r for r, (hits, _) in enumerate(rows) for _ in hits], dtype=np.int64)
    col = np.array([index[f] for hits, _ in rows for f in hits], dtype=np.int64)
    y = np.array([p for _, p in rows])
    w, b, n = np.zeros(len(index)), 0.0, max(1, len(rows))
    qw, qb = np.full(len(index), 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(owner, weights=w[col], minlength=len(rows))
        rest = y - 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        gw = np.bincount(col, weights=rest[owner], minlength=len(index)) / n - keep * w / max(1, len(index))
        gb = rest.sum() / n
        qw, qb = qw + gw**2, qb + gb**2
        w, b = w + rate * gw / np.sqrt(qw), b + rate * gb / np.sqrt(qb)
    return Classifier(voters, {f: float(w[i]) for f, i in index.items()}, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000) -> Classifier:
    """Mine, vote, fit.  ``labels`` has the ids and ``toxic`` of training rows only.

    ``sample`` bounds the texts used for mining and for the classifier, those with the smallest hashes
    of their ids; votes and the label model cover every document.  Where these labels are not of both
    classes, the classifier takes as many distinct texts of all documents, by their own hashes.
    """
    gold = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("gold"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = F.broadcast(gold.orderBy(F.xxhash64("id"), "id").limit(sample))
    labelled = own.join(chosen, "id")
    voters = Voters.of(mine(labelled.select("text", F.col("gold").alias("toxic"))))
    # Votes of all documents first, then the labels: only narrow rows are shuffled.
    pairs = own.select("text", F.col("id").alias("gold")).mapInPandas(partial(_vote, voters=voters, lists=False), f"pattern long, gold {own.schema['id'].dataType.simpleString()}")
    told = pairs.withColumnRenamed("gold", "id").join(gold, "id", "left").groupBy("pattern", F.coalesce("gold", F.lit(-1)).alias("gold")).count().collect()
    told.sort()
    rows = labelled.select("text", "gold").mapInPandas(partial(_vote, voters=voters, lists=True), "pattern long, gold int, hits array<string>").collect()
    both = len({r["gold"] for r in rows}) == 2
    patterns, golds, counts = (np.array([r[i] for r in told], dtype=np.int64) for i in range(3))
    golds = golds if both else np.full(len(golds), -1)
    model = fit_label_model(patterns, golds, counts, voters.size, discount=both)
    if not both:
        hashed = own.select("text", F.xxhash64("text").alias("th"), F.lit(-1).alias("gold"))
        chosen = F.broadcast(hashed.select("th").distinct().orderBy("th").limit(sample))
        texts = hashed.join(chosen, "th").dropDuplicates(["th"]).select("text", "gold")
        rows = texts.mapInPandas(partial(_vote, voters=voters, lists=True), "pattern long, gold int, hits array<string>").collect()
    rows = sorted((list(r["hits"]), int(r["pattern"]), int(r["gold"])) for r in rows)
    soft = model.posterior(np.array([p for _, p, _ in rows], dtype=np.int64), np.array([g for *_, g in rows])) if rows else []
    return fit_classifier([(h, float(p)) for (h, *_), p in zip(rows, soft)], voters)


def score(text: Column, model: Classifier) -> Column:
    @F.pandas_udf("double")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype=float)

    return udf(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_on_labels(docs: DataFrame, labels: DataFrame, **settings) -> Classifier:
    """Train on the labels whose id is not held out."""
    return train(docs, labels.filter(~held_out(F.col("doc_id"))), **settings)
