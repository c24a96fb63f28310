"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration (operator 5).

Two lexicons feed the features: a short fixed one, and terms learned from the training labels
(words and word beginnings, so that inflected forms count).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakeep.llm.additive_model import sigmoid
from stratakeep.llm.statistics import labelled_sample
from stratakeep.llm.store import materialise
from stratakeep.llm.words import chunks

#: Insults that count without any labels.
INSULTS = frozenset("idiot moron stupid loser trash scum pathetic worthless disgusting clown".split())
#: Second-person pronouns of the four languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine tu te toi ton ta tes vous votre vos tú usted ustedes vosotros".split())
#: Look-alikes used to hide words.
LOOK_ALIKES = str.maketrans("013457@$", "oieastas")
STEMS = (4, 5, 6, 7, 8)
NEAR = 4
FEATURES = (
    "insult_density", "insult_count", "learned_density", "learned_count", "stem_density", "stem_count", "hidden_count",
    "near_second_person", "capital_share", "exclamation_rate", "mark_rate", "obfuscation_rate", "log_words",
)

_WORD = re.compile(r"[^\W_]+(?:[@$*.\-]?[^\W_]+)*")
_MIXED = re.compile(r"[^\W\d_][\d@$*]+[^\W\d_]")
_SPACED = re.compile(r"(?<!\w)[^\W\d_]([.\-*_ ])[^\W\d_](?:\1[^\W\d_]){2,}(?!\w)")


@dataclass(frozen=True)
class Lexicon:
    """Learned terms: whole words, and beginnings of words."""

    words: frozenset[str] = field(default_factory=frozenset)
    stems: frozenset[str] = field(default_factory=frozenset)
    heads: frozenset[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "heads", frozenset(s[: STEMS[0]] for s in self.stems))

    def begins(self, word: str) -> bool:
        """Whether a learned beginning goes on in this word."""
        return word[: STEMS[0]] in self.heads and any(word[:k] in self.stems for k in STEMS if len(word) > k)


def _terms(text: str | None) -> set[str]:
    """The distinct words of a text, and what longer words begin with, marked with an asterisk."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def _term_counts(batches):
    """Of each batch, in how many toxic and other documents each term is."""
    for batch in chunks(batches, "text"):
        toxic, other = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else other).update(_terms(text))
        terms = list(toxic | other)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([other[t] for t in terms], pa.int64())], ["term", "toxic", "other"])


def learn_lexicon(sample: DataFrame, support: int = 6, precision: float = 0.9, evidence: float = 14.0, most: int = 2_000) -> Lexicon:
    """Terms in at least `support` toxic documents of the sample, of which `precision` of all with it are toxic.

    As there are many terms, some fit by chance: a term's counts must also be e**evidence times
    likelier at its own rate than at the sample's. Counted by Spark; the `most` of highest support
    come to the driver.
    """
    base = sample.agg(F.avg("label").alias("rate")).first().rate
    if not base or base == 1:
        return Lexicon()
    counts = sample.select("text", "label").mapInArrow(_term_counts, "term string, toxic long, other long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    chosen = counts.where((F.col("toxic") >= support) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("other"))))
    rate = F.col("toxic") / (F.col("toxic") + F.col("other"))
    gain = F.col("toxic") * F.log(rate / base) + F.when(F.col("other") > 0, F.col("other") * F.log((1 - rate) / (1 - base))).otherwise(0)
    terms = [r.term for r in chosen.where(gain >= evidence).orderBy(F.desc("toxic"), "term").limit(most).collect()]
    return Lexicon(frozenset(t for t in terms if t[-1] != "*"), frozenset(t[:-1] for t in terms if t[-1] == "*"))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES; all 0 for null and empty texts."""
    text = text or ""
    raw = _WORD.findall(text)
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    lower = [w.lower() for w in raw]
    insult = [i for i, w in enumerate(lower) if w in INSULTS]
    learned = [i for i, w in enumerate(lower) if w in lexicon.words]
    heads = lexicon.heads
    by_stem = [i for i, w in enumerate(lower) if w[:4] in heads and lexicon.begins(w)]
    known = INSULTS | lexicon.words
    odd = [w for w in lower if _MIXED.search(w)]
    plain = [re.sub(r"[*.\-]", "", w.translate(LOOK_ALIKES)) for w in odd]
    spaced = [re.sub(r"[^\w]|_", "", m[0]).lower() for m in _SPACED.finditer(text)]
    hidden = sum(w in known for w in plain) + sum(w in known for w in spaced)
    hits = sorted({*insult, *learned, *by_stem})
    near = sum(any(w in SECOND_PERSON for w in lower[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    letters = sum(map(len, raw))
    capitals = sum(w.isupper() and len(w) > 1 for w in raw)
    marks = sum(text.count(c) for c in "!?.,;:")
    return [
        1000 * len(insult) / n, len(insult), 1000 * len(learned) / n, len(learned), 1000 * len(by_stem) / n, len(by_stem), hidden,
        near, capitals / n, 100 * text.count("!") / max(1, letters), 100 * marks / max(1, letters), 100 * (len(odd) + len(spaced)) / n, float(np.log1p(n)),
    ]


def _features(lexicon: Lexicon):
    def run(batches):
        for batch in chunks(batches, "text"):
            rows = np.array([features(t, lexicon) for t in batch.column(0).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c) for c in rows.T)], [*batch.schema.names[1:], *FEATURES])

    return run


@dataclass
class Tree:
    """A binary tree in arrays; the children of node k are 2k + 1 and 2k + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            right = x[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, depth: int, ridge: float, least: float) -> Tree:
    """One regression tree by histograms of gradients g and weights h."""
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
    where = {0: np.arange(len(x))}
    for node in range(size):
        rows = where.pop(node, None)
        if rows is None:
            continue
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        tree.value[node] = sum_g / (sum_h + ridge)
        if 2 * node + 2 >= size:
            continue
        best = (1e-9, -1, 0)
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            left_g = np.cumsum(np.bincount(bins[rows, f], g[rows], len(edges) + 1))[:-1]
            left_h = np.cumsum(np.bincount(bins[rows, f], h[rows], len(edges) + 1))[:-1]
            gain = left_g**2 / (left_h + ridge) + (sum_g - left_g) ** 2 / (sum_h - left_h + ridge) - sum_g**2 / (sum_h + ridge)
            gain[(left_h < least) | (sum_h - left_h < least)] = 0
            if gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] < 0:
            continue
        tree.feature[node], tree.cut[node] = best[1], cuts[best[1]][best[2]]
        right = bins[rows, best[1]] > best[2]
        where[2 * node + 1], where[2 * node + 2] = rows[~right], rows[right]
    return tree


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the steps of the non-decreasing fit of y to score (each step smoothed a little)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # least score, greatest score, sum, rows
    for s, v in zip(score[order], y[order]):
        blocks.append([s, s, float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    mid = np.array([(b[0] + b[1]) / 2 for b in blocks])
    level = np.array([(b[2] + 0.05) / (b[3] + 0.1) for b in blocks])
    return mid, np.maximum.accumulate(level)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    base: float
    trees: list[Tree]
    steps: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.base + sum((t(x) for t in self.trees), np.zeros(len(x))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability, with a trace of the raw score so that ties within a step stay ordered."""
        raw = self.raw(x)
        return 0.98 * np.interp(raw, *self.steps) + 0.02 * raw if len(self.steps[0]) else raw


def boost(x: np.ndarray, y: np.ndarray, lexicon: Lexicon, fit: np.ndarray, rounds: int = 80, rate: float = 0.15, depth: int = 3, ridge: float = 2.0, least: float = 1.0) -> ToxicityModel:
    """Trees on the rows that fit marks, calibration on the rest; without both labels, a constant."""
    n, ones = len(y), int(y.sum())
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    model = ToxicityModel(lexicon, base, [], (np.zeros(0), np.zeros(0)))
    if not 0 < y[fit].sum() < fit.sum():
        return model
    cuts = [(v[1:] + v[:-1]) / 2 for v in (np.unique(np.r_[np.quantile(c, np.linspace(0, 1, 33)), np.quantile(c[c > 0], np.linspace(0, 1, 17)) if (c > 0).any() else []]) for c in x[fit].T)]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(cuts, x[fit].T)], axis=1)
    z = np.full(int(fit.sum()), base)
    for _ in range(rounds):
        p = sigmoid(z)
        tree = _grow(x[fit], y[fit] - p, p * (1 - p), cuts, bins, depth, ridge, least)
        tree.value *= rate
        model.trees.append(tree)
        z += tree(x[fit])
    if 0 < y[~fit].sum() < (~fit).sum():
        model.steps = isotonic(model.raw(x[~fit]), y[~fit])
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, modulus: int = 3, fold: int = 1) -> ToxicityModel:
    """A model of labels.toxic from at most `most` labelled documents outside the held-out fold.

    Lexicon and trees are learned from four fifths of them, by a hash of doc_id; the isotonic
    calibration is fitted on the rest, which neither has seen. Labelled rows without a text count
    as empty ones, repeated rows of a doc_id as often as they come, and of labels that clash the
    greatest; without labels, or with one only, the score is a constant.
    """
    sample = materialise(labelled_sample(docs, labels, "toxic", most, modulus, fold), "toxic-sample")
    to_fit = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) > 0
    lexicon = learn_lexicon(sample.where(to_fit))
    schema = T.StructType([sample.schema["doc_id"], sample.schema["label"], T.StructField("to_fit", T.BooleanType()), *(T.StructField(c, T.DoubleType()) for c in FEATURES)])
    rows = sample.select("text", "doc_id", "label", to_fit.alias("to_fit")).mapInArrow(_features(lexicon), schema).toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    return boost(rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), rows["label"].to_numpy(float), lexicon, rows["to_fit"].to_numpy(bool))


def _scored(model: ToxicityModel):
    def run(batches):
        for batch in chunks(batches, "text"):
            x = np.array([features(t, model.lexicon) for t in batch.column(0).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.score(x))], [*batch.schema.names[1:], "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score), one row for each row of docs; null and empty texts have all features 0."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.select(F.col("text").cast("string").alias("text"), "doc_id").mapInArrow(_scored(model), schema)
