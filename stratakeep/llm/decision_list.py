"""Quality rules as a learned decision list (operator 4): sequential covering over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakeep.llm.statistics import BASE, FEATURES, labelled_sample, statistics, training_rows


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Thresholds half-way between neighbouring quantiles."""
    v = np.unique(np.quantile(values, np.linspace(0, 1, most + 1)))
    return (v[1:] + v[:-1]) / 2


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """FOIL's gain: bits saved on the rejected rows that stay covered."""
    return bad * (np.log2(bad / (bad + good)) - np.log2(bad0 / (bad0 + good0))) if bad else 0.0


def _grow(x: dict[str, np.ndarray], y: np.ndarray, longest: int) -> Rule:
    rule, inside = (), np.ones(len(y), bool)
    while len(rule) < longest:
        bad0, good0 = int(y[inside].sum()), int((~y[inside]).sum())
        if not good0 or not bad0:
            break
        best = (1e-9, None)
        for name in FEATURES:
            v, w = x[name][inside], y[inside]
            order = np.argsort(v, kind="stable")
            v, bad = v[order], np.r_[0, np.cumsum(w[order])]
            for cut in _cuts(v):
                k = int(np.searchsorted(v, cut, "right"))
                for above, b, n in ((False, int(bad[k]), k), (True, int(bad[-1] - bad[k]), len(v) - k)):
                    if (g := _gain(b, n - b, bad0, good0)) > best[0]:
                        best = (g, Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> float:
    """RIPPER's pruning measure on rows that the rule wasn't grown on."""
    inside = covered(rule, x)
    n = int(inside.sum())
    return (2 * int(y[inside].sum()) - n) / n if n else -1.0


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, x, y), default=())


def learn(x: dict[str, np.ndarray], reject: np.ndarray, most_rules: int = 12, longest: int = 4, precision: float = 0.9) -> list[Rule]:
    """An ordered list of rules that reject; what none covers is kept.

    Each round grows a conjunction on two thirds of the rows not yet covered, prunes it on the
    rest, and takes it if, there, at least `precision` of what it covers is to be rejected.
    """
    rules, left, third = [], np.ones(len(reject), bool), np.random.default_rng(17).random(len(reject)) < 1 / 3
    take = lambda rows: ({k: v[rows] for k, v in x.items()}, reject[rows])
    while len(rules) < most_rules and reject[left & ~third].any():
        rule = _prune(_grow(*take(left & ~third), longest), *take(left & third))
        inside = covered(rule, x) & left
        judged = reject[inside & third]
        if not rule or not len(judged) or judged.mean() < precision:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one Spark expression: the first rule that holds rejects, none keeps."""
    out = F.lit(True)
    for rule in reversed(rules):
        conjunction = rule[0].column()
        for c in rule[1:]:
            conjunction &= c.column()
        out = F.when(conjunction, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> list[Rule]:
    """Rules learned from the quality labels of at most `most` documents (their statistics only)."""
    x, label = training_rows(labelled_sample(docs, labels, "quality", most))
    return learn(x, label == 0)


def quality_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, the base statistics, base_failed, kept), one row for each row of docs.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. kept: the
    verdict of the rules for texts that pass the base. Null, empty and wordless texts fail it.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs).select("doc_id", *BASE, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
