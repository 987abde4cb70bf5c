"""A quality classifier of sparse rules.

Boosted trees are grown over statistics of the texts; each path from a root is a conjunctive rule; a logistic model
with an L1 penalty gives each rule a weight, most of them 0. The rules that are left become one Spark column
expression, so scoring runs in the JVM without a model object.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let
from .labelled import MAX_TRAIN_ROWS, crc_mod, training_ids

STATISTICS = ("log_words", "chars_per_word", "symbols_per_word", "distinct_words", "distinct_trigrams", "digits", "marks_per_word", "capitals", "words_per_line", "repeated_lines", "long_words")
TREES, DEPTH, BINS, RATE, PENALTY = 40, 3, 24, 0.2, 0.002


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text; ratios with nothing to divide by are 0, so a null or empty text has zeros."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        trigrams = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))
        return F.struct(
            n.cast("double").alias("n"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x)).cast("double").alias("chars"),
            F.size(F.array_distinct(w)).cast("double").alias("distinct"),
            F.size(F.array_distinct(trigrams)).cast("double").alias("trigrams"),
            F.size(F.filter(w, lambda x: F.char_length(x) > 11)).cast("double").alias("long"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("distinct"))

    without = lambda p: (F.char_length(t) - F.char_length(F.regexp_replace(t, p, ""))).cast("double")
    ratio = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1.0))).otherwise(F.lit(0.0))

    def all_of(s: Column) -> Column:
        w, x = s["w"], s["l"]
        parts = (
            F.log1p(w["n"]), ratio(w["chars"], w["n"]), ratio(s["symbols"], w["n"]), ratio(w["distinct"], w["n"]), ratio(w["trigrams"], w["n"] - 2), ratio(s["digits"], w["chars"]),
            ratio(s["marks"], w["n"]), ratio(s["capitals"], w["n"]), ratio(w["n"], x["n"]), ratio(x["n"] - x["distinct"], x["n"]), ratio(w["long"], w["n"]),
        )
        return F.struct(*(p.alias(n) for p, n in zip(parts, STATISTICS, strict=True)))

    words = F.filter(F.split(t, rf"[{SPACE}]+"), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    raw = F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), without(r"[#*$%&|<>]+").alias("symbols"), without(r"[0-9]+").alias("digits"), without(r"[.,;:!?]+").alias("marks"), without(r"[A-Z]+").alias("capitals"))
    return let(raw, all_of)


@dataclass(frozen=True)
class Rule:
    """All of conditions (statistic, is above, threshold) hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, k] > t) == above for k, above, t in self.conditions])

    def column(self, stats: Column) -> Column:
        parts = [stats[STATISTICS[k]] > F.lit(t) if above else stats[STATISTICS[k]] <= F.lit(t) for k, above, t in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        """The score as a Spark column over a struct of statistics."""
        z = F.lit(self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: np.ndarray, rules: set) -> None:
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 40:
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            gs, hs = (np.bincount(binned[rows, k], v[rows], len(c) + 1).cumsum()[:-1] for v in (grad, hess))
            ns = np.bincount(binned[rows, k], minlength=len(c) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < 20) | (len(rows) - ns < 20)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, at)
    if best[1] is None:
        out[rows] += RATE * g / (h + 1)
        return
    _, k, at = best
    for above in (False, True):
        here = rows[(binned[rows, k] > at) == above]
        p = (*path, (k, above, float(cuts[k][at])))
        rules.add(tuple(sorted(set(p))))
        _grow(binned, cuts, grad, hess, here, p, depth - 1, out, rules)


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A rule model of the statistics x and labels y (0 or 1); with one kind of label, or none, its share for any text."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return RuleModel(base, (), ())
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    z, paths = np.full(len(y), base), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        _grow(binned, cuts, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH, z, paths)
    rules = [Rule(p) for p in sorted(paths)]
    r = np.stack([q.holds(x) for q in rules], axis=1).astype(np.float32)
    keep = (r.mean(axis=0) > 0) & (r.mean(axis=0) < 1)
    r, rules = r[:, keep], [q for q, k in zip(rules, keep, strict=True) if k]
    w, b = _lasso(r, y.astype(np.float32), base)
    chosen = [(q, float(v)) for q, v in zip(rules, w, strict=True) if v]
    return RuleModel(b, tuple(q for q, _ in chosen), tuple(v for _, v in chosen))


def _lasso(r: np.ndarray, y: np.ndarray, base: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model with an L1 penalty on centred rules, by accelerated proximal gradient."""
    mean = r.mean(axis=0)
    v = np.random.default_rng(0).normal(size=r.shape[1]).astype(np.float32)
    for _ in range(12):  # the largest singular value bounds the curvature
        v = r.T @ (r @ v - mean @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / max(float(v @ (r.T @ (r @ v - mean @ v))), 1e-9)
    w, last, b, t = np.zeros(r.shape[1], np.float32), np.zeros(r.shape[1], np.float32), base, 1.0
    for _ in range(steps):
        u = (1 + 4 * t * t) ** 0.5 / 2 + 0.5
        at = w + (t - 1) / u * (w - last)
        gap = 1 / (1 + np.exp(-(r @ at - mean @ at + b))) - y
        last, t = w, u
        w = at - step * ((r.T @ gap) - mean * gap.sum()) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        b -= 4 * float(gap.mean())
    return w, float(b - mean @ w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS, keep=None) -> RuleModel:
    """A model of labels(doc_id, quality), fitted on about max_rows labelled documents for which keep holds (all by default)."""
    ids = training_ids(labels, "quality", F.lit(True) if keep is None else keep, max_rows)
    sample = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(ids, "id").select("id", "y", statistics(F.col("text")).alias("s"))
    rows = sample.select("y", *(F.col(f"s.{n}") for n in STATISTICS)).orderBy("id").toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the statistics of each row of docs.

    Null and empty texts have statistics of zero and a score like any other; texts of any length are measured whole, and equal
    texts have equal scores. Rows are scored one by one: repeated rows
    repeat, a null id stays null; other columns are ignored; no rows give no rows.
    """
    s = docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("s"))
    return s.select("doc_id", let(F.col("s"), model.column).alias("score"), "s")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, by rules fitted on labels whose crc32 modulo 5 isn't 0."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, keep=crc_mod("doc_id", 5) != 0)
    s = scored(docs, model)
    return s.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
