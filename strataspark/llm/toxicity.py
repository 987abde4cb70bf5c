"""Toxicity scores of texts whose disguised words are restored by a noisy channel.

A token that may be disguised (digits or signs for letters, letters set apart, letters repeated) is a lattice: each
character may stand for some letters, or nothing, at a cost, and a run of equal letters for one or two. The Viterbi
path under a character trigram model of all documents is the restored word. Restored words then meet a lexicon of
words and beginnings of words that toxic labelled documents have far more often than clean ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small, stored
from .labelled import MAX_TRAIN_ROWS, crc_mod, training_ids

#: Letters of the character model; all other characters are its symbol 0.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçñíóúáîïôûùœæ"
_K = len(LETTERS) + 1
_INDEX = np.zeros(0x180, np.int64)
for _k, _c in enumerate(LETTERS):
    _INDEX[ord(_c)] = _k + 1
_AT = {c: k + 1 for k, c in enumerate(LETTERS)}
#: What a character may stand for besides itself.
DISGUISES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
_SEPARATORS = set(".-_*~·'#%^=/\\ ")
_COST_DISGUISE, _COST_DROP, _COST_ONCE = 0.7, 1.0, 0.5
_EDGES = ".,;:!?\"'()[]{}<>…«»“”„‘’`"
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){3,}[^\W_](?=[.,;:!?]*(?!\S))")
_RUN = re.compile(r"([^\W\d_])\1\1")
_JUNK = re.compile(r"([^\w\s])\1+$")
_APART = re.compile(r"[^\W\d_](?:[.\-_*~·][^\W\d_]){2,}")
_HIDDEN = re.compile(r"[^\W\d_].*[0-9@$!|+€£(*].*[^\W\d_]|[^\W\d_][0-9@$!|+€£]|[0-9@$!|+€£][^\W\d_]")

#: A beginning of a word of these lengths is a feature beside the whole word.
PREFIXES = (4, 5, 6)
#: A feature is kept if it is in this many toxic documents of the sample at least, or in one in SHARE of them where that
#: is less (but two), and its likelihood ratio G2 is above what the largest of as many features reaches by chance: twice
#: the logarithm of their number and MARGIN.
MIN_TOXIC, SHARE, MARGIN = 5, 40, 4.0
#: Longer tokens are restored each time, not remembered.
REMEMBERED = 200


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams of all texts, in lower case; what comes to the driver is a row a trigram at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_K**3, np.int64)
        for batch in small(batches):
            texts = batch.column(0).to_pylist()
            for part in chunks(texts, limit=500_000):
                c = np.frombuffer("  ".join(t.lower() for t in texts[part] if t).encode("utf-32-le", "surrogatepass"), "<u4")
                if len(c) > 2:
                    x = _INDEX[np.where(c < len(_INDEX), c, 0)]
                    total += np.bincount((x[:-2] * _K + x[1:-1]) * _K + x[2:], minlength=_K**3)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_K**3, np.int64)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts.reshape(_K, _K, _K)


def char_model(counts: np.ndarray) -> np.ndarray:
    """-log p of a character after two others: trigrams, bigrams and single characters mixed."""
    c3 = counts.astype(np.float64)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + _K)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def decode(token: str, model: np.ndarray) -> str:
    """The letters that token most likely stands for, by Viterbi over its lattice; states are the last two letters."""
    low = token.lower()
    # each state has its cost and its way: (letters, way before)
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    k = 0
    while k < len(low):
        c, n = low[k], 1
        while k + n < len(low) and low[k + n] == c:
            n += 1
        k += n
        options: list[tuple[str, float]] = []
        for letter, cost in [(c, 0.0)] * (c in _AT or c.isalpha()) + [(x, _COST_DISGUISE) for x in DISGUISES.get(c, "")]:
            options.append((letter, cost if n != 2 else cost + _COST_ONCE))
            if n > 1:
                options.append((2 * letter, cost if n == 2 else cost + _COST_ONCE))
        if c in _SEPARATORS or c in DISGUISES and n > 1 or not options:
            options.append(("", _COST_DROP))
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (spent, way) in states.items():
            for letters, cost in options:
                x, y, total = a, b, spent + cost
                for letter in letters:
                    z = _AT.get(letter, 0)  # a letter outside the model stands for itself
                    total += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (letters, way) if letters else way)
        states = after
    way = min(((spent + float(model[a, b, 0]), a, b, way) for (a, b), (spent, way) in states.items()), key=lambda s: s[:3])[3]
    said = []
    while way is not None:
        letters, way = way
        said.append(letters)
    return "".join(reversed(said))


class Restored(dict):
    """Restored word of each token that was met; emptied when it is large."""

    def __init__(self, model: np.ndarray):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> str:
        word = self.restore(token)
        if len(token) <= REMEMBERED:
            if len(self) > 50_000:
                self.clear()
            self[token] = word
        return word

    def restore(self, token: str) -> str:
        if token.isalpha():
            word = token.lower()
            return decode(word, self.model) if _RUN.search(word) else word
        t = _JUNK.sub("", token.strip(_EDGES)).strip(_EDGES)
        word = t.lower()
        if t.isalpha() and not _RUN.search(word):
            return word
        if _RUN.search(word) or _APART.fullmatch(t) or _HIDDEN.search(t):
            return decode(t, self.model)
        return word

    def words(self, text: str | None) -> list[str]:
        """The words of text: its tokens restored, and what its spaced-out letters spell."""
        text = text or ""
        out = list(map(self.__getitem__, text.split()))
        out += [self[m[0].replace(" ", "-")] for m in _SPACED.finditer(text)]
        return out


def features(word: str) -> list[str]:
    """The word, and its beginnings, marked with a hyphen."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


SIGNALS = 4


@dataclass
class ToxicModel:
    chars: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    scale: tuple[float, ...] = (0.0,) * (SIGNALS + 1)  # of the intercept and the signals

    def signals(self, words: list[str], known: dict[str, float]) -> tuple[float, ...]:
        """The highest weight, the logs of the sum of weights and of their number, and of their share of the words."""
        found = [w for w in map(known.__getitem__, words) if w]
        return (max(found), math.log1p(sum(found)), math.log1p(len(found)), math.log1p(100 * len(found) / len(words))) if found else (0.0,) * SIGNALS

    def score(self, signals: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + signals @ np.array(self.scale[1:]), -30, 30)))


class _Weights(dict):
    """The highest weight of a word's features; emptied when it is large."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        best = max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
        if len(word) <= REMEMBERED:
            if len(self) > 50_000:
                self.clear()
            self[word] = best
        return best


def _counted(sample: DataFrame, chars: np.ndarray, among: frozenset[str] | None) -> DataFrame:
    """feature, n: documents of sample(text) that have it, of among where that is given; tasks count in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, restored = Counter(), Restored(chars)
        part = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])
        for batch in small(batches):
            for t in batch.column(0).to_pylist():
                own = {f for w in set(restored.words(t)) for f in features(w)}
                seen.update(own if among is None else own & among)
                if len(seen) > 100_000:
                    yield part()
                    seen.clear()
        yield part()

    return sample.select("text").mapInArrow(run, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def _g2(a, b, na: float, nb: float):
    """Column: likelihood ratio of a of na against b of nb."""
    p = (a + b) / F.lit(float(na + nb))
    part = lambda k, n, q: F.when(k > 0, k * F.log(k / (q * n))).otherwise(0.0)
    sides = lambda k, n: part(k, n, p) + part(F.lit(float(n)) - k, n, 1 - p)
    return 2 * (sides(a, na) + sides(b, nb))


def _lead(text: str | None) -> bytes:
    """The smallest hash of a text's three-word sequences; near copies mostly have the same."""
    w = (text or "").lower().split()
    return min((xxhash.xxh3_64_digest(" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), default=b"")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS, keep=None) -> ToxicModel:
    """A model of labels(doc_id, toxic): the character model of all docs, the rest from about max_rows labelled documents.

    Of labelled near copies with the same label one counts, so that their words don't pass for a lexicon. Without toxic or
    without clean labels every text scores the share of toxic labels.
    """
    chars = char_model(char_counts(docs, text_col))
    ids = training_ids(labels, "toxic", F.lit(True) if keep is None else keep, max_rows)

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_lead(t) for t in batch.column(2).to_pylist()], pa.binary())], names=["id", "y", "text", "lead"])

    sample = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(ids, "id").select("id", "y", "text")
    sample = sample.mapInArrow(led, "id bigint, y int, text string, lead binary")
    first = sample.groupBy("y", "lead").agg(F.min("id").alias("id"))
    sample = stored(sample.join(first, ["y", "lead", "id"], "left_semi").dropDuplicates(["id"]))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    na, nb = sizes.get(1, 0), sizes.get(0, 0)
    share = (na + 1) / (na + nb + 2)
    model = ToxicModel(chars, {}, (math.log(share / (1 - share)), *(0.0,) * SIGNALS))
    if not na or not nb:
        return model
    # those of toxic documents first; they are bounded by the words of the sample
    toxic = stored(_counted(sample.where("y = 1"), chars, None).where(f"n >= {max(2, min(MIN_TOXIC, na // SHARE))}").withColumnRenamed("n", "a"))
    names = frozenset(r["feature"] for r in toxic.select("feature").collect())
    clean = _counted(sample.where("y = 0"), chars, names).withColumnRenamed("n", "b")
    counts = toxic.join(clean, "feature", "left").fillna(0, ["b"])
    weight = F.log((F.col("a") + 0.5) / (na + 1)) - F.log((F.col("b") + 0.5) / (nb + 1))
    bound = 2 * math.log(max(2, len(names))) + MARGIN
    good = counts.select("feature", weight.alias("w"), _g2(F.col("a").cast("double"), F.col("b").cast("double"), na, nb).alias("g2")).where(f"w > 1.5 and g2 >= {bound!r}")
    model.weights = {r["feature"]: r["w"] for r in good.collect()}

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, known = Restored(chars), _Weights(model.weights)
        for batch in small(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.signals(restored.words(t), known) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["y", "s"])

    rows = sample.select("y", "text").mapInArrow(signals, "y int, s array<double>").toPandas()
    model.scale = _logistic(np.stack(rows["s"].to_list()), rows["y"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and weights of a logistic model with a small L2 penalty, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def scored(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row of docs.

    Null and empty texts have no words and get the lowest score. Rows are scored one by one: repeated rows repeat, a null
    id stays null; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, known = Restored(model.chars), _Weights(model.weights)
        for batch in small(batches):
            if batch.num_rows:
                s = np.array([model.signals(restored.words(t), known) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(s))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is below threshold; one pass, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored, known = Restored(model.chars), _Weights(model.weights)
        for batch in small(batches):
            if batch.num_rows:
                s = model.score(np.array([model.signals(restored.words(t), known) for t in batch.column(text_col).to_pylist()]))
                yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from labels whose crc32 modulo 4 isn't 2."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, keep=crc_mod("doc_id", 4) != 2)
    s = scored(docs, model)
    return s.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
