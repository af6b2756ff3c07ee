"""Quality of texts, learned from trusted positives and unlabelled text.

A text is described by statistics of its form. A first classifier that tells positives
from unlabelled text gives the class prior: the share of unlabelled texts that score as
high as positives do, at the best threshold. A second one, additive over quantile bins of
every statistic, minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

so texts marked as bad are never looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from martwright.llm.common import WORD, stored

# Positives and unlabelled texts to learn from, at most, drawn by a seeded hash of doc_id.
SAMPLE_ROWS = 20_000
BINS = 8
STEPS = 400
# How far below zero the part of the negatives may fall: room for the error of the prior.
TOLERANCE = 0.05
# Characters of a text whose words are held at once.
CHUNK = 1 << 20

_WORD = re.compile(WORD)
_KINDS = np.zeros(256, dtype=np.int64)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:'\"()-", b"!?"), 1):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:] = 8
STATISTICS = [
    "symbols", "lower", "upper", "digits", "spaces", "breaks", "points", "calls", "beyond_ascii",
    "words", "word_length", "distinct", "repeated", "commonest", "capitalised", "lines", "distinct_lines", "sentence_length",
]


def _chunks(text: str) -> Iterator[str]:
    """The text in order, cut inside no word."""
    start = 0
    while start < len(text):
        end = start + CHUNK
        while end < len(text) and not text[end] in " \t\n\r\v\f":
            end += 1
        yield text[start:end]
        start = end


def statistics(text: str) -> list[float]:
    """Form of a whole text in the order of ``STATISTICS``; an empty one gives zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kinds = np.bincount(_KINDS, weights=np.bincount(raw, minlength=256), minlength=9)
    counts: Counter[str] = Counter()
    letters = repeated = capitalised = 0
    last = None
    for chunk in _chunks(text):
        words = _WORD.findall(chunk)
        counts.update(words)
        letters += sum(map(len, words))
        repeated += sum(map(str.__eq__, words, [last or "", *words[:-1]]))
        capitalised += sum(word[0].isupper() for word in words)
        last = words[-1] if words else last
    n = sum(counts.values())
    lines = [line for line in text.split("\n") if line]
    shares = kinds / max(1, len(raw))
    ends = text.count(".") + text.count("!") + text.count("?")
    per_word = 1 / max(1, n)
    return [
        *shares, math.log1p(n), letters * per_word, len(counts) * per_word, repeated * per_word, max(counts.values(), default=0) * per_word,
        capitalised * per_word, math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), math.log1p(n / (1 + ends)),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text, in one pass without a shuffle."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(text.as_py() or "") for text in batch.column("text")]
            values = pa.array(np.array(found, dtype=np.float32).ravel())
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "form"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, "doc_id long, form array<float>")


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document are kept from learning; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Additive:
    """A sum of one weight per statistic, by the bin it falls into."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float = 0.0

    @classmethod
    def over(cls, forms: np.ndarray) -> Additive:
        """Bins of equal shares of the rows; a frequent value has a bin to itself."""
        levels = np.linspace(0, 1, BINS + 1)[1:-1]
        edges = [np.unique(np.quantile(column, levels, method="inverted_cdf")) for column in forms.T]
        return cls(edges, np.zeros((forms.shape[1], 2 * BINS)))

    def bins(self, forms: np.ndarray) -> np.ndarray:
        """Index into all weights; a value on an edge and one above it fall apart."""
        places = [np.searchsorted(e, c, "left") + np.searchsorted(e, c, "right") for e, c in zip(self.edges, forms.T)]
        return np.stack(places, axis=1) + np.arange(len(places)) * 2 * BINS

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.weights.ravel()[bins].sum(axis=1) + self.bias

    def score(self, forms: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(self.bins(forms)))

    def fit(self, gradients, bins: np.ndarray, penalty: float = 1e-3) -> Additive:
        """Adam over all rows; ``gradients`` maps margins to the risk's slope per row."""
        size = self.weights.size
        state = np.zeros(size + 1)
        mean, square = np.zeros(size + 1), np.zeros(size + 1)
        for step in range(1, STEPS + 1):
            self.weights, self.bias = state[:-1].reshape(self.weights.shape), state[-1]
            slope = gradients(self.margin(bins))
            gradient = np.bincount(bins.ravel(), weights=np.repeat(slope, bins.shape[1]), minlength=size)
            gradient = np.append(gradient + penalty * state[:-1], slope.sum())
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            state = state - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        self.weights, self.bias = state[:-1].reshape(self.weights.shape), state[-1]
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores.

    Above any threshold lie at least prior times the share of positives there; the
    quotient of both shares is taken where it is smallest, the error of both added.
    """
    thresholds = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), thresholds) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), thresholds) / len(unlabelled)
    doubt = sum(1 / math.sqrt(n) for n in (len(positive), len(unlabelled)))
    best = np.argmin((above_u + doubt) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def biased(positives: int, rows: int):
    """Slope of the logistic loss of positives (first rows) against unlabelled rows, both weighing alike."""
    weight = np.where(np.arange(rows) < positives, 1 / positives, 1 / max(1, rows - positives))
    target = np.arange(rows) < positives
    return lambda margin: weight * (_sigmoid(margin) - target)


def non_negative(positives: int, rows: int, prior: float):
    """Slope of the non-negative risk; while the part of the negatives is below ``-TOLERANCE``, it is raised instead."""
    is_positive = np.arange(rows) < positives
    of_p, of_u = is_positive * prior / positives, ~is_positive / max(1, rows - positives)

    def slopes(margin: np.ndarray) -> np.ndarray:
        up = _sigmoid(margin)
        negative_risk = ((of_u - of_p) * np.logaddexp(0, margin)).sum()
        negative_slope = (of_u - of_p) * up
        return of_p * (up - 1) + negative_slope if negative_risk >= -TOLERANCE else -negative_slope

    return slopes


@dataclass
class QualityModel:
    """Prior and classifier; without positives both are missing and every score is 0.5."""

    prior: float | None
    classifier: Additive | None

    def score(self, forms: np.ndarray) -> np.ndarray:
        return self.classifier.score(forms) if self.classifier else np.full(len(forms), 0.5)


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """Prior on halves that the first classifier has not seen, then the risk over all rows."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(None, None)
    estimates = []
    for half in (0, 1):
        seen_p, seen_u = positive[half::2], unlabelled[half::2]
        new_p, new_u = positive[1 - half :: 2], unlabelled[1 - half :: 2]
        if len(seen_p) and len(seen_u) and len(new_p) and len(new_u):
            forms = np.concatenate([seen_p, seen_u])
            first = Additive.over(forms)
            rows = first.bins(forms)
            first.fit(biased(len(seen_p), len(rows)), rows)
            estimates.append(class_prior(first.score(new_p), first.score(new_u)))
    prior = float(np.mean(estimates)) if estimates else 0.5
    both = np.concatenate([positive, unlabelled])
    classifier = Additive.over(both)
    rows = classifier.bins(both)
    return QualityModel(prior, classifier.fit(non_negative(len(positive), len(rows), prior), rows))


def _drawn(forms: DataFrame, most: int, seed: int) -> np.ndarray:
    """Statistics of at most ``most`` rows, those of the smallest hashes.

    Tasks let through little more than the share that is wanted, so what reaches the
    driver does not grow with their number.
    """
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    rows = forms.count()
    spare = most + 8 * math.isqrt(most) + 64
    if rows > spare:
        forms = forms.where(F.pmod(F.xxhash64(F.lit(-seed), "doc_id"), F.lit(rows)) < spare)
    found = forms.orderBy(*order).limit(most).select("form").collect()
    return np.array([r["form"] for r in found], dtype=np.float32).reshape(-1, len(STATISTICS))


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Learns from at most ``sample_rows`` texts marked quality 1 and as many of any kind, of
    documents that are not held out; their statistics, a few numbers a text, come to the
    driver. Every whole text is described and scored. A null text is empty and an empty
    one is scored like any other; without a positive every score is 0.5. Rows with equal
    doc_id are scored each by its text, an empty table gives no rows, a null doc_id has no
    label; further columns are not looked at.
    """
    forms = stored(described(docs), "forms")
    learning = forms.where(~held_out(F.col("doc_id")))
    good = labels.where("quality = 1").select("doc_id").distinct()
    model = learn(_drawn(learning.join(good, "doc_id", "left_semi"), sample_rows, seed), _drawn(learning, sample_rows, seed + 1))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("form").flatten().to_numpy().reshape(-1, len(STATISTICS))
            found = model.score(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    scored = forms.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
