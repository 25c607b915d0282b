"""Toxic spans and document scores by a linear-chain conditional random field."""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of

SAMPLE_PER_LABEL = 600
MAX_FEATURES = 4_096
MIN_CONTEXTS = 3
MIN_ASSOCIATION = 15.0
SEGMENT = 64
ROUNDS = 120
CACHE = 200_000
REJECT = 0.7
WORD = re.compile(r"[^\W_]+")
SPANS = "array<struct<start:long,end:long,probability:double>>"


PREFIXES = range(3, 8)


def features(word: str) -> list[str]:
    """The word itself and its proper prefixes of three to seven letters, lower-cased."""
    word = word.lower()
    return ["=" + word] + [word[:k] for k in PREFIXES if k < len(word)]


@dataclass
class Field:
    """The trained field: ``weights`` of features, ``bias``, state ``transitions``, document calibration."""

    weights: dict[str, float]
    bias: float
    transitions: list[list[float]]
    calibration: list[float]
    rate: float

    def potentials(self) -> dict[str, float]:
        """A table from word to its potential of the toxic state, filled as words are met."""
        weights, bias = self.weights, self.bias

        class Table(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= CACHE:
                    self.clear()
                total = bias + sum(weights.get(f, 0.0) for f in features(word))
                value = self[word] = math.exp(max(-25.0, min(25.0, total)))
                return value

        return Table()

    def marginals(self, potentials: list[float]) -> np.ndarray:
        """Odds of the toxic state at each token, from the forward and the backward pass."""
        (a00, a01), (a10, a11) = self.transitions
        forward = list(accumulate(
            potentials[1:], lambda r, x: x * (a01 + a11 * r) / (a00 + a10 * r), initial=potentials[0] * a01 / a00
        ))
        backward = list(accumulate(
            potentials[:0:-1], lambda b, x: (a10 + a11 * x * b) / (a00 + a01 * x * b), initial=1.0
        ))
        return np.array(forward) * np.array(backward[::-1])

    def evidence(self, words: list[str], table: dict[str, float]) -> tuple[list[float], np.ndarray]:
        """Document features: the highest log-odds, the expected toxic tokens, the length."""
        if not words:
            return [-8.0, 0.0, 0.0], np.empty(0)
        odds = self.marginals([table[w] for w in words])
        chance = odds / (1 + odds)
        top = min(8.0, max(-8.0, math.log(max(odds.max(), 1e-9))))
        return [top, math.log1p(chance[chance > 0.01].sum()), math.log1p(len(words))], chance

    def score(self, evidence: list[float]) -> float:
        if not self.calibration:
            return self.rate
        total = self.calibration[0] + sum(c * v for c, v in zip(self.calibration[1:], evidence))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def choose_features(toxic: list[list[str]], clean: list[list[str]]) -> dict[str, float]:
    """Features that go with toxic documents, and the share of their contexts that are in toxic ones.

    Each distinct context (a word with its neighbours) counts once per class, so copies of a document
    add nothing. A feature needs MIN_CONTEXTS toxic contexts and a likelihood ratio of MIN_ASSOCIATION.
    """
    def contexts_of(documents: list[list[str]]) -> tuple[Counter, int]:
        """Distinct contexts of each lower-cased word, and of all words."""
        seen: set[int] = set()
        counts: Counter = Counter()
        for words in documents:
            for context in zip(["", *words], words, [*words[1:], ""]):
                if (key := hash(context)) not in seen:
                    seen.add(key)
                    counts[context[1].lower()] += 1
        return counts, len(seen)

    def of_length(words: Counter, k: int, least: int) -> dict[str, int]:
        """Contexts of the features of one kind, whole words (0) or prefixes, that have ``least``."""
        counts: Counter = Counter()
        for word, n in words.items():
            if not k:
                counts["=" + word] += n
            elif k < len(word):
                counts[word[:k]] += n
        return {f: n for f, n in counts.items() if n >= least}

    (bad_words, n_bad), (good_words, n_good) = contexts_of(toxic), contexts_of(clean)
    bad, good = {}, {}
    for k in (0, *PREFIXES):  # one kind at a time, which bounds the memory
        kind = of_length(bad_words, k, MIN_CONTEXTS)
        bad.update(kind)
        good.update((f, n) for f, n in of_length(good_words, k, 1).items() if f in kind)
    found = {}
    for feature, a in bad.items():
        b = good.get(feature, 0)
        share = n_bad / max(1, n_bad + n_good)
        expected_a, expected_b = (a + b) * share, (a + b) * (1 - share)
        ratio = 2 * (a * math.log(a / expected_a) + (b * math.log(b / expected_b) if b else 0.0))
        if a > expected_a and ratio >= MIN_ASSOCIATION:
            found[feature] = ratio
    return dict(sorted(found.items(), key=lambda item: (-item[1], item[0]))[:MAX_FEATURES])


def train(rows: list[tuple[str, int]], totals: dict[int, int]) -> Field:
    """Fit the field on (text, label) rows; ``totals`` are the labels' counts in all training rows."""
    documents = [(WORD.findall(text or ""), label) for text, label in rows]
    by_label = {label: [w for w, own in documents if own == label] for label in (0, 1)}
    n_all = sum(totals.values())
    rate = totals.get(1, 0) / n_all if n_all else 0.0
    field = Field({}, -8.0, [[1.0, 1.0], [1.0, 1.0]], [], rate)
    if not by_label[0] or not by_label[1]:
        return field
    weight = {label: totals[label] / len(by_label[label]) for label in (0, 1)}
    total_weight = sum(weight[label] * len(by_label[label]) for label in (0, 1))
    chosen = choose_features(by_label[1], by_label[0])
    if not chosen:
        return field

    names = {feature: i for i, feature in enumerate(chosen)}
    kinds: dict[tuple[int, ...], int] = {(): 0}
    kind_of: dict[str, int] = {}
    occurrences = {0: Counter(), 1: Counter()}
    streams = {0: [], 1: []}
    for words, label in documents:
        for word in words:
            if (kind := kind_of.get(word)) is None:
                active = tuple(sorted(names[f] for f in features(word) if f in names))
                kind = kind_of[word] = kinds.setdefault(active, len(kinds))
            streams[label].append(kind)
        occurrences[label].update(streams[label][len(streams[label]) - len(words):])
    toxic_kind = np.zeros(len(kinds), bool)
    for kind in range(1, len(kinds)):
        bad, good = occurrences[1][kind] * weight[1], occurrences[0][kind] * weight[0]
        toxic_kind[kind] = bad > good
    segments, importance, labels = [], [], []
    for label, stream in streams.items():
        stream = np.array(stream + [0] * (-len(stream) % SEGMENT), np.int64).reshape(-1, SEGMENT)
        segments.append(stream)
        labels.append(toxic_kind[stream] & (label == 1))
        importance.append(np.full(len(stream), weight[label] / total_weight))
    weights, bias, transitions = fit(
        np.concatenate(segments), np.concatenate(labels).astype(np.int64), np.concatenate(importance),
        [list(active) for active in kinds], len(names),
    )
    field = Field({f: float(weights[i]) for f, i in names.items()}, float(bias), transitions, [], rate)
    table = field.potentials()
    rows_of = np.array([field.evidence(words, table)[0] for words, _ in documents])
    truth = np.array([label for _, label in documents], float)
    field.calibration = calibrate(rows_of, truth, np.array([weight[label] for _, label in documents]))
    return field


def fit(
    kinds: np.ndarray, labels: np.ndarray, importance: np.ndarray, active: list[list[int]], n_features: int
) -> tuple[np.ndarray, float, list[list[float]]]:
    """Conditional likelihood by adaptive gradient steps over segments of token kinds."""
    owner = np.repeat(np.arange(len(active)), [len(a) for a in active])
    member = np.array([i for a in active for i in a], np.int64)
    theta = np.zeros(n_features + 5)
    theta[n_features] = -4.0
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    steps = kinds.shape[1]
    scale = importance / importance.sum() * len(kinds)
    target = np.zeros_like(theta)
    on = np.bincount(kinds.ravel(), (labels * scale[:, None]).ravel(), len(active))
    target[:n_features] = np.bincount(member, on[owner], n_features)
    target[n_features] = on.sum()
    moves = labels[:, :-1] * 2 + labels[:, 1:]
    target[n_features + 1:] = np.bincount(moves.ravel(), np.repeat(scale, steps - 1), 4)
    norm = scale.sum()
    for step in range(1, ROUNDS + 1):
        emission = theta[n_features] + np.bincount(owner, theta[member], len(active))
        x = np.exp(np.clip(emission, -25, 25))[kinds].T
        a = np.exp(theta[n_features + 1:]).reshape(2, 2)
        forward, backward = np.empty_like(x), np.ones_like(x)
        forward[0] = x[0]
        for t in range(1, steps):
            forward[t] = x[t] * (a[0, 1] + a[1, 1] * forward[t - 1]) / (a[0, 0] + a[1, 0] * forward[t - 1])
        for t in range(steps - 2, -1, -1):
            next_ = x[t + 1] * backward[t + 1]
            backward[t] = (a[1, 0] + a[1, 1] * next_) / (a[0, 0] + a[0, 1] * next_)
        odds = forward * backward
        chance = odds / (1 + odds) * scale
        expected = np.zeros_like(theta)
        on = np.bincount(kinds.T.ravel(), chance.ravel(), len(active))
        expected[:n_features] = np.bincount(member, on[owner], n_features)
        expected[n_features] = on.sum()
        following = x[1:] * backward[1:]
        pairs = [a[0, 0] * np.ones_like(following), a[0, 1] * following, a[1, 0] * forward[:-1], a[1, 1] * forward[:-1] * following]
        whole = sum(pairs)
        expected[n_features + 1:] = [(p / whole * scale).sum() for p in pairs]
        gradient = (target - expected) / norm - 1e-4 * theta
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        theta += 0.15 * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return theta[:n_features], theta[n_features], np.exp(theta[n_features + 1:]).reshape(2, 2).tolist()


def calibrate(evidence: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weights of a logistic model on document evidence, by Newton steps with a small penalty."""
    rows = np.column_stack([np.ones(len(evidence)), evidence])
    beta = np.zeros(rows.shape[1])
    weight = weight / weight.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        hessian = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(rows.shape[1])
        beta += np.linalg.solve(hessian, rows.T @ (weight * (truth - p)) - 0.1 * beta)
    return beta.tolist()


def train_on(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", per_label: int = SAMPLE_PER_LABEL,
) -> Field:
    """Fit on a bounded sample: about ``per_label`` documents of each label from the training fold.

    The fold is every id whose crc32 as text modulo 3 is not 1. Null labels and ids are left out; of
    repeated labels of an id the highest counts.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold_of(F.col("id")) != 1)
    ).groupBy("id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = bounded_sample(known, "label", "id", per_label)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(sample), "id").dropDuplicates(["id"]).orderBy("id").select("text", "label").collect()
    return train([(r["text"], r["label"]) for r in rows], totals)


def score_toxicity(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id, score, spans``; spans are tokens more likely toxic than not.

    Every token of a whole text gets its marginal by a forward and a backward pass. The score, 0 to 1,
    is a logistic model of the highest log-odds, the expected number of toxic tokens and the length.
    Offsets are code points, end exclusive. Null and empty texts have no tokens and the score of no
    evidence; without training rows of both labels the score is the toxic share. Repeated rows get the
    same score, other columns are ignored, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = field.potentials()
        item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                evidence, chance = field.evidence(WORD.findall(text), table)
                scores.append(field.score(evidence))
                offending = []
                if len(chance) and chance.max() > 0.5:
                    offending = [
                        {"start": m.start(), "end": m.end(), "probability": float(p)}
                        for m, p in zip(WORD.finditer(text), chance) if p > 0.5
                    ]
                spans.append(offending)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, item)], ["id", "score", "spans"]
            )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, spans {SPANS}")


def without_toxic(docs: DataFrame, field: Field, text_column: str = "text", reject: float = REJECT) -> DataFrame:
    """The input rows, all columns kept, whose text scores below ``reject``.

    Null and empty texts have the score of no evidence, repeated rows go or stay together, an empty
    table gives no rows.
    """
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = field.potentials()
        for batch in batches:
            kept = [
                field.score(field.evidence(WORD.findall(text.as_py() or ""), table)[0]) < reject
                for text in batch.column(place)
            ]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
