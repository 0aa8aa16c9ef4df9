"""Toxic passages by maximum-scoring segments over token log-odds.

Weights. Every word scores the log-odds of toxic passages against clean text, with an informative Dirichlet prior whose mean is the
word's share of the whole corpus (Monroe, Colaresi and Quinn 2008). Passages are not labelled, documents are: log-odds of whole
documents find the best segment of each toxic training document, and its words then count as toxic passage. How far a word keeps
its own odds follows from its evidence by documents, the binomial (Chernoff) bound on its share of toxic ones: an odd word keeps them,
positive or negative; a word without evidence scores as all such words together, which are rarer in passages than in clean text.
Scores are shifted, where need be, so that their exponentials average 1 at most under the clean word shares: the expected step is
negative by construction.

Scan. Ruzzo and Tompa's linear-time algorithm (1999) finds all maximal-scoring segments of a text.

Calibration. Under clean text the best segment of n words follows an extreme-value law, P(S > x) = 1 - exp(-K n exp(-lambda x))
(Karlin and Altschul 1990): lambda solves E[exp(lambda s)] = 1 under the clean word shares; K makes the number of clean training
documents, each of its own length, whose best segment passes the median such score as large as the law expects. Segments
whose expected number by chance is below 0.05 are significant. A document's score is a logistic function, fitted
on the training documents, of the extreme-value significance of its best segment and of the sum of its significant ones.

Training takes at most TRAIN_ROWS labelled rows, chosen by a hash of the id; the prior counts the whole corpus.

Defined results: a null or empty text has no segments and the score of no evidence, below 0.5; rows with a null label or id do not train;
an id with several labels is toxic if any is; without both classes the score is 0; ties and repeated rows score alike; further
columns pass through, but for any named tox_score or tox_passages, which the results replace.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import drop_stored, small_batches, stored

#: Most labelled rows that train a model.
TRAIN_ROWS = 50_000
#: Weight of the corpus prior in words; cost of a word without evidence while passages are not yet known.
PRIOR, FIRST_DRIFT = 100.0, 0.1
#: Expected number of chance segments below which one is significant.
SIGNIFICANT = 0.05

_WORDS = re.compile(r"\w+").findall
_SPANS = re.compile(r"\w+").finditer


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end exclusive, score), by Ruzzo and Tompa, in one pass.

    >>> maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5])
    [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    """
    # (start, end, sum before the segment, sum up to its end)
    found: list[tuple[int, int, float, float]] = []
    total = 0.0 if any(isinstance(s, float) for s in scores) else 0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, high = i, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


@dataclass
class ToxicityModel:
    """Word weights and calibration; of bounded size, as training is bounded."""

    weights: dict[str, float]
    other: float = -FIRST_DRIFT
    lam: float = 1.0
    k: float = 1.0
    logistic: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Maximal segments of words; runs of words without a weight of their own are taken in one step."""
        get = self.weights.get
        places = [(i, w) for i, x in enumerate(words) if (w := get(x)) is not None]
        items, at, owner = [], 0, []
        for i, w in places:
            if i > at:
                items.append(self.other * (i - at))
                owner.append(-1)
            items.append(w)
            owner.append(i)
            at = i + 1
        return [(owner[a], owner[b - 1] + 1, s) for a, b, s in maximal_segments(items)]

    def expected(self, n: int, score: float) -> float:
        """Chance segments of at least this score among n words."""
        return self.k * max(n, 1) * math.exp(-min(self.lam * score, 700.0))

    def features(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Extreme-value significance of the best segment (-ln p) and ln(1 + sum of significant normalised scores)."""
        if not segments:
            return 0.0, 0.0
        e = self.expected(n, max(s for *_, s in segments))
        p = -math.expm1(-e)
        total = sum(max(self.lam * s - math.log(self.k * n), 0.0) for *_, s in segments if self.expected(n, s) < SIGNIFICANT)
        return min(-math.log(max(p, 1e-30)), 60.0), math.log1p(total)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score from 0 to 1 and the significant segments, in words."""
        words = words_of(text)
        segments = self.segments(words)
        x, y = self.features(len(words), segments)
        c, a, b = self.logistic
        z = c + a * x + b * y
        return 1 / (1 + math.exp(-max(min(z, 700.0), -700.0))), [s for s in segments if self.expected(len(words), s[2]) < SIGNIFICANT]


def training_labels(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """label_id and label (0 or 1) of at most `rows` labelled ids, the first by hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    per_id = known.groupBy(F.col("doc_id").alias("label_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    return per_id.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)


def _class_counts(sample: DataFrame) -> tuple[dict[str, tuple[int, int, float]], int, int]:
    """(toxic count, clean count, evidence) of the words with evidence, signed nats beyond chance; and all words of each class.
    Bounded: at most TRAIN_ROWS texts speak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, texts = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                counts[label].update(words)
                docs[label].update(set(words))
                texts[label] += 1
        for label in (0, 1):
            c, d = counts[label], docs[label]
            words = list(c)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                cells = [pa.array(part, pa.string()), pa.array([label] * len(part), pa.int32()), pa.array([c[w] for w in part], pa.int64()), pa.array([d[w] for w in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(cells, ["word", "label", "n", "docs"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([label], pa.int32()), pa.array([c.total()], pa.int64()), pa.array([texts[label]], pa.int64())], ["word", "label", "n", "docs"])

    rows = sample.select("text", "label").mapInArrow(run, "word string, label int, n long, docs long")
    of = lambda column, label: F.sum(F.when(F.col("label") == label, F.col(column)).otherwise(0))
    sums = stored(rows.groupBy("word").agg(of("n", 1).alias("t"), of("n", 0).alias("c"), of("docs", 1).alias("td"), of("docs", 0).alias("cd")), "toxic-counts")
    total = sums.where(F.col("word").isNull()).head()
    if total is None or not total.t or not total.c:
        drop_stored(sums)
        return {}, 0, 0
    share = total.td / (total.td + total.cd)
    tried = sums.where("word is not null and td + cd > 1")
    n, part = F.col("td") + F.col("cd"), F.col("td") / (F.col("td") + F.col("cd"))
    toxic_part = F.when(part > 0, part * F.ln(part / share)).otherwise(0.0)
    clean_part = F.when(part < 1, (1 - part) * F.ln((1 - part) / (1 - share))).otherwise(0.0)
    beyond = n * (toxic_part + clean_part) - math.log(max(tried.count(), 1))
    odd = tried.withColumn("nats", beyond * F.when(part > share, 1).otherwise(-1)).where(beyond > 0).toPandas()
    drop_stored(sums)
    return {w: (int(t), int(c), float(x)) for w, t, c, x in zip(odd.word, odd.t, odd.c, odd.nats)}, int(total.t), int(total.c)


def _passage_counts(sample: DataFrame, model: ToxicityModel) -> tuple[dict[str, int], int]:
    """Occurrences of the weighted words in the best segments of the toxic documents, and the number of all words there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                best = max(model.segments(words), key=lambda x: (x[2], -x[0]), default=(0, 0, 0.0))
                part = words[best[0] : best[1]]
                total += len(part)
                counts.update(filter(model.weights.__contains__, part))
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), total], pa.int64())], ["word", "n"])

    rows = sample.where("label = 1").select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    total = found.pop(None, 0)
    return found, total


def _corpus_counts(docs: DataFrame, words: set[str]) -> tuple[dict[str, int], int]:
    """Occurrences of the given words in all documents, and the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = words_of(text)
                total += len(found)
                counts.update(filter(words.__contains__, found))
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), total], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    total = found.pop(None, 0)
    return found, total


def passage_weights(evidence: dict[str, float], passage: dict[str, int], n_passage: int, clean: dict[str, int], n_clean: int, prior: dict[str, float]) -> tuple[dict[str, float], float, dict[str, float]]:
    """Scores of the words with evidence, of all others, and the clean shares. prior: corpus shares.

    Both distributions get PRIOR words of the corpus. A word keeps its own log-odds by 1 - exp(-evidence), and the rest of it the score
    of all words without any; all are shifted down if their exponentials average more than 1 under the clean shares.
    """
    both = n_passage + PRIOR, n_clean + PRIOR
    p = {w: (passage.get(w, 0) + PRIOR * prior[w]) / both[0] for w in evidence}
    q = {w: (clean[w] + PRIOR * prior[w]) / both[1] for w in evidence}
    other = math.log(max(1 - sum(p.values()), 1e-9) / max(1 - sum(q.values()), 1e-9))
    scores = {}
    for w, nats in evidence.items():
        own = math.log(p[w] / q[w])
        if (own > 0) == (nats > 0):
            scores[w] = other + -math.expm1(-abs(nats)) * (own - other)
    rest = max(1 - sum(q[w] for w in scores), 1e-9)
    shift = max(0.0, math.log(sum(q[w] * math.exp(x) for w, x in scores.items()) + rest * math.exp(other)))
    return {w: x - shift for w, x in scores.items()}, min(other - shift, -1e-3), q


def _karlin_lambda(weights: dict[str, float], other: float, clean: dict[str, float]) -> float:
    """The positive root of E[exp(lambda s)] = 1 under clean word shares."""
    s = np.array([weights[w] for w in weights])
    p = np.array([clean[w] for w in weights])
    rest = max(1 - p.sum(), 1e-9)
    low, high = 1e-6, 1.0
    f = lambda x: (p * np.exp(np.minimum(x * s, 700))).sum() + rest * math.exp(x * other) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return (low + high) / 2


def _fitted_k(lam: float, sizes: np.ndarray, tops: np.ndarray) -> float:
    """K at which as many documents of these sizes are expected to pass the median positive best score as do."""
    some = tops[tops > 0]
    if not len(some) or lam <= 0:
        return math.exp(-30.0)
    x = float(np.median(some))
    observed, reach = float((tops >= x).sum()), sizes * math.exp(-min(lam * x, 700.0))
    low, high = -30.0, 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if -np.expm1(-math.exp(middle) * reach).sum() < observed else (low, middle)
    return math.exp((low + high) / 2)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    design, beta = np.hstack([np.ones((len(x), 1)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        penalty = ridge * np.array([0, 1, 1])
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty + 1e-9), design.T @ (y - p) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on documents with a row in labels(doc_id, toxic); docs also gives the corpus prior."""
    small_batches(docs.sparkSession)
    picked = stored(training_labels(labels, rows), "toxic-labels")
    chosen = F.broadcast(picked)  # at most `rows` rows of 12 bytes
    sample = stored(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_id")).select("text", "label"), "toxic-sample")
    counts, toxic_words, clean_words = _class_counts(sample)
    corpus, total = _corpus_counts(docs, set(counts)) if counts else ({}, 0)
    share = {w: (corpus.get(w, 0) + 1) / (total + 1) for w in counts}
    evidence, clean = {w: x for w, (_, _, x) in counts.items()}, {w: c for w, (_, c, _) in counts.items()}
    first, _, _ = passage_weights(evidence, {w: t for w, (t, _, _) in counts.items()}, toxic_words, clean, clean_words, share)
    first = ToxicityModel({w: x for w, x in first.items() if x > 0})
    passage, n_passage = _passage_counts(sample, first) if first.weights else ({}, 0)
    weights, other, shares = passage_weights(evidence, passage, n_passage, clean, clean_words, share) if n_passage else ({}, 0.0, {})
    if not any(x > 0 for x in weights.values()):
        drop_stored(sample)
        drop_stored(picked)
        return ToxicityModel({}, logistic=(-700.0, 0.0, 0.0))
    model = ToxicityModel(weights, other, _karlin_lambda(weights, other, shares))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            found = [model.segments(w) for w in words]
            lists = pa.array([[s for *_, s in f] for f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), lists, batch.column(1)], ["n", "s", "label"])

    seen = sample.select("text", "label").mapInArrow(best, "n long, s array<double>, label int").toPandas()
    drop_stored(sample)
    drop_stored(picked)
    low = seen[(seen.label == 0) & (seen.n > 0)]
    model.k = _fitted_k(model.lam, low.n.to_numpy(np.float64), np.array([max(s, default=0.0) for s in low.s]))
    x = np.array([model.features(n, [(0, 0, v) for v in s]) for n, s in zip(seen.n, seen.s)]).reshape(-1, 2)
    model.logistic = _logistic(x, seen.label.to_numpy(np.float64))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", passages: bool = True) -> DataFrame:
    """docs with tox_score and, if wanted, tox_passages: array of (start, end, score, expected) in code points of the text."""
    small_batches(docs.sparkSession)
    docs = docs.drop("tox_score", "tox_passages")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores, found = [], []
            for t in batch.column(place).to_pylist():
                score, segments = m.score(t)
                scores.append(score)
                if passages:
                    at = [x.span() for x in _SPANS(t)] if segments else []
                    n = len(at)
                    found.append([{"start": at[min(a, n - 1)][0], "end": at[min(b, n) - 1][1], "score": s, "expected": m.expected(n, s)} for a, b, s in segments])
            more = [pa.array(scores, pa.float64())] + ([pa.array(found, kind)] if passages else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "tox_score", *["tox_passages"] * passages])

    inner = T.StructType([T.StructField(n, t()) for n, t in (("start", T.IntegerType), ("end", T.IntegerType), ("score", T.DoubleType), ("expected", T.DoubleType))])
    schema = T.StructType([*docs.schema, T.StructField("tox_score", T.DoubleType()), *([T.StructField("tox_passages", T.ArrayType(inner))] if passages else [])])
    return docs.mapInArrow(run, schema)
