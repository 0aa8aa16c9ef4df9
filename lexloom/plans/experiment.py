"""Experiments: one document source, generators in the order of their inputs, selectors, a classifier, and their evaluation.

A generator is fitted on training documents only and applied to all. What it emits takes the place of the feature sets it names,
so a modifier such as TF-IDF makes a new version of its source sets; generators with equal rights keep the order of the
configuration. Generators marked per_class are fitted anew for every topic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import clusters as C
from lexloom.operators import corpus as D
from lexloom.operators import features as G
from lexloom.operators import learn as L
from lexloom.operators import relevance as R
from lexloom.operators import selectors as S
from lexloom.session import stored

FOLDS = 5
LONG = ("feature_set", "doc_id", "feature", "value")


@dataclass(frozen=True)
class Corpus:
    """documents(doc_id, is_training, classes, texts), the same without their texts, features in long form, and the sets that
    classifiers see. Features are kept in parts, the sets of a part with its rows: each is written once, by its generator, and a
    new one takes nothing over from those before. The table without texts is small, so that joins know its size."""

    documents: DataFrame
    ids: DataFrame
    parts: tuple[tuple[frozenset[str], DataFrame], ...] = ()
    visible: frozenset[str] = frozenset()

    @classmethod
    def of(cls, documents: DataFrame) -> "Corpus":
        return cls(documents, stored(documents.select([c for c in ("doc_id", "is_training", "classes") if c in documents.columns]), "corpus-ids"))

    def where(self, condition: str) -> "Corpus":
        """The documents, and their features, that a condition on (doc_id, is_training, classes) holds for."""
        ids = self.ids.where(condition)
        kept = ids.select("doc_id")
        parts = tuple((names, rows.join(kept, "doc_id", "left_semi").select(*LONG)) for names, rows in self.parts)
        return replace(self, documents=self.documents.where(condition), ids=ids, parts=parts)

    def training(self) -> "Corpus":
        return self.where("is_training")

    def sets(self, names: Iterable[str]) -> DataFrame:
        names = frozenset(names)
        found = [rows if own <= names else rows.where(F.col("feature_set").isin(sorted(names))) for own, rows in self.parts if own & names]
        if not found:
            return self.documents.sparkSession.createDataFrame([], "feature_set string, doc_id long, feature string, value double")
        return reduce(DataFrame.unionByName, found)

    def qualified(self, names: Iterable[str]) -> DataFrame:
        """doc_id, feature (qualified) and value of some sets."""
        return self.sets(names).select("doc_id", D.qualified().alias("feature"), "value")

    def labels(self, topic: str) -> DataFrame:
        return D.topic_labels(self.ids, topic).select("doc_id", F.col("label").cast("int").alias("label"))

    def with_sets(self, rows: DataFrame, names: Iterable[str], used: bool) -> "Corpus":
        names = frozenset(names)
        kept = tuple((own - names, old if not own & names else old.where(~F.col("feature_set").isin(sorted(names)))) for own, old in self.parts if own - names)
        new = stored(rows.select(*LONG), "features")
        return replace(self, parts=(*kept, (names, new)), visible=(self.visible - names) | (names if used else frozenset()))


@dataclass
class Generator:
    """name; the generators it reads; the state that fit() returns is handed to rows(), which emits the sets it names."""

    name: str
    requires: tuple[str, ...] = ("source",)
    used: bool = True
    per_class: bool = False

    def sets(self) -> tuple[str, ...]:
        return (self.name,)

    def fit(self, training: Corpus, labels: DataFrame | None):
        return None

    def rows(self, corpus: Corpus, state) -> DataFrame:
        raise NotImplementedError


@dataclass
class Bow(Generator):
    text: str = "text"
    max_ngram: int = 1
    threshold: int = 1
    stem: bool = True
    stop_words: DataFrame | None = None

    def _bag(self) -> G.BagOfWords:
        return G.BagOfWords(self.name, self.text, self.max_ngram, self.threshold, self.stem, self.stop_words)

    def sets(self):
        return tuple(self.name if n == 1 else f"{self.name}{n}gram" for n in range(1, self.max_ngram + 1))

    def fit(self, training, labels):
        return [stored(c.where(F.col("n") >= self.threshold), "counts") for c in self._bag().fit(training.documents)]

    def rows(self, corpus, state):
        return self._bag().transform(corpus.documents, state)


@dataclass
class Tfidf(Generator):
    sources: tuple[str, ...] = ("bow",)
    scheme: str = "ltc"

    def sets(self):
        return self.sources

    def fit(self, training, labels):
        return stored(G.document_frequency(training.sets(self.sources)), "document-frequencies"), training.ids.count()

    def rows(self, corpus, state):
        return G.tfidf(corpus.sets(self.sources), *state, self.scheme)


@dataclass
class RangeNormalize(Generator):
    sources: tuple[str, ...] = ("bow",)

    def sets(self):
        return self.sources

    def fit(self, training, labels):
        return stored(G.ranges(training.sets(self.sources)), "ranges")

    def rows(self, corpus, state):
        return G.range_normalised(corpus.sets(self.sources), state)


@dataclass
class EmbeddingMean(Generator):
    text: str = "text"
    embeddings: DataFrame | None = None

    def rows(self, corpus, state):
        return G.embedding_means(X.term_counts(corpus.documents, self.text, valid_only=False), self.embeddings, self.name)


@dataclass
class Concepts(Generator):
    """Explicit concepts of articles(concept_id, token); with category_links(concept_id, category) also the set <name>cats."""

    text: str = "text"
    articles: DataFrame | None = None
    category_links: DataFrame | None = None
    limit: int = 200

    def sets(self):
        return (self.name,) if self.category_links is None else (self.name, f"{self.name}cats")

    def fit(self, training, labels):
        return stored(G.concept_index(self.articles), "concept-index")

    def rows(self, corpus, state):
        vectors = G.concept_vectors(X.term_counts(corpus.documents, self.text), state, self.limit)
        vectors = vectors if self.category_links is None else stored(vectors, "concept-vectors")  # read for both sets
        long = lambda rows, name, of: rows.select(F.lit(name).alias("feature_set"), "doc_id", F.col(of).cast("string").alias("feature"), F.col("weight").alias("value"))
        out = long(vectors, self.name, "concept_id")
        if self.category_links is None:
            return out
        return out.unionByName(long(G.category_vectors(vectors, self.category_links, self.limit), f"{self.name}cats", "category"))


@dataclass
class Clusters(Generator):
    """Activation of clusters of the source set's features; points(training corpus) gives (feature, vec) of what is clustered."""

    source: str = "esa"
    ks: tuple[int, ...] = (8,)
    points: Callable[[Corpus], DataFrame] | None = None
    method: Callable[[DataFrame, int], DataFrame] = C.k_means
    combiner: str = "sum"

    def fit(self, training, labels):
        points = C.document_points(training.sets([self.source])) if self.points is None else self.points(training)
        return C.several(points, list(self.ks), self.method).persist()

    def rows(self, corpus, state):
        return G.cluster_activation(corpus.sets([self.source]), state, self.combiner, self.name)


@dataclass
class GainClusters(Generator):
    """Clusters of the `best` features by information gain, agglomerated by the gain of their merged columns."""

    source: str = "esa"
    clusters: int = 300
    best: int = 10_000
    combiner: str = "sum"
    per_class: bool = True

    def fit(self, training, labels):
        rows = training.sets([self.source]).select("doc_id", "feature", "value")
        return C.agglomerated(rows, labels, self.clusters, S.info_gain(rows, labels, self.best), self.combiner).persist()

    def rows(self, corpus, state):
        return G.cluster_activation(corpus.sets([self.source]), state, self.combiner, self.name)


class UnresolvedInputs(ValueError):
    """Generators wait for inputs that nothing makes, or for each other."""


def in_order(generators: list[Generator]) -> list[Generator]:
    """Generators after all that they require, otherwise as configured."""
    place = {g.name: i for i, g in enumerate(generators)}
    if unknown := {r for g in generators for r in g.requires} - {*place, "source"}:
        raise UnresolvedInputs(f"nothing makes {', '.join(sorted(unknown))}")
    sorter = TopologicalSorter({g.name: [r for r in g.requires if r != "source"] for g in generators})
    try:
        sorter.prepare()
    except CycleError as e:
        raise UnresolvedInputs(f"generators wait for each other: {' '.join(e.args[1])}") from e
    out: list[Generator] = []
    ready: list[str] = []
    while sorter.is_active():
        ready += sorter.get_ready()
        name = min(ready, key=place.__getitem__)
        ready.remove(name)
        out.append(generators[place[name]])
        sorter.done(name)
    return out


def generated(corpus: Corpus, generators: list[Generator], topic: str | None = None) -> Corpus:
    """corpus with what the generators emit: without a topic those that serve all classes, with one those fitted per class."""
    for g in in_order(generators):
        if g.per_class == (topic is not None):
            training = corpus.training()
            state = g.fit(training, training.labels(topic) if topic else None)
            corpus = corpus.with_sets(g.rows(corpus, state), g.sets(), g.used)
    return corpus


@dataclass(frozen=True)
class Selector:
    """Keeps the `keep` best features of its source sets by info_gain, pos, neg or boost."""

    sources: tuple[str, ...]
    keep: int
    measure: str = "info_gain"

    def best(self, corpus: Corpus, labels: DataFrame) -> DataFrame:
        rows = corpus.qualified(self.sources)
        if self.measure == "info_gain":
            return S.info_gain(rows, labels, self.keep).select("feature")
        if self.measure == "boost":
            picked = S.ada_boost(rows, labels, self.keep)
            return rows.sparkSession.createDataFrame([(f,) for f, _ in dict(picked).items()], "feature string")
        return S.pos_neg(rows, labels, self.keep, self.measure).select("feature")

    def rejected(self, corpus: Corpus, labels: DataFrame) -> DataFrame:
        return S.rejected(corpus.qualified(self.sources), self.best(corpus, labels))


@dataclass
class Experiment:
    """A corpus, what is made of it, and how topics are tested on it."""

    corpus: Corpus
    generators: list[Generator]
    selectors: list[Selector] = field(default_factory=list)
    repeated: bool = False
    best_of: int = 5
    cost: float = 0.1

    def processed(self) -> Corpus:
        return generated(self.corpus, self.generators)

    def _trained(self, corpus: Corpus, topic: str):
        """(corpus with per-class sets, model, vocabulary, size, names) fitted on its training documents."""
        corpus = generated(corpus, self.generators, topic)
        training = corpus.training()
        labels = training.labels(topic)
        names = training.qualified(training.visible).select("feature").distinct()
        if self.selectors:
            names = names.join(D.rejected_by_any(*(s.rejected(training, labels) for s in self.selectors)), "feature", "left_anti")
        vocab = L.vocabulary(names).persist()
        size = max(vocab.count(), 1)
        data = L.vectors(labels, training.qualified(training.visible), vocab, size)
        return corpus, L.train_svm(data, self.cost), vocab, size

    def _predicted(self, trained, condition: str, topic: str) -> DataFrame:
        corpus, model, vocab, size = trained
        part = corpus.where(condition)
        return L.predictions(model, L.vectors(part.labels(topic), part.qualified(part.visible), vocab, size))

    def report(self, corpus: Corpus, topic: str) -> DataFrame:
        """Relevance of every feature that classifiers see, by its part for the negative class."""
        training = generated(corpus, self.generators, topic).training()
        return R.relevance_report(training.qualified(training.visible), training.labels(topic))

    def validated(self, corpus: Corpus, topic: str, seed: int = 0) -> DataFrame:
        """Predictions of every training document by a model of the other folds."""
        out = None
        docs = D.folds(corpus.documents.where("is_training"), FOLDS, seed)
        for fold in range(FOLDS):
            # generators are fitted on the other folds only: state fitted on all training documents would leak
            part = self._fold(docs, fold)
            said = self._predicted(self._trained(generated(part, self.generators), topic), "not is_training", topic)
            out = said if out is None else out.unionByName(said)
        return out

    def _fold(self, docs: DataFrame, fold: int) -> Corpus:
        return Corpus.of(docs.withColumn("is_training", F.col("fold") != fold).drop("fold"))

    def tested(self, topic: str) -> DataFrame:
        """One row each for the training and test documents (and, if repeated, the best of `best_of` cross validations):
        counts, precision, recall, f1 and accuracy."""
        corpus = self.processed()
        trained = self._trained(corpus, topic)
        rows = []
        for name, condition in (("train", "is_training"), ("test", "not is_training")):
            rows.append(L.evaluation(self._predicted(trained, condition, topic)).withColumn("part", F.lit(name)))
        if self.repeated:
            # one small row an attempt; the seed of the best is what is kept of it
            tried = [L.evaluation(self.validated(corpus, topic, seed)).head() for seed in range(max(self.best_of, 1))]
            best = max(range(len(tried)), key=lambda i: (tried[i].f1, -i))
            rows.append(corpus.documents.sparkSession.createDataFrame([tried[best]]).withColumn("part", F.lit(f"validation (seed {best})")))
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out
