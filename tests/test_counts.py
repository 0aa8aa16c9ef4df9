import re
from collections import Counter

import numpy as np
import pytest

from lexloom.functions import text as X
from lexloom.operators import features as G
from lexloom.operators import postings as P

TEXTS = ["The cat\tsat, the CAT ran", "naïve café İx Kelvin b2b a_b", "", None, "solo", "cats cat running runs 42 the end", "end" + " the" * 40, "xéy z"]


def _valid(text, stop=()):
    return [t for t in re.split(r"[^0-9A-Za-z_]+", (text or "").lower()) if t and not re.search("[0-9]", t) and t not in stop]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("stop", [(), ("the", "end")])
@pytest.mark.parametrize("repeated", [False, True])
def test_counts_against_plain_python(spark, monkeypatch, n, stop, repeated):
    monkeypatch.setattr(X, "SLICE_BYTES", 40)
    ids = [i // 2 if repeated else i for i in range(len(TEXTS))]
    docs = spark.createDataFrame(list(zip(ids, TEXTS)), "doc_id long, text string")
    want = Counter()
    for i, text in zip(ids, TEXTS):
        words = _valid(text, stop)
        want.update((i, " ".join(words[j : j + n])) for j in range(len(words) - n + 1))
    found = X.term_counts(docs, n=n, stop_words=spark.createDataFrame([(w,) for w in stop], "token string"))
    assert {(r.doc_id, r.token): r.n for r in found.collect()} == dict(want) and found.count() == len(want)


def test_stems_are_counted_together_and_nothing_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "running runs ran"), (2, "run")], "doc_id long, text string")
    found = X.term_counts(docs, stem=True)
    assert {(r.doc_id, r.token): r.n for r in found.collect()} == {(1, "run"): 2, (1, "ran"): 1, (2, "run"): 1}
    assert "Exchange" not in _plan(found)


def _tables(spark):
    rng = np.random.default_rng(3)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)]
    return words, docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), rng


@pytest.mark.parametrize("counted", [True, False])
def test_vector_means_over_many_chunks(spark, monkeypatch, counted):
    monkeypatch.setattr(P, "CHUNK_ROWS", 40)
    monkeypatch.setattr(P, "BATCH_ROWS", 3)
    monkeypatch.setattr(P, "SLAB", 8)
    words, docs, frame, rng = _tables(spark)
    vec = {w: [float(x) for x in (rng.integers(-8, 8, 4) if i % 2 else rng.random(3))] for i, w in enumerate(words[:9])}
    e = spark.createDataFrame(list(vec.items()), "term string, vec array<double>")
    tokens = X.term_counts(frame) if counted else X.valid(X.exploded_tokens(frame))
    got = {(r.doc_id, r.feature): r.value for r in G.embedding_means(tokens, e).collect()}
    want = {}
    for i, text in docs:
        for w in text.split():
            for d, x in enumerate(vec.get(w, [])):
                want[i, str(d)] = want.get((i, str(d)), 0.0) + x / len(text.split())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert _plan(G.embedding_means(tokens, e)).count("Generate") == 1 + (not counted)  # only means are spread out by dimension


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_heaviest_concepts_over_many_chunks(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "CHUNK_ROWS", 40)
    monkeypatch.setattr(P, "SLAB", 30)
    words, docs, frame, rng = _tables(spark)
    rows = [(w, int(c), float(rng.choice([0.5, 0.5 + 1e-11, 0.25, 1 / 3]))) for w in words[:10] for c in rng.choice(12, 6, replace=False)]
    index = spark.createDataFrame(rows, "token string, concept_id int, weight double")
    got = {(r.doc_id, r.concept_id): r.weight for r in G.concept_vectors(X.term_counts(frame), index, limit).collect()}
    want = {}
    for i, text in docs:
        sums = {}
        for w, n in Counter(text.split()).items():
            for token, c, x in rows:
                if token == w:
                    sums[c] = sums.get(c, 0.0) + n * x
        for c in sorted(sums, key=lambda c: (-round(sums[c], 9), c))[:limit]:
            want[i, c] = sums[c]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
