import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import contracts, toxicity


def plain_segments(scores, base=0):
    """By definition: the best contiguous run (the first of equals, the shortest), then the same to both sides."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = i, j + 1, total
    if best is None:
        return []
    a, b, s = best
    return [*plain_segments(scores[:a], base), (a + base, b + base, s), *plain_segments(scores[b:], base + b)]


@pytest.mark.parametrize("seed", range(20))
def test_segments_by_definition(seed):
    rng = random.Random(seed)
    scores = [rng.gauss(-0.2, 1) for _ in range(rng.randrange(0, 60))]
    got, expected = toxicity.maximal_segments(scores), plain_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in expected])


def test_words_without_weight_are_skipped_in_one_step():
    model = toxicity.ToxicityModel({"bad": 2.0, "worse": 3.0})
    words = "a b bad c worse d e f g bad".split()
    plain = toxicity.maximal_segments([model.weights.get(w, model.other) for w in words])
    assert [(a, b) for a, b, _ in model.segments(words)] == [(a, b) for a, b, _ in plain]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = contracts.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = {k: [r.predicted == k for r in rows if r.toxic == k] for k in (0, 1)}
    assert sum(right[0]) / len(right[0]) + sum(right[1]) / len(right[1]) >= 2 * 0.8  # balanced accuracy
    assert sum(right[0]) >= 0.97 * len(right[0])


def test_held_out_rows_are_those_of_the_rule(spark, sf):
    for r in contracts.op2_toxicity(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_passages_cover_the_planted_words(spark):
    rng = random.Random(1)
    clean = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for d in range(300):
        words = [rng.choice(clean) for _ in range(80)]
        if d % 3 == 0:
            words[30:36] = ["vile", "nasty", "vile", "foul", "nasty", "foul"]
        rows.append((d, " ".join(words)))
        labels.append((d, int(d % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for r in toxicity.score_toxicity(docs, model).collect():
        assert (r.tox_score >= 0.5) == (r.doc_id % 3 == 0)
        if r.doc_id % 3 == 0:
            (p,) = r.tox_passages
            assert r.text[p.start : p.end] == "vile nasty vile foul nasty foul"


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (5, 0), (4, 0), (99, 1)], "doc_id long, toxic int")
    for docs, y in ((odd, labels), (odd, labels.where("toxic = 0")), (odd, labels.limit(0)), (empty, labels)):
        rows = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, y)).collect()
        assert len(rows) == docs.count()
        assert all(r.tox_score < 0.5 and r.tox_passages == [] for r in rows if not (r.text or "").strip())
    assert toxicity.score_toxicity(odd, toxicity.ToxicityModel({})).columns == [c for c in odd.columns if c != "tox_score"] + ["tox_score", "tox_passages"]


def test_expected_step_is_negative():
    """Whatever the counts, the exponentials of the scores average 1 at most under the clean shares."""
    import random

    rng = random.Random(1)
    for _ in range(50):
        words = [f"w{i}" for i in range(rng.randrange(1, 30))]
        clean = {w: rng.randrange(0, 300) for w in words}
        passage = {w: rng.randrange(0, 40) for w in words}
        n_passage, n_clean = sum(passage.values()) + rng.randrange(0, 100), sum(clean.values()) + rng.randrange(100, 5000)
        share = {w: rng.random() / 100 for w in words}
        scores, other, q = toxicity.passage_weights({w: rng.uniform(-9, 9) for w in words}, passage, n_passage, clean, n_clean, share)
        rest = 1 - sum(q[w] for w in scores)
        assert sum(q[w] * math.exp(x) for w, x in scores.items()) + rest * math.exp(other) <= 1 + 1e-9
        assert sum(q[w] * x for w, x in scores.items()) + rest * other < 0
