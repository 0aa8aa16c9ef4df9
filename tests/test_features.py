import math
import random

import pytest

from lexloom.operators import clusters as C
from lexloom.operators import corpus as D
from lexloom.operators import features as G
from lexloom.operators import learn as L
from lexloom.operators import relevance as R
from lexloom.operators import selectors as S

LONG = "feature_set string, doc_id long, feature string, value double"


def labelled(spark, column, n0, n1):
    """features of one column x over n0 + n1 documents, of which the first n0 have label 0; and the labels."""
    labels = spark.createDataFrame([(i, int(i >= n0)) for i in range(n0 + n1)], "doc_id long, label int")
    rows = [("s", i, "x", float(v)) for i, v in column.items()]
    return spark.createDataFrame(rows, LONG), labels


def entropy(a, b):
    return sum(-x / (a + b) * math.log2(x / (a + b)) for x in (a, b) if x)


def test_perfect_separator_has_the_whole_entropy(spark):
    f, y = labelled(spark, {i: 1.0 for i in range(6, 10)}, 6, 4)
    row = R.information_gain(f, y).head()
    assert row.ig == pytest.approx(entropy(6, 4), abs=1e-9) and row.cut == 500_000
    hist = R.value_histogram(f, y)
    assert R.purity(hist, R.binary_splits(hist)).head().pos == 1.0


def test_constant_and_one_sided_columns(spark):
    f, y = labelled(spark, {i: 2.0 for i in range(10)}, 6, 4)
    assert R.information_gain(f, y).head().ig == 0.0
    hist = R.value_histogram(f, y)
    assert R.purity(hist, R.binary_splits(hist)).head().pos == 0.5
    f, y = labelled(spark, {0: 1.0, 3: 2.0}, 5, 0)
    hist = R.value_histogram(f, y)
    assert R.purity(hist, R.binary_splits(hist)).head().pos == 0.5


def test_split_against_brute_force(spark):
    rng = random.Random(5)
    rows, labels = [], [(i, rng.randrange(2)) for i in range(60)]
    for c in range(6):
        rows += [("s", i, f"c{c}", float(rng.randrange(1, 5))) for i in range(60) if rng.random() < 0.6]
    f, y = spark.createDataFrame(rows, LONG), spark.createDataFrame(labels, "doc_id long, label int")
    label = dict(labels)
    got = {r.feature: r.ig for r in R.information_gain(f, y).collect()}
    hist = R.value_histogram(f, y)
    parts = {r.feature: r.ig0 + r.ig1 for r in R.label_contributions(hist, R.binary_splits(hist)).collect()}
    full = {r.feature: r for r in R.mdlp(hist).collect()}
    for c in range(6):
        value = {i: 0.0 for i in label} | {d: v for _, d, n, v in rows if n == f"c{c}"}
        whole, best = entropy(*(sum(v == k for v in label.values()) for k in (0, 1))), 0.0
        for cut in sorted(set(value.values()))[:-1]:
            sides = [[label[d] for d, v in value.items() if (v > cut) == up] for up in (False, True)]
            best = max(best, whole - sum(len(s) / 60 * entropy(s.count(0), s.count(1)) for s in sides))
        assert got[f"c{c}"] == pytest.approx(best, abs=1e-8)
        assert parts[f"c{c}"] == pytest.approx(best, abs=1e-8)
        assert full[f"c{c}"].ig >= best - 1e-9 and full[f"c{c}"].ig <= whole + 1e-9


def test_quantisation_truncates_toward_zero(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(R.quantised(F.lit(-0.0000019))).head()[0] == -1


def test_tfidf_unseen_features_stay_raw(spark):
    f = spark.createDataFrame([("bow", 1, "a", 2.0), ("bow", 1, "b", 1.0), ("bow", 2, "new", 3.0)], LONG)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "feature string, df long")
    out = {(r.doc_id, r.feature): r.value for r in G.tfidf(f, df, 4, "ltc").collect()}
    assert out[1, "a"] == pytest.approx((1 + math.log(2)) * math.log(4) / math.sqrt(5))
    assert out[1, "b"] == pytest.approx(math.log(2) / math.sqrt(5)) and out[2, "new"] == 3.0


def test_ranges(spark):
    f = spark.createDataFrame([("s", 1, "zero", 0.0), ("s", 1, "c", 4.0), ("s", 2, "c", 2.0), ("s", 3, "new", 9.0), ("s", 2, "n", -2.0)], LONG)
    out = {(r.doc_id, r.feature): r.value for r in G.range_normalised(f, G.ranges(f.where("feature <> 'new'"))).collect()}
    assert out == {(1, "zero"): 1.0, (1, "c"): 1.0, (2, "c"): 0.5, (3, "new"): 0.0, (2, "n"): 0.0}


def test_embedding_mean_counts_unknown_words(spark):
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "oov"), (2, 0, "oov")], "doc_id long, pos int, token string")
    e = spark.createDataFrame([("a", [3.0, 6.0])], "term string, vec array<double>")
    assert {(r.doc_id, r.feature): r.value for r in G.embedding_means(tokens, e).collect()} == {(1, "0"): 2.0, (1, "1"): 4.0}


def test_names_folds_and_sets(spark):
    f = spark.createDataFrame([("bow", 1, "a_b", 1.0), ("esa", 2, "7", 1.0)], LONG)
    assert D.feature_of(f, "bow_a_b").count() == 1
    with pytest.raises(ValueError):
        D.feature_of(f, "plain")
    docs = spark.range(1000).withColumnRenamed("id", "doc_id")
    folds = D.folds(docs, 5, seed=3)
    assert folds.count() == 1000 and {r.fold for r in folds.select("fold").distinct().collect()} == set(range(5))
    assert folds.exceptAll(D.folds(docs, 5, seed=3)).count() == 0
    train, valid = D.validation_split(docs, 0.3)
    assert train.count() + valid.count() == 1000 and 200 < valid.count() < 400


def test_evaluation_without_predictions(spark):
    none = spark.createDataFrame([(False, True), (False, False)], "predicted boolean, actual boolean")
    row = L.evaluation(none).head()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (1.0, 0.0, 0.0, 0.5)
    row = L.evaluation(none.where("not actual")).head()
    assert (row.precision, row.recall) == (1.0, 1.0)


def test_ties_go_by_name(spark):
    scores = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "feature string, score double")
    assert [r.feature for r in S.best(scores, 2).orderBy("feature").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        S.pos_neg(scores, scores, 1, "SIDE")


def test_boosting_finds_the_separator(spark):
    y = [(i, int(i >= 6)) for i in range(12)]
    rows = [("s", i, "good", 1.0) for i in range(6, 12)] + [("s", i, "noise", float(i % 3)) for i in range(12)]
    picked = S.ada_boost(spark.createDataFrame(rows, LONG), spark.createDataFrame(y, "doc_id long, label int"), 3)
    assert picked[0][0] == "good" and len(picked) == 1


def test_agglomeration_keeps_all_features(spark):
    rows = [("s", i, f"f{j}", 1.0) for i in range(12) for j in range(4) if i % (j + 2) == 0]
    y = spark.createDataFrame([(i, int(i % 2)) for i in range(12)], "doc_id long, label int")
    best = spark.createDataFrame([(f"f{j}",) for j in range(4)], "feature string")
    out = C.agglomerated(spark.createDataFrame(rows, LONG), y, 2, best).collect()
    assert sorted(r.feature for r in out) == ["f0", "f1", "f2", "f3"] and len({r.cluster_id for r in out}) == 2


def test_nearest_centroid_ties(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0])], "id long, vec array<double>")
    c = spark.createDataFrame([(5, [1.0, 0.0]), (4, [-1.0, 0.0])], "cluster_id int, c array<double>")
    assert {r.id: r.cluster_id for r in C.nearest_centroid(p, c).collect()} == {1: 4, 2: 5}
