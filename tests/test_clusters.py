import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import clusters as C


def _agglomerated_plainly(columns, label, clusters, combiner):
    """The same greedy steps over whole columns in memory."""
    h = lambda a, b: sum(-x * math.log2(x / (a + b)) for x in (a, b) if x > 0)
    n0, n1 = label.count(0), label.count(1)

    def gain(column):
        by = {0.0: [0, 0]}
        for d, k in enumerate(label):
            by.setdefault(round(column.get(d, 0.0), 6), [0, 0])[k] += 1
        l0 = l1 = top = 0.0
        for v in sorted(by)[:-1]:
            l0, l1 = l0 + by[v][0], l1 + by[v][1]
            top = max(top, h(n0, n1) - h(l0, l1) - h(n0 - l0, n1 - l1))
        return top / (n0 + n1)

    def merge(a, b):
        return a | {d: a.get(d, 0.0) + v if combiner == "sum" else max(a.get(d, 0.0), v) for d, v in b.items()}

    held = [([f], c, gain(c)) for f, c in sorted(columns.items())]
    while len(held) > clusters:
        held.sort(key=lambda x: (x[2], x[0]))
        names, column, _ = held.pop(0)
        _, i, m = max(((gain(m := merge(column, c)) - g, -i, m) for i, (_, c, g) in enumerate(held)), key=lambda x: x[:2])
        held[-i] = (names + held[-i][0], m, gain(m))
    return [(i, f) for i, (names, *_) in enumerate(sorted(held, key=lambda x: min(x[0]))) for f in sorted(names)]


@pytest.mark.parametrize("combiner", ["sum", "max"])
def test_agglomeration_against_plain_columns(spark, monkeypatch, combiner):
    monkeypatch.setattr(C, "VALUES", 50)
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", None)  # no group holds all columns
    rng = np.random.default_rng(7)
    label = [int(x) for x in rng.integers(0, 2, 80)]
    columns = {f"f{j}": {d: float(rng.integers(1, 4)) for d in range(80) if rng.random() < 0.2 + 0.3 * label[d] * (j % 2)} for j in range(7)}
    features = spark.createDataFrame([("s", d, f, v) for f, c in columns.items() for d, v in c.items()], "feature_set string, doc_id long, feature string, value double")
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, label int")
    best = spark.createDataFrame([(f,) for f in columns], "feature string")
    got = [(r.cluster_id, r.feature) for r in C.agglomerated(features, labels, 3, best, combiner).collect()]
    assert got == _agglomerated_plainly(columns, label, 3, combiner)


def test_reweighting_takes_each_length_once(spark):
    points = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 0.0]), ("z", [0.0, 0.0])], "feature string, vec array<double>")
    members = points.select("feature", F.lit(0).alias("cluster_id"), F.lit(1.0).alias("factor"))
    c = np.array([4 / 3, 2 / 3])
    y = c * c / (c @ c)
    got = {r.feature: r.vec for r in C.reweighted(points, members).collect()}
    for f, v in (("a", np.array([1.0, 2.0])), ("b", np.array([3.0, 0.0])), ("z", np.zeros(2))):
        assert got[f] == pytest.approx(list(v * v / max(v @ v, 1e-300) * (1 - y / (2 * y.max()))))
    logical = C.reweighted(points, members)._jdf.queryExecution().optimizedPlan().toString()
    inner = logical[logical.index("zip_with") :].split("\n")[0]
    assert "aggregate(" not in inner and "array_max" not in inner


def test_branches_and_rounds_meet_their_points_without_a_join(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), [float(x) for x in rng.random(3)]) for i in range(120)]
    points = spark.createDataFrame(rows, "feature string, vec array<double>")
    found = C.hierarchical(points, 20)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.feature for r in found.collect()) == sorted(f for f, _ in rows)
    rounds = C.two_rounds(points, 4)
    plan = rounds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == plan.count("BroadcastHashJoin ") and "SortMergeJoin" not in plan
    assert sorted(r.feature for r in rounds.collect()) == sorted(f for f, _ in rows)
