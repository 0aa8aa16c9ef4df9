"""Feature relevance against a two-valued label: histograms, information-gain splits, purity, stumps and MDLP."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values are compared in steps of one millionth, truncated toward zero.
STEP = 1_000_000


def quantised(value: Column) -> Column:
    return (value * STEP).cast("long")


def class_weights(labels: DataFrame) -> DataFrame:
    """One row n0, n1: documents (or their weight) of label 0 and 1."""
    w = F.col("weight") if "weight" in labels.columns else F.lit(1.0)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, w)), F.lit(0.0))
    return labels.agg(of(0).alias("n0"), of(1).alias("n1"))


def value_histogram(features: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, q, w0, w1: weight of both labels by quantised value, with absent values completed at zero.

    labels(doc_id, label 0/1[, weight]). Only present values are counted; the rest of each class is one row a feature.
    """
    w = F.col("weight") if "weight" in labels.columns else F.lit(1.0)
    of = lambda k: F.sum(F.when(F.col("label") == k, w).otherwise(0.0))
    seen = features.join(labels, "doc_id").groupBy("feature", quantised(F.col("value")).alias("q")).agg(of(0).alias("w0"), of(1).alias("w1"))
    sums = seen.groupBy("feature").agg(F.sum("w0").alias("s0"), F.sum("w1").alias("s1"))
    totals = F.broadcast(class_weights(labels))  # one row
    rest = sums.crossJoin(totals).select("feature", F.lit(0).cast("long").alias("q"), F.greatest(F.col("n0") - F.col("s0"), F.lit(0.0)).alias("w0"), F.greatest(F.col("n1") - F.col("s1"), F.lit(0.0)).alias("w1"))
    both = seen.unionByName(rest.where("w0 + w1 > 0"))
    return both.groupBy("feature", "q").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def entropy_weight(a: Column, b: Column) -> Column:
    """Entropy in bits times total weight."""
    return xlogx(a + b) - xlogx(a) - xlogx(b)


def _swept(hist: DataFrame) -> DataFrame:
    below = W.partitionBy("feature").orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("feature")
    return hist.select(
        "feature", "q", F.lead("q").over(W.partitionBy("feature").orderBy("q")).alias("nq"),
        F.sum("w0").over(below).alias("l0"), F.sum("w1").over(below).alias("l1"), F.sum("w0").over(whole).alias("t0"), F.sum("w1").over(whole).alias("t1"))


def binary_splits(hist: DataFrame) -> DataFrame:
    """feature, ig and cut (quantised) of the best binary split by information gain; equal gains take the lowest cut.
    Features with a single value have no row."""
    s = _swept(hist).where(F.col("nq").isNotNull())
    r0, r1 = F.col("t0") - F.col("l0"), F.col("t1") - F.col("l1")
    total = F.col("t0") + F.col("t1")
    gain = (entropy_weight(F.col("t0"), F.col("t1")) - entropy_weight(F.col("l0"), F.col("l1")) - entropy_weight(r0, r1)) / total
    cut = F.expr("(q + nq) div 2")
    best = s.withColumn("gain", F.round(gain, 9)).groupBy("feature").agg(F.max_by(F.struct("gain", cut.alias("cut")), F.struct("gain", -F.col("q"))).alias("b"))
    return best.select("feature", F.col("b.gain").alias("ig"), F.col("b.cut").alias("cut"))


def information_gain(features: DataFrame, labels: DataFrame) -> DataFrame:
    """feature and ig of every feature; 0 for those that cannot be split."""
    hist = value_histogram(features, labels)
    return hist.select("feature").distinct().join(binary_splits(hist), "feature", "left").select("feature", F.coalesce("ig", F.lit(0.0)).alias("ig"), "cut")


def label_contributions(hist: DataFrame, splits: DataFrame) -> DataFrame:
    """feature, ig0, ig1: the parts of the information gain that each label brings; they sum to it."""
    side = F.when(F.col("q") > F.col("cut"), 1).otherwise(0)
    parts = hist.join(splits.select("feature", "cut"), "feature").groupBy("feature", side.alias("side")).agg(F.sum("w0").alias("a"), F.sum("w1").alias("b"))
    part = lambda x, n: F.when(x > 0, -x * F.log2(x / n)).otherwise(0.0)
    inner = parts.groupBy("feature").agg(
        F.sum(part(F.col("a"), F.col("a") + F.col("b"))).alias("h0"), F.sum(part(F.col("b"), F.col("a") + F.col("b"))).alias("h1"), F.sum("a").alias("t0"), F.sum("b").alias("t1"))
    n = F.col("t0") + F.col("t1")
    return inner.select("feature", ((part(F.col("t0"), n) - F.col("h0")) / n).alias("ig0"), ((part(F.col("t1"), n) - F.col("h1")) / n).alias("ig1"))


def purity(hist: DataFrame, splits: DataFrame) -> DataFrame:
    """feature, pos and neg: class-balanced share of label 1 among values at or over the cut, and its complement; 0.5 without a cut."""
    joined = hist.join(splits.select("feature", "cut"), "feature", "left")
    up = F.col("cut").isNotNull() & (F.col("q") >= F.col("cut"))
    sums = joined.groupBy("feature").agg(
        F.sum("w0").alias("n0"), F.sum("w1").alias("n1"), F.sum(F.when(up, F.col("w1")).otherwise(0.0)).alias("p"), F.sum(F.when(up, F.col("w0")).otherwise(0.0)).alias("m"))
    balanced = F.col("p") * F.try_divide("n0", "n1")
    pos = F.coalesce(F.try_divide(balanced, balanced + F.col("m")), F.lit(0.5))
    return sums.select("feature", pos.alias("pos"), (1 - pos).alias("neg"))


def stumps(hist: DataFrame) -> DataFrame:
    """feature, loss, cut and high_positive of the decision stump with the least misclassified weight, lowest cut first."""
    s = _swept(hist).where(F.col("nq").isNotNull())
    high = F.col("l1") + F.col("t0") - F.col("l0")  # label 1 over the cut
    low = F.col("l0") + F.col("t1") - F.col("l1")
    rows = s.select("feature", "q", F.expr("(q + nq) div 2").alias("cut"), F.least(high, low).alias("loss"), (high <= low).alias("high_positive"))
    best = rows.groupBy("feature").agg(F.min_by(F.struct("loss", "cut", "high_positive"), F.struct("loss", "q")).alias("b"))
    return best.select("feature", "b.*")


def stump_gain(hist: DataFrame, stumps: DataFrame) -> DataFrame:
    """feature and gain: the information that a stump's cut brings, values on the cut below it."""
    side = (F.col("q") > F.col("cut")).cast("int").alias("side")
    parts = hist.join(stumps.select("feature", "cut"), "feature").groupBy("feature", side).agg(F.sum("w0").alias("a"), F.sum("w1").alias("b"))
    sums = parts.groupBy("feature").agg(F.sum(entropy_weight(F.col("a"), F.col("b"))).alias("inner"), F.sum("a").alias("t0"), F.sum("b").alias("t1"))
    return sums.select("feature", ((entropy_weight(F.col("t0"), F.col("t1")) - F.col("inner")) / (F.col("t0") + F.col("t1"))).alias("gain"))


def interval_entropy(hist: DataFrame, cuts: DataFrame) -> DataFrame:
    """feature and entropy, in bits, that is left once values are told apart by cuts(feature, cuts) only."""
    rows = hist.join(cuts.select("feature", "cuts"), "feature").groupBy("feature", interval_of(F.col("q"), F.col("cuts")).alias("interval"))
    parts = rows.agg(F.sum("w0").alias("a"), F.sum("w1").alias("b"))
    return parts.groupBy("feature").agg((F.sum(entropy_weight(F.col("a"), F.col("b"))) / F.sum(F.col("a") + F.col("b"))).alias("entropy"))


def mdlp_cuts(rows: list[tuple[int, float, float]], recursive: bool = True, first: bool = True) -> list[int]:
    """Cut points of one column by Fayyad and Irani (1993): the best split, always taken once, then both halves while the
    gain pays for its description. rows: (q, w0, w1) by q."""
    h = lambda a, b: sum(-x * math.log2(x / (a + b)) for x in (a, b) if x > 0)
    t0, t1 = sum(r[1] for r in rows), sum(r[2] for r in rows)
    n, best = t0 + t1, None
    l0 = l1 = 0.0
    for i in range(len(rows) - 1):
        l0, l1 = l0 + rows[i][1], l1 + rows[i][2]
        gain = (h(t0, t1) - h(l0, l1) - h(t0 - l0, t1 - l1)) / n
        if best is None or gain > best[0] + 1e-12:
            best = gain, i, (l0, l1)
    if best is None:
        return []
    gain, i, (a, b) = best
    kinds = lambda *w: sum(x > 0 for x in w)
    if not first:
        k, k1, k2 = kinds(t0, t1), kinds(a, b), kinds(t0 - a, t1 - b)
        e, e1, e2 = h(t0, t1) / n, h(a, b) / max(a + b, 1e-300), h(t0 - a, t1 - b) / max(n - a - b, 1e-300)
        if n <= 1 or gain <= (math.log2(n - 1) + math.log2(3**k - 2) - (k * e - k1 * e1 - k2 * e2)) / n:
            return []
    x, y = rows[i][0], rows[i + 1][0]
    cut = int((x + y) / 2)
    if not recursive:
        return [cut]
    return sorted([*mdlp_cuts(rows[: i + 1], True, False), cut, *mdlp_cuts(rows[i + 1 :], True, False)])


def mdlp(hist: DataFrame) -> DataFrame:
    """feature, ig and cuts of the recursive discretisation. A row of the kernel's input is one column's histogram, bounded by
    its distinct quantised values; columns go through in Arrow batches, as one pandas call each would cost more than its work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = lambda a, b: sum(-x * math.log2(x / (a + b)) for x in (a, b) if x > 0)
        for batch in batches:
            gains, all_cuts = [], []
            for cells in batch.column(1).to_pylist():
                rows = [(c["q"], c["w0"], c["w1"]) for c in cells]
                cuts = mdlp_cuts(rows)
                parts = [[0.0, 0.0] for _ in range(len(cuts) + 1)]
                for q, w0, w1 in rows:
                    part = parts[bisect_left(cuts, q)]  # a value on a cut belongs below it
                    part[0] += w0
                    part[1] += w1
                t0, t1 = sum(p[0] for p in parts), sum(p[1] for p in parts)
                gains.append((h(t0, t1) - sum(h(*p) for p in parts)) / (t0 + t1))
                all_cuts.append(cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gains, pa.float64()), pa.array(all_cuts, pa.list_(pa.int64()))], ["feature", "ig", "cuts"])

    columns = hist.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("q", "w0", "w1"))).alias("rows"))
    return columns.mapInArrow(run, "feature string, ig double, cuts array<long>")


def interval_of(q: Column, cuts: Column) -> Column:
    """Index of the interval of q among ascending cuts; a value on a cut belongs below it."""
    return F.size(F.filter(cuts, lambda c: q > c))


def interval_votes(hist: DataFrame, cuts: DataFrame) -> DataFrame:
    """feature, interval and vote (+1, -1 or 0): the majority sign of each interval of cuts(feature, cuts)."""
    rows = hist.join(cuts.select("feature", "cuts"), "feature").groupBy("feature", interval_of(F.col("q"), F.col("cuts")).alias("interval"))
    return rows.agg(F.signum(F.sum("w1") - F.sum("w0")).cast("int").alias("vote"))


def interval_classified(features: DataFrame, docs: DataFrame, feature: str, cuts: DataFrame, votes: DataFrame) -> DataFrame:
    """doc_id and predicted of docs(doc_id) by one feature's intervals, an absent value as 0 and no vote as false."""
    own = cuts.where(F.col("feature") == feature).select("cuts")
    value = docs.select("doc_id").join(features.where(F.col("feature") == feature).select("doc_id", "value"), "doc_id", "left")
    placed = value.crossJoin(F.broadcast(own)).select("doc_id", interval_of(quantised(F.coalesce("value", F.lit(0.0))), F.col("cuts")).alias("interval"))  # one row of cuts
    said = votes.where(F.col("feature") == feature).select("interval", "vote")
    return placed.join(said, "interval", "left").select("doc_id", F.coalesce(F.col("vote") > 0, F.lit(False)).alias("predicted"))


def relevance_report(features: DataFrame, labels: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Per feature: contributions of both labels (0 where nothing splits), purities and a description, by the first contribution descending."""
    hist = value_histogram(features, labels)
    splits = binary_splits(hist)
    rows = purity(hist, splits).join(label_contributions(hist, splits), "feature", "left").na.fill(0.0, ["ig0", "ig1"])
    rows = rows.select("feature", "ig0", "ig1", "pos", "neg")
    rows = rows.withColumn("description", F.col("feature")) if descriptions is None else rows.join(descriptions, "feature", "left")
    return rows.orderBy(F.desc("ig0"), "feature")


def cut_number(x: Column) -> Column:
    """A number's decimal form, cut to seven characters."""
    return F.substring(x.cast("string"), 1, 7)
