"""Feature selectors: the best features by a relevance measure, and what they leave out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import relevance as R
from lexloom.session import stored


def best(scores: DataFrame, n: int, by: str = "score") -> DataFrame:
    """The n features with the highest score, equal scores by name (a top-n, not a full sort)."""
    return scores.orderBy(F.desc(by), "feature").limit(n)


def info_gain(features: DataFrame, labels: DataFrame, n: int, recursive: bool = False) -> DataFrame:
    hist = R.value_histogram(features, labels)
    scores = R.mdlp(hist).select("feature", F.round("ig", 9).alias("score")) if recursive else R.information_gain(features, labels).select("feature", F.col("ig").alias("score"))
    return best(scores, n)


def pos_neg(features: DataFrame, labels: DataFrame, n: int, side: str) -> DataFrame:
    if side.upper() not in ("POS", "NEG"):
        raise ValueError(f"{side} is neither POS nor NEG")
    hist = R.value_histogram(features, labels)
    return best(R.purity(hist, R.binary_splits(hist)).select("feature", F.col(side.lower()).alias("score")), n)


def rejected(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """All features less the chosen ones."""
    return features.select("feature").distinct().join(chosen.select("feature"), "feature", "left_anti")


def ada_boost(features: DataFrame, labels: DataFrame, rounds: int = 10, candidates: int = 10) -> list[tuple[str, float]]:
    """Features picked by AdaBoost over stumps, with their weights. Each round ranks stumps by weighted loss among the
    `candidates` of highest weighted gain, then raises the weight of what the best one misses."""
    features = stored(features.select("doc_id", "feature", "value"), "boost-features")  # every round reads it
    # document weights are a column that each round recomputes from labels; only one stump a round reaches the driver
    total = labels.count()
    weights = stored(labels.select("doc_id", "label", F.lit(1.0 / max(total, 1)).alias("weight")), "boost-weights")
    chosen: list[tuple[str, float]] = []
    for _ in range(rounds):
        hist = R.value_histogram(features, weights)
        near = best(R.binary_splits(hist).where("ig > 0").select("feature", F.col("ig").alias("score")), candidates)
        stump = R.stumps(hist.join(near.select("feature"), "feature", "left_semi")).orderBy("loss", "feature").head()
        if stump is None or stump.loss >= 0.5:
            break
        loss = max(stump.loss, 1e-12)
        alpha = 0.5 * math.log((1 - loss) / loss)
        chosen.append((stump.feature, alpha))
        if stump.loss < 1e-12:
            break
        own = features.where(F.col("feature") == stump.feature).select("doc_id", "value")
        high = R.quantised(F.coalesce("value", F.lit(0.0))) > stump.cut
        said = (high == F.lit(stump.high_positive)).cast("int")
        moved = weights.join(own, "doc_id", "left").select("doc_id", "label", (F.col("weight") * F.when(said == F.col("label"), math.exp(-alpha)).otherwise(math.exp(alpha))).alias("weight"))
        norm = moved.agg(F.sum("weight")).head()[0]
        weights = stored(moved.withColumn("weight", F.col("weight") / norm), "boost-weights")
    return chosen
