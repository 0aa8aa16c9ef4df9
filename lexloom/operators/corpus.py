"""Corpus views: splits, lookups, names and edits of the long feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qualified(feature_set: str | Column = "feature_set", feature: str | Column = "feature") -> Column:
    return F.concat_ws("_", feature_set, feature)


def split_name(name: Column) -> tuple[Column, Column]:
    """Feature set and feature of a qualified name, parted at the first underscore."""
    return F.substring_index(name, "_", 1), F.regexp_extract(name, "^[^_]*_(.*)$", 1)


def id_after_last(name: Column) -> Column:
    return F.substring_index(name, "_", -1).cast("int")


def restricted(docs: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Documents with an id in ids(doc_id); all if None."""
    return docs if ids is None else docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def training(docs: DataFrame, is_training: Column) -> DataFrame:
    return docs.where(is_training)


def testing(docs: DataFrame, is_training: Column) -> DataFrame:
    return docs.where(~is_training)


def folds(docs: DataFrame, k: int, seed: int = 0, arithmetic: bool = False) -> DataFrame:
    """docs with a fold from 0 to k - 1, reproducible; arithmetic takes the id's remainder instead of a hash."""
    key = F.col("doc_id") + seed if arithmetic else F.xxhash64("doc_id", F.lit(seed))
    return docs.withColumn("fold", F.pmod(key, F.lit(k)).cast("int"))


def validation_split(docs: DataFrame, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(training, validation): each document falls into validation with the given chance, by a keyed hash."""
    in_validation = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return docs.where(~in_validation), docs.where(in_validation)


def document(docs: DataFrame, doc_id: int) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def feature_of(features: DataFrame, name: str) -> DataFrame:
    """Rows of one qualified feature; a name without underscore is an error."""
    feature_set, found, feature = name.partition("_")
    if not found:
        raise ValueError(f"{name} has no feature set")
    return features.where((F.col("feature_set") == feature_set) & (F.col("feature") == feature))


def without_feature(features: DataFrame, name: str) -> DataFrame:
    feature_set, _, feature = name.partition("_")
    return features.where(~((F.col("feature_set") == feature_set) & (F.col("feature") == feature)))


def without_set(features: DataFrame, feature_set: str) -> DataFrame:
    return features.where(F.col("feature_set") != feature_set)


def replaced_set(features: DataFrame, new: DataFrame, feature_set: str) -> DataFrame:
    """Generator output overwrites the feature set of its name."""
    return without_set(features, feature_set).unionByName(new)


def replaced_values(features: DataFrame, value: Column) -> DataFrame:
    return features.withColumn("value", value)


def feature_names(features: DataFrame, sets: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Distinct qualified names, of some sets and under a predicate."""
    rows = features if sets is None else features.where(F.col("feature_set").isin(sets))
    rows = rows if where is None else rows.where(where)
    return rows.select(qualified().alias("name")).distinct()


def classification_names(features: DataFrame, sets: DataFrame, rejected: DataFrame) -> DataFrame:
    """Names of the sets that classify (feature_sets: feature_set, used_for_classification) less the rejected(name)."""
    used = features.join(sets.where("used_for_classification"), "feature_set", "left_semi")
    return feature_names(used).join(rejected, "name", "left_anti")


def feature_set_names(features: DataFrame) -> DataFrame:
    return features.select("feature_set").distinct()


def class_rows(docs: DataFrame) -> DataFrame:
    """doc_id and class, a row each."""
    return docs.select("doc_id", F.explode("classes").alias("class"))


def topic_labels(docs: DataFrame, topic: str) -> DataFrame:
    """doc_id and label (boolean): one topic against the rest."""
    return docs.select("doc_id", F.array_contains("classes", topic).alias("label"))


def rejected_by_any(*rejections: DataFrame) -> DataFrame:
    """A feature is rejected if any selector rejects it."""
    return reduce(DataFrame.unionByName, rejections).distinct()


def complement(all_names: DataFrame, best: DataFrame) -> DataFrame:
    return all_names.join(best, all_names.columns, "left_anti")


def feature_pairs(a: DataFrame, b: DataFrame, combiner: str = "sum") -> DataFrame:
    """Two sparse columns (doc_id, value) merged by sum or maximum, absent as 0."""
    value = F.sum("value") if combiner == "sum" else F.max("value")
    return a.unionByName(b).groupBy("doc_id").agg(value.alias("value"))
