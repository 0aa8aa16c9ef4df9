"""Vectors, classifiers, evaluation, topic models and exports."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vocabulary(names: DataFrame) -> DataFrame:
    """feature and idx from 0 by name: positions within ranges are offset by the counts of those before, so no task sees all."""
    ranged = names.select("feature").distinct().repartitionByRange("feature").sortWithinPartitions("feature")
    rdd = ranged.rdd.map(lambda r: r.feature).zipWithIndex()
    return names.sparkSession.createDataFrame(rdd, "feature string, idx long")


def sparse_rows(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id and cells, an array of (idx, value) by idx."""
    joined = features.join(vocab, "feature").where("value <> 0")
    return joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("cells"))


def vectors(docs: DataFrame, features: DataFrame, vocab: DataFrame, size: int) -> DataFrame:
    """docs with a sparse vector column features; documents without features get the zero vector.

    The vector's parts are built by Spark; Arrow batches pass through unchanged and only take the vector's type."""
    cells = F.coalesce("cells", F.array().cast("array<struct<idx:bigint,value:double>>"))
    parts = (F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.transform(cells, lambda c: c["idx"].cast("int")).alias("indices"), F.transform(cells, lambda c: c["value"]).alias("values"))
    rows = docs.join(sparse_rows(features, vocab), "doc_id", "left").select(*docs.columns, F.struct(*parts).alias("features"))
    return rows.mapInArrow(lambda batches: batches, T.StructType([*docs.schema, T.StructField("features", VectorUDT())]))


def libsvm_lines(docs: DataFrame, features: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id and line: +1 or -1 by label and index:value pairs from 1."""
    rows = docs.select("doc_id", "label").join(sparse_rows(features, vocab), "doc_id", "left")
    cells = F.transform(F.coalesce("cells", F.array().cast("array<struct<idx:bigint,value:double>>")), lambda c: F.concat((c["idx"] + 1).cast("string"), F.lit(":"), c["value"].cast("string")))
    return rows.select("doc_id", F.concat_ws(" ", F.when(F.col("label") == 1, "+1").otherwise("-1"), F.array_join(cells, " ")).alias("line"))


def dense_rows(docs: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """One column a feature, absent as 0, and the class as negative or positive: the attribute-relation form."""
    wide = features.groupBy("doc_id").pivot("feature", names).agg(F.first("value"))
    target = F.when(F.col("label") == 1, "positive").otherwise("negative").alias("__target")
    return docs.select("doc_id", target).join(wide, "doc_id", "left").na.fill(0.0)


def train_svm(data: DataFrame, c: float = 0.1, weight: str | None = None, iterations: int = 50) -> LinearSVCModel:
    """Linear soft-margin classifier of data(features, label); the regularisation matches a cost of c a row."""
    data = data.persist()  # every iteration reads it
    n = max(data.count(), 1)
    svm = LinearSVC(regParam=1.0 / (n * c), standardization=False, maxIter=iterations, tol=1e-3)
    return (svm.setWeightCol(weight) if weight else svm).fit(data)


def predictions(model: LinearSVCModel, data: DataFrame) -> DataFrame:
    return model.transform(data).select("doc_id", (F.col("prediction") > 0).alias("predicted"), (F.col("label") > 0).alias("actual"))


def evaluation(rows: DataFrame) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1 and accuracy of predictions(predicted, actual). Precision is 1 if nothing was
    predicted, recall 1 if nothing is relevant, f1 0 if both are 0."""
    p, a = F.col("predicted"), F.col("actual")
    counts = rows.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.try_divide("tp", F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.try_divide("tp", F.col("tp") + F.col("fn")))
    out = counts.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.withColumns({"f1": f1, "accuracy": F.try_divide(F.col("tp") + F.col("tn"), n)})


def break_even(scored: DataFrame) -> DataFrame:
    """One row bep: the mean of precision and recall where, by descending score, they differ least. scored(score, actual).

    Counts are taken by distinct score first, so the ordered pass sees one row a score."""
    by = scored.groupBy("score").agg(F.count_if("actual").alias("pos"), F.count("*").alias("n"))
    down = W.orderBy(F.desc("score"))
    sums = by.select("score", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("picked"), F.sum("pos").over(W.partitionBy()).alias("all"))
    rows = sums.where("all > 0").select((F.col("tp") / F.col("picked")).alias("p"), (F.col("tp") / F.col("all")).alias("r"), "picked")
    return rows.orderBy(F.round(F.abs(F.col("p") - F.col("r")), 12), "picked").limit(1).select(((F.col("p") + F.col("r")) / 2).alias("bep"))


def lda_lines(tokens: DataFrame) -> DataFrame:
    """doc_id and line: the document's tokens (doc_id, pos, token) in order, blank-separated."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"])
    return tokens.groupBy("doc_id").agg(F.array_join(words, " ").alias("line"))


def concept_lines(tokens: DataFrame, index: DataFrame, top: int = 10) -> DataFrame:
    """As lda_lines, each token replaced by the ids C<id> of its heaviest concepts in index(token, concept_id, weight)."""
    order = W.partitionBy("token").orderBy(F.desc("weight"), "concept_id")
    best = index.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).groupBy("token")
    ids = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "concept_id"))), lambda c: F.concat(F.lit("C"), c["concept_id"].cast("string"))), " ").alias("ids"))
    return lda_lines(tokens.join(ids, "token").select("doc_id", "pos", F.col("ids").alias("token")))


def write_lda(lines: DataFrame, path: str) -> None:
    """A line count and then the lines; the count is its own small file, first by name."""
    lines.agg(F.count("*").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/0-count")
    lines.select("line").write.mode("overwrite").text(f"{path}/1-documents")


def topics(tokens: DataFrame, k: int, iterations: int = 20, seed: int = 1, words: int = 200) -> DataFrame:
    """topic, word, weight: a topic model with the customary priors 50/k and 0.1."""
    docs = tokens.groupBy("doc_id").agg(F.collect_list("token").alias("words")).persist()
    counted = CountVectorizer(inputCol="words", outputCol="features", minDF=2).fit(docs)
    model = LDA(k=k, maxIter=iterations, seed=seed, docConcentration=[max(50 // k, 1) + 0.0], topicConcentration=0.1, optimizer="online").fit(counted.transform(docs).persist())
    names = tokens.sparkSession.createDataFrame(list(enumerate(counted.vocabulary)), "termIndices int, word string")  # at most CountVectorizer's 2**18
    rows = model.describeTopics(words).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t")).select("topic", "t.*")
    return rows.join(names, "termIndices").select("topic", "word", F.col("termWeights").alias("weight"))
