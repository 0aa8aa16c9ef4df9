"""Feature generators over one long table: (feature_set, doc_id, feature, value). fit reads training rows, transform all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import postings as P


# bag of words and n-grams

def corpus_counts(tokens: DataFrame) -> DataFrame:
    """token and its occurrences, of rows (doc_id, token), or of those of term_counts(), which bring their count n."""
    return tokens.groupBy("token").agg((F.sum("n") if "n" in tokens.columns else F.count("*")).alias("n"))


def term_statistics(counted: DataFrame) -> DataFrame:
    """token, its occurrences n and the documents df that have it, of the rows of term_counts()."""
    return counted.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


def bag_of_words(tokens: DataFrame, counts: DataFrame | None = None, threshold: int = 1, name: str = "bow") -> DataFrame:
    """Term frequencies of the tokens whose corpus count reaches the threshold; tokens as for corpus_counts()."""
    if "n" in tokens.columns:
        tf = tokens.select("doc_id", F.col("token").alias("feature"), F.col("n").cast("double").alias("value"))
    else:
        tf = tokens.groupBy("doc_id", F.col("token").alias("feature")).agg(F.count("*").cast("double").alias("value"))
    if counts is not None:
        kept = counts.where(F.col("n") >= threshold).select(F.col("token").alias("feature"))
        tf = tf.join(kept, "feature", "left_semi")
    return tf.select(F.lit(name).alias("feature_set"), "doc_id", "feature", "value")


@dataclass
class BagOfWords:
    """Tokens, stop words, stems, counts and n-grams up to max_ngram; one feature set a length (bow, bow2gram, ...)."""

    name: str = "bow"
    text: str = "text"
    max_ngram: int = 1
    threshold: int = 1
    stem: bool = True
    stop_words: DataFrame | None = None

    def grams(self, docs: DataFrame, n: int) -> DataFrame:
        return X.term_counts(docs, self.text, n, self.stop_words, self.stem)

    def fit(self, training: DataFrame) -> list[DataFrame]:
        return [corpus_counts(self.grams(training, n)) for n in range(1, self.max_ngram + 1)]

    def transform(self, docs: DataFrame, counts: list[DataFrame]) -> DataFrame:
        out = None
        for n, c in enumerate(counts, 1):
            part = bag_of_words(self.grams(docs, n), c, self.threshold, self.name if n == 1 else f"{self.name}{n}gram")
            out = part if out is None else out.unionByName(part)
        return out


# TF-IDF and range normalisation

def document_frequency(features: DataFrame) -> DataFrame:
    return features.groupBy("feature").agg(F.count("*").alias("df"))


def tfidf(features: DataFrame, df: DataFrame, n_docs: int | Column, scheme: str, post_norm: bool = False) -> DataFrame:
    """Values reweighted by a three-letter scheme: term n l a b L, document n t p, norm n c (of raw values, or of the weighted
    ones with post_norm). Features without a document frequency keep their raw value."""
    t, d, c = scheme
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    doc = W.partitionBy("doc_id")
    v = F.col("value")
    term = {
        "n": lambda: v,
        "l": lambda: F.when(v > 0, 1 + F.ln(v)).otherwise(0.0),
        "a": lambda: F.when(F.max("value").over(doc) > 0, 0.5 + 0.5 * v / F.max("value").over(doc)).otherwise(0.5),
        "b": lambda: F.when(v > 0.1, 1.0).otherwise(0.0),
        "L": lambda: F.when(v > 0, (1 + F.ln(v)) / (1 + F.ln(F.avg("value").over(doc)))).otherwise(0.0),
    }.get(t, lambda: F.lit(0.0))()
    idf = {
        "t": lambda: F.ln(n / F.col("df")),
        "p": lambda: F.when(n > F.col("df"), F.greatest(F.lit(0.0), F.ln((n - F.col("df")) / F.col("df")))).otherwise(0.0),
    }.get(d, lambda: F.lit(1.0))()
    raw_norm = F.sqrt(F.sum(v * v).over(doc)) if c == "c" and not post_norm else F.lit(1.0)
    rows = features.join(df, "feature", "left").withColumn("w", term * idf / raw_norm)
    if c == "c" and post_norm:
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc))
        rows = rows.withColumn("w", F.when(norm > 0, F.col("w") / norm).otherwise(0.0))
    return rows.withColumn("value", F.when(F.col("df").isNull(), v).otherwise(F.col("w"))).select(*features.columns)


def ranges(features: DataFrame) -> DataFrame:
    """feature, lo and hi, both reaching zero."""
    return features.groupBy("feature").agg(F.least(F.min("value"), F.lit(0.0)).alias("lo"), F.greatest(F.max("value"), F.lit(0.0)).alias("hi"))


def range_normalised(features: DataFrame, fitted: DataFrame) -> DataFrame:
    """(value - lo) / (hi - lo); 1 where a column was all zero, 0 for features not seen in training."""
    scaled = F.when(F.col("lo").isNull(), 0.0).when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return features.join(fitted, "feature", "left").withColumn("value", scaled).select(*features.columns)


# embeddings

def embedding_means(tokens: DataFrame, embeddings: DataFrame, name: str = "w2v") -> DataFrame:
    """Per document the mean vector of its tokens, one feature a dimension; unknown tokens count in the denominator."""
    means = P.vector_means(tokens, embeddings).select("doc_id", F.posexplode("mean").alias("dim", "value"))
    return means.select(F.lit(name).alias("feature_set"), "doc_id", F.col("dim").cast("string").alias("feature"), "value")


def dimension_stats(embeddings: DataFrame) -> DataFrame:
    """dim, mean and root of the summed squared deviations (not divided by their number)."""
    x = embeddings.select(F.posexplode("vec").alias("dim", "x"))
    return x.groupBy("dim").agg(F.avg("x").alias("mean"), F.sqrt(F.var_pop("x") * F.count("x")).alias("dev"))


def scaled_embeddings(embeddings: DataFrame, stats: DataFrame) -> DataFrame:
    """Vectors divided by their dimensions' deviations; the mean stays."""
    devs = F.broadcast(stats.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "dev"))), lambda s: s["dev"]).alias("devs")))  # one number a dimension
    return embeddings.crossJoin(devs).select("term", F.zip_with("vec", "devs", lambda a, b: F.when(b > 0, a / b).otherwise(a)).alias("vec"))


# explicit concepts

def concept_index(articles: DataFrame, prune: int | None = None) -> DataFrame:
    """token, concept_id and weight (1 + ln tf) ln(N/df) of article tokens(concept_id, token); prune keeps the heaviest of a token."""
    tf = articles.groupBy("concept_id", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = articles.agg(F.countDistinct("concept_id").alias("concepts"))  # one row
    rows = tf.join(df, "token").crossJoin(F.broadcast(n))
    rows = rows.select("token", "concept_id", ((1 + F.ln("tf")) * F.ln(F.col("concepts") / F.col("df"))).alias("weight")).where("weight > 0")
    if prune is None:
        return rows
    return rows.withColumn("r", F.row_number().over(W.partitionBy("token").orderBy(F.desc("weight"), "concept_id"))).where(F.col("r") <= prune).drop("r")


def concept_vectors(tokens: DataFrame, index: DataFrame, limit: int = 200) -> DataFrame:
    """doc_id, concept_id and weight: each document's `limit` heaviest concepts, ties to smaller ids."""
    return P.heaviest(tokens, index, limit)


def category_vectors(vectors: DataFrame, links: DataFrame, limit: int = 200) -> DataFrame:
    """doc_id, category and weight: concept weights rolled up along links(concept_id, category)."""
    sums = vectors.join(links, "concept_id").groupBy("doc_id", "category").agg(F.sum("weight").alias("weight"))
    order = W.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "category")
    return sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).drop("r")


def frequent_concepts(vectors: DataFrame, least: int = 3) -> DataFrame:
    """concept_id and df of the concepts of at least `least` documents."""
    return vectors.groupBy("concept_id").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def concept_descriptions(features: DataFrame, titles: DataFrame) -> DataFrame:
    """feature and description: the title's first 25 characters, or the name where there is none."""
    return features.select("feature").distinct().join(titles.select(F.col("concept_id").cast("string").alias("feature"), "title"), "feature", "left").select(
        "feature", F.coalesce(F.substring("title", 1, 25), F.col("feature")).alias("description"))


# clusters as features

def cluster_activation(features: DataFrame, members: DataFrame, combiner: str = "sum", name: str = "clusters") -> DataFrame:
    """Per document and cluster the sum or maximum of value times factor over its members; only positive values stay."""
    x = F.col("value") * F.col("factor")
    value = F.sum(x) if combiner == "sum" else F.greatest(F.max(x), F.lit(0.0))
    joined = features.select("doc_id", "feature", "value").join(members, "feature")
    rows = joined.groupBy("doc_id", "cluster_id").agg(value.alias("value")).where("value > 0")
    return rows.select(F.lit(name).alias("feature_set"), "doc_id", F.col("cluster_id").cast("string").alias("feature"), "value")
