"""Clustering of features: k-means variants, agglomeration by information gain, assignment and statistics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.session import stored

MAX_ITERATIONS, DELTA, BRANCHES = 25, 0.01, 16
#: Values of all columns that one step of the agglomeration holds at a time.
VALUES = 2_000_000


def _vectors(points: DataFrame) -> DataFrame:
    """Points as ML vectors, kept while the model's iterations read them again and again; spilt to disk if they don't fit."""
    return points.select("feature", array_to_vector("vec").alias("features")).persist()


def _assigned(points: DataFrame, k: int, cosine: bool, seed: int) -> DataFrame:
    """feature, features and prediction: the cached points beside their clusters, so that no join brings the two together."""
    data = _vectors(points.where(F.exists("vec", lambda x: x != 0)) if cosine else points)
    return KMeans(k=k, maxIter=MAX_ITERATIONS, tol=DELTA, seed=seed, distanceMeasure="cosine" if cosine else "euclidean").fit(data).transform(data)


def k_means(points: DataFrame, k: int, cosine: bool = True, seed: int = 1) -> DataFrame:
    """cluster_id, feature and factor 1 of points(feature, vec); zero vectors take no part in cosine clusters."""
    return _assigned(points, k, cosine, seed).select(F.col("prediction").alias("cluster_id"), "feature", F.lit(1.0).alias("factor"))


def hierarchical(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k-means into BRANCHES branches, each bisected on into its share of the k clusters, by its number of points."""
    if k <= BRANCHES:
        return k_means(points, k, cosine=False, seed=seed)
    rows = _assigned(points, BRANCHES, False, seed).select("feature", "features", F.col("prediction").alias("branch"))
    sizes = {r.branch: r["count"] for r in rows.groupBy("branch").count().collect()}  # at most BRANCHES rows
    total = sum(sizes.values())
    shares = {b: max(1, k * n // total) for b, n in sizes.items()}
    for b in sorted(sizes, key=lambda b: (k * sizes[b] / total - shares[b], b), reverse=True)[: max(0, k - sum(shares.values()))]:
        shares[b] += 1
    parts, first = [], 0
    for b in sorted(shares):
        own = rows.where(F.col("branch") == b)
        if shares[b] == 1:
            members = own.select(F.lit(0).alias("cluster_id"), "feature")
        else:
            data = own.select("feature", "features").persist()
            members = BisectingKMeans(k=shares[b], maxIter=MAX_ITERATIONS, seed=seed).fit(data).transform(data).select(F.col("prediction").alias("cluster_id"), "feature")
        parts.append(members.select((F.col("cluster_id") + first).alias("cluster_id"), "feature", F.lit(1.0).alias("factor")))
        first += shares[b]
    return reduce(DataFrame.unionByName, parts)


def several(points: DataFrame, ks: list[int], cluster=k_means) -> DataFrame:
    """One clustering a k, ids renumbered consecutively."""
    parts = [cluster(points, k).withColumn("cluster_id", F.col("cluster_id") + offset) for k, offset in zip(ks, np.cumsum([0, *ks[:-1]]).tolist())]
    return reduce(DataFrame.unionByName, parts)


def reweighted(points: DataFrame, members: DataFrame) -> DataFrame:
    """Points(feature, vec) drawn away from the main dimensions of the centroid of their cluster in members(feature, cluster_id)."""
    return _reweighted(points.join(members.select("feature", "cluster_id"), "feature"))


def _reweighted(joined: DataFrame) -> DataFrame:
    """feature and vec of joined(feature, vec, cluster_id), with c the centroid of a cluster: v_d becomes v_d^2/|v|^2 (1 - y_d/(2 max y)), y_d = c_d^2/|c|^2."""
    square = lambda v: F.greatest(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), F.lit(1e-300))
    dims = joined.select("cluster_id", F.posexplode("vec").alias("d", "x")).groupBy("cluster_id", "d").agg(F.avg("x").alias("c"))
    centroids = dims.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("cv"))
    # lengths are bound as arguments of a lambda, so that they are taken once a vector and not once a component
    given = lambda x, f: F.transform(F.array(x), f)[0]
    y = given(square(F.col("cv")), lambda n: F.transform("cv", lambda c: c * c / n))
    most = given(F.col("y"), lambda y: F.greatest(F.array_max(y), F.lit(1e-300)))
    centroids = centroids.withColumn("y", y)
    rows = joined.join(F.broadcast(centroids.select("cluster_id", "y")), "cluster_id")  # one vector a cluster
    vec = given(F.struct(square(F.col("vec")).alias("n"), most.alias("m")), lambda s: F.zip_with("vec", "y", lambda v, y: v * v / s["n"] * (1 - y / (2 * s["m"]))))
    return rows.select("feature", vec.alias("vec"))


def two_rounds(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k-means, then again on the reweighted points."""
    first = _assigned(points, k, True, seed).select("feature", vector_to_array("features").alias("vec"), F.col("prediction").alias("cluster_id"))
    return k_means(_reweighted(first), k, seed=seed)


def document_points(features: DataFrame, hashed: int = 256) -> DataFrame:
    """feature and vec: each feature's values over documents, folded into `hashed` dimensions by the document's hash, so that
    vectors neither grow with the corpus nor need its ids dense."""
    dims = features.groupBy("feature", F.pmod(F.xxhash64("doc_id"), F.lit(hashed)).cast("int").alias("d")).agg(F.sum("value").alias("x"))
    cells = dims.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))
    return cells.select("feature", F.transform(F.sequence(F.lit(0), F.lit(hashed - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("vec"))


def term_points(articles: DataFrame, hashed: int = 256) -> DataFrame:
    """feature (concept) and vec: relative term frequencies of articles(concept_id, token), folded by the token's hash."""
    tf = articles.groupBy("concept_id", "token").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("concept_id"))
    rows = tf.select(F.xxhash64("token").alias("doc_id"), F.col("concept_id").cast("string").alias("feature"), share.alias("value"))
    return document_points(rows, hashed)


def link_points(links: DataFrame, hashed: int = 256) -> DataFrame:
    """feature (concept) and vec: its links(from_id, to_id), folded by the target's hash."""
    rows = links.select(F.col("to_id").alias("doc_id"), F.col("from_id").cast("string").alias("feature"), F.lit(1.0).alias("value"))
    return document_points(rows, hashed)


def concept_points(embeddings: DataFrame, features: DataFrame, least: int = 3, inlinks: DataFrame | None = None, least_links: int = 100) -> DataFrame:
    """feature and vec of embeddings(term, vec) whose term is the id of a concept of at least `least` documents and, where
    inlinks(id, n) is given, of `least_links` links."""
    ids = features.groupBy("feature").agg(F.count("*").alias("df")).where(F.col("df") >= least).select(F.expr("try_cast(feature as long)").alias("id"))
    if inlinks is not None:
        ids = ids.join(inlinks.where(F.col("n") >= least_links).select("id"), "id", "left_semi")
    rows = embeddings.withColumn("id", F.expr("try_cast(term as long)")).where("id is not null")
    return rows.join(ids, "id", "left_semi").select(F.col("id").cast("string").alias("feature"), "vec")


def nearest_centroid(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """id and cluster_id of the nearest of k centroids(cluster_id, c), equal distances to the smaller id. The k centroids
    are one array row beside every point: no pair is emitted."""
    every = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "c"))).alias("all"))
    distance = lambda c: F.aggregate(F.zip_with("vec", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    tried = F.transform("all", lambda c: F.struct(F.round(distance(c["c"]), 9).alias("d"), c["cluster_id"].alias("cluster_id")))
    return points.crossJoin(F.broadcast(every)).select("id", F.array_min(tried)["cluster_id"].alias("cluster_id"), F.array_min(tried)["d"].alias("distance"))


def cluster_statistics(members: DataFrame, relevance: DataFrame) -> DataFrame:
    """cluster_id, mean and variance (population) of the members' negative relevance, without the undecided 0.5."""
    rows = members.join(relevance.where("neg <> 0.5"), "feature")
    return rows.groupBy("cluster_id").agg(F.avg("neg").alias("mean"), F.var_pop("neg").alias("variance"), F.count("*").alias("n"))


def upper_medians(relevance: DataFrame) -> DataFrame:
    """One row d1, d2: upper medians of positive relevance over and under 0.5; null where a side is empty."""
    side = F.when(F.col("pos") > 0.5, 1).when(F.col("pos") < 0.5, 2)
    # by value first, so the ordered pass sees one row a distinct value
    counts = relevance.withColumn("side", side).where("side is not null").groupBy("side", "pos").agg(F.count("*").alias("n"))
    order = W.partitionBy("side").orderBy("pos")
    rows = counts.select("side", "pos", F.sum("n").over(order).alias("upto"), F.sum("n").over(W.partitionBy("side")).alias("all"))
    hit = rows.where(F.col("upto") > F.expr("all div 2")).groupBy("side").agg(F.min("pos").alias("m"))
    return hit.agg(F.max(F.when(F.col("side") == 1, F.col("m"))).alias("d1"), F.max(F.when(F.col("side") == 2, F.col("m"))).alias("d2"))


def agglomerated(features: DataFrame, labels: DataFrame, clusters: int, best: DataFrame, combiner: str = "sum") -> DataFrame:
    """Greedy agglomeration: of the `best` features, pairs whose merged column keeps the most information gain are joined
    until `clusters` are left.

    The features are a top-n, so names and merges fit the driver. Columns stay where their documents are: each step counts, in Arrow
    batches, the values that the weakest column makes with every other one, and only a gain a pair reaches the driver."""
    chosen = features.join(best.select("feature"), "feature", "left_semi").join(labels, "doc_id")
    totals = labels.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).head()
    chosen = stored(chosen.select("feature", "doc_id", "value", "label"), "agglomerated-columns")
    spark = features.sparkSession
    names = sorted(r.feature for r in chosen.select("feature").distinct().collect())
    place = spark.createDataFrame(list(zip(names, range(len(names)))), "feature string, slot int")
    cells = F.collect_list(F.struct("slot", F.col("value").cast("double").alias("value")))
    rows = stored(chosen.join(F.broadcast(place), "feature").groupBy("doc_id").agg(F.first("label").cast("int").alias("label"), cells.alias("cells")).select("label", "cells"), "agglomerated-rows")

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        old = np.nan_to_num(a)  # not a number: absent
        return np.where(np.isnan(b), a, old + b if combiner == "sum" else np.maximum(old, b))

    def gain(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h = lambda a, b: sum(-x * math.log2(x / (a + b)) for x in (a, b) if x > 0)
        by: dict[float, list[float]] = {0.0: [totals.n0, totals.n1]}
        for v, w0, w1 in zip(*(table.column(c).to_pylist() for c in ("value", "w0", "w1"))):
            cell = by.setdefault(round(v, 6), [0, 0])
            for i, w in enumerate((w0, w1)):
                by[0.0][i] -= w
                cell[i] += w
        l0 = l1 = 0.0
        top, whole = 0.0, h(totals.n0, totals.n1)
        for v in sorted(by)[:-1]:
            l0, l1 = l0 + by[v][0], l1 + by[v][1]
            top = max(top, whole - h(l0, l1) - h(totals.n0 - l0, totals.n1 - l1))
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "gain": [top / max(totals.n0 + totals.n1, 1)]})

    def gains(merged: list[tuple[int, int]], slots: list[int], weakest: int | None = None) -> dict[int, float]:
        """Of every slot after the merges so far, beside the weakest one where it is given, the information gain."""

        def run(batches):
            for batch in batches:
                step = max(VALUES // max(len(names), 1), 1)
                for first in range(0, len(batch), step):
                    part = batch.slice(first, step)
                    label, lists = part.column(0).to_numpy(), part.column(1)
                    flat, at = lists.flatten(), np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                    columns = np.full((len(names), len(part)), np.nan)
                    columns[flat.field(0).to_numpy(), at] = flat.field(1).to_numpy()
                    for a, b in merged:
                        columns[b] = merge(columns[a], columns[b])
                    for slot in slots:
                        column = columns[slot] if weakest is None else merge(columns[weakest], columns[slot])
                        some = np.nan_to_num(column) != 0
                        values, key = np.unique(column[some], return_inverse=True)
                        w = [np.bincount(key[label[some] == k], minlength=len(values)) for k in (0, 1)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), slot, np.int32)), pa.array(values), *map(pa.array, w)], ["slot", "value", "w0", "w1"])

        counts = rows.mapInArrow(run, "slot int, value double, w0 long, w1 long").groupBy("slot", "value").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
        found = {r.slot: r.gain for r in counts.groupBy("slot").applyInArrow(gain, "slot int, gain double").collect()}  # one row a slot
        return {slot: found.get(slot, 0.0) for slot in slots}

    merged: list[tuple[int, int]] = []
    first = gains(merged, list(range(len(names)))) if names else {}
    held = [([f], i, first[i]) for i, f in enumerate(names)]
    while len(held) > clusters:
        held.sort(key=lambda x: (x[2], x[0]))
        own, weakest, _ = held.pop(0)  # the weakest goes where it costs least
        if not held:
            held = [(own, weakest, 0.0)]
            break
        found = gains(merged, [slot for _, slot, _ in held], weakest)
        _, i = max(((found[slot] - g, -i) for i, (_, slot, g) in enumerate(held)))
        others, slot, _ = held[-i]
        held[-i] = (own + others, slot, found[slot])
        merged.append((weakest, slot))
    out = [(i, f, 1.0) for i, (group, *_) in enumerate(sorted(held, key=lambda x: min(x[0]))) for f in sorted(group)]
    return spark.createDataFrame(out, "cluster_id int, feature string, factor double")


def most_similar(missing: DataFrame, known: DataFrame) -> DataFrame:
    """feature, replacement and similarity: for each missing feature the known one whose terms overlap most (Jaccard).
    Both are (feature, term); only pairs that share a term meet."""
    a = missing.select("feature", "term").distinct()
    b = known.select(F.col("feature").alias("replacement"), "term").distinct()
    shared = a.join(b, "term").where("feature <> replacement").groupBy("feature", "replacement").agg(F.count("*").alias("both"))
    sized = shared.join(a.groupBy("feature").agg(F.count("*").alias("na")), "feature").join(b.groupBy("replacement").agg(F.count("*").alias("nb")), "replacement")
    rows = sized.select("feature", "replacement", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))
    order = W.partitionBy("feature").orderBy(F.desc(F.round("similarity", 9)), "replacement")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
