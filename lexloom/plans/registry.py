"""Registered queries over the reference feature operators, each with equal SQL where SQL can say it.

Fixtures: body is documents.text; classes are lang_<lang>, quality and toxic; documents with doc_id % 5 <> 0 train; embeddings
serve as term vectors, dealt to tokens by MD5 so that half of the tokens have none; benchmark items serve as concept articles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.tags import tag_rows
from lexloom.operators import clusters as C
from lexloom.operators import corpus as D
from lexloom.operators import features as G
from lexloom.operators import learn as L
from lexloom.operators import relevance as R
from lexloom.operators import selectors as S
from lexloom.plans import config, small_cases
from lexloom.session import shared_path, stored, table
from lexloom.sources import readers
from lexloom.streaming import scorer

STOP = "the of and to in de la que le el der die und".split()
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | small_cases.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | small_cases.SQL


# shared inputs

def docs(spark, sf):
    return table(spark, sf, "documents")


def stop_words(spark):
    return spark.createDataFrame([(w,) for w in STOP], "token string")


def tokens(spark, sf):
    return X.valid(X.exploded_tokens(docs(spark, sf)), stop_words(spark))


def training(rows):
    return rows.where(F.col("doc_id") % 5 != 0)


def counted(spark, sf, documents=None):
    """doc_id, token and n of the documents, or of some of them."""
    return X.term_counts(docs(spark, sf) if documents is None else documents, stop_words=stop_words(spark))


def vocabulary(counts, name="vocabulary"):
    """token, n and df over training documents of the tokens that occur three times there, written once: a small table whose size is known."""
    return stored(G.term_statistics(training(counts)).where("n >= 3"), name)


def bow(spark, sf, threshold=3):
    t = counted(spark, sf)
    return G.bag_of_words(t, vocabulary(t), threshold)


def quality_labels(spark, sf):
    """doc_id and label of the labelled training documents."""
    return training(table(spark, sf, "labels").where("quality is not null")).select("doc_id", F.col("quality").alias("label"))


def labelled_bow(spark, sf):
    """The bag of the labelled training documents, written once: selection, vectors and models read it again and again."""
    labelled = docs(spark, sf).join(quality_labels(spark, sf).select("doc_id"), "doc_id", "left_semi")
    return stored(G.bag_of_words(counted(spark, sf, labelled), vocabulary(counted(spark, sf)), 3), "labelled-bow")


def dimensions(spark, sf):
    """Embedding components as features of their vectors."""
    e = table(spark, sf, "embeddings")
    return e.select(F.lit("dims").alias("feature_set"), F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("d", "x")).select(
        "feature_set", "doc_id", F.col("d").cast("string").alias("feature"), F.col("x").cast("double").alias("value"))


def term_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    slots = F.lit(2 * e.count())
    terms = counted(spark, sf).select(F.col("token").alias("term")).distinct()
    slot = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % slots
    return terms.withColumn("vec_id", slot).join(e, "vec_id").select("term", "vec")


def articles(spark, sf):
    a = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return X.valid(X.exploded_tokens(a), stop_words(spark)).select(F.col("doc_id").alias("concept_id"), "token")


def esa(spark, sf, limit=10):
    return G.concept_vectors(counted(spark, sf), G.concept_index(articles(spark, sf)), limit)


def category_links(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("concept_id"), (F.col("item_id") % 5).alias("category"))


def classes(spark, sf):
    lab = table(spark, sf, "labels")
    d = docs(spark, sf).join(lab, "doc_id", "left")
    names = F.array(F.concat(F.lit("lang_"), "lang"), F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    return d.select("doc_id", F.array_compact(names).alias("classes"))


def token_members(spark, sf):
    """Clusters of tokens: by length."""
    t = counted(spark, sf).select(F.col("token").alias("feature")).distinct()
    return t.select((F.char_length("feature") % 16).cast("int").alias("cluster_id"), "feature", F.lit(0.5).alias("factor"))


_STOPS = ", ".join(f"'{w}'" for w in STOP)
TOK = rf"""tok AS (
  SELECT doc_id, token FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\W+')) AS token FROM documents)
  WHERE token <> '' AND NOT regexp_matches(token, '[0-9]') AND token NOT IN ({_STOPS}))"""
VOCAB = "vocab AS (SELECT token FROM tok WHERE doc_id % 5 <> 0 GROUP BY token HAVING count(*) >= 3)"
BOW = f"{TOK}, {VOCAB}, bow AS (SELECT doc_id, token AS feature, count(*)::DOUBLE AS value FROM tok WHERE token IN (SELECT token FROM vocab) GROUP BY ALL)"
LAB = "lab AS (SELECT doc_id, quality AS label FROM labels WHERE doc_id % 5 <> 0 AND quality IS NOT NULL)"
HIST = f"""{BOW}, {LAB},
tot AS (SELECT count(*) FILTER (label = 0)::DOUBLE AS n0, count(*) FILTER (label = 1)::DOUBLE AS n1 FROM lab),
seen AS (SELECT feature, trunc(value * 1000000)::BIGINT AS q, count(*) FILTER (label = 0)::DOUBLE AS w0, count(*) FILTER (label = 1)::DOUBLE AS w1 FROM bow JOIN lab USING (doc_id) GROUP BY ALL),
hist AS (SELECT feature, q, sum(w0) AS w0, sum(w1) AS w1 FROM (SELECT * FROM seen UNION ALL
  SELECT feature, 0::BIGINT, greatest(n0 - sum(w0), 0), greatest(n1 - sum(w1), 0) FROM seen, tot GROUP BY feature, n0, n1 HAVING n0 - sum(w0) + n1 - sum(w1) > 0) GROUP BY ALL)"""
XL = "CASE WHEN {0} > 0 THEN ({0}) * log2({0}) ELSE 0 END"


def _h(a: str, b: str) -> str:
    return f"({XL.format(f'({a} + {b})')} - {XL.format(f'({a})')} - {XL.format(f'({b})')})"


SPLIT = f"""{HIST},
swept AS (SELECT feature, q, lead(q) OVER w AS nq, sum(w0) OVER w AS l0, sum(w1) OVER w AS l1, sum(w0) OVER (PARTITION BY feature) AS t0, sum(w1) OVER (PARTITION BY feature) AS t1
  FROM hist WINDOW w AS (PARTITION BY feature ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gains AS (SELECT feature, q, ((q + nq) // 2)::BIGINT AS cut, l0, l1, t0, t1, round(({_h('t0', 't1')} - {_h('l0', 'l1')} - {_h('t0 - l0', 't1 - l1')}) / (t0 + t1), 9) AS ig FROM swept WHERE nq IS NOT NULL),
split AS (SELECT feature, ig, cut FROM gains QUALIFY row_number() OVER (PARTITION BY feature ORDER BY ig DESC, q) = 1)"""


# tokens, counts, n-grams

@query("bow_tf", f"WITH {BOW} SELECT doc_id, feature, value FROM bow")
def _(spark, sf):
    return bow(spark, sf).select("doc_id", "feature", "value")


@query("bow_corpus_count", f"WITH {TOK} SELECT token, count(*) AS n FROM tok WHERE doc_id % 5 <> 0 GROUP BY token HAVING count(*) >= 3")
def _(spark, sf):
    return G.corpus_counts(training(counted(spark, sf))).where("n >= 3")


@query("bow_df", f"WITH {BOW} SELECT feature, count(*) AS df FROM bow WHERE doc_id % 5 <> 0 GROUP BY feature")
def _(spark, sf):
    return G.document_frequency(training(bow(spark, sf)))


@query("bow_ngram2", rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\W+'), lambda t: t <> '' AND NOT regexp_matches(t, '[0-9]') AND NOT list_contains([{_STOPS}], t)) AS w FROM documents),
g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS feature FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w WHERE len(w) > 1)),
keep AS (SELECT feature FROM g WHERE doc_id % 5 <> 0 GROUP BY feature HAVING count(*) >= 3)
SELECT doc_id, feature, count(*)::DOUBLE AS value FROM g WHERE feature IN (SELECT feature FROM keep) GROUP BY ALL""")
def _(spark, sf):
    g = G.BagOfWords(max_ngram=2, threshold=3, stem=False, stop_words=stop_words(spark))
    d = docs(spark, sf).select("doc_id", "text")
    pairs = g.grams(d, 2)
    return G.bag_of_words(pairs, vocabulary(pairs), 3).select("doc_id", "feature", "value")


@query("bow_stemmed")
def _(spark, sf):
    t = X.term_counts(docs(spark, sf), stop_words=stop_words(spark), stem=True)
    return G.bag_of_words(t, vocabulary(t), 3).select("doc_id", "feature", "value")


@query("stopword_anti", rf"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\W+')) AS token FROM documents) WHERE token <> '' AND token NOT IN ({_STOPS}) GROUP BY doc_id")
def _(spark, sf):
    t = X.exploded_tokens(docs(spark, sf)).join(stop_words(spark), "token", "left_anti")
    return t.groupBy("doc_id").agg(F.count("*").alias("n"))


# TF-IDF, ranges

_TERM = {"n": "value", "l": "1 + ln(value)", "a": "0.5::DOUBLE + 0.5::DOUBLE * value / max(value) OVER d", "b": "CASE WHEN value > 0.1 THEN 1.0::DOUBLE ELSE 0 END", "L": "(1 + ln(value)) / (1 + ln(avg(value) OVER d))", "x": "0.0::DOUBLE"}
_IDF = {"n": "1", "t": "ln(n / df)", "p": "CASE WHEN n > df THEN greatest(0.0::DOUBLE, ln((n - df) / df)) ELSE 0.0::DOUBLE END"}
_NORM = {"n": "1", "c": "sqrt(sum(value * value) OVER d)"}


def _weighted(spark, sf, scheme, post_norm=False):
    t = counted(spark, sf)
    kept = vocabulary(t)
    df = kept.select(F.col("token").alias("feature"), "df")  # a kept token's rows are all in the bag
    return G.tfidf(G.bag_of_words(t, kept, 3).select("doc_id", "feature", "value"), df, training(docs(spark, sf)).count(), scheme, post_norm)


def _tfidf(scheme):
    t, d, c = scheme
    sql = f"""WITH {BOW}, df AS (SELECT feature, count(*)::DOUBLE AS df FROM bow WHERE doc_id % 5 <> 0 GROUP BY feature), nn AS (SELECT count(*)::DOUBLE AS n FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, feature, round(CASE WHEN df IS NULL THEN value ELSE ({_TERM[t]}) * ({_IDF[d]}) / ({_NORM[c]}) END, 6) AS value FROM bow LEFT JOIN df USING (feature), nn WINDOW d AS (PARTITION BY doc_id)"""

    @query(f"tfidf_{scheme if scheme != 'Ltc' else 'avg_Ltc'}", sql)
    def _(spark, sf):
        return _weighted(spark, sf, scheme).withColumn("value", F.round("value", 6))


for _s in ("nnn", "ntc", "ltc", "apc", "bnn", "Ltc", "lpn", "anc", "btc", "xtn"):
    _tfidf(_s)


@query("tfidf_post_norm")
def _(spark, sf):
    return _weighted(spark, sf, "ltc", post_norm=True)


_DIMS = "dims AS (SELECT vec_id AS doc_id, (i - 1)::VARCHAR AS feature, embedding[i]::DOUBLE AS value FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"


@query("range_norm", f"""WITH {_DIMS}, r AS (SELECT feature, least(min(value), 0.0) AS lo, greatest(max(value), 0.0) AS hi FROM dims WHERE doc_id % 5 <> 0 GROUP BY feature)
SELECT doc_id, feature, round(CASE WHEN lo IS NULL THEN 0.0 WHEN hi = lo THEN 1.0 ELSE (value - lo) / (hi - lo) END, 6)::DOUBLE AS value FROM dims LEFT JOIN r USING (feature)""")
def _(spark, sf):
    d = dimensions(spark, sf)
    return G.range_normalised(d, G.ranges(training(d))).select("doc_id", "feature", F.round("value", 6).alias("value"))


# embeddings

_TERMS = f"""{TOK}, terms AS (SELECT token, embedding FROM (SELECT DISTINCT token, ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT 2 * count(*) FROM embeddings) AS vec_id FROM tok) JOIN embeddings USING (vec_id))"""


@query("w2v_doc_mean", f"""WITH {_TERMS}, total AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
x AS (SELECT doc_id, (i - 1)::VARCHAR AS feature, sum(embedding[i]::DOUBLE * c) AS s FROM (SELECT doc_id, c, embedding, unnest(generate_series(1, 64)) AS i FROM (SELECT doc_id, token, count(*) AS c FROM tok GROUP BY ALL) JOIN terms USING (token)) GROUP BY ALL)
SELECT doc_id, feature, CASE WHEN round(s / n, 6) = 0 THEN 0.0::DOUBLE ELSE round(s / n, 6) END AS value FROM x JOIN total USING (doc_id)""")
def _(spark, sf):
    value = F.round("value", 6)
    unsigned = F.when(value == 0, 0.0).otherwise(value)  # negative zero as zero
    return G.embedding_means(counted(spark, sf), term_vectors(spark, sf)).select("doc_id", "feature", unsigned.alias("value"))


@query("emb_dim_stats", f"WITH {_DIMS} SELECT feature::INTEGER AS dim, round(avg(value), 6) AS mean, round(sqrt(var_pop(value) * count(*)), 6) AS dev FROM dims GROUP BY feature")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return G.dimension_stats(e).select("dim", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"))


@query("emb_scaled", f"""WITH {_DIMS}, s AS (SELECT feature, sqrt(var_pop(value) * count(*)) AS dev FROM dims GROUP BY feature)
SELECT doc_id, round(sum(value / dev), 5) AS total FROM dims JOIN s USING (feature) GROUP BY doc_id""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("term"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    s = G.scaled_embeddings(e, G.dimension_stats(e))
    return s.select(F.col("term").alias("doc_id"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# splits, labels, names

@query("train_split", "SELECT doc_id, doc_id % 5 <> 0 AS is_training FROM documents")
def _(spark, sf):
    d = docs(spark, sf)
    is_training = F.col("doc_id") % 5 != 0
    return D.training(d, is_training).select("doc_id", F.lit(True).alias("is_training")).union(D.testing(d, is_training).select("doc_id", F.lit(False)))


@query("cv_folds", "SELECT doc_id, (doc_id % 5)::INTEGER AS fold FROM documents")
def _(spark, sf):
    return D.folds(docs(spark, sf), 5, arithmetic=True).select("doc_id", "fold")


@query("cv_folds_hashed")
def _(spark, sf):
    return D.folds(training(docs(spark, sf)), 5, seed=7).select("doc_id", "fold")


@query("class_counts", f"WITH {LAB} SELECT count(*) FILTER (label = 0)::DOUBLE AS n0, count(*) FILTER (label = 1)::DOUBLE AS n1 FROM lab")
def _(spark, sf):
    return R.class_weights(quality_labels(spark, sf))


_CLASSES = """cl AS (SELECT doc_id, 'lang_' || lang AS class FROM documents UNION ALL SELECT doc_id, 'quality' FROM documents JOIN labels USING (doc_id) WHERE quality = 1
UNION ALL SELECT doc_id, 'toxic' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""


@query("class_explode", f"WITH {_CLASSES} SELECT doc_id, class FROM cl")
def _(spark, sf):
    return D.class_rows(classes(spark, sf))


@query("topic_labels", f"WITH {_CLASSES} SELECT doc_id, bool_or(class = 'toxic') AS label FROM cl GROUP BY doc_id")
def _(spark, sf):
    return D.topic_labels(classes(spark, sf), "toxic")


@query("feature_names", f"WITH {BOW} SELECT DISTINCT 'bow_' || feature AS name FROM bow WHERE length(feature) > 3")
def _(spark, sf):
    return D.feature_names(bow(spark, sf), ["bow"], F.char_length("feature") > 3)


@query("feature_set_names", "SELECT * FROM (VALUES ('bow'), ('dims')) t(feature_set)")
def _(spark, sf):
    return D.feature_set_names(bow(spark, sf).unionByName(dimensions(spark, sf)))


@query("feature_lookup", f"WITH {BOW} SELECT doc_id, value FROM bow WHERE feature = 'that'")
def _(spark, sf):
    return D.feature_of(bow(spark, sf), "bow_that").select("doc_id", "value")


@query("feature_removed", f"WITH {BOW} SELECT doc_id, sum(value) AS total FROM bow WHERE feature <> 'that' GROUP BY doc_id")
def _(spark, sf):
    return D.without_feature(bow(spark, sf), "bow_that").groupBy("doc_id").agg(F.sum("value").alias("total"))


@query("qualified_split", f"WITH {BOW} SELECT DISTINCT 'bow' AS feature_set, feature FROM bow")
def _(spark, sf):
    names = D.feature_names(bow(spark, sf))
    feature_set, feature = D.split_name(F.col("name"))
    return names.select(feature_set.alias("feature_set"), feature.alias("feature")).distinct()


@query("restricted_corpus", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    return D.restricted(docs(spark, sf), table(spark, sf, "labels").where("toxic = 1")).select("doc_id")


@query("summary100", "SELECT doc_id, '---' || ' ' || substr(coalesce(text, '---'), 1, 100) AS summary FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", readers.summary(F.lit(None).cast("string"), F.col("text")).alias("summary"))


# relevance and selection

@query("value_hist", f"WITH {HIST} SELECT feature, q, w0, w1 FROM hist")
def _(spark, sf):
    return R.value_histogram(labelled_bow(spark, sf), quality_labels(spark, sf))


@query("ig_binary_split", f"WITH {SPLIT} SELECT DISTINCT h.feature, round(coalesce(ig, 0), 6) AS ig FROM hist h LEFT JOIN split USING (feature)")
def _(spark, sf):
    return R.information_gain(labelled_bow(spark, sf), quality_labels(spark, sf)).select("feature", F.round("ig", 6).alias("ig"))


def _splits(spark, sf):
    hist = R.value_histogram(labelled_bow(spark, sf), quality_labels(spark, sf))
    return hist, R.binary_splits(hist)


_SIDES = """sides AS (SELECT feature, sum(w0) AS a, sum(w1) AS b FROM hist JOIN split USING (feature) GROUP BY feature, q > cut)"""


@query("ig_label_contrib", f"""WITH {SPLIT}, {_SIDES},
parts AS (SELECT feature, sum(CASE WHEN a > 0 THEN -a * log2(a / (a + b)) ELSE 0 END) AS h0, sum(CASE WHEN b > 0 THEN -b * log2(b / (a + b)) ELSE 0 END) AS h1, sum(a) AS t0, sum(b) AS t1 FROM sides GROUP BY feature)
SELECT feature, round((CASE WHEN t0 > 0 THEN -t0 * log2(t0 / (t0 + t1)) ELSE 0 END - h0) / (t0 + t1), 6) AS ig0, round((CASE WHEN t1 > 0 THEN -t1 * log2(t1 / (t0 + t1)) ELSE 0 END - h1) / (t0 + t1), 6) AS ig1 FROM parts""")
def _(spark, sf):
    hist, splits = _splits(spark, sf)
    return R.label_contributions(hist, splits).select("feature", F.round("ig0", 6).alias("ig0"), F.round("ig1", 6).alias("ig1"))


_PURITY = """purity AS (SELECT feature, coalesce(x / nullif(x + m, 0), 0.5)::DOUBLE AS pos FROM (
  SELECT feature, p * n0 / nullif(n1, 0) AS x, m FROM (SELECT h.feature, sum(w0) AS n0, sum(w1) AS n1, coalesce(sum(w1) FILTER (q >= cut), 0) AS p, coalesce(sum(w0) FILTER (q >= cut), 0) AS m FROM hist h LEFT JOIN split s ON h.feature = s.feature GROUP BY h.feature)))"""


@query("posneg_purity", f"WITH {SPLIT}, {_PURITY} SELECT feature, round(pos, 6) AS pos, round(1 - pos, 6) AS neg FROM purity")
def _(spark, sf):
    return R.purity(*_splits(spark, sf)).select("feature", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"))


_TOP = "top AS (SELECT DISTINCT feature, coalesce(ig, 0) AS score FROM (SELECT DISTINCT feature FROM hist) LEFT JOIN split USING (feature) ORDER BY score DESC, feature LIMIT 100)"


@query("topk_features", f"WITH {SPLIT}, {_TOP} SELECT feature, round(score, 6) AS score FROM top")
def _(spark, sf):
    return S.info_gain(labelled_bow(spark, sf), quality_labels(spark, sf), 100).select("feature", F.round("score", 6).alias("score"))


@query("filtered_features", f"WITH {SPLIT}, {_TOP} SELECT DISTINCT feature FROM hist WHERE feature NOT IN (SELECT feature FROM top)")
def _(spark, sf):
    b = labelled_bow(spark, sf)
    return S.rejected(b, S.info_gain(b, quality_labels(spark, sf), 100))


@query("selector_union", f"""WITH {SPLIT}, {_TOP}, {_PURITY}, best AS (SELECT feature FROM purity ORDER BY pos DESC, feature LIMIT 100)
SELECT DISTINCT feature FROM hist WHERE feature NOT IN (SELECT feature FROM top) OR feature NOT IN (SELECT feature FROM best)""")
def _(spark, sf):
    b, y = labelled_bow(spark, sf), quality_labels(spark, sf)
    return D.rejected_by_any(S.rejected(b, S.info_gain(b, y, 100)), S.rejected(b, S.pos_neg(b, y, 100, "POS")))


@query("classification_features", f"""WITH {SPLIT}, {_TOP} SELECT DISTINCT 'bow_' || feature AS name FROM hist WHERE feature IN (SELECT feature FROM top)""")
def _(spark, sf):
    b, y = labelled_bow(spark, sf), quality_labels(spark, sf)
    sets = spark.createDataFrame([("bow", True), ("source", False)], "feature_set string, used_for_classification boolean")
    rejected = S.rejected(b, S.info_gain(b, y, 100)).select(F.concat(F.lit("bow_"), "feature").alias("name"))
    return D.classification_names(b, sets, rejected)


@query("stump_split", f"""WITH {SPLIT}, s AS (SELECT feature, q, cut, least(l1 + t0 - l0, l0 + t1 - l1) AS loss, l1 + t0 - l0 <= l0 + t1 - l1 AS high_positive FROM gains)
SELECT feature, loss, cut, high_positive FROM s QUALIFY row_number() OVER (PARTITION BY feature ORDER BY loss, q) = 1""")
def _(spark, sf):
    return R.stumps(R.value_histogram(labelled_bow(spark, sf), quality_labels(spark, sf)))


@query("stump_gain", f"""WITH {SPLIT}, s AS (SELECT feature, cut FROM (SELECT feature, q, cut, least(l1 + t0 - l0, l0 + t1 - l1) AS loss FROM gains) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY loss, q) = 1),
p AS (SELECT feature, sum(w0) AS a, sum(w1) AS b FROM hist JOIN s USING (feature) GROUP BY feature, q > cut), z AS (SELECT feature, sum({_h('a', 'b')}) AS inn, sum(a) AS t0, sum(b) AS t1 FROM p GROUP BY feature)
SELECT feature, round(({_h('t0', 't1')} - inn) / (t0 + t1), 6) AS gain FROM z""")
def _(spark, sf):
    hist, _ = _splits(spark, sf)
    return R.stump_gain(hist, R.stumps(hist)).select("feature", F.round("gain", 6).alias("gain"))


@query("interval_entropy", f"""WITH {SPLIT}, p AS (SELECT feature, sum(w0) AS a, sum(w1) AS b FROM hist JOIN split USING (feature) GROUP BY feature, q > cut)
SELECT feature, round(sum({_h('a', 'b')}) / sum(a + b), 6) AS entropy FROM p GROUP BY feature""")
def _(spark, sf):
    hist, splits = _splits(spark, sf)
    return R.interval_entropy(hist, splits.select("feature", F.array("cut").alias("cuts"))).select("feature", F.round("entropy", 6).alias("entropy"))


@query("interval_classified", f"""WITH {SPLIT}, side AS (SELECT q > cut AS up, sum(w1) > sum(w0) AS pos FROM hist JOIN split USING (feature) WHERE feature = 'that' GROUP BY ALL),
v AS (SELECT d.doc_id, coalesce(value, 0) AS value FROM documents d LEFT JOIN (SELECT * FROM bow WHERE feature = 'that') b USING (doc_id))
SELECT doc_id, coalesce(pos, false) AS predicted FROM v, (SELECT cut FROM split WHERE feature = 'that') LEFT JOIN side ON up = (trunc(value * 1000000)::BIGINT > cut)""")
def _(spark, sf):
    hist, splits = _splits(spark, sf)
    cuts = splits.select("feature", F.array("cut").alias("cuts"))
    return R.interval_classified(bow(spark, sf), docs(spark, sf), "that", cuts, R.interval_votes(hist, cuts))


@query("interval_votes", f"WITH {SPLIT}, {_SIDES.replace('GROUP BY feature, q > cut', 'GROUP BY feature, q > cut').replace('SELECT feature, sum', 'SELECT feature, (q > cut)::INTEGER AS interval, sum')} SELECT feature, interval, sign(b - a)::INTEGER AS vote FROM sides")
def _(spark, sf):
    hist, splits = _splits(spark, sf)
    return R.interval_votes(hist, splits.select("feature", F.array("cut").alias("cuts")))


@query("relevance_report", f"""SELECT feature, coalesce(ig0, 0)::DOUBLE AS ig0, coalesce(ig1, 0)::DOUBLE AS ig1, pos, neg, feature AS description
FROM ({_SQL["posneg_purity"]}) LEFT JOIN ({_SQL["ig_label_contrib"]}) USING (feature)""")
def _(spark, sf):
    rows = R.relevance_report(labelled_bow(spark, sf), quality_labels(spark, sf))
    return rows.select("feature", *(F.round(c, 6).alias(c) for c in ("ig0", "ig1", "pos", "neg")), "description")


@query("mdlp_ig")
def _(spark, sf):
    return R.mdlp(R.value_histogram(labelled_bow(spark, sf), quality_labels(spark, sf)))


@query("sample_weight_hist", f"""WITH {BOW}, {LAB}, w AS (SELECT doc_id, label, 1 + doc_id % 3 AS weight FROM lab)
SELECT feature, sum(weight) FILTER (label = 1)::DOUBLE AS w1 FROM bow JOIN w USING (doc_id) GROUP BY feature HAVING w1 IS NOT NULL""")
def _(spark, sf):
    y = quality_labels(spark, sf).withColumn("weight", (1 + F.col("doc_id") % 3).cast("double"))
    return R.value_histogram(labelled_bow(spark, sf), y).where("q <> 0").groupBy("feature").agg(F.sum("w1").alias("w1")).where("w1 > 0")


# concepts

_ESA = f"""{TOK}, art AS (SELECT concept_id, token FROM (SELECT item_id AS concept_id, unnest(string_split_regex(lower(text), '\\W+')) AS token FROM benchmark)
  WHERE token <> '' AND NOT regexp_matches(token, '[0-9]') AND token NOT IN ({_STOPS})),
tf AS (SELECT concept_id, token, count(*) AS tf FROM art GROUP BY ALL), cdf AS (SELECT token, count(*) AS df FROM tf GROUP BY token), nc AS (SELECT count(DISTINCT concept_id) AS n FROM art),
idx AS (SELECT token, concept_id, (1 + ln(tf)) * ln(n::DOUBLE / df) AS weight FROM tf JOIN cdf USING (token), nc WHERE df < n),
vec AS (SELECT doc_id, concept_id, sum(c * weight) AS weight FROM (SELECT doc_id, token, count(*) AS c FROM tok GROUP BY ALL) JOIN idx USING (token) GROUP BY ALL),
esa AS (SELECT * FROM vec QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, concept_id) <= 10)"""


@query("esa_doc_concepts", f"WITH {_ESA} SELECT doc_id, concept_id, round(weight, 5) AS weight FROM esa")
def _(spark, sf):
    return esa(spark, sf).select("doc_id", "concept_id", F.round("weight", 5).alias("weight"))


@query("esa_categories", f"WITH {_ESA} SELECT doc_id, concept_id % 5 AS category, round(sum(weight), 5) AS weight FROM esa GROUP BY ALL")
def _(spark, sf):
    return G.category_vectors(esa(spark, sf), category_links(spark, sf)).select("doc_id", "category", F.round("weight", 5).alias("weight"))


@query("concept_df_having", f"WITH {_ESA} SELECT concept_id, count(*) AS df FROM esa GROUP BY concept_id HAVING count(*) >= 3")
def _(spark, sf):
    return G.frequent_concepts(esa(spark, sf))


@query("concept_descriptions", f"WITH {_ESA} SELECT DISTINCT e.concept_id::VARCHAR AS feature, coalesce(substr(text, 1, 25), e.concept_id::VARCHAR) AS description FROM esa e LEFT JOIN (SELECT * FROM benchmark WHERE item_id % 2 = 0) b ON item_id = concept_id")
def _(spark, sf):
    titles = table(spark, sf, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("concept_id"), F.col("text").alias("title"))
    return G.concept_descriptions(esa(spark, sf).select(F.col("concept_id").cast("string").alias("feature")), titles)


@query("page_lookup", f"WITH {TOK} SELECT token AS term, max(item_id) AS page_id FROM (SELECT DISTINCT token FROM tok) JOIN (SELECT item_id, lower(string_split(text, ' ')[1]) AS title FROM benchmark) ON title = token GROUP BY token")
def _(spark, sf):
    pages = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lower(F.split("text", " ")[0]).alias("title_stemmed"))
    return readers.page_ids(counted(spark, sf).select(F.col("token").alias("term")), pages)


@query("category_links", "SELECT item_id AS concept_id, item_id % 5 AS category FROM benchmark UNION ALL SELECT item_id, 100 + item_id % 3 FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    links = b.select(F.col("item_id").alias("from_id"), (F.col("item_id") % 5).alias("to_id")).union(b.select("item_id", 100 + F.col("item_id") % 3))
    return readers.categories_of(b.select(F.col("item_id").alias("concept_id")), links)


@query("article_term_frequency", f"WITH {_ESA} SELECT concept_id, token, round(tf::DOUBLE / sum(tf) OVER (PARTITION BY concept_id), 6) AS share FROM tf")
def _(spark, sf):
    tf = articles(spark, sf).groupBy("concept_id", "token").agg(F.count("*").alias("n"))
    return tf.select("concept_id", "token", F.round(F.col("n") / F.sum("n").over(W.partitionBy("concept_id")), 6).alias("share"))


# clusters

def _cluster(combiner):
    agg = "sum(value * 0.5)" if combiner == "sum" else "max(value * 0.5)"

    @query(f"cluster_{combiner}", f"WITH {BOW} SELECT doc_id, (length(feature) % 16)::VARCHAR AS feature, {agg}::DOUBLE AS value FROM bow GROUP BY ALL")
    def _(spark, sf):
        return G.cluster_activation(bow(spark, sf), token_members(spark, sf), combiner).select("doc_id", "feature", "value")


_cluster("sum")
_cluster("max")


@query("merged_columns", f"WITH {BOW} SELECT doc_id, sum(value) AS value FROM bow WHERE feature IN ('that', 'this') GROUP BY doc_id")
def _(spark, sf):
    b = bow(spark, sf)
    one = lambda f: D.feature_of(b, f"bow_{f}").select("doc_id", "value")
    return D.feature_pairs(one("that"), one("this"))


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


@query("nearest_centroid", f"""WITH dims AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
c AS (SELECT label AS cluster_id, i, avg(x) AS c FROM dims GROUP BY ALL),
d AS (SELECT vec_id AS id, cluster_id, round(sum((x - c) * (x - c)), 9) AS distance FROM dims JOIN c USING (i) GROUP BY ALL)
SELECT id, cluster_id, round(distance, 4) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster_id) = 1""")
def _(spark, sf):
    p = _points(spark, sf)
    dims = p.select(F.col("label").alias("cluster_id"), F.posexplode("vec").alias("d", "x")).groupBy("cluster_id", "d").agg(F.avg("x").alias("c"))
    centroids = dims.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("c"))
    return C.nearest_centroid(p, centroids).withColumn("distance", F.round("distance", 4))


@query("cluster_stats", f"""WITH {SPLIT}, {_PURITY} SELECT (length(feature) % 16)::INTEGER AS cluster_id, round(avg(1 - pos), 6) AS mean, round(var_pop(1 - pos), 6) AS variance, count(*) AS n FROM purity WHERE 1 - pos <> 0.5 GROUP BY ALL""")
def _(spark, sf):
    s = C.cluster_statistics(token_members(spark, sf), R.purity(*_splits(spark, sf)))
    return s.select("cluster_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "n")


@query("upper_median", f"""WITH {SPLIT}, {_PURITY}, r AS (SELECT pos, pos > 0.5 AS up, row_number() OVER (PARTITION BY pos > 0.5 ORDER BY pos) AS k, count(*) OVER (PARTITION BY pos > 0.5) AS n FROM purity WHERE pos <> 0.5)
SELECT round(max(pos) FILTER (up), 6) AS d1, round(max(pos) FILTER (NOT up), 6) AS d2 FROM r WHERE k = n // 2 + 1""")
def _(spark, sf):
    return C.upper_medians(R.purity(*_splits(spark, sf))).select(F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("similar_feature", f"""WITH {_ESA}, a AS (SELECT concept_id AS feature, token AS term FROM tf WHERE concept_id % 2 = 0), b AS (SELECT concept_id AS replacement, token AS term FROM tf WHERE concept_id % 2 = 1),
s AS (SELECT feature, replacement, count(*) AS common FROM a JOIN b USING (term) GROUP BY ALL), j AS (SELECT feature, replacement, common::DOUBLE / (na + nb - common) AS similarity FROM s JOIN (SELECT feature, count(*) AS na FROM a GROUP BY ALL) USING (feature) JOIN (SELECT replacement, count(*) AS nb FROM b GROUP BY ALL) USING (replacement))
SELECT feature, replacement, round(similarity, 6) AS similarity FROM j QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(similarity, 9) DESC, replacement) = 1""")
def _(spark, sf):
    t = articles(spark, sf).select(F.col("concept_id").alias("feature"), F.col("token").alias("term"))
    return C.most_similar(t.where("feature % 2 = 0"), t.where("feature % 2 = 1")).withColumn("similarity", F.round("similarity", 6))


def _feature_points(spark, sf):
    return _points(spark, sf).select(F.col("id").cast("string").alias("feature"), "vec")


@query("kmeans_cosine")
def _(spark, sf):
    return C.k_means(_feature_points(spark, sf), 8)


@query("kmeans_several_k")
def _(spark, sf):
    return C.several(_feature_points(spark, sf), [4, 8])


@query("kmeans_two_rounds")
def _(spark, sf):
    return C.two_rounds(_feature_points(spark, sf), 8)


@query("kmeans_hierarchical")
def _(spark, sf):
    return C.hierarchical(_feature_points(spark, sf), 24)


@query("cluster_by_documents")
def _(spark, sf):
    vectors = esa(spark, sf).select("doc_id", F.col("concept_id").cast("string").alias("feature"), F.col("weight").alias("value"))
    return C.k_means(C.document_points(vectors), 4)


@query("cluster_by_terms")
def _(spark, sf):
    return C.k_means(C.term_points(articles(spark, sf)), 4)


@query("cluster_by_links")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    links = b.select(F.col("item_id").alias("from_id"), (F.col("item_id") % 7).alias("to_id"))
    return C.k_means(C.link_points(links), 4)


@query("agglomerated")
def _(spark, sf):
    b, y = labelled_bow(spark, sf), quality_labels(spark, sf)
    return C.agglomerated(b, y, 10, S.info_gain(b, y, 40))


# vectors, classifiers, exports

def _confusion(spark, sf):
    lab = table(spark, sf, "labels").where("quality is not null")
    return docs(spark, sf).join(lab, "doc_id").select("doc_id", (F.col("n_chars") % 3 != 0).alias("predicted"), (F.col("quality") == 1).alias("actual"), (F.col("n_chars") % 97).alias("score"))


_PRED = "pred AS (SELECT doc_id, n_chars % 3 <> 0 AS p, quality = 1 AS a, n_chars % 97 AS score FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


@query("confusion_prf", f"""WITH {_PRED}, c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (NOT p AND a) AS fn FROM pred),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END AS re FROM c)
SELECT tp, fp, tn, fn, round(pr, 6)::DOUBLE AS precision, round(re, 6)::DOUBLE AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6)::DOUBLE AS f1, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy FROM r""")
def _(spark, sf):
    e = L.evaluation(_confusion(spark, sf))
    return e.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy")})


@query("break_even", f"""WITH {_PRED}, s AS (SELECT score, count(*) FILTER (a) AS pos, count(*) AS n FROM pred GROUP BY score),
c AS (SELECT sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS picked, sum(pos) OVER () AS al FROM s)
SELECT round((tp::DOUBLE / picked + tp::DOUBLE / al) / 2, 6) AS bep FROM c ORDER BY round(abs(tp::DOUBLE / picked - tp::DOUBLE / al), 12), picked LIMIT 1""")
def _(spark, sf):
    return L.break_even(_confusion(spark, sf)).select(F.round("bep", 6).alias("bep"))


def _chosen(spark, sf, n=200):
    b, y = labelled_bow(spark, sf), quality_labels(spark, sf)
    return b, y, S.info_gain(b, y, n)


@query("libsvm_rows", f"""WITH {SPLIT}, {_TOP}, v AS (SELECT feature, row_number() OVER (ORDER BY feature) AS idx FROM top)
SELECT l.doc_id, CASE WHEN label = 1 THEN '+1' ELSE '-1' END || ' ' || coalesce(string_agg(idx || ':' || value::VARCHAR, ' ' ORDER BY idx), '') AS line FROM lab l LEFT JOIN (SELECT doc_id, idx, value FROM bow JOIN v USING (feature)) x USING (doc_id) GROUP BY l.doc_id, label""")
def _(spark, sf):
    b, y, best = _chosen(spark, sf, 100)
    return L.libsvm_lines(y, b, L.vocabulary(best))


@query("sparse_rows", f"""WITH {SPLIT}, {_TOP}, v AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM top)
SELECT doc_id, string_agg(idx || '=' || value::VARCHAR, ',' ORDER BY idx) AS cells FROM bow JOIN v USING (feature) GROUP BY doc_id""")
def _(spark, sf):
    b, _, best = _chosen(spark, sf, 100)
    rows = L.sparse_rows(bow(spark, sf), L.vocabulary(best))
    return rows.select("doc_id", F.array_join(F.transform("cells", lambda c: F.concat(c["idx"].cast("string"), F.lit("="), c["value"].cast("string"))), ",").alias("cells"))


@query("dense_rows", f"""WITH {BOW}, {LAB} SELECT l.doc_id, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS __target, coalesce(sum(value) FILTER (feature = 'that'), 0)::DOUBLE AS "that", coalesce(sum(value) FILTER (feature = 'this'), 0)::DOUBLE AS "this"
FROM lab l LEFT JOIN bow USING (doc_id) GROUP BY ALL""")
def _(spark, sf):
    return L.dense_rows(quality_labels(spark, sf), labelled_bow(spark, sf), ["that", "this"])


@query("svm_predict")
def _(spark, sf):
    b, y, best = _chosen(spark, sf)
    vocab = L.vocabulary(best).persist()
    size = vocab.count()
    data = L.vectors(y, b, vocab, size)
    return L.predictions(L.train_svm(data), data)


@query("svm_weighted")
def _(spark, sf):
    b, y, best = _chosen(spark, sf, 50)
    vocab = L.vocabulary(best).persist()
    data = L.vectors(y.withColumn("weight", (1 + F.col("doc_id") % 3).cast("double")), b, vocab, vocab.count())
    return L.predictions(L.train_svm(data, weight="weight", iterations=20), data)


@query("adaboost_features")
def _(spark, sf):
    b, y, best = _chosen(spark, sf, 50)
    picked = S.ada_boost(b.join(best.select("feature"), "feature", "left_semi"), y, rounds=3)
    return spark.createDataFrame(picked, "feature string, alpha double")


@query("lda_corpus", rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\W+'), lambda t: t <> '' AND NOT regexp_matches(t, '[0-9]') AND NOT list_contains([{_STOPS}], t)) AS w FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, array_to_string(w, ' ') AS line FROM w WHERE len(w) > 0""")
def _(spark, sf):
    return L.lda_lines(training(tokens(spark, sf)))


@query("lda_concepts")
def _(spark, sf):
    return L.concept_lines(training(tokens(spark, sf)), G.concept_index(articles(spark, sf)))


@query("lda_topics")
def _(spark, sf):
    return L.topics(training(tokens(spark, sf)), 4, iterations=3, words=10)


# sources, over literal records

_OHSUMED = [".I 1\n.U\n91000001\n.M\nAdult; Heart/*PH; Human.\n.T\nA short title.\n.W\nAn abstract.", "2\n.U\n90000002\n.T\nNo topics", "3\n.U\n91000003\n.M\nChild; Child/*SU.\n.T\nTies\n.W\n"]


@query("ohsumed_parse", "SELECT * FROM (VALUES (1, 'A short title.', 'An abstract.', 'Adult,Heart,Human'), (2, 'No topics', NULL, ''), (3, 'Ties', NULL, 'Child')) t(id, title, abs, classes)")
def _(spark, sf):
    rows = readers.parse_ohsumed(spark.createDataFrame([(r,) for r in _OHSUMED], "value string"))
    return rows.select("id", "title", "abs", F.array_join("classes", ",").alias("classes"))


_REUTERS = """<!DOCTYPE lewis SYSTEM "lewis.dtd">
<REUTERS TOPICS="YES" LEWISSPLIT="TRAIN" NEWID="1"><TOPICS><D>grain</D><D>wheat</D></TOPICS><TEXT><TITLE>Title &lt;X&gt; &amp; Y</TITLE><BODY>Body &#65;.</BODY></TEXT></REUTERS>
<REUTERS TOPICS="NO" LEWISSPLIT="TRAIN" NEWID="2"><TOPICS></TOPICS><TEXT></TEXT></REUTERS>
<REUTERS TOPICS="YES" LEWISSPLIT="TEST" NEWID="3"><TOPICS></TOPICS><TEXT><TITLE>Only</TITLE></TEXT></REUTERS>"""


@query("reuters_parse", "SELECT * FROM (VALUES (1, true, 'Title <X> & Y', 'Body A.', 'grain,wheat'), (3, false, 'Only', '', '')) t(id, is_training, title, body, classes)")
def _(spark, sf):
    rows = readers.parse_reuters(spark.createDataFrame([(_REUTERS,)], "value string"))
    return rows.withColumn("classes", F.array_join("classes", ","))


@query("simple_parse", "SELECT * FROM (VALUES (true, 'sports', 'text : may hold colons'), (false, 'news', '')) t(is_training, class, body)")
def _(spark, sf):
    rows = readers.parse_simple(spark.createDataFrame([("train:sports:text : may hold colons",), ("test:news:",)], "value string"))
    return rows.select("is_training", F.col("classes")[0].alias("class"), "body")


@query("entity_decode", "SELECT '<a> & b A &lt;' AS text")
def _(spark, sf):
    return spark.createDataFrame([(" &lt;a&gt; &amp; b &#65; &amp;lt; ",)], "value string").select(X.decode_references(F.col("value")).alias("text"))



@query("tag_tree", """SELECT * FROM (VALUES (1, 0, '/r', 'x', ''), (1, 1, '/r/a', NULL, '1 < 2 & 3'), (1, 2, '/r/b', NULL, ''), (1, 3, '/r/b/a', NULL, 'A'), (2, 0, '/r', NULL, 'alone')) t(id, position, path, k, content)""")
def _(spark, sf):
    rows = [(1, '<!DOCTYPE r><r k="x"> <a> 1 &lt; 2 &amp; 3 </a><b><a>&#65;</a></b></r>'), (2, "<r>alone</r>")]
    found = tag_rows(spark.createDataFrame(rows, "id long, value string"), "id", "value")
    return found.select(F.col("id").cast("int").alias("id"), "position", "path", F.try_element_at("attributes", F.lit("k")).alias("k"), "content")


# experiments and streams

_CONFIG = {
    "experiment": {"RepeatedExperiment": "false"},
    "source": None,
    "generators": [
        {"class": "TfidfFeatureModifier", "name": "weights", "values": {"SourceFeatureGenerator": ["bow"], "SourceFeatureSet": ["bow"], "Scheme": ["ltc"]}},
        {"class": "BOWFeatureGenerator", "name": "bow", "values": {"SourceFeatureName": ["source_text"], "CountTreshhold": ["3"]}},
        {"class": "ESAFeatureGenerator", "name": "esa", "values": {"SourceFeatureName": ["source_text"], "Categories": ["true"]}},
    ],
    "selectors": [
        {"class": "InfoGainFeatureSelector", "name": "words", "values": {"SourceFeatureSet": ["bow"], "KeepNFeatures": ["200"]}},
        {"class": "PosNegFeatureSelector", "name": "concepts", "values": {"SourceFeatureSet": ["esa", "esacats"], "KeepNFeatures": ["20"], "PosNeg": ["POS"]}},
    ],
}


def experiment(spark, sf):
    """The configured experiment over the documents with a quality label."""
    known = table(spark, sf, "labels").where("quality is not null").select("doc_id")
    documents = docs(spark, sf).select("doc_id", "text", (F.col("doc_id") % 5 != 0).alias("is_training")).join(known, "doc_id", "left_semi").join(classes(spark, sf), "doc_id")
    return config.experiment(spark, _CONFIG, stored(documents, "experiment-documents"), {"articles": articles(spark, sf), "category_links": category_links(spark, sf)})


@query("experiment_topic")
def _(spark, sf):
    return experiment(spark, sf).tested("quality")


@query("experiment_report")
def _(spark, sf):
    e = experiment(spark, sf)
    return e.report(e.processed(), "quality")


@query("stream_scores", rf"""SELECT d.doc_id, coalesce(sum((length(token) % 7)::DOUBLE), 0) AS score FROM documents d LEFT JOIN (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\W+'), lambda t: t <> '')) AS token FROM documents) t USING (doc_id) GROUP BY d.doc_id""")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    weights = X.exploded_tokens(d).select(F.col("token").alias("feature")).distinct().withColumn("weight", (F.char_length("feature") % 7).cast("double"))
    path = shared_path(spark, "stream-scores")
    stream = scorer.stream_table(spark, f"{sf}/documents.parquet*", docs(spark, sf).schema)
    scorer.score_stream(stream, stored(weights, "stream-weights"), path, shared_path(spark, "stream-state"), once=True).awaitTermination()
    return spark.read.schema("doc_id long, score double").parquet(path).select("doc_id", "score")


@query("event_windows", "SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    rows = scorer.windowed_counts(table(spark, sf, "events"), "ts", "event_type")
    return rows.select("event_type", F.unix_seconds(F.col("window.start").cast("timestamp")).alias("hour"), "n")


@query("html_titles", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The most telling words for document quality, by information gain of their TF-IDF values."""
    b = labelled_bow(spark, sf).select("doc_id", "feature", "value")
    y = quality_labels(spark, sf)
    weighted = G.tfidf(b, G.document_frequency(b), y.count(), "ltc")
    return S.info_gain(weighted, y, 50)
