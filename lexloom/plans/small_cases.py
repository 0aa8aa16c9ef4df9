"""Registered queries over small literal inputs whose results are worked out by hand: models, stems and file formats that SQL cannot say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import clusters as C
from lexloom.operators import corpus as D
from lexloom.operators import learn as L
from lexloom.operators import relevance as R
from lexloom.operators import selectors as S
from lexloom.session import shared_path, table
from lexloom.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def case(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _values(columns: str, rows: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) t({columns})"


#: Words and stems that Porter's paper of 1980 gives for its rules.
_STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss "
    "fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile "
    "analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl "
    "triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust "
    "defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler "
    "probate probat rate rate cease ceas controll control roll roll"
).split()


@case("porter_stems", _values("token, stem", ", ".join(f"('{a}', '{b}')" for a, b in zip(_STEMS[::2], _STEMS[1::2]))))
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(w, w) for w in _STEMS[::2]], "word string, token string")
    return X.stemmed(rows).select(F.col("word").alias("token"), F.col("token").alias("stem"))


# files

_RECORDS = [".I 1", ".U", "91000001", ".M", "Adult; Heart/*PH; Human.", ".T", "A short title.", ".W", "An abstract.", ".I 2", ".U", "90000002", ".T", "No topics", ".I 3", ".U", "91000003", ".M", "Child.", ".T", "Last", ".W", ""]


def _ohsumed(spark: SparkSession) -> str:
    path = shared_path(spark, "ohsumed")
    spark.createDataFrame([("\n".join(_RECORDS),)], "value string").coalesce(1).write.text(path)
    return path


@case("ohsumed_files", _values("id, classes, is_training", "(1, 'Adult,Heart,Human', false), (2, '', false), (3, 'Child', false)"))
def _(spark, sf):
    return readers.read_ohsumed(spark, _ohsumed(spark)).select("id", F.array_join("classes", ",").alias("classes"), "is_training")


@case("ohsumed_only_short", _values("id, title", "(2, 'No topics'), (3, 'Last')"))
def _(spark, sf):
    return readers.read_ohsumed(spark, _ohsumed(spark), only_short=True).select("id", "title")


@case("ohsumed_only_1991", _values("id, is_training", "(1, true), (3, true)"))
def _(spark, sf):
    return readers.read_ohsumed(spark, _ohsumed(spark), only_20000=True).select("id", "is_training")


@case("embedding_file", _values("term, x, y, z", "('apple', 0.5::DOUBLE, 1.0::DOUBLE, -2.0::DOUBLE), ('42', 1.0::DOUBLE, 0.0::DOUBLE, 0.25::DOUBLE)"))
def _(spark, sf):
    path = shared_path(spark, "word2vec")
    lines = "3 3\napple 0.5 1 -2\n42 1.0 0.0 0.25 \nskipped 1 1 1"
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(path)
    rows = readers.read_embeddings(spark, path, keep=F.col("term") != "skipped")
    return rows.select("term", *(F.col("vec")[i].alias(c) for i, c in enumerate("xyz")))


@case("reuters_files", _values("id, is_training, title", "(1, true, 'One'), (7, false, 'Seven & more')"))
def _(spark, sf):
    path = shared_path(spark, "reuters")
    record = '<REUTERS TOPICS="{}" LEWISSPLIT="{}" NEWID="{}"><TOPICS></TOPICS><TEXT><TITLE>{}</TITLE></TEXT></REUTERS>'
    files = {"000": record.format("YES", "TRAIN", 1, "One") + record.format("NO", "TRAIN", 2, "No"), "001": record.format("YES", "TEST", 7, "Seven &amp; more") + record.format("YES", "NOT-USED", 8, "Unused")}
    for n, value in files.items():  # a folder by the name of each file holds it
        spark.createDataFrame([(value,)], "value string").coalesce(1).write.text(f"{path}/reut2-{n}.sgm")
    return readers.read_reuters(spark, path).select("id", "is_training", "title")


@case("corpus_saved", "SELECT doc_id, lang, n_chars::DOUBLE AS value FROM documents WHERE doc_id IS NOT NULL")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    path = shared_path(spark, "corpus")
    readers.save_corpus(docs.drop("n_chars"), docs.select(F.lit("size").alias("feature_set"), "doc_id", F.lit("n").alias("feature"), F.col("n_chars").cast("double").alias("value")), path)
    documents, features = readers.load_corpus(spark, path)
    return documents.join(features.where("feature_set = 'size'"), "doc_id").select("doc_id", "lang", "value")


# views and edits

@case("document_by_id", "SELECT doc_id, text FROM documents WHERE doc_id = 7")
def _(spark, sf):
    return D.document(table(spark, sf, "documents"), 7).select("doc_id", "text")


def _two_sets(spark, sf):
    docs = table(spark, sf, "documents")
    rows = lambda name, value: docs.select(F.lit(name).alias("feature_set"), "doc_id", F.lit("x").alias("feature"), value.cast("double").alias("value"))
    return rows("size", F.col("n_chars")).unionByName(rows("odd", F.col("doc_id") % 2))


@case("set_removed", "SELECT doc_id, n_chars::DOUBLE AS value FROM documents")
def _(spark, sf):
    return D.without_set(_two_sets(spark, sf), "odd").select("doc_id", "value")


@case("set_replaced", "SELECT 'size' AS feature_set, doc_id, n_chars::DOUBLE AS value FROM documents UNION ALL SELECT 'odd', doc_id, 9.0::DOUBLE FROM documents WHERE lang = 'en'")
def _(spark, sf):
    new = table(spark, sf, "documents").where("lang = 'en'").select(F.lit("odd").alias("feature_set"), "doc_id", F.lit("x").alias("feature"), F.lit(9.0).alias("value"))
    return D.replaced_set(_two_sets(spark, sf), new, "odd").select("feature_set", "doc_id", "value")


@case("values_replaced", "SELECT doc_id, sqrt(n_chars::DOUBLE) AS value FROM documents")
def _(spark, sf):
    return D.replaced_values(D.without_set(_two_sets(spark, sf), "odd"), F.sqrt("value")).select("doc_id", "value")


@case("validation_parts", "SELECT doc_id, 1::BIGINT AS parts FROM documents")
def _(spark, sf):
    """Every document is in one of both parts, and once."""
    train, held = D.validation_split(table(spark, sf, "documents"), 0.3, seed=4)
    return train.unionByName(held).groupBy("doc_id").agg(F.count("*").alias("parts"))


@case("concept_filter", _values("feature, x", "('11', 0.5::DOUBLE), ('12', 1.5::DOUBLE)"))
def _(spark, sf):
    """Of the numeric terms those of concepts in three documents and with a hundred links."""
    vectors = spark.createDataFrame([("11", [0.5]), ("12", [1.5]), ("13", [2.5]), ("14", [3.5]), ("word", [4.5])], "term string, vec array<double>")
    rows = [(d, f, 1.0) for f, n in (("11", 3), ("12", 5), ("13", 2), ("14", 4), ("word", 9)) for d in range(n)]
    links = spark.createDataFrame([(11, 100), (12, 250), (13, 400), (14, 99)], "id long, n long")
    found = C.concept_points(vectors, spark.createDataFrame(rows, "doc_id long, feature string, value double"), 3, links, 100)
    return found.select("feature", F.col("vec")[0].alias("x"))


# relevance and models

def _labelled(spark):
    """16 documents, the first eight of label 0. `step` parts them, `flat` says nothing, `thirds` needs two cuts, `late` errs once."""
    labels = spark.createDataFrame([(d, int(d >= 8)) for d in range(16)], "doc_id long, label int")
    columns = {"step": [1.0] * 8 + [3.0] * 8, "flat": [2.0] * 16, "thirds": [1.0] * 4 + [5.0] * 4 + [3.0] * 8, "late": [1.0] * 9 + [2.0] * 7}
    rows = [(d, f, v) for f, vs in columns.items() for d, v in enumerate(vs)]
    return spark.createDataFrame(rows, "doc_id long, feature string, value double"), labels


@case("mdlp_cases", _values("feature, ig, cuts", "('step', 1.0::DOUBLE, 1), ('flat', 0.0::DOUBLE, 0), ('thirds', 1.0::DOUBLE, 2), ('late', round(1 + 9 / 16 * (8 / 9 * log2(8 / 9) + 1 / 9 * log2(1 / 9)), 6)::DOUBLE, 1)"))
def _(spark, sf):
    """Gains of the whole entropy, none, and 1 - 9/16 h(8/9)."""
    found = R.mdlp(R.value_histogram(*_labelled(spark)))
    return found.select("feature", F.round("ig", 6).alias("ig"), F.size("cuts").alias("cuts"))


@case("boosted_cases", _values("feature, rounds", "('step', 1), ('late', 1)"))
def _(spark, sf):
    """A perfect stump ends the rounds at once; without it the nearly perfect one is first."""
    features, labels = _labelled(spark)
    picked = [S.ada_boost(features, labels, rounds=5), S.ada_boost(features.where("feature in ('late', 'flat')"), labels, rounds=1)]
    return spark.createDataFrame([(p[0][0], len(p)) for p in picked], "feature string, rounds int")


@case("report_cases", _values("feature, ig0, ig1, pos, neg", "('flat', 0.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE), ('step', 0.5::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE)"))
def _(spark, sf):
    features, labels = _labelled(spark)
    rows = R.relevance_report(features.where("feature in ('flat', 'step')"), labels)
    return rows.select("feature", *(F.round(c, 6).alias(c) for c in ("ig0", "ig1", "pos", "neg")))


def _groups(members: DataFrame) -> DataFrame:
    """Clusters by their members, whatever their numbers are."""
    return members.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("members")).select("members")


def _far_points(spark):
    """Three bundles of directions, far apart."""
    rows = [(f"{g}{i}", [base[0] + i / 100, base[1] - i / 100, base[2]]) for g, base in (("a", (9.0, 1.0, 0.0)), ("b", (0.0, 8.0, 1.0)), ("c", (1.0, 0.0, 7.0))) for i in range(4)]
    return spark.createDataFrame(rows, "feature string, vec array<double>")


_BUNDLES = "('a0,a1,a2,a3'), ('b0,b1,b2,b3'), ('c0,c1,c2,c3')"


@case("kmeans_cases", _values("members", _BUNDLES))
def _(spark, sf):
    return _groups(C.k_means(_far_points(spark), 3))


@case("kmeans_union_cases", _values("members", f"{_BUNDLES}, {_BUNDLES}"))
def _(spark, sf):
    return _groups(C.several(_far_points(spark), [3, 3]))


@case("kmeans_again_cases", _values("members", _BUNDLES))
def _(spark, sf):
    return _groups(C.two_rounds(_far_points(spark), 3))


@case("kmeans_tree_cases", _values("members", _BUNDLES))
def _(spark, sf):
    return _groups(C.hierarchical(_far_points(spark), 3))


@case("cluster_profile_cases", _values("kind, members", "('documents', 'p,q'), ('documents', 'r,s'), ('links', '1,2'), ('links', '3,4'), ('terms', '1,2'), ('terms', '3,4')"))
def _(spark, sf):
    """Features of the same documents, articles of the same words and concepts of the same links fall together."""
    values = spark.createDataFrame([(d, f, 1.0) for f, ds in (("p", (1, 2)), ("q", (1, 2)), ("r", (7, 8)), ("s", (7, 8))) for d in ds], "doc_id long, feature string, value double")
    words = spark.createDataFrame([(c, w) for c, ws in ((1, "red blue"), (2, "blue red"), (3, "sun moon"), (4, "moon sun")) for w in ws.split()], "concept_id long, token string")
    links = spark.createDataFrame([(1, 50), (1, 51), (2, 50), (2, 51), (3, 60), (4, 60)], "from_id long, to_id long")
    parts = {"documents": C.document_points(values), "links": C.link_points(links), "terms": C.term_points(words)}
    found = None
    for kind, points in parts.items():
        rows = _groups(C.k_means(points, 2)).select(F.lit(kind).alias("kind"), "members")
        found = rows if found is None else found.unionByName(rows)
    return found


@case("svm_cases", _values("doc_id, predicted, actual", ", ".join(f"({d}, {str(d >= 8).lower()}, {str(d >= 8).lower()})" for d in range(16))))
def _(spark, sf):
    """Separable documents are all classified right."""
    features, labels = _labelled(spark)
    features = features.where("feature = 'step'").withColumn("value", F.col("value") - 2)
    data = L.vectors(labels, features, L.vocabulary(features), 1)
    return L.predictions(L.train_svm(data, c=1.0, iterations=10), data)


@case("concept_line_cases", _values("doc_id, line", "(1, 'C7 C8 C9'), (2, 'C9')"))
def _(spark, sf):
    tokens = spark.createDataFrame([(1, 0, "x"), (1, 1, "unknown"), (1, 2, "y"), (2, 0, "y")], "doc_id long, pos int, token string")
    index = spark.createDataFrame([("x", 8, 0.5), ("x", 7, 0.9), ("x", 6, 0.1), ("y", 9, 1.0)], "token string, concept_id long, weight double")
    return L.concept_lines(tokens, index, top=2)
