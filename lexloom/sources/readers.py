"""Document sources. Each returns doc_id or id, is_training, classes and the source's text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.text import decode_references

OHSUMED_TRAINING, OHSUMED_DOCS = 10_000, 20_001


def topics_of(field: Column) -> Column:
    """Subject headings: split at semicolons, cut at the first slash, without a closing period, each once."""
    names = F.transform(F.split(F.coalesce(field, F.lit("")), ";"), lambda t: F.trim(F.regexp_replace(F.split(t, "/")[0], r"\.+\s*$", "")))
    return F.array_distinct(F.array_remove(names, ""))


def parse_ohsumed(records: DataFrame) -> DataFrame:
    """id, u, title, abs, m and classes of records(value): the text after `.I `, a tag line and a value line a field."""
    body = F.regexp_replace("value", r"^\.I ", "")
    field = lambda tag: F.nullif(F.regexp_extract(body, rf"(?:^|\n)\.{tag}\n([^\n]*)", 1), F.lit(""))
    rows = records.where(F.trim("value") != "").select(
        F.trim(F.split(body, "\n")[0]).cast("int").alias("id"), field("U").alias("u"), field("T").alias("title"), field("W").alias("abs"), field("M").alias("m")
    )
    return rows.withColumn("classes", topics_of(F.col("m")))


def read_ohsumed(spark: SparkSession, path: str, only_short: bool = False, only_20000: bool = False) -> DataFrame:
    """OHSUMED files. only_short keeps documents without abstract; only_20000 the first 20,001 of 1991, the first
    10,000 of which train. The last record of a file is read too."""
    rows = parse_ohsumed(spark.read.text(path, lineSep="\n.I "))
    if only_short:
        rows = rows.where(F.coalesce(F.trim("abs"), F.lit("")) == "")
    if not only_20000:
        return rows.withColumn("is_training", F.lit(False))
    # take the first by id before numbering: the window then sees a bounded number of rows
    first = rows.where(F.substring("u", 1, 2) == "91").orderBy("id").limit(OHSUMED_DOCS)
    return first.withColumn("is_training", F.row_number().over(W.orderBy("id")) <= OHSUMED_TRAINING)


def parse_reuters(files: DataFrame) -> DataFrame:
    """ModApte split of Reuters-21578: id, is_training, title, body, classes from whole SGML files(value)."""
    records = files.select(F.explode(F.regexp_extract_all("value", F.lit("(?s)<REUTERS .*?</REUTERS>"), F.lit(0))).alias("r"))
    attr = lambda name: F.regexp_extract("r", rf'^<REUTERS [^>]*\b{name}="([^"]*)"', 1)
    tag = lambda name: decode_references(F.regexp_extract("r", rf"(?s)<{name}>(.*?)</{name}>", 1))
    topics = F.regexp_extract_all(F.regexp_extract("r", "(?s)<TOPICS>(.*?)</TOPICS>", 1), F.lit("(?s)<D>(.*?)</D>"), F.lit(1))
    rows = records.where(attr("LEWISSPLIT").isin("TRAIN", "TEST") & (attr("TOPICS") == "YES"))
    return rows.select(
        attr("NEWID").cast("int").alias("id"), (attr("LEWISSPLIT") == "TRAIN").alias("is_training"), tag("TITLE").alias("title"), tag("BODY").alias("body"), F.transform(topics, decode_references).alias("classes")
    )


def read_reuters(spark: SparkSession, directory: str) -> DataFrame:
    """All reut2-NNN.sgm files of a directory."""
    return parse_reuters(spark.read.text(f"{directory}/reut2-[0-9][0-9][0-9].sgm", wholetext=True))


def parse_simple(lines: DataFrame) -> DataFrame:
    """split, class and body of lines(value) `split:class:text`; the text may hold colons; fewer parts are an error."""
    parts = F.split("value", ":", 3)
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not split:class:text: "), F.col("value"))))
    rows = lines.select(checked.alias("p"))
    return rows.select((F.col("p")[0] == "train").alias("is_training"), F.array(F.col("p")[1]).alias("classes"), F.col("p")[2].alias("body"))


def read_simple(spark: SparkSession, path: str) -> DataFrame:
    return parse_simple(spark.read.text(path))


def read_embeddings(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """term and vec of a word2vec text file: a header `count width`, then a term and its numbers a line. keep, over term,
    is applied before any number is parsed; a line of another width is an error."""
    lines = spark.read.text(path)
    header = lines.where(F.rlike("value", F.lit(r"^\d+ \d+\s*$"))).head()
    width = int(header.value.split()[1])
    parts = F.split(F.rtrim("value"), " ")
    rows = lines.where(F.col("value") != header.value).select(parts[0].alias("term"), parts.alias("parts"))
    rows = rows if keep is None else rows.where(keep)
    numbers = F.transform(F.slice("parts", 2, width), lambda x: x.cast("double"))
    right = F.size("parts") == width + 1
    return rows.select("term", F.when(right, numbers).otherwise(F.raise_error(F.concat(F.lit("wrong width at "), F.col("term")))).alias("vec"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """token: every distinct word of a stop-word file; `a's` gives a and s."""
    from lexloom.functions.text import tokens

    return spark.read.text(path).select(F.explode(tokens(F.col("value"))).alias("token")).distinct()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A side table (pages, categorylinks, text) over JDBC; filters on it are pushed to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def page_ids(terms: DataFrame, pages: DataFrame) -> DataFrame:
    """term and page id of terms(term) by stemmed title; of equal titles the largest id."""
    last = pages.groupBy(F.col("title_stemmed").alias("term")).agg(F.max("id").alias("page_id"))
    return terms.select("term").distinct().join(last, "term")


def categories_of(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """concept_id and category of every category link of concepts(concept_id)."""
    return concepts.join(links.select(F.col("from_id").alias("concept_id"), F.col("to_id").alias("category")), "concept_id")


def summary(title: Column, body: Column) -> Column:
    """The first 100 characters of title and body, --- for null."""
    return F.concat_ws(" ", *(F.substring(F.coalesce(c, F.lit("---")), 1, 100) for c in (title, body)))


def save_corpus(documents: DataFrame, features: DataFrame, path: str) -> None:
    """The processed corpus: documents and features, the latter in folders by feature set."""
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    features.write.mode("overwrite").partitionBy("feature_set").parquet(f"{path}/features")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/features")
