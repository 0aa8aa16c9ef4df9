import re

import duckdb

from lexloom.llm import contracts, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of a text."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


TEXTS = ["", None, "one", "a b c d e f g h " * 2, "a b c d e f g h i " * 30, "x " * 9, "x " * 8, "l1\nl1\n \nl2\r\nl2\n", "#*$%&|<> 😀 é word tab\x1f", " ".join(map(str, range(100))) + " 1 2 3 4 5 6 7 8 9", "\n\n\n", "a b c d e f g h i j k l a b c d e f g h"]


def measures(rows):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}


def test_query_equals_brute_force(spark, sf, texts):
    rows = contracts.op4_quality(spark, sf).collect()
    assert measures(rows) == {d: plain(t) for d, t in texts.items()}
    assert not any(r.kept for r in rows if r.base_failed)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert {r.doc_id: r.kept for r in rows} == dict(con.execute(f"SELECT doc_id, kept FROM ({quality.QUALITY_SQL})").fetchall())


def test_measures_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = quality.cascade(docs).collect()
    got = {r.doc_id: (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words, r.base_failed) for r in rows}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_every_order_keeps_the_same_documents(spark, docs):
    rules = quality.default_rules()
    kept = lambda rs, n: {r.doc_id for r in quality.cascade(docs, rs, n).where("failed_rule is null").select("doc_id").collect()}
    assert kept(rules, 50) == kept(rules[::-1], 1)
    assert len(kept([], 1)) == quality.measured(docs).where(~quality.base_failed()).count()


def test_useless_rules_come_last(spark, docs):
    from pyspark.sql import functions as F

    never, always = quality.Rule("never", F.lit(False)), quality.Rule("always", F.col("q_n_words") >= 0)
    assert [r.name for r in quality.ordered([never, always], quality.measured(docs))] == ["always", "never"]


def test_ordering_saves_evaluations(spark):
    """The rule that rejects nearly all is given last; a CASE works a rule out only for what is left."""
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of a text "), F.repeat(F.lit("more WORDS here and there "), 20), F.when(F.col("id") % 10 > 0, "lorem ipsum").otherwise("")).alias("text"))
    rules = quality.default_rules(measured=False)
    plain, sorted_ = (quality.cascade(docs, rules, measure=False, order=o) for o in (False, True))
    tried = [df.agg(F.sum("rules_tried")).head()[0] for df in (plain, sorted_)]
    assert tried[1] < tried[0] and [df.where("failed_rule is null").count() for df in (plain, sorted_)] == [0, 0]
    slow = docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    rules = [quality.Rule("dear", F.size(F.array_distinct(F.split("text", ""))) < 5), quality.Rule("cheap", F.col("doc_id") % 10 > 0)]
    assert [r.name for r in quality.ordered(rules, slow)] == ["cheap", "dear"]
    assert quality.cascade(slow, rules, measure=False).agg(F.sum("rules_tried")).head()[0] == 4000 + 400


def test_filter_without_measures_keeps_the_same(spark, docs):
    kept = lambda df: {r.doc_id for r in df.where("failed_rule is null").select("doc_id").collect()}
    assert kept(quality.cascade(docs, measure=False)) == kept(quality.cascade(docs))


def test_odd_rows(spark, odd, empty):
    rows = quality.cascade(odd).collect()
    assert len(rows) == 10 and {r.doc_id for r in rows if not r.base_failed} == {1, 4}
    assert rows[0].row == "own row" and quality.cascade(empty).count() == 0
