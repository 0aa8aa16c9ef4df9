import pytest

from lexloom.sources import readers

OHSUMED = """.I 1
.U
91000001
.S
Sample J 9101
.M
Adult; Heart/*PH; Human.
.T
A short title.
.W
An abstract on one line.
.I 2
.U
90000002
.T
Old
.I 3
.U
91000003
.M
Child; Child/*SU.
.T
Last
.W

"""


def test_ohsumed(spark, tmp_path):
    (tmp_path / "o.txt").write_text(OHSUMED)
    rows = {r.id: r for r in readers.read_ohsumed(spark, str(tmp_path / "o.txt")).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].classes == ["Adult", "Heart", "Human"] and rows[1].abs == "An abstract on one line." and not rows[1].is_training
    assert rows[2].classes == [] and rows[2].abs is None
    assert rows[3].classes == ["Child"] and rows[3].abs is None
    short = readers.read_ohsumed(spark, str(tmp_path / "o.txt"), only_short=True, only_20000=True).collect()
    assert [(r.id, r.is_training) for r in short] == [(3, True)]


def test_reuters(spark, tmp_path):
    (tmp_path / "reut2-000.sgm").write_text(
        """<!DOCTYPE lewis SYSTEM "lewis.dtd">
<REUTERS TOPICS="YES" LEWISSPLIT="TRAIN" NEWID="1"><TOPICS><D>grain</D><D>wheat</D></TOPICS><TEXT><TITLE>Title &lt;X&gt;</TITLE><BODY>Body &#2;
two lines</BODY></TEXT></REUTERS>
<REUTERS TOPICS="YES" LEWISSPLIT="NOT-USED" NEWID="2"><TOPICS></TOPICS><TEXT></TEXT></REUTERS>
<REUTERS TOPICS="NO" LEWISSPLIT="TEST" NEWID="3"><TOPICS></TOPICS><TEXT></TEXT></REUTERS>"""
    )
    (tmp_path / "reut2-001.sgm").write_text('<REUTERS TOPICS="YES" LEWISSPLIT="TEST" NEWID="4"><TOPICS></TOPICS><TEXT></TEXT></REUTERS>')
    rows = {r.id: r for r in readers.read_reuters(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 4}
    assert rows[1].title == "Title <X>" and rows[1].classes == ["grain", "wheat"] and rows[1].is_training and "two lines" in rows[1].body
    assert rows[4].title == "" and rows[4].body == "" and rows[4].classes == [] and not rows[4].is_training


def test_simple(spark, tmp_path):
    (tmp_path / "s.txt").write_text("train:sports:text : with colons\nvalid:news:\n")
    rows = readers.read_simple(spark, str(tmp_path / "s.txt")).collect()
    assert [(r.is_training, r.classes, r.body) for r in rows] == [(True, ["sports"], "text : with colons"), (False, ["news"], "")]
    (tmp_path / "bad.txt").write_text("train:sports\n")
    with pytest.raises(Exception, match="not split:class:text"):
        readers.read_simple(spark, str(tmp_path / "bad.txt")).collect()


def test_embeddings(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "e.txt").write_text("3 3\napple 0.1 0.2 0.3\n42 1.0 0.0 0.5\nlong 1 2 3 4\n")
    kept = readers.read_embeddings(spark, str(tmp_path / "e.txt"), F.col("term") != "long").collect()
    assert {r.term: r.vec for r in kept} == {"apple": [0.1, 0.2, 0.3], "42": [1.0, 0.0, 0.5]}
    with pytest.raises(Exception, match="wrong width"):
        readers.read_embeddings(spark, str(tmp_path / "e.txt")).collect()


def test_stop_words_and_corpus(spark, tmp_path):
    (tmp_path / "w.txt").write_text("a's\nThe\nthe\n")
    assert {r.token for r in readers.read_stop_words(spark, str(tmp_path / "w.txt")).collect()} == {"a", "s", "the"}
    docs = spark.createDataFrame([(1, True)], "doc_id long, is_training boolean")
    features = spark.createDataFrame([("bow", 1, "x", 2.0)], "feature_set string, doc_id long, feature string, value double")
    readers.save_corpus(docs, features, str(tmp_path / "c"))
    d, f = readers.load_corpus(spark, str(tmp_path / "c"))
    assert d.count() == 1 and f.where("feature_set = 'bow'").head().value == 2.0
