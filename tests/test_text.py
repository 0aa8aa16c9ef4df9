import pytest
from pyspark.sql import functions as F

from lexloom.functions import tags
from lexloom.functions import text as X


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
        "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit",
        "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv",
        "allowance": "allow", "inference": "infer", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "is": "is",
    }
    assert {w: X.porter_stem(w) for w in known} == known


def test_tokens_and_validity(spark):
    docs = spark.createDataFrame([(1, "The a's, x2 d'été THE"), (2, None), (3, "")], "doc_id long, text string")
    stop = spark.createDataFrame([("the",)], "token string")
    rows = X.valid(X.exploded_tokens(docs), stop).select("doc_id", "token").collect()
    assert sorted((r.doc_id, r.token) for r in rows) == [(1, "a"), (1, "d"), (1, "s"), (1, "t")]


def test_ngrams(spark):
    row = spark.createDataFrame([(["a", "b", "c"],)], "w array<string>").select(X.ngrams(F.col("w"), 2).alias("g"), X.ngrams(F.col("w"), 4).alias("none")).head()
    assert row.g == ["a b", "b c"] and row.none == []


def test_references(spark):
    decode = lambda t: spark.createDataFrame([(t,)], "t string").select(X.decode_references(F.col("t"))).head()[0]
    assert decode(" &lt;b&gt; &amp;lt; &#65; ") == "<b> &lt; A"
    with pytest.raises(Exception, match="unknown entity"):
        decode("&nbsp;")


def test_tag_trees():
    (root,) = tags.tag_trees('<!x><r k="1" k="2"><a>one</a><b/ ><c></c></b><a> &#50; </a></r>')
    assert root.attr("k") == "1" and root.attr("k", 1) == "2" and root.attr("k", 2) is None
    assert [a.content for a in root.all("a")] == ["one", "2"]
    assert root.child("b").child("c").content == "" and root.child("b", 1) is None
    for wrong in ("<a></b>", "<a>", "</a>", "<a>&nbsp;</a>"):
        with pytest.raises(ValueError):
            list(tags.tag_trees(wrong))
