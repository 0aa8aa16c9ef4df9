import pytest

from lexloom.plans import config
from lexloom.plans import experiment as E

XML = """<Config>
<Experiment><RepeatedExperiment>false</RepeatedExperiment><BestOf>2</BestOf></Experiment>
<DocumentSource class="any.SimpleDocumentSource" name="source"><Filename>{path}</Filename></DocumentSource>
<Generators>
 <FeatureGenerator class="any.TfidfFeatureModifier" name="weights"><SourceFeatureGenerator>words</SourceFeatureGenerator><SourceFeatureSet>words</SourceFeatureSet><Scheme>ltc</Scheme></FeatureGenerator>
 <FeatureGenerator class="any.BOWFeatureGenerator" name="words"><SourceFeatureGenerator>source</SourceFeatureGenerator><SourceFeatureName>source_body</SourceFeatureName><MaxNGram>1</MaxNGram><CountTreshhold>1</CountTreshhold></FeatureGenerator>
</Generators>
<FeatureSelectors><FeatureSelector class="any.InfoGainFeatureSelector" name="s"><SourceFeatureSet>words</SourceFeatureSet><KeepNFeatures>5</KeepNFeatures></FeatureSelector></FeatureSelectors>
</Config>"""


def test_configured_experiment(spark, tmp_path):
    lines = [f"{'train' if i % 5 else 'test'}:{'river' if i % 2 else 'hill'}:{'water boat' if i % 2 else 'stone goat'} word{'abcdefg'[i % 7]}" for i in range(40)]
    (tmp_path / "docs.txt").write_text("\n".join(lines))
    made = config.experiment(spark, XML.format(path=tmp_path / "docs.txt"))
    rows = {r.part: r for r in made.tested("river").collect()}
    assert rows["test"].tp + rows["test"].fn == 4
    assert rows["train"].tp + rows["train"].fp + rows["train"].tn + rows["train"].fn == 32 and rows["train"].f1 > 0.8


def test_order_of_generators():
    a, b, c = E.Bow("a", ("source",)), E.Tfidf("b", ("a",)), E.Bow("c", ("source",))
    assert [g.name for g in E.in_order([b, c, a])] == ["c", "a", "b"]
    with pytest.raises(E.UnresolvedInputs):
        E.in_order([b])
    with pytest.raises(E.UnresolvedInputs):
        E.in_order([E.Bow("x", ("y",)), E.Bow("y", ("x",))])


def test_unknown_classes_are_refused(spark):
    item = {"class": "os.system", "name": "x", "values": {"SourceFeatureSet": ["a"]}}
    with pytest.raises(ValueError):
        config.experiment(spark, {"experiment": {}, "source": item, "generators": [], "selectors": []})
    docs = spark.createDataFrame([(1, True)], "doc_id long, is_training boolean")
    for kind in ("generators", "selectors"):
        with pytest.raises(ValueError):
            config.experiment(spark, {"experiment": {}, "source": None, "generators": [], "selectors": []} | {kind: [item]}, docs)
