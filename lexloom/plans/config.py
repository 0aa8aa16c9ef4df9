"""Experiments declared in XML or as dictionaries of the same names.

Fixed values: element and class names are those of existing configuration files, misspelt ones included; of a class only the
last part of its dotted name counts. Classes are matched against the names below and never imported by name.
"""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import clusters as C
from lexloom.plans import experiment as E
from lexloom.sources import readers


def parsed(xml: str) -> dict:
    """experiment (name to text), source, generators and selectors: each with class, name and values (name to list of texts)."""
    root = ElementTree.fromstring(xml)

    def item(e) -> dict:
        values: dict[str, list[str]] = {}
        for child in e:
            values.setdefault(child.tag, []).append((child.text or "").strip())
        return {"class": e.get("class", "").rpartition(".")[2], "name": e.get("name", ""), "values": values}

    source = root.find("DocumentSource")
    return {
        "experiment": {c.tag: (c.text or "").strip() for c in root.findall("Experiment/*")},
        "source": None if source is None else item(source),
        "generators": [item(e) for e in root.findall("Generators/FeatureGenerator")],
        "selectors": [item(e) for e in root.findall("FeatureSelectors/FeatureSelector")],
    }


def _one(values: dict, name: str, default: str = "") -> str:
    return values.get(name, [default])[0]


def _flag(values: dict, name: str, default: str = "false") -> bool:
    return _one(values, name, default).lower() == "true"


def _source(spark: SparkSession, item: dict) -> DataFrame:
    v = item["values"]
    if item["class"] == "OhsumedDocumentSource":
        rows = readers.read_ohsumed(spark, _one(v, "Filename"), _flag(v, "OnlyShort"), _flag(v, "Only20000Docs"))
    elif item["class"] == "Reuters21578DocumentSource":
        rows = readers.read_reuters(spark, _one(v, "Directory"))
    elif item["class"] == "SimpleDocumentSource":
        rows = readers.read_simple(spark, _one(v, "Filename")).withColumn("id", F.monotonically_increasing_id())
    else:
        raise ValueError(f"unknown document source {item['class']}")
    return rows.withColumn("doc_id", F.col("id").cast("long")).drop("id")


def _generator(spark: SparkSession, item: dict, tables: dict[str, DataFrame]) -> E.Generator:
    v, kind = item["values"], item["class"]
    sets = tuple(v.get("SourceFeatureSet", []))
    own = {"name": item["name"], "requires": tuple(v.get("SourceFeatureGenerator", ["source"])), "used": _flag(v, "UsedForClassification", "true")}
    text = _one(v, "SourceFeatureName", "source_text").partition("_")[2]
    if kind == "BOWFeatureGenerator":
        path = _one(v, "StopWordsFileName")
        stop = readers.read_stop_words(spark, path) if path else None
        return E.Bow(**own, text=text, max_ngram=int(_one(v, "MaxNGram", "1")), threshold=int(_one(v, "CountTreshhold", "1")), stop_words=stop)
    if kind == "TfidfFeatureModifier":
        return E.Tfidf(**own, sources=sets, scheme=_one(v, "Scheme"))
    if kind == "RangeNormalizeFeatureModifier":
        return E.RangeNormalize(**own, sources=sets)
    if kind == "W2VFeatureGenerator":
        path = _one(v, "EmbeddingFile")
        return E.EmbeddingMean(**own, text=text, embeddings=tables["embeddings"] if "embeddings" in tables else readers.read_embeddings(spark, path))
    if kind == "ESAFeatureGenerator":
        return E.Concepts(**own, text=text, articles=tables["articles"], category_links=tables.get("category_links") if _flag(v, "Categories") else None)
    if kind == "ESANewClusterFeatureGenerator":
        return E.GainClusters(**own, source=sets[0], clusters=int(_one(v, "NumberOfClusters")), best=int(_one(v, "NumberOfBestToUse")), combiner=_one(v, "Combiner", "sum"))
    methods = {"ClusterByBOW": C.k_means, "ClusterByCorrelation": C.k_means, "ClusterByLinkDist": C.k_means, "ClusterByW2V": C.k_means, "ClusterByW2V2": C.two_rounds, "ClusterByW2VHeirarchical": C.hierarchical}
    if kind in methods:
        ks = tuple(int(k) for text in v["K"] for k in text.split(","))
        points = None
        if kind == "ClusterByBOW":
            points = lambda _: C.term_points(tables["articles"])
        elif kind == "ClusterByLinkDist":
            points = lambda _: C.link_points(tables["links"])
        elif kind != "ClusterByCorrelation":
            path = _one(v, "EmbeddingFileName")
            table = tables["embeddings"] if "embeddings" in tables else readers.read_embeddings(spark, path)
            points = lambda corpus: C.concept_points(table, corpus.sets([sets[0]]))
        return E.Clusters(**own, source=sets[0], ks=ks, points=points, method=methods[kind], per_class=kind == "ClusterByW2V")
    raise ValueError(f"unknown feature generator {kind}")


def _selector(item: dict) -> E.Selector:
    v, kind = item["values"], item["class"]
    sets, keep = tuple(v["SourceFeatureSet"]), int(_one(v, "KeepNFeatures", "10"))
    measures = {"InfoGainFeatureSelector": "info_gain", "PosNegFeatureSelector": _one(v, "PosNeg").lower(), "AdaBoostFeatureSelector": "boost"}
    if kind not in measures or measures[kind] not in ("info_gain", "pos", "neg", "boost"):
        raise ValueError(f"unknown feature selector {kind} {_one(v, 'PosNeg')}".strip())
    return E.Selector(sets, keep, measures[kind])


def experiment(spark: SparkSession, config: str | dict, documents: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> E.Experiment:
    """The experiment of an XML text or of its dictionary form. documents replaces the declared source; tables gives
    articles(concept_id, token), category_links(concept_id, category), links(from_id, to_id) and embeddings(term, vec)."""
    said = parsed(config) if isinstance(config, str) else config
    docs = _source(spark, said["source"]) if documents is None else documents
    own = {k: [v] for k, v in said["experiment"].items()}
    return E.Experiment(
        E.Corpus.of(docs), [_generator(spark, g, tables or {}) for g in said["generators"]], [_selector(s) for s in said["selectors"]],
        repeated=_flag(own, "RepeatedExperiment"), best_of=int(_one(own, "BestOf", "5")),
    )
