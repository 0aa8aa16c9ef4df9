import datetime as dt

from lexloom.streaming import scorer


def test_stream_scores_every_document_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "good good bad"), (2, None), (3, "other")], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    weights = spark.createDataFrame([("good", 1.5), ("bad", -1.0)], "feature string, weight double")
    for _ in range(2):  # the second run finds nothing new
        stream = scorer.stream_table(spark, str(tmp_path / "in"), docs.schema)
        scorer.score_stream(stream, weights, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id: r.score for r in rows} == {1: 2.0, 2: 0.0, 3: 0.0} and len(rows) == 3


def test_windows(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    events = spark.createDataFrame([(at(1, 5), "a"), (at(1, 50), "a"), (at(2, 0), "a"), (at(1, 10), "b")], "ts timestamp, kind string")
    rows = scorer.windowed_counts(events, "ts", "kind").collect()
    assert sorted((r.window.start.hour, r.kind, r.n) for r in rows) == [(1, "a", 2), (1, "b", 1), (2, "a", 1)]
