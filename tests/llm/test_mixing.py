import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexloom.llm import contracts, mixing


def water_level(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeated sharing; sizes in order of the sources."""
    w = {i: weights[i % len(weights)] for i in range(len(sizes))}
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in w if i not in fixed]
        rest, weight = total - sum(fixed.values()), sum(w[i] for i in free)
        over = [i for i in free if rest * w[i] / weight > most * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else rest * w[i] / weight for i in w]
        fixed |= {i: most * sizes[i] for i in over}


def plain_mix(docs, seed=7):
    """Copies of each of docs, a list of (doc_id, source, text) without equal rows, sources without null."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in docs]
    sources = sorted({s for _, s, _ in docs})
    total = {s: sum(n for n, d in zip(size, docs) if d[1] == s) for s in sources}
    out = [0] * len(docs)
    for s, target in zip(sources, water_level([total[s] for s in sources])):
        own = [i for i, d in enumerate(docs) if d[1] == s]
        whole = math.floor(target / total[s]) if total[s] else 0
        left = target - whole * total[s]
        weight = {i: max(1, size[i].bit_length()) for i in own}
        sure, rest = set(), own
        for w in sorted(set(weight.values()), reverse=True):
            same = [i for i in rest if weight[i] == w]
            if not sum(size[i] for i in same) or w * left < sum(weight[i] * size[i] for i in rest):
                break
            sure |= set(same)
            left -= sum(size[i] for i in same)
            rest = [i for i in rest if i not in sure]
        weighed = sum(weight[i] * size[i] for i in rest)

        def rank(i):
            text = hashlib.md5((docs[i][2] or "").encode()).hexdigest()
            u = (int(hashlib.md5(f"{seed}:{docs[i][0]}:{text}:1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = weight[i] * left / max(weighed, 1)
            return ((u / (1 - u)) / (p / (1 - p)) if 0 < p < 1 else 1e300, docs[i][0])

        after = 0
        for i in sorted(rest, key=rank):
            after += size[i]
            out[i] = int(left > 0 and 2 * after - size[i] < 2 * left)
        for i in own:
            out[i] = whole + (1 if i in sure else out[i])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_pareto_sampling(spark, seed):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["a"] * 6 + ["b", "c", "d"]), "w " * rng.choice([0, 1, 3, 8, 20, 100, 700])) for i in range(400)]
    rows = mixing.mix_report(spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)).collect()
    assert {r.doc_id: r.taken // r.size if r.size else 0 for r in rows if r.size} == {d[0]: n for d, n in zip(docs, plain_mix(docs)) if d[2]}


def test_certain_documents_come_first(spark):
    # one document holds most words of a source: its probability would pass 1, so every run takes it
    docs = [(i, "a", "w " * (4000 if i == 0 else 1)) for i in range(400)] + [(1000 + i, "b", "w " * 10) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, source string, text string")
    for seed in range(3):
        rows = {r.doc_id: r for r in mixing.mix_report(table, seed, weights=(2, 1)).collect()}
        assert rows[0].taken >= 4000


def test_null_and_equal_ids_meet_their_targets(spark):
    """All ids null, few different texts, sources of 5000 words: the taken words still come within one document of the target."""
    docs = [(None if i % 3 else 5, f"w{i % 4} " * 5, "ab"[i // 1000]) for i in range(2000)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(6)
    rows = mixing.mix_report(table).groupBy("target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert len(rows) == 2 and all(r.n == 1000 and abs(r.taken - r.target) <= 5 for r in rows)
    mixed = {r.source: r["count"] for r in mixing.mix(table).groupBy("source").count().collect()}
    assert abs(5 * mixed["a"] - 10000 / 3) <= 5 and abs(5 * mixed["b"] - 20000 / 3) <= 5
    assert sorted(map(str, mixing.mix(table).collect())) == sorted(map(str, mixing.mix(table.repartition(3)).collect()))


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 7, 2000], [10], [0, 50], [3, 3, 3, 900, 1, 1]])
def test_targets(spark, sizes):
    sums = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sums).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(water_level(sizes))


def test_query_equals_sql_and_meets_targets(spark, sf):
    rows = contracts.op9_mixing(spark, sf).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.MIX_SQL})").fetchall())
    assert all(r.taken <= 3 * r.size for r in rows)
    again = contracts.op9_mixing(spark, sf).collect()
    assert sorted(rows) == sorted(again)


def test_taken_words_come_near_targets(spark):
    rng = random.Random(2)
    docs = [(i, "w " * rng.choice([1, 5, 50, 400]), rng.choice(["a"] * 9 + ["b", "c", None])) for i in range(1500)]
    rows = mixing.mix_report(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)).collect()
    source = {d: s for d, _, s in docs}
    by = {}
    for r in rows:
        by.setdefault(source[r.doc_id], [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= 200 for target, taken in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(len(t.split()) for _, t, _ in docs))


def test_inclusion_follows_the_odds(spark):
    # equal sources of 3000 words get 1500, 3000 and 4500; within the first, even ids weigh twice as much as odd ones
    docs = spark.createDataFrame([(i, "abc"[i // 3000]) for i in range(9000)], "doc_id long, source string")
    slim = mixing.ranked(docs, F.lit(1), 3, weight=F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(1.0)).persist()
    rows = mixing.copies(slim, mixing.plan(slim)).collect()
    first = [r for r in rows if r.source == "a"]
    assert sum(r.copies for r in first) == 1500
    assert sum(r.copies for r in first if r.doc_id % 2 == 0) == pytest.approx(1000, abs=75)
    assert {r.copies for r in rows if r.source == "b"} == {1} and {r.copies for r in rows if r.source == "c"} == {1, 2}


def test_odd_rows(spark, odd, empty):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == 10 and all(r.taken == 0 for r in rows if r.size == 0)
    assert {r.size for r in rows if r.doc_id == 5} == {60_000}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    taken = {r.doc_id: r.taken // r.size if r.size else 0 for r in rows}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for d, n in counts.items():
        if d not in (2, 3, 6):
            assert n == taken[d] * (2 if d == 4 else 1)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0
