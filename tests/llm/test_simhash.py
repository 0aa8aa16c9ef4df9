import random
import re

import numpy as np
import xxhash

from lexloom.llm import components, contracts, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """doc_id to the smallest reachable one, over all pairs; fps: (doc_id, fingerprint)."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(fps))]


def test_query_equals_brute_force(spark, sf, texts):
    fps = [(d, plain_fingerprint(t)) for d, t in sorted(texts.items())]
    expected = {d: (f"{fp:016x}", c) for (d, fp), c in zip(fps, plain_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in contracts.op3_simhash(spark, sf).collect()} == expected


def test_links_of_close_fingerprints(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(40):  # chains of small steps, so that components are longer than the radius
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.append(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    root = {r.node: r.root for r in components.components(edges).collect()}
    expected = plain_components(list(enumerate(fps)))
    groups = lambda of: {frozenset(i for i in range(len(fps)) if of(i) == k) for k in {of(i) for i in range(len(fps))}}
    assert groups(lambda i: root.get(signed[i], signed[i])) == groups(expected.__getitem__)


def test_tree_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, 300).astype(np.uint64)
    fps = np.unique(base)
    for radius in (0, 1, 2, 3):
        got = {tuple(sorted(p)) for p in simhash.bk_links(fps, radius)}
        assert got == {(j, i) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def test_rows_with_null_or_equal_ids_are_not_lost(spark):
    a, b, c, d = ("alpha beta gamma delta one two", "zeta eta theta iota kappa mu", "x1 x2 x3 x4 x5 x6", "y1 y2 y3 y4 y5 y6")
    rows = [(None, a, "s"), (None, b, "s"), (3, c, "s"), (3, d, "s"), (3, d, "s"), (9, d, "t"), (None, a, "s"), (None, a, "t"), (4, d, "s")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(kept) == 4 and {(r.doc_id, r.text) for r in kept} == {(None, a), (None, b), (3, c), (3, d)}
    again = simhash.deduplicated(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(2)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


def test_one_row_stays_of_each_component(spark, sf, docs, texts):
    ids = sorted(texts)
    groups = plain_components([(d, plain_fingerprint(texts[d])) for d in ids])
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).select("doc_id").collect()) == sorted(set(groups))


def test_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[2].fp == by[3].fp == by[6].fp == 0 and by[2].component_id == by[3].component_id == by[6].component_id == 2
    assert by[4].component_id == 1
    assert by[None].component_id is None
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([1, 2, 5, 7, 8, None], key=str)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
