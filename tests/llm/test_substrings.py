import hashlib
import random
import re

import numpy as np
import pytest

from lexloom.llm import contracts, substrings


def plain_removed(texts, length):
    """For each text (bytes) whether each byte is covered by a window that starts twice or more anywhere."""
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append(bytes(gone))
    return out


def runs(gone):
    out, at = [], 0
    for i in range(len(gone) + 1):
        on = i < len(gone) and gone[i]
        if on and not at:
            start, at = i, 1
        elif not on and at:
            out.append((start, i))
            at = 0
    return out


@pytest.mark.parametrize("seed", range(8))
def test_two_stage_order(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"ab" if seed % 2 else b"abcdefgh\x00\xff") for _ in range(rng.randrange(0, 400)))
    depth = rng.choice([1, 3, 50, 1000])
    order = substrings.two_stage_order(data, depth).tolist()
    assert sorted(order) == list(range(len(data)))
    cut = [data[i : i + depth] for i in order]
    assert cut == sorted(cut)
    wanted = [rng.random() < 0.7 for _ in data]
    some = [i for i in substrings.two_stage_order(data, depth, np.array(wanted, bool)).tolist() if wanted[i]]
    assert sorted(some) == [i for i, w in enumerate(wanted) if w]
    cut = [data[i : i + depth] for i in some]
    assert cut == sorted(cut)


def plain_shared(texts, length, sub, words):
    """For each text (bytes) whether a string of `length` bytes of it, or of `words` words and at least `sub` bytes, starts elsewhere."""
    count, own = {}, []
    for t in texts:
        places = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        spans = {(i, i + length) for i in range(len(t) - length + 1)}
        spans |= {(places[i][0], places[i + words - 1][1]) for i in range(len(places) - words + 1) if places[i + words - 1][1] - places[i][0] >= sub}
        own.append({hash(t[a:b]) if b - a == length else t[a:b] for a, b in spans if b - a <= length})
        for w in [hash(t[a:b]) if b - a == length else t[a:b] for a, b in spans if b - a <= length]:
            count[w] = count.get(w, 0) + 1
    return [any(count[w] > 1 for w in ws) for ws in own]


@pytest.mark.parametrize(("seed", "crowded"), [(1, False), (2, False), (3, True), (4, False)])
def test_passages_of_words(spark, monkeypatch, seed, crowded):
    if crowded:
        monkeypatch.setattr(substrings, "SHARD_CONTEXTS", 1)
    rng = random.Random(seed)
    common = [" ".join(rng.choice("abcdefg") + rng.choice("xyz") for _ in range(rng.randrange(2, 14))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(common) if rng.random() < 0.3 else " ".join(str(rng.randrange(300)) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 5))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (None, rows[5][1]), (101, "1 2 3 4 5 6 7 8 9 " * 3), (102, None), (103, "alone \n" * 4)]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 40, 14, 6, 6).collect()
    flags = plain_shared([(t or "").encode() for _, t in rows], 40, 14, 6)
    assert {r.doc_id for r in got if r.shared} == {d for (d, _), f in zip(rows, flags) if f}
    assert 5 < sum(flags) < 60


def planted(seed, n=40):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(8, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))))
        texts.append("".join(parts))
    return texts + texts[:5] + ["ab" * 100, "a" * 90]


def compare(spark, rows, length, sub, gram):
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length, sub, gram).collect()
    data = [(t or "").encode() for _, t in rows]
    expected = sorted((str(d), len(t), runs(g), bytes(x for x, y in zip(t, g) if not y)) for (d, _), t, g in zip(rows, data, plain_removed(data, length)))
    assert sorted((str(r.doc_id), r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in got) == expected


@pytest.mark.parametrize(("seed", "length", "sub", "gram"), [(1, 12, 9, 5), (2, 20, 20, 8), (3, 6, 6, 6), (4, 16, 10, 3)])
def test_equals_all_windows(spark, seed, length, sub, gram):
    compare(spark, list(enumerate(planted(seed))), length, sub, gram)


def test_crowded_anchors_take_the_counted_way(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_CONTEXTS", 1)
    compare(spark, list(enumerate(planted(7))), 12, 9, 5)


def surrounded(n, seed=11):
    """Texts that share a passage of 520 bytes in surroundings of their own, near copies of one text, and a copy."""
    rng = random.Random(seed)
    own = lambda size: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(size // 6))
    passage, long = own(560)[:520], own(1500)
    texts = [f"{own(300)} {passage} {own(300)}" for _ in range(n)]
    for i in range(n // 4):
        at = rng.randrange(len(long))
        texts.append(long[:at] + f"<{i}>" + long[at:])
    return [*texts, texts[0]]


def test_crowded_windows_equal_all_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_CONTEXTS", 2)
    compare(spark, list(enumerate(surrounded(40))), substrings.LENGTH, substrings.SUB, substrings.GRAM)


def test_crowded_anchors_make_few_rows(spark, monkeypatch):
    """Of a passage in many surroundings, far fewer rows than windows, and as many a text in a larger group."""
    monkeypatch.setattr(substrings, "SHARD_CONTEXTS", 2)
    kept, made = substrings.stored, {}

    def counted(df, name):
        out = kept(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(substrings, "stored", counted)
    share = []
    for n in (40, 160):
        texts = surrounded(n)
        substrings.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        share.append(sum(made.get(name, 0) for name in ("blocks", "pieces", "windows")) / len(texts))
    assert made["windows"] > 0 and max(share) < 250 and share[1] < 1.2 * share[0]


def test_small_shards_and_segments(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 64)
    compare(spark, list(enumerate(planted(9))), 12, 9, 5)


def test_long_texts_in_segments():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(substrings.SEGMENT + 5000))
    _, _, start, n, full, size, passage = substrings.occurrences(text)
    assert start[0] == 0 and (start[1:] == (start + n)[:-1]).all() and start[-1] + n[-1] == len(text) - substrings.SUB + 1
    assert full.sum() == len(text) - substrings.LENGTH + 1 and ((size == n - 1 + substrings.LENGTH) | (start + size == len(text))).all() and (passage == (full > 0)).all()


def test_query_equals_all_windows(spark, sf, texts):
    ids = sorted(texts)
    data = [(texts[d] or "").encode() for d in ids]
    # of each window its hash only: 400 bytes for every place would not fit
    count, keys = {}, []
    for t in data:
        own = [hash(t[i : i + 400]) for i in range(len(t) - 399)]
        keys.append(own)
        for k in own:
            count[k] = count.get(k, 0) + 1
    expected = {}
    for d, t, own in zip(ids, data, keys):
        gone = bytearray(len(t))
        for i, k in enumerate(own):
            if count[k] > 1:
                gone[i : i + 400] = b"\x01" * 400
        kept = bytes(x for x, y in zip(t, gone) if not y)
        expected[d] = len(t), sum(gone), len(runs(gone)), hashlib.sha256(kept).hexdigest()
    rows = contracts.op7_substrings(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected
    flags = plain_shared(data, 400, substrings.SUB, substrings.PASSAGE_WORDS)
    assert {r.doc_id: r.repeats_passage for r in rows} == {d: int(f) for d, f in zip(ids, flags)}


def test_odd_rows(spark, odd, empty):
    rows = substrings.deduplicated(odd, 20, 14, 8).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[2].n_bytes == 0 and by[1].kept == b"" and by[4].kept == b"" and by[5].kept == b"" and by[8].removed == []
    compare(spark, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.doc_id != 5], 20, 14, 8)
    assert substrings.deduplicated(empty).count() == 0
