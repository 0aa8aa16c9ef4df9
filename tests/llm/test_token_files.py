import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexloom.llm import contracts, huffman, token_files


@pytest.mark.parametrize("seed", range(6))
def test_round_trip_and_kraft(seed):
    rng = np.random.default_rng(seed)
    counts = np.floor(rng.pareto(0.6, 400) * rng.integers(0, 2, 400)).astype(np.int64)
    counts[0] += 1
    for limit in (9, 12, 18):
        lengths = huffman.code_lengths(counts, limit)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit
        if (counts > 0).sum() > 1:
            assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() == 1
        code = huffman.Codebook(lengths, limit)
        for n in (0, 1, huffman.BLOCK, 3000):
            ids = rng.choice(np.flatnonzero(counts), n)
            payload, at = code.encode(ids)
            assert (code.decode(payload, at, n) == ids).all()


def _best_cost(counts, limit):
    """Least total length over all length vectors that a code can have."""
    best = None
    for lengths in itertools.product(range(1, limit + 1), repeat=len(counts)):
        if sum(2.0**-x for x in lengths) <= 1:
            cost = sum(a * b for a, b in zip(lengths, counts))
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("counts", [(1, 1, 2, 3, 5), (1, 1, 1, 1, 1), (100, 1, 1, 1), (5, 5), (9, 4, 4, 1, 1)])
@pytest.mark.parametrize("limit", [3, 4])
def test_lengths_are_optimal_under_the_limit(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    assert int((lengths * np.array(counts)).sum()) == _best_cost(counts, limit)


def test_blocks_decode_by_themselves():
    ids = np.arange(2000) % 50
    code = huffman.Codebook(huffman.code_lengths(np.bincount(ids)))
    payload, at = code.encode(ids)
    third = np.frombuffer(at, "<u8")[3:4].tobytes()
    assert (code.decode(payload, third, huffman.BLOCK) == ids[3 * huffman.BLOCK : 4 * huffman.BLOCK]).all()


def test_too_many_symbols():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, np.int64), 2)


ODD = ["ÀÉÎ ǅ Ɏ ȺȾ ẞ H̱ É É ŒÆ Σίσυφος ΣΣ","it's we'll I'M DON'T 'tis", "a b c\x1cd\x85e", "x<|endoftext|>y <|STARTOFTEXT|>", "é Å ẞ İ ǅ 𝔘 ﬁ", "3.14 1,000 ¼ ٣ ४", "…—«»!!! ???", "नमस्ते สวัสดี 你好 안녕", "​﻿­", "a_b-c/d", "'s 'S ' s", "\n\n \t"]


def test_encoder_equals_the_library(texts):
    with open(contracts.WORD_BPE, encoding="utf-8") as f:
        spec = f.read()
    plain, own = Tokenizer.from_str(spec), token_files.TextEncoder(spec, 1)
    assert own.by_word
    every = [*ODD, None, "", " ", *texts.values(), "x" * 5000, *ODD]
    expected = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in every]
    column = pa.array(["cut off", *every], pa.string())[1:]  # a slice, as its offsets do not start at zero
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(column).to_pylist()] == expected
    for t, ids in zip(every[:30], expected):
        assert np.frombuffer(own.encode(pa.array([t], pa.string()))[0].as_py(), own.dtype).tolist() == ids


def test_encoder_that_forgets(texts, monkeypatch):
    monkeypatch.setattr(token_files, "POOL_WORDS", 50)
    monkeypatch.setattr(token_files, "GATHER", 7)
    with open(contracts.WORD_BPE, encoding="utf-8") as f:
        own = token_files.TextEncoder(spec := f.read())
    plain = Tokenizer.from_str(spec)
    for t in list(texts.values())[:20]:
        assert np.frombuffer(own.encode(pa.array([t]))[0].as_py(), own.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids


def _expected(rows):
    plain, at, out = Tokenizer.from_file(contracts.WORD_BPE), 0, []
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_brute_force(spark, sf, texts):
    got = sorted(tuple(r) for r in contracts.op1_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == _expected(sorted(texts.items()))


def test_odd_rows(spark, odd, empty, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "odd"), contracts.WORD_BPE, 1)
    rows = token_files.read_token_files(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    assert rows[2].n_tokens == 1 and rows[6].n_tokens == 60_001
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    token_files.write_token_files(empty, str(tmp_path / "none"), contracts.WORD_BPE, 1)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
