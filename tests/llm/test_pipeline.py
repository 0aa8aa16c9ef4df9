import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexloom.llm import contracts, pieces, secrets, toxicity
from tests.llm.test_mixing import plain_mix
from tests.llm.test_secrets import plain as plain_secrets
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_toxicity import plain_segments


def plain_toxicity(texts, labels):
    """Scores by a plain reading of the model's description; labels: doc_id to 0 or 1."""
    words = {d: re.findall(r"\w+", (t or "").lower()) for d, t in texts.items()}
    train = {d: y for d, y in labels.items() if zlib.crc32(str(d).encode()) % 5}
    n = [Counter(w for d, y in train.items() if y == k for w in words[d]) for k in (0, 1)]
    df = [Counter(w for d, y in train.items() if y == k for w in set(words[d])) for k in (0, 1)]
    corpus = Counter(w for ws in words.values() for w in ws)
    share = sum(train.values()) / len(train)
    tried = [w for w in df[0] | df[1] if df[0][w] + df[1][w] > 1]
    part = lambda x, y: x * math.log(x / y) if x > 0 else 0.0
    evidence = {}
    for w in tried:
        seen, hit = df[0][w] + df[1][w], df[1][w] / (df[0][w] + df[1][w])
        nats = seen * (part(hit, share) + part(1 - hit, 1 - share)) - math.log(len(tried))
        if nats > 0:
            evidence[w] = nats if hit > share else -nats
    mean = {w: (corpus[w] + 1) / (corpus.total() + 1) for w in evidence}

    def weigh(toxic, total):
        """Score of any word, and of words without evidence."""
        p = {w: (toxic[w] + toxicity.PRIOR * mean[w]) / (total + toxicity.PRIOR) for w in evidence}
        q = {w: (n[0][w] + toxicity.PRIOR * mean[w]) / (n[0].total() + toxicity.PRIOR) for w in evidence}
        other = math.log((1 - sum(p.values())) / (1 - sum(q.values())))
        out = {}
        for w, nats in evidence.items():
            own = math.log(p[w]) - math.log(q[w])
            if own * nats > 0:
                keep = 1 - math.exp(-abs(nats))
                out[w] = keep * own + (1 - keep) * other
        z = math.log(sum(q[w] * math.exp(x) for w, x in out.items()) + (1 - sum(q[w] for w in out)) * math.exp(other))
        return {w: x - max(z, 0) for w, x in out.items()}, min(other - max(z, 0), -1e-3), q

    first = {w: x for w, x in weigh(n[1], n[1].total())[0].items() if x > 0}
    inside = Counter()
    for d, y in train.items():
        if y == 1 and first:
            found = toxicity.maximal_segments([first.get(w, -toxicity.FIRST_DRIFT) for w in words[d]])
            a, b, _ = max(found, key=lambda x: (x[2], -x[0]), default=(0, 0, 0))
            inside.update(words[d][a:b])
    if not inside:
        return dict.fromkeys(texts, 0.0)
    weights, other, clean = weigh(inside, inside.total())
    model = toxicity.ToxicityModel(weights, other, toxicity._karlin_lambda(weights, other, clean))
    segments = {}
    for d, ws in words.items():
        # only runs between the first and the last weighted word can score; the definition is cubic elsewhere
        at = [i for i, w in enumerate(ws) if w in weights]
        scores = [weights.get(w, other) for w in ws[at[0] : at[-1] + 1]] if at else []
        segments[d] = plain_segments(scores) if len(scores) < 400 else toxicity.maximal_segments(scores)
    low = [d for d in train if train[d] == 0 and words[d]]
    tops = {d: max((s for *_, s in segments[d]), default=0.0) for d in low}
    some = sorted(x for x in tops.values() if x > 0)
    model.k = math.exp(-30)
    if some:
        x = (some[(len(some) - 1) // 2] + some[len(some) // 2]) / 2
        observed, a, b = sum(t >= x for t in tops.values()), -30.0, 0.0
        for _ in range(60):
            c = (a + b) / 2
            expected = sum(1 - math.exp(-math.exp(c) * len(words[d]) * math.exp(-model.lam * x)) for d in low)
            a, b = (c, b) if expected < observed else (a, c)
        model.k = math.exp((a + b) / 2)
    ids = list(train)
    x = np.array([model.features(len(words[d]), segments[d]) for d in ids])
    c, a, b = toxicity._logistic(x, np.array([train[d] for d in ids], float))
    out = {}
    for d in texts:
        f, g = model.features(len(words[d]), segments[d])
        out[d] = 1 / (1 + math.exp(-max(min(c + a * f + b * g, 700.0), -700.0)))
    return out


def masked(text):
    """text without its base spans, if linking adds none."""
    out, at, open_ = [], 0, False
    for a, _, b in plain_secrets(text):
        if open_ and a <= at:
            at = max(at, b)
            continue
        out += [text[at:a], "[SECRET]"]
        at, open_ = b, True
    return "".join(out) + text[at:]


def test_run_equals_a_plain_version(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic = plain_toxicity({d: r.text for d, r in docs.items()}, labels)
    kept = [d for d in sorted(docs) if toxic[d] < 0.5]
    groups = plain_components([(d, plain_fingerprint(docs[d].text)) for d in kept])
    kept = [d for d, c in zip(kept, groups) if c == d]
    links = {r.doc_id for r in secrets.secrets(spark.read.parquet(f"{sf}/documents.parquet")).where("size(spans) > size(strong)").select("doc_id").collect()}
    text = {d: masked(docs[d].text or "") for d in kept}
    copies = dict(zip(kept, plain_mix([(d, docs[d].source, text[d]) for d in kept])))
    with open(contracts.PIECES, "rb") as f:
        model = pieces.Pieces(f.read())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter({d: n for d, n in copies.items() if n})
    for r in rows:
        assert r.source == docs[r.doc_id].source and r.n_pieces * 4 == len(r.piece_ids)
        if r.doc_id not in links:
            assert bytes(r.piece_ids) == model.encode(text[r.doc_id])


def test_scores_of_the_plain_model(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    plain = plain_toxicity(texts, labels)
    for r in contracts.op2_toxicity(spark, sf).collect():
        assert r.score == pytest.approx(plain[r.doc_id], abs=1e-6)


def test_stages_keep_columns(spark, sf, odd, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "pieces"]
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, empty, odd.drop("text_key", "strong", "spans")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "pieces" or out.columns == columns
            out.count()
            docs = docs if name == "pieces" else out
