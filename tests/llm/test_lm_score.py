import random
from collections import Counter

import numpy as np
import pytest

from tabtwin.llm.lm_score import (CLASSES, IN_CLASS, SUFFIXES, TOKENS, WORDS, Tokens, WindowNet, _SHAPES, _steps, score_documents, train_network, vocabulary,
                                  windows)
from tabtwin.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute(net, tokens):
    """The log-probability of each token by itself, in float64, and the total probability of all tokens there."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    padded = [TOKENS, TOKENS, *tokens, TOKENS, TOKENS]
    for i in range(len(tokens)):
        h = np.tanh(sum(p["context"][k][padded[i + 2 + o]] for k, o in enumerate((-2, -1, 1, 2))))
        top = np.exp(p["classes"] @ h + p["class_bias"])
        low = np.exp(p["words"] @ h + p["word_bias"])
        all_ = (top / top.sum())[:, None] * (low / low.sum(axis=1, keepdims=True))
        yield np.log(all_.ravel()[tokens[i]]), all_.sum()


def test_scores_equal_a_token_at_a_time():
    rng = np.random.default_rng(0)
    net = WindowNet(rng.normal(0, 0.7, sum(int(np.prod(s)) for s in _SHAPES.values())))
    documents = [rng.integers(0, TOKENS, n).astype(np.int32) for n in (1, 2, 5, 40)]
    got = net.log_probabilities(*windows(documents))
    want = [x for d in documents for x in brute(net, d.tolist())]
    assert got == pytest.approx([x for x, _ in want], rel=1e-3)
    assert [total for _, total in want] == pytest.approx(np.ones(len(want)))


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(1)
    net = WindowNet(rng.normal(0, 0.3, sum(int(np.prod(s)) for s in _SHAPES.values())))
    targets, contexts = windows([rng.integers(0, TOKENS, 60).astype(np.int32)])
    loss = lambda: -net.log_probabilities(targets, contexts).sum()
    squares = {name: np.zeros(shape, np.float32) for name, shape in _SHAPES.items()}
    before = net.flat.copy()
    net.log_probabilities(targets, contexts, squares, rate=0.0)
    assert (net.flat == before).all()
    for name in _SHAPES:                            # squares now hold the squared gradient
        at = np.unravel_index(squares[name].argmax(), squares[name].shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 0.02
        up = loss()
        net.p[name][at] = kept - 0.02
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / 0.04) == pytest.approx(float(squares[name][at]) ** 0.5, rel=0.05)


def test_vocabulary_counts_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words, shares = vocabulary(docs)
    counts = Counter(w for r in docs.collect() for w in (r.text or "").split())
    assert words == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:WORDS]]
    tokens, totals = Tokens(words), np.ones(TOKENS)
    for w, n in counts.items():
        totals[tokens[w]] += n
    assert shares == pytest.approx(totals / totals.sum())


def test_trained_network_prefers_real_text(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_lm_score"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    assert all(r.n_tokens == len(texts[d].split()) for d, r in rows.items())
    words, net = train_network(docs)
    for d, r in rows.items():                       # the query's own training gives the same network
        want = net.log_probabilities(*windows([Tokens(words).of(texts[d])])).sum() if texts[d].split() else 0
        assert r.log_prob == pytest.approx(want, rel=1e-3, abs=1e-3)
    rnd, better, all_ = random.Random(0), 0, 0
    _, shares = vocabulary(docs)
    real = np.concatenate([Tokens(words).of(t) for t in texts.values()])
    assert sum(r.log_prob for r in rows.values()) / len(real) > np.log(shares[real]).mean() + 0.3
    for d in sorted(texts)[:60]:
        if len(texts[d].split()) > 80:
            shuffled = texts[d].split()
            rnd.shuffle(shuffled)
            all_ += 1
            better += rows[d].log_prob > net.log_probabilities(*windows([Tokens(words).of(" ".join(shuffled))])).sum()
    assert better > 0.9 * all_ > 10


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b a", "l"), (1, "a b a", "l"), (2, None, "l"), (None, "", "l"), (3, "  \n", "l"), (4, "w " * 50_000, "l"), (5, "日本 🎈\x1cé", "l")],
                               "doc_id long, text string, lm string")
    out = score_documents(df, *train_network(df)).collect()
    assert sorted((r.lm.tokens for r in out)) == [0, 0, 0, 3, 3, 3, 50_000]
    assert all((r.lm.log_prob < 0) == (r.lm.tokens > 0) for r in out)
    assert len({r.lm.log_prob for r in out if r.doc_id == 1}) == 1
    none = df.limit(0)
    assert score_documents(none, *train_network(none)).count() == 0
    assert CLASSES * IN_CLASS == TOKENS == WORDS + SUFFIXES
