from collections import Counter

import numpy as np
import pytest

from tabtwin.llm import lm_score
from tabtwin.llm.lm_score import TOKENS, UNSEEN, WIDTH, WORDS, Tokens, growth, score_documents, train_network, windows, word_counts


def corpus(spark, rare):
    common = [f"w{i:03d}x" for i in range(WORDS)]
    texts = [" ".join(common * 4), " ".join(rare), "", None]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), common


def test_rare_words_have_their_own_probability(spark):
    """Words of one ending get the shares of their counts; one that the corpus lacks gets less."""
    rare = ["basalt-ng"] * 3 + ["quarry-ng"]
    docs, common = corpus(spark, rare)
    counts = word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == Counter(common * 4 + rare)
    words, net = train_network(docs, counts=counts)
    # "basalt-ng" and "quarry-ng" are left out of the frequent words
    assert sorted(words) == sorted(common)
    probes = spark.createDataFrame([(0, "basalt-ng"), (1, "quarry-ng"), (2, "invented-ng"), (3, common[0]), (4, ""), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.lm for r in score_documents(probes, words, net, counts=counts).collect()}
    inside = {d: lm.word_log_prob - lm.log_prob for d, lm in got.items()}
    total = 4 + UNSEEN
    assert inside[0] == pytest.approx(np.log(3 / total)) and inside[1] == pytest.approx(np.log(1 / total))
    assert inside[2] == pytest.approx(np.log(UNSEEN / total)) and inside[3] == pytest.approx(0)
    assert got[0].log_prob == pytest.approx(got[2].log_prob, rel=1e-6)
    assert (got[4].tokens, got[4].word_log_prob) == (0, 0) == (got[None].tokens, got[None].word_log_prob)


def test_tokens_and_parameters_grow_with_the_distinct_words(spark, monkeypatch):
    assert [growth(n) for n in (0, 27_782, 131_071, 131_072, 457_666, 4_200_000, 250_000_000)] == [0, 0, 0, 1, 1, 3, 6]
    monkeypatch.setattr(lm_score, "GROWS_FROM", 1000)
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghijklmnopqr"]     # 1,800 words
    docs = spark.createDataFrame([(i, " ".join(words[i:] + words[:i])) for i in range(0, 1800, 300)] + [(-1, "outside")], "doc_id long, text string")
    counts = word_counts(docs)
    top, net = train_network(docs, counts=counts)
    assert counts.count() == 1801 and len(top) == 2 * WORDS
    assert net.tokens == 2 * TOKENS and net.p["context"].shape == (4, 2 * TOKENS + 1, WIDTH)
    tokens = Tokens([f"w{i}" for i in range(4 * WORDS)])
    assert tokens["w2047"] == 2047 and 2048 <= tokens["elsewhere"] < 4096
    rows = {r.doc_id: r.lm for r in score_documents(docs, top, net, counts=counts).collect()}
    text = docs.where("doc_id = 300").first().text
    assert rows[300].log_prob == pytest.approx(net.log_probabilities(*windows([Tokens(top).of(text)])).sum(), rel=1e-3)
