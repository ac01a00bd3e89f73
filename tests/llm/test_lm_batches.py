import numpy as np
import pytest

from tabtwin.llm import lm_score
from tabtwin.llm.lm_score import SCORED, STEP, TOKENS, WIDTH, WORDS, Tokens, WindowNet, _SHAPES, _steps, windows


def network(seed, scale):
    return WindowNet(np.random.default_rng(seed).normal(0, scale, sum(int(np.prod(s)) for s in _SHAPES.values())))


def test_tokens_of_many_words_equal_those_of_each():
    words = [f"w{i}" for i in range(WORDS)]
    texts = ["w1 w2  quarry-ng basalt-ng x", None, "", " \t", "日本 🎈 naïveté g ng w511 w512 " * 50, "\x1cw3\u2003é"]
    tokens = Tokens(words)
    tokens.ending = 4
    flat, documents = tokens.of_texts(texts)
    assert flat.to_pylist() == [w for t in texts for w in (t or "").split()]
    one = Tokens(words)
    one.ending = 4
    assert [d.tolist() for d in documents] == [one.of(t or "").tolist() for t in texts]
    assert [d.tolist() for d in tokens.of_texts(["", None])[1]] == [[], []]


@pytest.mark.parametrize("scale", [0.3, 9.0])           # great weights: powers are taken from each row's own greatest
def test_scores_do_not_depend_on_the_windows_at_a_time(scale, monkeypatch):
    rng, net = np.random.default_rng(2), network(0, scale)
    line = windows([rng.integers(0, TOKENS, n).astype(np.int32) for n in (3000, 1, 0, 7000)])
    assert SCORED > STEP
    many = np.concatenate([net.log_probabilities(*s) for s in _steps(*line, SCORED)])
    monkeypatch.setattr(lm_score, "ROWS", 64)
    few = np.concatenate([net.log_probabilities(*s) for s in _steps(*line, 500)])
    assert np.isfinite(many).all() and many == pytest.approx(few, rel=1e-4, abs=1e-4)


def test_a_step_costs_few_calls_and_leaves_absent_tokens_alone(monkeypatch):
    """One softmax for each block of rows and one for all classes; tokens that do not occur keep their parameters."""
    net, calls, softmax = network(1, 0.2), [], lm_score._softmax
    before, squares = net.flat.copy(), net.zeros()
    monkeypatch.setattr(lm_score, "_softmax", lambda *a: (calls.append(len(a[0])), softmax(*a))[1])
    ids = np.random.default_rng(3).integers(0, 700, 2000).astype(np.int32)
    net.log_probabilities(*windows([ids]), squares)
    assert len(calls) <= 1 + -(-2000 // lm_score.ROWS)
    old = WindowNet(before).p["context"]
    moved = (old != net.p["context"]).any(axis=(0, 2))
    assert set(np.flatnonzero(moved)) == set(ids) | {TOKENS} and squares["context"].shape == (4, TOKENS + 1, WIDTH)
