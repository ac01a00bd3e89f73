import hashlib
import random
import re
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabtwin.llm.periodic_runs import periodic_runs, runs_of
from tabtwin.llm.queries import QUERIES, with_planted_periods

DATA = "/root/testdata/sf0.001"


def brute(w):
    """(first, last, period) of the maximal runs, diagonal by diagonal."""
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            s = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            a, b = s - q, i - 1
            if i > s and b - a + 1 >= max(12, 2 * q) and not any(w[a + k:b + 1] == w[a:b + 1 - k] for k in range(1, q)):
                out.add((a, b, q))
            i += i == s
    return out


def found(docs):
    counts = [len(d) for d in docs]
    flat = np.array([x for d in docs for x in d], dtype=np.int64)
    got = runs_of(flat, np.repeat(np.arange(len(docs)), counts), np.concatenate([np.arange(n) for n in counts]))
    return {(a, b, q) for (a, b), q in got.items()}


def check(docs):
    want, offset = set(), 0
    for d in docs:
        want |= {(a + offset, b + offset, q) for a, b, q in brute(d)}
        offset += len(d)
    assert found(docs) == want


block = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 9)).map(lambda x: x[0] * x[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(block, max_size=4).map(lambda parts: sum(parts, [])), min_size=1, max_size=3))
def test_runs_equal_brute_force(docs):
    check(docs)


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 60), st.integers(3, 60), st.integers(1, 6), st.integers(0, 300))
def test_runs_of_blocks_of_one_word(n, m, times, cut):
    words = ([0] * n + [1] + [0] * m + [2]) * times
    check([words[:len(words) - cut % len(words)], words])


def rewritten(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    checked = 0
    for doc, text in texts.items():
        words = rewritten(doc, text)
        if len(words) > 1500:                       # brute force is quadratic; longer ones are held below
            continue
        runs = sorted((a, b - a + 1, q) for a, b, q in brute(words))
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        r = got[doc]
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
        checked += len(runs)
    assert checked > 5


def test_planted_runs_of_long_texts_are_found(spark):
    docs = with_planted_periods(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    n = 0
    for r in periodic_runs(docs).collect():
        if crc32(str(r.doc_id).encode()) % 10 == 0 and len(words := r.text.split()) >= 30:
            g = crc32(str(r.doc_id).encode()) // 10
            a, p = g % len(words), 1 + (len(words) - g % len(words)) // (3 + g % 8)
            if len(words) - a >= max(12, 2 * p):
                assert any(x.start <= a and x.start + x.length == len(words) and p % x.period == 0 for x in r.periodic.runs)
                n += 1
    assert n > 5


def test_nulls_blank_and_long_texts_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, periodic int, `a.b` string, row int"
    rows = [(None, None, 1, None, 1), (1, "", 1, "x", 2), (1, " \t\x0b\n", 1, "x", 3), (2, "a " * 11, 1, "x", 4), (2, "a b " * 12, 1, "x", 5),
            (2, "a b " * 12, 1, "x", 5), (3, "so " + "x y z " * 100_000 + "end", 1, "x", 6)]
    out = periodic_runs(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "a.b", "row", "periodic"]
    got = sorted((r.row, [tuple(x) for x in r.periodic.runs], r.periodic.collapsed) for r in out.collect())
    assert got == [(1, [], ""), (2, [], ""), (3, [], ""), (4, [], " ".join("a" * 11)), (5, [(0, 12, 1)], "a b"), (5, [(0, 12, 1)], "a b"),
                   (6, [(1, 300_000, 3)], "so x y z end")]
    assert periodic_runs(spark.createDataFrame([], schema), keep_text=False).collect() == []
    assert with_planted_periods(spark.createDataFrame([(None, "a b"), (0, None), (0, "")], "doc_id long, text string")).collect()[0].text == "a b"


def test_random_words_of_two_letters():
    rng = random.Random(1)
    check([[rng.randint(0, 1) for _ in range(2000)]])
