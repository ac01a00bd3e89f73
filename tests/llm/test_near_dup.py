import random

import numpy as np

from tabtwin.llm.near_dup import COORDINATES, near_duplicates, sketch, words_of
from tabtwin.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def brute(rows, percent=75):
    """doc -> (n, component) over (doc, text) rows, all pairs of texts that share a shingle."""
    sets = []
    for doc, text in rows:
        w = words_of(text or "")
        sets.append((doc, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {doc: doc for doc, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for ids in where.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                if (j, i) not in seen:
                    seen.add((j, i))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= percent * len(a | b):
                        x, y = sorted((find(sets[i][0]), find(sets[j][0])))
                        parent[y] = x
    return sorted((doc, len(s), find(doc), find(doc) == doc) for doc, s in sets)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute(rows)
    assert sum(not kept for *_, kept in want) > 20
    assert sorted(map(tuple, QUERIES["op7_near_dup"](spark, DATA).collect())) == want


def test_sketch_estimates_similarity_and_fills_every_coordinate():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 5000):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:n - n // 5], pool[n:n + n // 5]])
        x, y = sketch(a), sketch(b)
        assert (x != np.uint64(2**64 - 1)).all()
        true = (n - n // 5) / (n + n // 5)
        assert abs((x == y).mean() - true) < 5 / COORDINATES**0.5 / 2


def test_chains_of_near_copies_and_edge_cases(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, now = [], rnd.choices(words, k=120)
    for i in range(60):                     # each is linked with its neighbours, the ends are far apart
        rows.append((1000 - i, " ".join(now)))
        now = list(now)
        now[rnd.randrange(len(now))] = f"new{i}"
    base = rnd.choices(words, k=100)
    for i in range(40):                     # variants of one text that differ more from each other than from it
        v = list(base)
        for _ in range(3):
            v[rnd.randrange(100)] = f"x{rnd.random()}"
        rows.append((i + 1, " ".join(v)))
    rows += [(500, " ".join(base)), (501, "\t".join(base).upper()), (600, None), (601, ""), (602, " \n"), (603, "a b"), (604, "A  B"), (605, "b a"),
             (700, "p q r s t u"), (700, "p q r s t u"), (701, "q r s t u v w"), (702, "z " * 30000)]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, node string, label int")
    got = near_duplicates(df)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    none = near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, none), key=str) == [(1, 1, 1, True), (None, 1, None, True), (None, 1, None, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_texts_of_one_id_share_a_component(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(df).collect()} == {3}


def test_three_texts_under_one_id_link_all_their_documents(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    df = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (5, c), (7, c)], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(df).collect()} == {1}
