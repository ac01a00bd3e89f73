import math

import numpy as np

from tabtwin.llm.queries import QUERIES
from tabtwin.llm.topk_search import CoverTree, dual_search, top_k_search

DATA = "/root/testdata/sf0.01"


def brute(rows, asked, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(1024 * float(np.float32(x))) for x in v])
    out = []
    for q in sorted(x for x in asked if x in ok):
        best = sorted((-max(sum(a * b for a, b in zip(x, y)) for x in ok[q] for y in vs), i) for i, vs in ok.items() if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best[:k])]
    return out


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op9_topk_search"](spark, DATA).collect()))
    assert got == brute(rows, [i for i, _ in rows if i % 100 == 0])


def test_ties_repeats_odd_vectors_and_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5).round(1)]) for i in range(150)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(200)]           # one vector that many rows hold
    rows += [(500, None), (501, [None, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (504, []), (505, [1.0, 2.0]),
             (3, rows[3][1]), (7, [9.0] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, score string")
    asked = [0, 3, 7, 200, 500, 504, 505]
    got = top_k_search(df, df.where(F_in(asked)), block_rows=40, group_rows=2)
    want = brute([(i, v + [0.0] * (5 - len(v)) if v is not None else v) for i, v in rows], asked)
    assert sorted(map(tuple, got.collect())) == want
    few = top_k_search(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3]
    assert top_k_search(df.limit(0), df.limit(0)).count() == 0


def F_in(ids):
    from pyspark.sql import functions as F
    return F.col("vec_id").isin(ids)


def test_cover_tree_covers_and_separates():
    points = np.random.default_rng(2).normal(size=(900, 3))
    tree = CoverTree(points)
    for node, kids in enumerate(tree.children):
        gap = np.linalg.norm(points[tree.rows[node]] - points[tree.centres[node]], axis=1)
        assert gap.max() <= tree.radii[node] + 1e-12
        if kids:
            assert sorted(np.concatenate([tree.rows[k] for k in kids])) == sorted(tree.rows[node])
            reach = 2.0 ** (math.ceil(math.log2(tree.radii[node])) - 1)
            centres = points[[tree.centres[k] for k in kids]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(len(kids), 1)]
            assert (apart > reach).all()


def test_few_pairs_are_compared(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.floor(1024 * np.array([r.embedding for r in rows], dtype=np.float64)).astype(np.int64)
    asked, compared = ids % 100 == 0, []
    dual_search(vectors[asked], ids[asked], vectors, ids, 10, compared)
    assert 10 * asked.sum() <= sum(compared) < 0.05 * asked.sum() * len(ids)
