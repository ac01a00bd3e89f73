import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tabtwin.llm.importance import _buckets, numbered, resample, select_key
from tabtwin.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, target, percent=25):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for doc, text in docs:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in found]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): n for n, r in enumerate(able[:percent * len(able) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance"](spark, DATA)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {f.dataType.simpleString() for f in got.schema} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)


def test_buckets_of_pairs_go_on_from_the_first_word():
    import pyarrow as pa
    ones, twos, counts = _buckets(pa.array(["Größe 3x-A\x7fb", None, "", "é"]), 10000)
    assert counts.tolist() == [4, 0, 0, 1]
    assert ones.tolist() == [crc32(w.encode()) % 10000 for w in ("größe", "3x", "a", "b", "é")]
    assert twos.tolist() == [crc32(w.encode()) % 10000 for w in ("größe 3x", "3x a", "a b")]


def test_selection_is_exact_and_each_round_discards_a_quarter(spark):
    rng = np.random.default_rng(3)
    keys = [(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 3000), rng.integers(0, 500, 3000))]
    df = spark.createDataFrame(keys, "a long, b long").repartition(7)
    want = sorted(keys)
    for k in (1, 2, 750, 1500, 2999, 3000):
        key, left = select_key(df, k)
        assert key == want[k - 1]
        assert left[0] == 3000 and all(y <= 0.75 * x + 7 for x, y in zip(left, left[1:]))
    lopsided = spark.createDataFrame([(5, 5)] * 2000 + [(i, 0) for i in range(10)], "a long, b long").orderBy("a")
    assert select_key(lopsided, 1000)[0] == (5, 5)


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("a"), F.lit(0).alias("b"))
    assert all(r.number == r.a + 1 for r in numbered(rows, ["a", "b"]).collect())


def test_nulls_repeats_empty_and_long_texts_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text, 9, "x")] * 5 + [(None, text, None, None), (None, None, 1, None), (2, "", 1, "y"), (3, "short one", 1, "y"),
                                      (4, "long " * 300_000, 1, "y"), (5, text + " more", 2, None)]
    schema = "doc_id long, text string, rank int, `a.b` string"
    target = spark.createDataFrame([("w1 w2",), (None,)], "text string")
    out = resample(spark.createDataFrame(rows, schema), target, percent=50)
    assert out.columns == ["doc_id", "text", "a.b", "n_features", "weight", "score", "rank"]
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=str)
    want = brute([r[:2] for r in rows], ["w1 w2", None], percent=50)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert sorted(g[4] for g in got if g[4]) == [1, 2, 3, 4] and Counter(g[0] for g in got if g[4]) == Counter(w[0] for w in want if w[4])
    empty = spark.createDataFrame([], schema)
    assert resample(empty, target).collect() == []
    assert resample(spark.createDataFrame(rows[:3], schema), target.limit(0), percent=0).where("rank is not null").count() == 0
