import random

import numpy as np
from pyspark.sql import functions as F

from tabtwin.llm import decontaminate
from tabtwin.llm.decontaminate import Matcher, least_distance, match_benchmark, normalised
from tabtwin.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute_distance(item, text):
    """Dynamic programming, a row of the table at a time."""
    letters, at = np.array(list(text), dtype="U1"), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, a in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (letters != a))])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min()), int(row.argmin())


def edited(rnd, text, n):
    for _ in range(n):
        i = rnd.randrange(len(text) or 1)
        text = text[:i] + rnd.choice(["", "q", text[i:i + 1] + "z"]) + text[i + 1:]
    return text


def test_distance_equals_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(400):
        item = "".join(rnd.choices("abc", k=rnd.randrange(1, 90)))
        text = "".join(rnd.choices("abc", k=rnd.randrange(60))) + edited(rnd, item, rnd.randrange(6)) + "".join(rnd.choices("abc", k=rnd.randrange(9)))
        assert least_distance(item, text) == brute_distance(item, text)


def test_matcher_finds_all_within_budget():
    rnd = random.Random(2)
    items = tuple("".join(rnd.choices("abcd ", k=n)).strip().ljust(20, "x") for n in (20, 45, 80, 200) for _ in range(5))
    matcher = Matcher(items, 10)
    for _ in range(60):
        parts = ["".join(rnd.choices("abcd ", k=rnd.randrange(40)))]
        for _ in range(rnd.randrange(3)):
            item = rnd.choice(items)
            parts += [edited(rnd, item, rnd.randrange(len(item) // 8)), "".join(rnd.choices("abcd ", k=9))]
        text = "".join(parts)
        want = [(i, *brute_distance(item, text)) for i, item in enumerate(items)]
        assert matcher.matches(text) == [(i, d, e) for i, d, e in want if d <= len(items[i]) // 10]


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, normalised(r.text or "")) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, normalised(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = set()
    for doc, text in docs:
        for item, t in items:
            k = len(t) * 5 // 100
            if t in text:
                want.add((doc, item, 0))
            elif any(p in text for p in (t[i:i + len(t) // (k + 1)] for i in range(0, len(t), max(1, len(t) // (k + 1))))) and brute_distance(t, text)[0] <= k:
                want.add((doc, item, brute_distance(t, text)[0]))
    assert want and {tuple(r) for r in QUERIES["op2_decontaminate"](spark, DATA).collect()} == want


def test_edge_cases_and_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    items = [(i, " ".join(rnd.choices(words, k=30))) for i in range(12)]
    extra = [(20, items[0][1].upper()), (None, items[1][1]), (21, None), (22, ""), (23, "short one"), (3, items[3][1])]
    bench = spark.createDataFrame(items + extra, "item_id long, text string")
    rows = [(0, f"x {items[0][1]}\n y"), (1, edited(rnd, items[1][1], 4)), (2, None), (3, ""), (4, "short one"), (5, edited(rnd, items[5][1], 60)),
            (6, "w " * 50_000 + items[2][1].replace(" ", " \n\t") + " w" * 50_000), (None, items[3][1]), (0, f"x {items[0][1]}\n y")]
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, matches int, row string")
    for chars in (1_000_000, 700):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        out = match_benchmark(docs, bench)
        assert set(out.columns) == {"doc_id", "text", "matches", "row"}
        got = sorted(((r.doc_id, sorted((m.item, m.distance) for m in r.matches if m.item is not None)) for r in out.collect()), key=str)
        hits = {0: [(0, 0), (20, 0)], 6: [(2, 0)], None: [(3, 0), (3, 0)]}
        assert [x for x in got if x[0] != 1] == sorted(((d, hits.get(d, [])) for d, _ in rows if d != 1), key=str)
        one = out.where("doc_id = 1").select(F.explode("matches").alias("m")).select("m.*").collect()
        assert {r.item for r in one} == {1, None} and all(0 < r.distance <= 4 for r in one)
    assert match_benchmark(docs.limit(0), bench).count() == 0
    assert {len(r.matches) for r in match_benchmark(docs, bench.limit(0)).collect()} == {0}


def test_short_items_are_found_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "so: What  is 2+2? ok"), (2, "what is 2+2?x"), (3, "awhat is 2+2?"), (4, None), (5, "it is 7")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "what is 2+2?"), (8, "7"), (7, ""), (6, None)], "item_id long, text string")
    got = {r.doc_id: [(m["item"], m.distance, m.end) for m in r.matches] for r in match_benchmark(docs, items).collect()}
    assert got == {1: [(9, 0, 16)], 2: [], 3: [], 4: [], 5: [(8, 0, 7)]}


def test_blocks_leave_clashing_columns_alone(spark, monkeypatch):
    monkeypatch.setattr("tabtwin.llm.decontaminate.BLOCK_CHARS", 30)
    items = [f"item number {n} has words like {'abcdef'[n] * 12}" for n in range(6)]
    docs = spark.createDataFrame([(1, " ".join(items), 5, 6, 7)], "doc_id long, text string, `__block0` int, block0 int, row int")
    out = match_benchmark(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert out.columns == [*docs.columns, "matches"]
    row = out.first()
    assert sorted(m["item"] for m in row.matches) == list(range(6)) and (row["__block0"], row.block0, row.row) == (5, 6, 7)
