import hashlib
import importlib.util
import os

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tabtwin.llm.bpe import read_ranks
from tabtwin.llm.decontaminate import normalised
from tabtwin.llm.quality import fit_quality
from tabtwin.llm.queries import held_out, tokenizer

DATA = "/root/testdata/sf0.01"


def beside(name):
    """A test module of this folder."""
    spec = importlib.util.spec_from_file_location(name, os.path.join(os.path.dirname(__file__), f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = fit_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet").where(~held_out()))
    scores = dict(zip(rows, model.scores(list(rows.values()))))
    stages = [f for _, f in corpus_pipeline.STAGES]

    one = stages[0](spark, docs, DATA).cache()
    assert one.columns == docs.columns
    kept = {r.doc_id: r.text or "" for r in one.collect()}
    assert kept == {d: rows[d] for d in rows if scores[d] >= 0.7} and 0.6 * len(rows) < len(kept) < len(rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all((d in kept) == (q == 1) for d, q in labels.items())

    two = stages[1](spark, one, DATA).cache()
    assert two.columns == docs.columns
    want = {d: t for d, _, _, t in beside("test_line_dedup").brute(list(kept.items()), 10)}
    assert {r.doc_id: r.text for r in two.collect()} == want != kept
    assert two.where(F.length("text") != F.col("n_chars")).count() == 0

    three = stages[2](spark, two, DATA).cache()
    first = {d for d, _, _, is_first in beside("test_near_dup").brute(list(want.items())) if is_first}
    assert {r.doc_id for r in three.collect()} == first and len(first) < len(want)

    four = stages[3](spark, three, DATA).cache()
    items = [normalised(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in four.collect()}
    assert clean < first
    brute_distance = beside("test_decontaminate").brute_distance
    for d in sorted(first - clean):
        text = normalised(want[d])
        assert any(t in text or brute_distance(t, text)[0] <= len(t) * 5 // 100 for t in items)
    assert not [d for d in clean if any(t in normalised(want[d]) for t in items)]

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(tokenizer()[0]), special_tokens={})
    last = stages[4](spark, four, DATA).collect()
    assert {r.doc_id for r in last} == clean
    for r in last:
        assert r.ids == library.encode_ordinary(want[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.ids_sha256) for r in last)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_all_stages(spark, empty):
    schema = "doc_id long, text string, lang string, source string, n_chars int, score int, rest string, row string, `a.b` int"
    text = "plain words of a document that is neither short nor strange, "
    rows = [(1, text * 3, "en", "s", 9, 1, "x", "r"), (1, text * 3, "en", "s", 9, 1, "x", "r"), (2, text.upper() * 3, None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
            (3, None, "en", "s", 0, 1, "x", "r"), (4, "", "en", "s", 0, 1, "x", "r"), (None, text * 3, "en", "s", 9, 1, "x", "r"), (5, text * 4000, "en", "s", 9, 1, "x", "r")]
    rows = [(*r, 7) for r in rows]
    docs = spark.createDataFrame([] if empty else rows, schema)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "rest", "row", "a.b"], name
    out = [r.doc_id for r in corpus_pipeline.tokenize(spark, docs, DATA).collect()]
    assert sorted(out, key=str) == ([] if empty else [1, 3, 4, None, None])  # 2 and 5 have the shingles of 1
    scored = corpus_pipeline.keep_quality(spark, spark.createDataFrame([] if empty else rows, schema), DATA)
    assert scored.columns == docs.columns and scored.count() >= 0


def test_one_row_of_each_document_stays(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, text), (1, text), (1, other), (2, text), (None, text), (None, text), (None, other), (3, None), (3, None), (4, "fourteen fifteen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")                 # no n_chars either
    kept = corpus_pipeline.keep_one_of_each_group(spark, corpus_pipeline.strip_shared_lines(spark, docs, DATA), DATA)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text), (1, other), (None, text), (None, other), (3, ""), (4, "fourteen fifteen")], key=str)
