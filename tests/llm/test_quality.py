import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabtwin.llm.quality import BUCKETS, Model, WIDTH, document_features, fit_quality, score_quality, train
from tabtwin.llm.queries import QUERIES

DATA = "/root/testdata/sf0.1"


def held(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def area(scores, labels):
    ranks = np.empty(len(scores))
    ranks[np.argsort(scores, kind="stable")] = np.arange(1, len(scores) + 1)
    ones = labels.sum()
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_quality"](spark, DATA).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == held(doc) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for doc, r in rows.items())
    test = [(rows[doc].score, rows[doc].predicted, q) for doc, q in labels if held(doc)]
    scores, predicted, quality = (np.array(x) for x in zip(*test))
    assert area(scores, quality) > 0.99 and (predicted == quality).mean() > 0.98
    assert (predicted[quality == 1] == 1).mean() > 0.99


def test_score_is_the_mean_of_the_features():
    rng = np.random.default_rng(0)
    model = Model(rng.normal(size=(BUCKETS, WIDTH)).astype(np.float32), rng.normal(size=(2, WIDTH)), rng.normal(size=2))
    texts = ["a b a a cde", "x" * 5000 + " é日本 🎈", "one", "the the the", " \n ", ""]
    for text, score in zip(texts, model.scores(texts)):
        buckets, weights = document_features(text)
        mean = (model.vectors[buckets] * weights[:, None]).sum(axis=0) if len(buckets) else np.zeros(WIDTH)
        assert score == pytest.approx(model.probabilities(mean[None])[0], abs=1e-4)


def test_odd_labels_and_texts(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "@@ !! ") * 5, "s", "v") for i in range(200)] + [(900, None, "s", "v"), (None, "", "s", "v"), (1, "good", "s", "v")],
                                 "doc_id long, text string, score string, vectors string")
    labels = docs.where("doc_id < 150").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 1), (77, 7)], labels.schema))
    out = score_quality(docs, fit_quality(docs, labels))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "vectors", "score"] and len(rows) == 203
    assert all((r.score > 0.7) == bool(r.doc_id % 2) for r in rows if r.doc_id is not None and r.doc_id < 200)
    assert score_quality(docs.limit(0), train([])).count() == 0
    assert {r.score for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    one = fit_quality(docs, labels.where("quality = 1"))
    assert all(r.score > 0.9 for r in score_quality(docs, one).collect())
