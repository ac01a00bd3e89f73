"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document.

A word's vector is the mean of the vectors of the word itself and of its n-grams, a document's
the mean over its words and one more word for each that repeats the one before; a softmax layer on that gives the classes' probabilities. Vectors and
layer are trained together by stochastic gradient descent in numpy.

Scale: the fit uses at most ``sample_rows`` labelled documents, those whose ids have the least
hashes; their features are made in parallel, the descent itself runs in one task over those
rows, and the model is a table of fixed size. Scoring is one pass over all whole texts without
a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtwin.llm.common import with_arrow_column

#: Vectors, their width, and the lengths of the n-grams of ``<word>``.
BUCKETS, WIDTH, GRAMS = 1 << 15, 8, (3, 4)
#: The word that is added to a document for each word which repeats the one before it.
AGAIN = "\x00again"
_PRIME = 0x100000001B3


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, feature buckets as a matrix) of words of equal lengths."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if not len(rows):
            continue
        n = lengths[rows[0]]
        for part in np.array_split(rows, max(1, len(rows) * n // 500_000)):
            raw = "".join([words[i] for i in part]).encode("utf-32-le", "surrogatepass")
            chars = np.empty((len(part), n + 2), dtype=np.uint64)
            chars[:, 0], chars[:, -1] = ord("<"), ord(">")
            chars[:, 1:-1] = np.frombuffer(raw, dtype=np.uint32).reshape(len(part), n)
            yield part, _buckets(chars)


def _buckets(chars: np.ndarray) -> np.ndarray:
    prime, width, hashes = np.uint64(_PRIME), chars.shape[1], []
    for size in dict.fromkeys([*(g for g in GRAMS if g <= width), width]):      # the last is the word itself
        h = np.full((len(chars), width - size + 1), size, dtype=np.uint64)
        for i in range(size):
            h = (h ^ chars[:, i:width - size + 1 + i]) * prime
        hashes.append(h)
    h = np.concatenate(hashes, axis=1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) whose weighted sum of vectors is the document's mean; none for a text without words."""
    words = text.split()
    counts = Counter(words)
    if again := sum(map(eq, words, islice(words, 1, None))):
        counts[AGAIN] += again
    total = np.zeros(BUCKETS)
    words, times = list(counts), np.array(list(counts.values()), dtype=np.float64)
    for rows, buckets in _by_length(words):
        weights = np.repeat(times[rows] / buckets.shape[1], buckets.shape[1])
        total += np.bincount(buckets.ravel(), weights, minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used.astype(np.int32), (total[used] / max(1, times.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray     # BUCKETS x WIDTH, float32
    layer: np.ndarray       # 2 x WIDTH
    bias: np.ndarray        # 2

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        """Of class 1, for document means."""
        z = means @ self.layer.T + self.bias
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))

    def scores(self, texts: list[str]) -> np.ndarray:
        words_of = [text.split() for text in texts]
        index: dict[str, int] = {AGAIN: 0}
        for words in words_of:
            for word in words:
                index.setdefault(word, len(index))
        known = np.empty((len(index), self.vectors.shape[1]), dtype=np.float32)
        for rows, buckets in _by_length(list(index)):
            known[rows] = self.vectors[buckets].mean(axis=1)
        means = np.zeros((len(texts), self.vectors.shape[1]))
        for i, words in enumerate(words_of):
            if words:
                at = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
                again = np.count_nonzero(at[1:] == at[:-1])
                means[i] = (known[at].sum(axis=0, dtype=np.float64) + again * known[0]) / (len(words) + again)
        return self.probabilities(means)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 16, rate: float = 1.0, seed: int = 7) -> Model:
    """Descend on (label, buckets, weights) rows; a half for every text if there are no rows, the smoothed share of label 1 if all are alike."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    layer, bias = np.zeros((2, WIDTH)), np.zeros(2)
    if len({label for label, _, _ in rows}) < 2:
        ones = sum(label for label, _, _ in rows)
        return Model(vectors, layer, np.log(np.array([len(rows) - ones + 1.0, ones + 1.0])))
    rows = sorted(rows, key=lambda r: (r[0], len(r[1]), r[1][:3].tolist()))
    spread = np.zeros((BUCKETS, WIDTH), dtype=np.float32)       # summed squares of the gradient: steps shrink where it was large
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = [rows[i] for i in order[at:at + batch]]
            labels = np.array([r[0] for r in some])
            sizes = np.array([len(r[1]) for r in some])
            ids, weights = np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some])
            of = np.repeat(np.arange(len(some)), sizes)
            drawn = vectors[ids] * weights[:, None]
            means = np.stack([np.bincount(of, drawn[:, j], minlength=len(some)) for j in range(WIDTH)], axis=1)
            z = means @ layer.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels] -= 1
            p /= len(some)
            back = (p @ layer).astype(np.float32)[of] * weights[:, None]
            used, place = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(place, back[:, j], minlength=len(used)) for j in range(WIDTH)], axis=1).astype(np.float32)
            spread[used] += grad ** 2
            step = rate * (1 - epoch / epochs)
            vectors[used] -= 0.1 * step * grad / (np.sqrt(spread[used]) + 1e-8)
            layer -= step * (p.T @ means + 1e-4 * layer)
            bias -= step * p.sum(axis=0)
    return Model(vectors, layer, bias)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model fitted on the ``sample_rows`` labelled documents whose ids have the least hashes.

    ``labels`` has the ids and labels (0 or 1) to learn from. Null ids and labels are left out;
    a document with several labels counts with the least; repeated rows of a document in
    ``docs`` count as one (the least text); a null text is an empty one.
    """
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
              .groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Broadcast: at most ``sample_rows`` ids and labels.
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(label, *document_features(text)) for label, text in zip(batch["label"], batch["text"])]
            yield pd.DataFrame([(label, b.tobytes(), w.tobytes()) for label, b, w in rows], columns=["label", "buckets", "weights"])

    def descend(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        model = train([(int(label), np.frombuffer(b, dtype=np.int32), np.frombuffer(w, dtype=np.float32)) for label, b, w in rows.itertuples(index=False)])
        return pd.DataFrame([(model.vectors.tobytes(), model.layer.tobytes(), model.bias.tobytes())], columns=["vectors", "layer", "bias"])

    made = (sample.mapInPandas(features, "label int, buckets binary, weights binary").groupBy(F.lit(0).alias("all"))
            .applyInPandas(lambda key, rows: descend(key, rows[["label", "buckets", "weights"]]), "vectors binary, layer binary, bias binary").collect())
    if not made:
        return train([])
    return Model(np.frombuffer(made[0].vectors, dtype=np.float32).reshape(BUCKETS, WIDTH), np.frombuffer(made[0].layer).reshape(2, WIDTH), np.frombuffer(made[0].bias))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score``: the probability of label 1 of each whole text.

    Null texts, empty ones and texts of white space get what the bias alone gives. Repeated
    rows get equal scores; a column that is already named ``score`` is replaced; other columns
    stay. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)    # of fixed size: BUCKETS x WIDTH floats

    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores([text or "" for text in texts.to_pylist()]), pa.float64())

    return with_arrow_column(docs, score_col, "double", text_col, keep_text, scores)
