"""Importance resampling of documents towards a target corpus, with an exact distributed cutoff.

Words and pairs of neighbouring words are hashed into buckets. A bucket's gain is the logarithm of
its share of the target over its share of the corpus; a document's weight is the mean gain of its
features, looked up in the array of gains, and its score adds a Gumbel draw keyed by its id, so that
the highest scores are a draw without replacement in proportion to the weights.

The cutoff is found by weighted median-of-medians selection. Every partition of the scored table
reports the median of its keys that are still in question and their number; the median of those
medians, weighted by the numbers, has a quarter of the remaining keys at least on either side, so
each round, one job that counts below and above it and takes the next medians on both sides, discards
that share until the exact key is met. The winners alone are sorted.

Scale: two passes over the documents and no shuffle of them: the first leaves at most one count per
bucket and task, the second one narrow row per document. The driver holds the counts of the
buckets (a parameter) and one median per partition. Keys left are written anew when they have fallen
to a quarter, so all rounds together read a small multiple of the keys. Every table between jobs
lies in the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabtwin.llm.common import packed, slices, unpacked, written

#: Buckets, words a document needs to be drawn, percent drawn, seed of the draw.
BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of a word as they are (A-Z lower-cased); every other ASCII byte parts words.
_WORD_BYTES = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b | 0x20 if chr(b).isupper() else 0x20 for b in range(256))
#: Keys are (-score, id); a null id comes last.
LAST = (1 << 63) - 1


def _buckets(texts: pa.Array, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and then of all pairs, and the number of words of each text."""
    split = [(t or b"").translate(_WORD_BYTES).split() for t in texts.cast(pa.binary()).to_pylist()]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    single = [list(map(crc32, words)) for words in split]
    pairs = [map(crc32, [b" " + w for w in words[1:]], ones) for words, ones in zip(split, single)]      # the checksum goes on from the first word's
    ones = np.fromiter(chain.from_iterable(single), dtype=np.int64, count=counts.sum()) % n_buckets
    twos = np.fromiter(chain.from_iterable(pairs), dtype=np.int64, count=np.maximum(counts - 1, 0).sum()) % n_buckets
    return ones, twos, counts


def feature_counts(texts: DataFrame, text_col: str, n_buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for found in _buckets(part.column("text"), n_buckets)[:2]:
                    total += np.bincount(found, minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(n_buckets, dtype=np.int64)
    for r in rows.collect():                                            # a row per bucket
        counts[r.bucket] = r.n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    n, S, T = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + n) / ((s + 1.0) * (T + n)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def _gumbel(seed: int, doc_id: object) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """(row, id, text) rows to (row, id, n_words, n_features, weight, score)."""
    shared = rows.sparkSession.sparkContext.broadcast(gains)             # an integer per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ones, twos, words = _buckets(part.column("text"), len(gain))
                pairs = np.maximum(words - 1, 0)
                total = sum(_sums(gain[found], n) for found, n in ((ones, words), (twos, pairs)))
                n = words + pairs
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                draw = np.array([_gumbel(seed, i) for i in part.column("id").to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *map(pa.array, (words, n, weight, weight + draw))],
                                                 names=["row", "id", "n_words", "n_features", "weight", "score"])

    schema = rows.drop("text").schema.add("n_words", "long").add("n_features", "long").add("weight", "long").add("score", "long")
    return rows.select("row", "id", "text").mapInArrow(run, schema)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


Key = tuple[int, int]


def _middle(a: np.ndarray, b: np.ndarray) -> Key:
    """Lower median of the keys (a, b); (0, 0) of none."""
    if not len(a):
        return 0, 0
    k = (len(a) - 1) // 2
    part = np.partition(a, k)[k]
    return int(part), int(np.sort(b[a == part])[k - int((a < part).sum())])


def _round(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> list:
    """Of every partition: the number and median of its keys between ``low`` and ``high`` below, at and above ``pivot``."""

    def below(a: np.ndarray, b: np.ndarray, key: Key) -> np.ndarray:
        return (a < key[0]) | ((a == key[0]) & (b < key[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for batch in batches:
            x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            inside = np.ones(len(x), dtype=bool)
            if low is not None:
                inside &= ~below(x, y, low) & ~((x == low[0]) & (y == low[1]))
            if high is not None:
                inside &= below(x, y, high)
            a.append(x[inside])
            b.append(y[inside])
        a, b = np.concatenate(a), np.concatenate(b)
        less = below(a, b, pivot) if pivot else np.zeros(len(a), dtype=bool)
        same = (a == pivot[0]) & (b == pivot[1]) if pivot else less
        more = ~less & ~same
        row = (int(less.sum()), *_middle(a[less], b[less]), int(same.sum()), int(more.sum()), *_middle(a[more], b[more]))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=names)

    names = ["n_less", "less_a", "less_b", "n_same", "n_more", "more_a", "more_b"]
    return keys.mapInArrow(run, ", ".join(f"{n} long" for n in names)).collect()          # a row per partition


def select_key(keys: DataFrame, k: int, shrink: int = 4) -> tuple[Key, list[int]]:
    """The ``k``-th least (from 1) of the two-column integer keys, and the share of the keys that each round left.

    ``keys`` is read once a round and should be a written table; it has ``k`` rows at least.
    """
    low = high = pivot = None
    stored, left = None, []
    while True:
        found = _round(keys, low, high, pivot)
        less, same = sum(r.n_less for r in found), sum(r.n_same for r in found)
        if pivot and less < k <= less + same:
            return pivot, left
        if pivot and k <= less:
            high, sides = pivot, [(r.less_a, r.less_b, r.n_less) for r in found if r.n_less]
        else:
            low, k = pivot or low, k - less - same
            sides = [(r.more_a, r.more_b, r.n_more) for r in found if r.n_more]
        remaining = sum(n for _, _, n in sides)
        left.append(remaining)
        pivot = _weighted_median(sides)
        stored = stored or remaining
        if remaining * shrink <= stored:
            fewer = max(1, math.ceil(len(found) * remaining / stored))
            keys, stored = written(keys.where(_between(low, high)).coalesce(fewer), "selection-keys"), remaining


def _between(low: Key | None, high: Key | None) -> F.Column:
    after = F.lit(True) if low is None else (F.col("a") > low[0]) | ((F.col("a") == low[0]) & (F.col("b") > low[1]))
    return after & (F.lit(True) if high is None else (F.col("a") < high[0]) | ((F.col("a") == high[0]) & (F.col("b") < high[1])))


def _weighted_median(medians: list[tuple[int, int, int]]) -> Key:
    medians = sorted(medians)
    half, seen = sum(n for _, _, n in medians) / 2, 0
    for a, b, n in medians:
        seen += n
        if seen >= half:
            return a, b
    raise ValueError("no keys are left: fewer than were asked for")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``number`` from 1 in the given order: range partitions, each numbered by itself behind those before."""
    dealt = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))                       # a row per partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "part").withColumn("number", F.col("offset") + place).drop("part", "offset")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n_buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_features``, ``weight``, ``score`` and ``rank`` (from 1 by score, null where not drawn).

    Of the N documents with ``min_words`` words or more, the floor(percent * N / 100) highest scores are drawn, ties to
    the smaller id. Ids are integers; a null one draws as an empty one and comes last in ties. Rows count one by one:
    repeated rows have equal scores and as many of them are drawn as fit. A null or empty text has no features and
    weight 0; without target texts the gains still follow from the corpus. An empty table gives an empty one. Columns
    named as a result are replaced, others stay (without ``keep_text`` the text goes).
    """
    names = [c for c in docs.columns if keep_text or c != text_col]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    rows = docs.select(packed(docs.select(*[quoted[c] for c in names])).alias("row"), quoted[id_col].cast("long").alias("id"), quoted[text_col].alias("text"))
    gains = bucket_gains(feature_counts(docs, text_col, n_buckets), feature_counts(target, target_col, n_buckets))
    # Written, as every round of the selection reads its keys.
    table = written(scored(rows, gains, seed).select("*", (-F.col("score")).alias("a"), F.coalesce("id", F.lit(LAST)).alias("b")), "importance")
    enough = F.col("n_words") >= min_words
    k = percent * table.where(enough).count() // 100
    if k:
        (a, b), _ = select_key(table.where(enough).select("a", "b"), k)
        upto = enough & ((F.col("a") < a) | ((F.col("a") == a) & (F.col("b") <= b)))
    else:
        upto = F.lit(False)
    drawn = numbered(table.where(upto), ["a", "b"]).withColumn("rank", F.when(F.col("number") <= k, F.col("number"))).drop("number")
    both = drawn.unionByName(table.where(~upto).withColumn("rank", F.lit(None).cast("long")))
    return unpacked(both, "row", names, {c: F.col(c).cast("long") for c in ("n_features", "weight", "score", "rank")})
