"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

1. Every text becomes its set of hashed word shingles and a fast similarity sketch: in round
   i each shingle is hashed to a bin and a value that starts with i, bins keep their least
   value, and rounds i >= T send everything to bin i - T, so every coordinate gets filled
   while long sets stop after a round or two.
2. Texts of equal words collapse to one node (the smallest doc_id) before anything is paired.
3. Nodes that agree on all coordinates of a band share a bucket. First every node is compared
   with one pivot, the least node of all its buckets, which joins most of a group of copies
   for one pair per node. Buckets whose members are all in one component then are done.
4. Buckets that still hold several components are verified whole, in cells of two chunks of
   bounded size: a cell's task counts the common shingles of its members by matrix products
   and returns only links that join components. No pair is emitted that isn't a link, no
   bucket is capped, and no pair of one bucket is left out unless it is in one component.
5. A link is confirmed on the two full shingle sets.

Scale: links and components stay distributed tables in the shared folder; hot buckets, pivots
and classes meet in plain equi-joins, whose large partitions adaptive execution splits, and
counts and minima are combined before their shuffles. Full sets are made only for texts that
share a bucket. What grows faster than the input is the counting of step 4 in buckets of many
texts that are alike but not linked; its memory and its rows do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtwin.llm.common import written

#: Coordinates of a sketch, and coordinates in a band: at a similarity of 0.75 a pair shares no
#: band with a probability of (1 - 0.75**4)**32, or 5e-6.
COORDINATES, BAND = 128, 4
#: Members of a chunk, and columns of the matrices that a cell multiplies at a time.
CHUNK, COLUMNS = 800, 4096
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS_KEPT = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit flips each output bit with a chance of one half."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SEEDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _STEP)
_ROUND = np.arange(2 * COORDINATES, dtype=np.uint64)
_BANDS = mixed(np.arange(1, COORDINATES // BAND + 1, dtype=np.uint64))


class _WordHashes(dict):
    """64-bit hashes of words, kept between texts."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def shingle_set(words: list[bytes], size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; all words as one if there are fewer than ``size``."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    width = min(n, size)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total = total * _STEP + values[i:n - width + 1 + i]
    return np.unique(mixed(total))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The ``COORDINATES`` least values of a set that isn't empty."""
    bins = np.full(COORDINATES, _EMPTY, dtype=np.uint64)
    at_once = max(1, 1024 // len(shingles))   # later rounds never change a filled bin
    for start in range(0, 2 * COORDINATES, at_once):
        rounds = _ROUND[start:start + at_once, None]
        values = mixed(shingles[None, :] ^ _SEEDS[start:start + at_once, None])
        slots = np.where(rounds < COORDINATES, values % np.uint64(COORDINATES), rounds - np.uint64(COORDINATES) * (rounds >= COORDINATES))
        np.minimum.at(bins, slots.astype(np.int64).ravel(), ((rounds << np.uint64(56)) | (values >> np.uint64(8))).ravel())
        if bins.max() != _EMPTY:
            break
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    keys = _BANDS.copy()
    for column in bins.reshape(-1, BAND).T:
        keys = mixed(keys * _STEP + column)
    return keys.view(np.int64)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc, content (digest of the words), n (shingles), bands; for docs of (doc, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        hashes = _WordHashes()
        for batch in batches:
            content, counts, bands = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py() or "")
                shingles = shingle_set(words, size, hashes)
                content.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                counts.append(len(shingles))
                bands.append(band_keys(sketch(shingles)) if len(shingles) else np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                                             names=["doc", "content", "n", "bands"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, content binary, n long, bands array<long>")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """node, content, shingles; for docs of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        hashes = _WordHashes()
        for batch in batches:
            content, sets = [], []
            for text in batch.column(1):
                words = words_of(text.as_py() or "")
                content.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                sets.append(shingle_set(words, size, hashes).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["node", "content", "shingles"])

    return docs.mapInArrow(run, f"node {docs.schema['node'].dataType.simpleString()}, content binary, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with an added ``linked``: whether the full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * common >= percent * (F.size("sa") + F.size("sb") - common)
    # Two texts that share a doc_id are one node with two sets: any of their links counts.
    return (pairs.join(left, "a").join(right, "b").select("a", "b", linked.alias("linked"))
            .groupBy("a", "b").agg(F.max("linked").alias("linked")))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b) but the roots; root: the least vertex it reaches.

    Alternates large-star and small-star steps until the edges stay the same.
    """
    def marked(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = written(df, "stars")
        return df, tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def both(df: DataFrame) -> DataFrame:
        return df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))

    now, mark = marked(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while mark[0]:
        sided = both(now)
        least = sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sided.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        now, after = marked(small)
        if after == mark:
            break
        mark = after
    return now.select("u", F.col("v").alias("root"))


def joining_links(sides: list[np.ndarray], sets: list[np.ndarray], labels: list, percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of similar members of different components, as few as join what is linked.

    ``sides``: the members' positions in the first chunk and in the second; only pairs between
    the sides are looked at (the sides are the same for a chunk with itself).
    """
    rows, columns = sides
    sizes = np.array([len(s) for s in sets])
    owner, place = np.repeat(np.arange(len(sets)), sizes), np.unique(np.concatenate(sets), return_inverse=True)[1]
    often = np.bincount(place)[place] > 1           # a shingle of one member only is in no common set
    owner, place = owner[often], np.unique(place[often], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, (start, start + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[owner[a:b], place[a:b] - start] = 1
        common += part[rows] @ part[columns].T
    alike = 100 * common >= percent * (sizes[rows][:, None] + sizes[columns][None] - common)
    group = {label: label for label in labels}

    def top(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(alike)):
        x, y = top(labels[rows[i]]), top(labels[columns[j]])
        if x != y:
            group[x] = y
            out.append((int(rows[i]), int(columns[j])))
    return out


def _links_in_cells(buckets: DataFrame, sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within the buckets which hold several."""
    labelled = written(buckets.join(stars, buckets["node"] == stars["u"], "left").select("key", "node", "size", F.coalesce("root", "node").alias("label")), "bucket-members")
    still_open = written(labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"), "open-buckets")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    members = (labelled.join(still_open, "key").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node", "key"), "chunks").cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
               .select("key", "node", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    cells = members.join(sets, "node")
    kind = cells.schema["node"].dataType.simpleString()

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, labels, own = rows["node"].to_numpy(), rows["label"].tolist(), rows["own"].to_numpy()
        links = []
        if len(set(labels)) > 1:
            sides = [np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])]
            if len(sides[0]) and len(sides[1]):
                links = joining_links(sides, [np.asarray(s) for s in rows["shingles"]], labels, percent)
        return pd.DataFrame({"a": [min(nodes[i], nodes[j]) for i, j in links], "b": [max(nodes[i], nodes[j]) for i, j in links]}, dtype=nodes.dtype)

    return cells.groupBy("key", "i", "j").applyInPandas(verify, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row (``id_col``, n_shingles, component_id, kept) per row of ``docs``.

    Two documents are linked if their sets of distinct ``words``-word shingles have a Jaccard
    similarity of ``percent`` per cent or more; ``component_id`` is the smallest id that a
    document reaches by links, ``kept`` whether that is its own. Texts with fewer words have
    one shingle, the whole sequence; null texts, empty texts and texts without words have
    none and are linked with nothing. Rows that share an id are one document: they get the
    same component. A row without an id is linked with nothing; its component is null and it
    is kept. Other columns, whatever their names, are not looked at. An empty table gives an
    empty table.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    sketches = written(_sketched(rows, words), "sketches")
    members = sketches.select("doc", "content", "n")
    nodes = written(members.where("n > 0 AND doc IS NOT NULL").groupBy("content").agg(F.min("doc").alias("node")), "nodes")
    bands = (sketches.join(nodes.withColumnRenamed("node", "doc"), ["content", "doc"]).dropDuplicates(["content", "doc"])
             .select(F.col("doc").alias("node"), "n", F.explode("bands").alias("key")))
    shared = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-bands")
    buckets = written(bands.join(shared, "key"), "buckets")
    wanted = buckets.select("node").distinct().join(nodes, "node")
    sets = written(_full_sets(rows.select(F.col("doc").alias("node"), "text").join(buckets.select("node").distinct(), "node", "left_semi"), words)
                   .join(wanted, ["node", "content"]).select("node", "shingles").distinct(), "shingle-sets")

    homes = members.where("n > 0 AND doc IS NOT NULL").join(nodes, "content")
    several = homes.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc", "a")
    links = homes.join(several, "doc").where("a <> node").select("a", F.col("node").alias("b")).distinct()      # ids of different texts
    one = buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"))
    nearest = (buckets.join(one, "key").where((F.col("p.node") < F.col("node")) & (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")))
               .groupBy(F.col("node").alias("b")).agg(F.min("p.node").alias("a")).select("a", "b"))
    first = written(_confirmed(nearest, sets, percent).where("linked").select("a", "b"), "links")
    stars = components(links.union(first))
    rest = written(_confirmed(_links_in_cells(buckets, sets, stars, percent), sets, percent).where("linked").select("a", "b"), "links")
    stars = components(stars.select(F.col("root").alias("a"), F.col("u").alias("b")).union(rest))

    placed = members.join(nodes, "content", "left")
    out = placed.join(stars, placed["node"] == stars["u"], "left")
    component = F.when(F.col("doc").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("root", "node"))
    return (out.select("doc", "n", component.cast(rows.schema["doc"].dataType).alias("component_id"))
            .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept")))
