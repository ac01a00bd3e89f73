"""Document scores by masked pseudo-likelihood under a bidirectional window network.

Words become tokens: the most frequent words of the whole corpus, and for every other word a
hash of its ending. A network predicts each token from the two before it and the two after it:
the sum of position-wise embeddings through tanh, then a softmax over classes of tokens and one
over the tokens of the class. ``log_prob`` is the sum of the log-probabilities of a document's
tokens, each given both sides; ``word_log_prob`` adds, for each word that shares its token with
others, the logarithm of its share of the token, from the counts of all words of the corpus.

What is learned grows with the corpus: every distinct word has its count in a distributed
table, and frequent words, endings, classes and embeddings follow the number of distinct words
(``growth``).

Training covers all documents: words are counted over the corpus, then every task descends
once over all windows of its documents from the same start, and the tasks' parameters are
averaged, weighted by their windows. Scoring is one more pass.

Scale: counts and parameters are combined in two levels, so no task reads more than a share of
them; what reaches the driver is the frequent words and one set of parameters, which grow with
the square root of the distinct words. Documents are not shuffled; their rarer words are, to
meet their counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtwin.llm.common import quoted, slices, unpacked, with_arrow_column, written

#: Least numbers of frequent words, suffix buckets and classes of tokens; width of the embeddings, windows in a training step.
WORDS, SUFFIXES, CLASSES, WIDTH, STEP = 512, 512, 32, 8, 8192
TOKENS = WORDS + SUFFIXES
IN_CLASS = TOKENS // CLASSES
OFFSETS = (-2, -1, 1, 2)
#: Windows that are scored at a time, which doesn't change their scores, and rows of one product in that.
SCORED, ROWS = 1 << 16, 1024
#: Distinct words at which the least numbers are doubled for the first time.
GROWS_FROM = 131_072
#: Occurrences that all words outside the corpus have together in each token.
UNSEEN = 0.5


def growth(distinct: int) -> int:
    """How often the frequent words and the suffix buckets are doubled: at ``GROWS_FROM`` distinct words and at each fourfold of that."""
    doubled = 0
    while distinct >= GROWS_FROM * 4 ** doubled:
        doubled += 1
    return doubled


def _shapes(tokens: int) -> dict[str, tuple[int, ...]]:
    classes = CLASSES
    while classes * classes < tokens:
        classes *= 2
    inside = tokens // classes
    return {"context": (len(OFFSETS), tokens + 1, WIDTH), "classes": (classes, WIDTH), "class_bias": (classes,), "words": (classes, inside, WIDTH), "word_bias": (classes, inside)}


def _sizes(shapes: dict[str, tuple[int, ...]]) -> dict[str, int]:
    return {name: int(np.prod(shape)) for name, shape in shapes.items()}


_SHAPES = _shapes(TOKENS)
#: Parameters in one row on their way to the average.
BLOCK = 4096


class Tokens(dict):
    """Token of a word; the rare ones are added as they come, up to a bound."""

    def __init__(self, words: list[str]) -> None:
        super().__init__((word, i) for i, word in enumerate(words))
        self.words, self.frequent = words, max(WORDS, len(words))
        self.ending = _ending(self.frequent)

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000 + self.frequent:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.words))
        token = self[word] = self.frequent + zlib.crc32(word[-self.ending:].encode("utf-8", "surrogatepass")) % self.frequent
        return token

    def of(self, text: str) -> np.ndarray:
        return self.of_words(text.split())

    def of_words(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))

    def of_array(self, words: pa.StringArray) -> np.ndarray:
        """Each distinct word, and each distinct ending of the rare ones, is looked up once."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        tokens = pc.index_in(distinct, value_set=pa.array(self.words, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        rare = tokens < 0
        endings = pc.utf8_slice_codeunits(distinct.filter(pa.array(rare)), start=-self.ending).dictionary_encode()
        hashed = [self.frequent + zlib.crc32(e.encode()) % self.frequent for e in endings.dictionary.to_pylist()]
        tokens[rare] = np.array(hashed, np.int32)[endings.indices.to_numpy(zero_copy_only=False)]
        return tokens[coded.indices.to_numpy(zero_copy_only=False)]

    def of_texts(self, texts: pa.StringArray | list[str | None]) -> tuple[pa.StringArray, list[np.ndarray]]:
        """(the words of all texts, the tokens of each text)."""
        words, counts = words_of(texts)
        return words, np.split(self.of_array(words), np.cumsum(counts, dtype=np.int64)[:-1])


def words_of(texts: pa.StringArray | list[str | None]) -> tuple[pa.StringArray, np.ndarray]:
    """(the words of all texts, as ``str.split`` cuts them; how many each text has)."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    pieces, owner = split.flatten(), pc.list_parent_indices(split)
    held = pc.greater(pc.binary_length(pieces), 0)      # nothing stands before white space at a text's start, nor after it at the end
    return pieces.filter(held), np.bincount(owner.filter(held).to_numpy(), minlength=len(texts))


def _ending(frequent: int) -> int:
    """Characters of a rare word's ending that its token is made of: two, and one more for each four times as many frequent words, begun."""
    return 2 + (frequent // WORDS).bit_length() // 2


class WindowNet:
    """The network's parameters by name, as float32 arrays of ``_shapes`` of its tokens."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, at, self.tokens = flat.astype(np.float32), 0, TOKENS
        while sum(_sizes(_shapes(self.tokens)).values()) < len(flat):
            self.tokens *= 2
        self.p: dict[str, np.ndarray] = {}
        for name, shape in _shapes(self.tokens).items():
            size = int(np.prod(shape))
            self.p[name] = self.flat[at:at + size].reshape(shape)
            at += size

    def zeros(self) -> dict[str, np.ndarray]:
        return {name: np.zeros_like(values) for name, values in self.p.items()}

    @staticmethod
    def start(shares: np.ndarray, seed: int = 5) -> "WindowNet":
        """Small random embeddings; biases that give each token its share of the corpus."""
        rng = np.random.default_rng(seed)
        net = WindowNet(rng.normal(0, 0.1, sum(_sizes(_shapes(len(shares))).values())))
        by_class = shares.reshape(net.p["word_bias"].shape)
        net.p["class_bias"][:] = np.log(by_class.sum(axis=1))
        net.p["word_bias"][:] = np.log(by_class)
        return net

    def hidden(self, contexts: list[np.ndarray]) -> np.ndarray:
        total = np.take(self.p["context"][0], contexts[0], axis=0)
        for table, ids in zip(self.p["context"][1:], contexts[1:]):
            total += np.take(table, ids, axis=0)
        return np.tanh(total, out=total)

    def log_probabilities(self, targets: np.ndarray, contexts: list[np.ndarray], descend: dict[str, np.ndarray] | None = None, rate: float = 0.1) -> np.ndarray:
        """Of each target given its context; with ``descend`` (sums of squared gradients), one step of descent is made as well."""
        p, n = self.p, len(targets)
        classes, in_class = p["word_bias"].shape
        order = _by_token(targets, self.tokens)         # tokens of one class lie together
        targets, contexts = targets[order], [np.take(np.where(c < 0, self.tokens, c), order) for c in contexts]      # padding is the last one
        h, owner = np.ones((n, WIDTH + 1), np.float32), targets // in_class
        h[:, :WIDTH] = self.hidden(contexts)            # the last one takes the biases
        inside = targets - owner * in_class
        edges = np.searchsorted(owner, np.arange(classes + 1)).tolist()
        top_weights, top_near = _weights(p["classes"], p["class_bias"])
        low_weights, low_near = _weights(p["words"], p["word_bias"])
        held = [(c, a, b) for c, a, b in zip(range(classes), edges, edges[1:]) if a < b]
        out, result = np.empty(n, np.float32), np.empty(n)
        if descend is None:                             # a few rows at a time, which stay in the processor's cache
            for a in range(0, n, ROWS):
                b = min(a + ROWS, n)
                out[a:b] = _softmax(h[a:b] @ top_weights, top_near, owner[a:b])[2]
            for c, first, end in held:
                for a in range(first, end, ROWS):
                    b = min(a + ROWS, end)
                    out[a:b] += _softmax(h[a:b] @ low_weights[c], low_near, inside[a:b])[2]
            result[order] = out
            return result
        top_grad, back = np.zeros((classes, WIDTH + 1), np.float32), np.empty((n, WIDTH), np.float32)
        for a in range(0, n, ROWS):
            b = min(a + ROWS, n)
            top, total, out[a:b] = _softmax(h[a:b] @ top_weights, top_near, owner[a:b])
            top[np.arange(b - a), owner[a:b]] -= total
            scale = (1 / total)[:, None]
            top_grad += top.T @ (h[a:b] * scale)
            np.multiply(top @ p["classes"], scale, out=back[a:b])
        grads = {}
        grads["classes"], grads["class_bias"] = _parted(top_grad)
        low = np.empty((n, in_class), np.float32)
        for c, a, b in held:
            np.matmul(h[a:b], low_weights[c], out=low[a:b])
        low, total, logs = _softmax(low, low_near, inside)
        out += logs
        low[np.arange(n), inside] -= total
        scale = 1 / total
        scaled, both, below = h * scale[:, None], np.zeros((classes, in_class, WIDTH + 1), np.float32), np.empty((n, WIDTH), np.float32)
        for c, a, b in held:
            np.matmul(low[a:b].T, scaled[a:b], out=both[c])
            np.matmul(low[a:b], p["words"][c], out=below[a:b])
        grads["words"], grads["word_bias"] = _parted(both)
        below *= scale[:, None]
        back += below
        back *= 1 - h[:, :WIDTH] ** 2
        for name, grad in grads.items():
            squares = descend[name]
            squares += grad * grad
            p[name] -= rate * grad / (np.sqrt(squares) + 1e-6)
        for table, squares, ids in zip(p["context"], descend["context"], contexts):     # only the tokens that occur have a gradient
            by = _by_token(ids, self.tokens)
            ids = ids[by]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if n else np.zeros(0, np.int64)
            held = ids[first].astype(np.int64)
            grad = np.add.reduceat(np.take(back, by, axis=0), first, axis=0) if n else back
            summed = np.take(squares, held, axis=0)
            summed += grad * grad
            squares[held] = summed
            table[held] -= rate * grad / (np.sqrt(summed) + 1e-6)
        result[order] = out
        return result


def _by_token(ids: np.ndarray, tokens: int) -> np.ndarray:
    """The stable order by token; padding is ``tokens``. Short integers are sorted by counting."""
    return np.argsort(ids.astype(np.uint16) if tokens < 1 << 16 else ids, kind="stable")


def _weights(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """(weights and biases to multiply h by, less the most that comes out of it; whether no power gets too small by that), for each class."""
    reach = np.abs(weights).sum(axis=-1)                # no entry of ``h`` is beyond 1
    most = (bias + reach).max(axis=-1, keepdims=True)
    near = bool((most - (bias - reach).min(axis=-1, keepdims=True)).max() < 60)
    both = np.concatenate([weights, (bias - most)[..., None]], axis=-1)
    return np.ascontiguousarray(np.swapaxes(both, -1, -2)), near


def _parted(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return both[..., :WIDTH], both[..., WIDTH]


def _softmax(z: np.ndarray, near: bool, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(powers, their sum by row, log-probability of the chosen ones); the powers are left undivided, in place of ``z``."""
    if not near:
        z -= z.max(axis=1, keepdims=True)
    out = z[np.arange(len(z)), chosen]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return z, total, out - np.log(total)


def windows(documents: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(targets, contexts by offset) of all tokens, document after document; what lies outside a document is a padding token."""
    pad, gap = np.int32(-1), max(OFFSETS)
    parts = [np.full(gap, pad, dtype=np.int32)]
    for tokens in documents:
        parts += [tokens, parts[0]]
    line = np.concatenate(parts)
    at = np.flatnonzero(line != pad)
    return line[at], [line[at + offset] for offset in OFFSETS]


def _steps(targets: np.ndarray, contexts: list[np.ndarray], step: int = STEP) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for a in range(0, len(targets), step):
        yield targets[a:a + step], [c[a:a + step] for c in contexts]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) for every distinct word of all documents, as a written table."""
    words = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?U)[\s\x1c-\x1f]+")).alias("word")).where("word <> ''")
    return written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")


def vocabulary(docs: DataFrame, text_col: str = "text", counts: DataFrame | None = None) -> tuple[list[str], np.ndarray]:
    """(the most frequent words, the smoothed share of each token), counted over all documents; ties go to the lesser word."""
    counts = word_counts(docs, text_col) if counts is None else counts
    size = WORDS << growth(counts.count())
    frequent = [(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]
    ending = _ending(size)
    totals = np.ones(2 * size)
    for row in counts.groupBy(_bucket(ending, size).alias("bucket")).agg(F.sum("n").alias("n")).collect():   # at most ``size`` rows
        totals[size + row.bucket] += row.n
    for i, (word, n) in enumerate(frequent):
        totals[i] += n
        totals[size + zlib.crc32(word[-ending:].encode()) % size] -= n
    return [word for word, _ in frequent], totals / totals.sum()


def _bucket(ending: int, size: int) -> Column:
    return F.crc32(F.encode(F.substring("word", -ending, ending), "utf-8")) % size


def train_network(docs: DataFrame, text_col: str = "text", counts: DataFrame | None = None) -> tuple[list[str], WindowNet]:
    """The vocabulary and the averaged network, from all windows of all documents."""
    words, shares = vocabulary(docs, text_col, counts)
    start = WindowNet.start(shares)
    shared = docs.sparkSession.sparkContext.broadcast((words, start.flat))      # grows with the root of the distinct words

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, flat = shared.value
        tokens, net, seen = Tokens(words), WindowNet(flat.copy()), 0
        squares = net.zeros()
        for batch in batches:
            for part in slices(batch, "text"):
                for targets, contexts in _steps(*windows(tokens.of_texts(part.column("text"))[1])):
                    net.log_probabilities(targets, contexts, squares)
                    seen += len(targets)
        if seen:
            blocks = range(0, len(net.flat), BLOCK)
            part = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in blocks], pa.int32()), pa.array([part] * len(blocks), pa.int32()),
                                              pa.array([float(seen)] * len(blocks)), pa.array([net.flat[b:b + BLOCK] for b in blocks], pa.list_(pa.float32()))],
                                             names=["block", "part", "windows", "mean"])

    kind = "block int, part int, windows double, mean array<float>"
    made = docs.select(F.col(text_col).alias("text")).mapInArrow(descend, kind)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "part": [0], "windows": [rows["windows"].sum()], "mean": [np.average(np.stack(rows["mean"]), axis=0, weights=rows["windows"]).astype(np.float32)]})

    halves = made.groupBy("block", "part").applyInPandas(add, kind)
    blocks = sorted(halves.groupBy("block").applyInPandas(add, kind).collect())
    if not blocks:
        return words, start
    return words, WindowNet(np.concatenate([np.array(b["mean"]) for b in blocks]))


def score_documents(docs: DataFrame, words: list[str], net: WindowNet, text_col: str = "text", score_col: str = "lm", keep_text: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``lm``: (tokens, log_prob), the number of tokens of the whole text and the sum of their log-probabilities.

    With ``counts`` (``word_counts`` of the corpus) also word_log_prob, the sum of the words'
    own log-probabilities: a word that is not among the frequent ones has its share of its token's
    occurrences, and one that the corpus lacks has the share of ``UNSEEN`` occurrences.

    Null and empty texts and texts of white space have no tokens and a sum of 0. Repeated rows
    get equal scores; a column that is already named ``lm`` is replaced, other columns stay; an
    empty table stays empty. Training takes the same texts; over an empty table it returns the
    network it starts from.
    """
    size = max(WORDS, len(words))
    totals = np.full(size, UNSEEN)
    if counts is not None:
        rare = counts.join(docs.sparkSession.createDataFrame([(w,) for w in words], "word string"), "word", "left_anti")
        for row in rare.groupBy(_bucket(_ending(size), size).alias("bucket")).agg(F.sum("n").alias("n")).collect():     # at most ``size`` rows
            totals[row.bucket] += row.n
    shared = docs.sparkSession.sparkContext.broadcast((words, net.flat, np.log(totals)))    # grows with the root of the distinct words
    by_word = counts is not None

    def run(texts: pa.Array) -> pa.Array:
        words, flat, logs = shared.value
        tokens, net = Tokens(words), WindowNet(flat)
        all_words, documents = tokens.of_texts(texts)
        parts = [net.log_probabilities(*step) for step in _steps(*windows(documents), SCORED)]
        ends = np.cumsum([0, *map(len, documents)])

        def sums(values: list[np.ndarray]) -> pa.Array:
            running = np.concatenate([[0.0], np.cumsum(np.concatenate(values))]) if values else np.zeros(1)
            return pa.array(running[ends[1:]] - running[ends[:-1]], pa.float64())

        columns = {"tokens": pa.array(np.diff(ends), pa.int64()), "log_prob": sums(parts)}
        if by_word:
            line = np.concatenate([np.zeros(0, np.int32), *documents])
            rare = line >= tokens.frequent
            columns["token_logs"] = sums([np.where(rare, logs[line - tokens.frequent * rare], 0.0)])
            offsets = np.concatenate([[0], np.cumsum(rare)])[ends]
            columns["rare"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), all_words.filter(pa.array(rare)))
        return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    if not by_word:
        return with_arrow_column(docs, score_col, "struct<tokens:long,log_prob:double>", text_col, keep_text, run)
    made = with_arrow_column(docs, score_col, "struct<tokens:long,log_prob:double,token_logs:double,rare:array<string>>", text_col, keep_text, run)
    kept = [c for c in made.columns if c != score_col]
    made = written(made.select(F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in kept]).alias("row"), F.col(quoted(score_col)).alias("lm"),
                               F.monotonically_increasing_id().alias("id")), "scored")
    # Each rare word meets its count; words without one are those the corpus lacks.
    found = made.select("id", F.explode("lm.rare").alias("word")).join(counts, "word").groupBy("id").agg(F.sum(F.ln("n")).alias("logs"), F.count(F.lit(1)).alias("found"))
    both = made.select("id", "row", "lm.tokens", "lm.log_prob", "lm.token_logs", F.size("lm.rare").alias("n_rare")).join(found, "id", "left")
    inside = F.coalesce("logs", F.lit(0.0)) + (F.col("n_rare") - F.coalesce("found", F.lit(0))) * float(np.log(UNSEEN)) - F.col("token_logs")
    return unpacked(both, "row", kept, {score_col: F.struct("tokens", "log_prob", (F.col("log_prob") + inside).alias("word_log_prob"))})
