"""Token counts that follow edits: a segment tree of pre-token runs per document.

A document's pre-tokens are kept as leaves of a few pre-tokens each, with the characters and
tokens of every leaf, and a binary tree of their sums above. An edit re-encodes only from the
leaf that holds the character two before it to the first old leaf border behind it where the
new pre-tokens fall back into step with the old ones; sums on the paths to the changed leaves
are then updated.

Two characters suffice on the left because no alternative of the pattern looks further than
one character past the end of what it may match plus one; on the right the pattern never looks
back, so equal text from equal borders on is cut equally.

Scale: one pass over whole texts without a shuffle. Trees are array columns beside the text, so
a document store can keep them and take in later edits without counting documents anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtwin.llm.bpe import Encoder, encoder
from tabtwin.llm.common import with_arrow_column

#: Pre-tokens of a new leaf.
LEAF = 32
TREE = "struct<chars:array<int>,tokens:array<int>>"


class CountTree:
    """Characters and tokens of each leaf, and the sums of ever larger runs of leaves.

    ``levels[0]`` has the leaves as (chars, tokens) rows, ``levels[h][i]`` the sum of
    ``levels[h - 1][2 * i]`` and its neighbour.
    """

    def __init__(self, leaves: np.ndarray) -> None:
        self.levels = [leaves.reshape(-1, 2)]
        self._sum_up()

    def _sum_up(self) -> None:
        del self.levels[1:]
        while len(below := self.levels[-1]) > 1:
            padded = below if len(below) % 2 == 0 else np.concatenate([below, np.zeros((1, 2), dtype=below.dtype)])
            self.levels.append(padded[0::2] + padded[1::2])

    @property
    def leaves(self) -> np.ndarray:
        return self.levels[0]

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1]) if len(self.leaves) else 0

    def find(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character; the end if there is none."""
        if not len(self.leaves) or char >= self.levels[-1][0, 0]:
            return len(self.leaves), int(self.levels[-1][0, 0]) if len(self.leaves) else 0
        at, start = 0, 0
        for level in reversed(self.levels[:-1]):
            at *= 2
            if char >= start + level[at, 0]:
                start += int(level[at, 0])
                at += 1
        return at, start

    def replace(self, first: int, stop: int, new: np.ndarray) -> None:
        """Leaves ``first`` to ``stop`` become ``new``; only paths to them change if their number stays."""
        if len(new) != stop - first:
            self.levels[0] = np.concatenate([self.leaves[:first], new.reshape(-1, 2), self.leaves[stop:]])
            self._sum_up()
            return
        self.leaves[first:stop] = new
        for below, level in zip(self.levels, self.levels[1:]):
            first, stop = first // 2, (stop + 1) // 2
            for i in range(first, stop):
                level[i] = below[2 * i:2 * i + 2].sum(axis=0)


def _counted(coder: Encoder, words: list[str]) -> np.ndarray:
    """Leaves (chars, tokens) of consecutive pre-tokens."""
    return _leaves(coder.finish(set(words)), words)


def _leaves(done: dict[str, bytes], words: list[str]) -> np.ndarray:
    if not words:
        return np.empty((0, 2), dtype=np.int64)
    sizes = np.empty((len(words), 2), dtype=np.int64)
    sizes[:, 0] = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    sizes[:, 1] = np.fromiter(map(len, map(done.__getitem__, words)), dtype=np.int64, count=len(words)) // 4
    return np.add.reduceat(sizes, np.arange(0, len(words), LEAF), axis=0)


def edit(coder: Encoder, text: str, tree: CountTree, start: int | None, end: int | None, put: str | None) -> tuple[str, int]:
    """(new text, characters re-encoded) after ``text[start:end]`` became ``put``; ``tree`` is updated.

    Offsets are clamped to the text; a null start is 0, a null end the start, a null text empty.
    """
    start = min(max(0, start or 0), len(text))
    end = start if end is None else min(max(start, end), len(text))
    put = put or ""
    new, shift, behind = text[:start] + put + text[end:], len(put) - (end - start), start + len(put)
    first, at = tree.find(max(0, start - 2))
    stop, border = tree.find(end)
    if border < end:                                # the leaf holds the edit's end, so it goes too
        border += int(tree.leaves[stop, 0])
        stop += 1
    begin, words = at, []
    if at < len(new):
        for span in coder.spans(new, at):
            if at >= behind:
                while stop < len(tree.leaves) and border + shift < at:
                    border += int(tree.leaves[stop, 0])
                    stop += 1
                if at == border + shift:
                    break
            words.append(span.group())
            at = span.end()
    if at >= len(new):
        stop = len(tree.leaves)
    tree.replace(first, max(first, stop), _counted(coder, words))
    return new, at - begin


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", tree_col: str = "tree") -> DataFrame:
    """``docs`` with ``tree``: the characters and tokens of each leaf; the count is the sum of its tokens.

    Null and empty texts have no leaves. Repeated rows get equal trees; a column that is already
    named ``tree`` is replaced, other columns stay; an empty table stays empty.
    """
    def trees(texts: pa.Array) -> pa.Array:
        coder = encoder(ranks_path, pattern)
        cut = [coder.split(text or "") for text in texts.to_pylist()]
        done = coder.finish(set().union(*cut))      # all texts' pre-tokens at once
        return _packed([_leaves(done, words) for words in cut])

    return with_arrow_column(docs, tree_col, TREE, text_col, True, trees)


def n_tokens(tree_col: str = "tree"):
    """The token count of a tree column."""
    return F.aggregate(F.col(tree_col)["tokens"], F.lit(0).cast("long"), lambda total, n: total + n)


def apply_edits(counted: DataFrame, ranks_path: str, pattern: str, edits_col: str = "edits", text_col: str = "text", tree_col: str = "tree",
                edited_col: str = "edited") -> DataFrame:
    """``counted`` with ``edited``: (text, tree, reencoded) after the edits of each row.

    ``edits`` is array<struct<start:int,end:int,text:string>>, applied in order, each to the
    text that those before it left (see ``edit`` for odd offsets); a null array or edit changes
    nothing. ``reencoded`` counts the characters that were encoded again. A null text is an
    empty one. A column that is already named ``edited`` is replaced.
    """
    def run(texts: pa.Array, trees: pa.Array, edits: pa.Array) -> pa.Array:
        coder = encoder(ranks_path, pattern)
        out, leaves, counts = [], [], []
        for text, chars, tokens, changes in zip(texts.to_pylist(), trees.field("chars"), trees.field("tokens"), edits.to_pylist()):
            text, tree, total = text or "", CountTree(np.stack([np.asarray(chars.values, dtype=np.int64), np.asarray(tokens.values, dtype=np.int64)], axis=1)), 0
            for change in changes or ():
                if change is not None:
                    text, n = edit(coder, text, tree, change["start"], change["end"], change["text"])
                    total += n
            out.append(text)
            leaves.append(tree.leaves)
            counts.append(total)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), _packed(leaves), pa.array(counts, pa.int64())], names=["text", "tree", "reencoded"])

    return with_arrow_column(counted, edited_col, f"struct<text:string,tree:{TREE},reencoded:long>", [text_col, tree_col, edits_col], True, run)


def _packed(leaves: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, leaves)], dtype=np.int32))
    both = np.concatenate(leaves).astype(np.int32) if leaves else np.empty((0, 2), dtype=np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(both[:, i]))) for i in (0, 1)]
    return pa.StructArray.from_arrays(lists, names=["chars", "tokens"])
