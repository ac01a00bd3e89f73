"""Benchmark decontamination by pigeonhole edit matching.

A test item of L characters may be found with up to k = L * percent / 100 edits. Cut into
k + 1 pieces, at least one piece of it is then in the document unchanged; all pieces of all
items are looked for at once by an Aho-Corasick automaton, and around each hit Myers'
bit-parallel algorithm gives the least edit distance between the item and any substring.

Scale: documents are scanned where they are, without a shuffle. Items go to the tasks in
blocks of bounded size, one scan for each block, so a benchmark of any size can be used.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tabtwin.llm.common import packed, quoted, unpacked, with_arrow_column

#: Characters of test items that are looked for in one scan.
BLOCK_CHARS = 1_000_000


def normalised(text: str) -> str:
    """Lower-cased, with white space runs as one space and none at the ends."""
    return " ".join(text.lower().split())


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 pieces of nearly equal lengths."""
    edges = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def least_distance(item: str, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance between ``item`` and a substring of ``text``, and where the first such substring ends."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        same = masks.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        rise = down | ~(horizontal | up) & full
        fall = up & horizontal
        if rise & high:
            score += 1
        elif fall & high:
            score -= 1
            if score < best:
                best, end = score, at
        rise, fall = rise << 1 & full, fall << 1 & full
        up = fall | ~(vertical | rise) & full
        down = rise & vertical
    return best, end


class Matcher:
    """A block of normalised items, each with its budget of edits."""

    def __init__(self, items: tuple[str, ...], percent: int, min_chars: int = 0) -> None:
        import ahocorasick

        self.items, self.short = items, [len(item) < min_chars for item in items]
        self.budgets = [0 if short else len(item) * percent // 100 for item, short in zip(items, self.short)]
        where: dict[str, list[tuple[int, int]]] = {}
        for number, (item, budget) in enumerate(zip(items, self.budgets)):
            for offset, piece in pieces_of(item, budget):
                where.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, distance, end) of each item that is in the text within its budget; the first of its best places."""
        starts: dict[int, set[int]] = {}
        for last, (length, places) in self.automaton.iter(text) if self.items else ():
            for number, offset in places:
                starts.setdefault(number, set()).add(last + 1 - length - offset)
        out = []
        for number, at in sorted(starts.items()):
            item, k = self.items[number], self.budgets[number]
            if self.short[number]:                  # one piece: the hits are the item itself
                whole = [a for a in sorted(at) if not text[max(0, a - 1):a].isalnum() and not text[a + len(item):a + len(item) + 1].isalnum()]
                if whole:
                    out.append((number, 0, whole[0] + len(item)))
                continue
            best, end = k + 1, 0
            windows: list[list[int]] = []
            for start in sorted(at):                # where the item may lie, overlapping places as one
                a, b = max(0, start - k), min(len(text), start + len(item) + k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            for a, b in windows:
                there = text.find(item, a, b)
                distance, stop = (0, there - a + len(item)) if there >= 0 else least_distance(item, text[a:b])
                if distance < best:
                    best, end = distance, a + stop
                if not best:
                    break
            if best <= k:
                out.append((number, best, end))
        return out


@lru_cache(maxsize=2)
def _matcher(items: tuple[str, ...], percent: int, min_chars: int) -> Matcher:
    return Matcher(items, percent, min_chars)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, percent: int = 5, min_chars: int = 20, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", matches_col: str = "matches") -> DataFrame:
    """``docs`` with ``matches``: (item, distance, end) of every benchmark item found in the whole text.

    Both texts are normalised (see ``normalised``); an item is found if a substring of the
    document is within ``percent`` per cent of the item's length in edits. ``end`` is where the
    first of the best substrings ends in the normalised document. Items under ``min_chars``
    normalised characters are found where they stand exactly, between characters that are no letters or
    digits; null and empty ones are looked for nowhere. Items of equal text are all reported; a null item id is reported as null.
    Null and empty documents have no matches; repeated rows get equal ones; a column that is
    already named ``matches`` is replaced, other columns stay. Empty tables are allowed on
    either side.
    """
    spark = docs.sparkSession
    kind = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where(F.length("text") > 0)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    found = f"array<struct<item:{kind},distance:int,end:long>>"
    arrow = to_arrow_type(DataType.fromDDL(found))
    out = docs.select(packed(docs).alias("row"), F.col(quoted(text_col)).alias("text"))
    for block in range(blocks):
        # About BLOCK_CHARS characters: the items are dealt out by a hash.
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        ids: dict[str, list] = {}
        for row in rows:
            ids.setdefault(normalised(row.text), []).append(row.item)
        texts = tuple(sorted(text for text in ids if text))
        shared = spark.sparkContext.broadcast((texts, [sorted(ids[text], key=str) for text in texts]))

        def search(column: pa.Array, shared=shared) -> pa.Array:
            texts, owners = shared.value
            matcher = _matcher(texts, percent, min_chars)
            return pa.array([[{"item": item, "distance": distance, "end": end} for number, distance, end in matcher.matches(normalised(text or "")) for item in owners[number]]
                             for text in column.to_pylist()], arrow)

        out = with_arrow_column(out, f"block{block}", found, "text", block < blocks - 1, search)
    return unpacked(out, "row", docs.columns, {matches_col: F.concat(*[f"block{block}" for block in range(blocks)])})
