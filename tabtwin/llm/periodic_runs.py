"""Maximal periodic runs of words, by an online sparse dynamic program over diagonals.

A run of period q is a diagonal of matches: word i agrees with word i - q for as long as the run
goes on. Words are read in order; every earlier occurrence j of the word at i adds one to the match
length of lag i - j, a lag that isn't added to has ended, and a diagonal that ends long enough emits
its run at once. What keeps the program sparse, with no lag left out:

* A run of length >= max(12, 2q) has 6 matches or more on its diagonal, and q or more, so an
  occurrence counts only where the last m words agree as well: m = 6 for lags under 12, and m = 12,
  24, 48, ... for lags from m to 2m - 1. Runs of m words are named from runs of m / 2 by pairs, and only
  those that a document holds twice go on.
* Inside a run of small period r the lags that are multiples of r start and end with it and have no
  run of their own; they are not opened. Between two runs of one small period that neither overlap nor
  meet, only lags that line up their starts or their ends can leave both, and so get as long as they
  are far apart; the others aren't opened.

Scale: one pass over the documents without a shuffle; a task holds a part of a batch of about two
million characters, or one longer text. Time goes with the words and with the occurrences that remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabtwin.llm.common import with_arrow_column

#: Pairs of occurrences taken at a time.
PAIRS = 1 << 20


def _again(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names by position of the keys that occur twice or more; -1 elsewhere."""
    names = np.full(size, -1, dtype=np.int64)
    if len(keys):
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        names[at[twice]] = inverse[twice]
    return names


def _joined(names: np.ndarray, shift: int, length: int, place: np.ndarray) -> np.ndarray:
    """Names of the runs of ``length`` words that end at a position, from the shorter ones ending there and ``shift`` words before."""
    at = np.flatnonzero((names >= 0) & (place >= length - 1))
    at = at[names[at - shift] >= 0]
    return _again(names[at - shift] * len(names) + names[at], at, len(names))


def _candidates(names: np.ndarray, m: int, least: int, runs: dict[tuple[int, int], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in order of i: an earlier occurrence j of the ``m`` words ending at i, at a lag from ``least`` to 2m - 1 that may have a run."""
    size = len(names)
    start, end = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
    for (s, e), period in runs.items():                      # the run of small period that holds all m words
        if 2 * period <= m <= e - s + 1:
            start[s + m - 1:e + 1], end[s + m - 1:e + 1] = s, e
    at = np.flatnonzero(names >= 0)
    order = at[np.argsort(names[at], kind="stable")]
    keys = names[order] * size + order
    last = np.where(start[at] >= 0, np.minimum(at - least, start[at] + m - 2), at - least)
    low = np.searchsorted(keys, names[at] * size + np.maximum(at - 2 * m + 1, 0))
    high = np.searchsorted(keys, names[at] * size + np.maximum(last, -1), side="right")
    some = high > low
    at, low, high = at[some], low[some], high[some]
    ends = np.cumsum(high - low)
    done = 0
    while done < len(at):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, side="right")))
        counts = high[done:stop] - low[done:stop]
        first = np.cumsum(counts) - counts
        i = np.repeat(at[done:stop], counts)
        j = order[np.repeat(low[done:stop] - first, counts) + np.arange(counts.sum())]
        open_ = (start[i] < 0) | (start[j] < 0) | (i - j == start[i] - start[j]) | (i - j == end[i] - end[j]) | (start[i] <= end[j] + 1)
        yield i[open_], j[open_]
        done = stop


def runs_of(words: np.ndarray, doc: np.ndarray, place: np.ndarray, least_length: int = 12) -> dict[tuple[int, int], int]:
    """{(first, last): smallest period} of the maximal runs of word numbers ``words``; ``doc`` doesn't fall and no run crosses it.

    ``place`` is a word's number in its document. A run is ``least_length`` (12 or more) and two periods long at least.
    """
    runs: dict[tuple[int, int], int] = {}
    size = len(words)
    if size < least_length:
        return runs
    at = np.flatnonzero(place >= 1)
    pairs = np.full(size, -1, dtype=np.int64)
    pairs[at] = np.unique(words[at - 1] * (words.max() + 1) + words[at], return_inverse=True)[1]
    at = np.flatnonzero(place >= 3)
    named = np.unique(pairs[at - 2] * size + pairs[at], return_inverse=True)[1]
    names = _again(doc[at] * size + named, at, size)
    names, m, least = _joined(names, 2, 6, place), 6, 1
    while (names >= 0).any():
        active: dict[int, int] = {}
        before = -1

        def end_of(lag: int, length: int, last: int) -> None:
            if length >= max(least_length - lag, lag):
                span = (last - length - lag + 1, last)
                runs[span] = min(lag, runs.get(span, lag))

        for i, j in _candidates(names, m, least, dict(runs)):
            edges = np.flatnonzero(np.diff(i)) + 1
            for word, lags in zip(i[np.concatenate([[0], edges])].tolist() if len(i) else [], _split((i - j).tolist(), edges.tolist())):
                known = active if word == before + 1 else {}
                if known is not active:
                    for lag, length in active.items():
                        end_of(lag, length, before)
                now = {lag: known.get(lag, m - 1) + 1 for lag in lags}
                for lag in known.keys() - now.keys():
                    end_of(lag, known[lag], before)
                active, before = now, word
        for lag, length in active.items():
            end_of(lag, length, before)
        names, m, least = _joined(names, m, 2 * m, place), 2 * m, 2 * m
    return runs


def _split(values: list[int], edges: list[int]) -> Iterator[list[int]]:
    for a, b in zip([0, *edges], [*edges, len(values)]):
        yield values[a:b]


def _periodic(texts: pa.Array) -> pa.Array:
    """struct(runs, collapsed) of every text."""
    split = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    flat = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    doc = np.repeat(np.arange(len(split)), counts)
    place = np.arange(counts.sum()) - firsts[doc]
    found = runs_of(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, place)
    rows = np.array([(first, last - first + 1, period) for (first, last), period in found.items()], dtype=np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    keep = np.ones(len(doc), dtype=bool)
    for first, length, period in rows.tolist():
        keep[first + period:first + length] = False
    homes = doc[rows[:, 0]] if len(rows) else np.zeros(0, dtype=np.int64)
    cut = set(homes.tolist())
    joined = [b" ".join(words if n not in cut else [w for w, k in zip(words, keep[firsts[n]:firsts[n] + len(words)].tolist()) if k]) for n, words in enumerate(split)]
    offsets = np.searchsorted(homes, np.arange(len(split) + 1)).astype(np.int32)
    if len(rows):
        rows[:, 0] = place[rows[:, 0]]
    each = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), each), pa.array(joined, pa.binary()).cast(pa.string())], names=["runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text", name: str = "periodic", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``name``: struct(runs array of struct(start, length, period), collapsed string).

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of words, 12 and two
    periods long at least, whose words a (smallest) period apart are identical and that no neighbouring word
    extends; runs come by start, then period. ``collapsed`` joins by one space the words that aren't in any run
    behind its first period. A null, empty or blank text has no run and an empty ``collapsed``. Rows don't
    depend on each other: repeated rows and ids get equal results, an empty table gives an empty one. A column
    called ``name`` is replaced, others stay (without ``keep_text`` the text goes).
    """
    return with_arrow_column(docs, name, "struct<runs:array<struct<start:long,length:long,period:long>>,collapsed:string>", text_col, keep_text, _periodic)
