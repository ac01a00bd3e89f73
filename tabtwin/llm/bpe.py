"""Byte-level BPE by ranked merges: encoding of whole texts to token ids, decoding to bytes.

A text is cut into pre-tokens by a pattern; each distinct pre-token's bytes are folded by the
merge of lowest rank until no adjacent pair is in the rank table. Both directions are
Arrow-batched column functions: no shuffle, no state beyond a bounded cache of finished
pre-tokens in each Python worker, so a lost executor costs its running tasks only.

A fold in Spark's higher-order functions (``fold_merges``, with the rank table as a literal)
gives the same ids and is kept for use on small vocabularies; README states why the whole
corpus does not go through it.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtwin.llm.common import with_arrow_column

#: Finished pre-tokens that a Python worker keeps; beyond it the cache starts anew (results do not depend on it).
CACHE_WORDS = 200_000
_NO_RANK = 2**31 - 1
#: Pre-tokens of one length that are folded one by one if they are fewer, and bytes beyond which each is folded by itself.
FEW, LONG = 24, 256


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file at ``path``: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PairTable:
    """Ranks of adjacent token pairs, looked up for whole arrays: open addressing over (left, right) keys."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NO_RANK, dtype=np.int32)
        keys, values = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):                            # keys that find their slot taken move on by one
            free = self.keys[slots] == -1
            self.keys[slots[free]], self.values[slots[free]] = keys[free], values[free]
            stay = self.keys[slots] != keys         # of keys for one free slot, the last was stored
            keys, values, slots = keys[stay], values[stay], (slots[stay] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32 | right).ravel()
        slots = self._slots(keys)
        out = np.full(len(keys), _NO_RANK, dtype=np.int32)
        there = np.arange(len(keys))
        while len(there):
            found = self.keys[slots]
            hit = found == keys
            out[there[hit]] = self.values[slots[hit]]
            on = ~hit & (found != -1)
            there, keys, slots = there[on], keys[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Encoder:
    """The rank table at a path with the pattern that cuts texts, and a bounded cache of finished pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = read_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.done: dict[str, bytes] = {}            # ids as the bytes of int32

    def merge(self, words: list[str]) -> None:
        """Finish distinct pre-tokens: all of one length are folded together, a merge each a step."""
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.done[word] = whole.to_bytes(4, "little")
            else:
                names, raws = by_length.setdefault(len(raw), ([], []))
                names.append(word)
                raws.append(raw)
        for length, (names, raws) in by_length.items():
            if length > LONG or len(names) < FEW:
                fold = self._fold_long if length > LONG else self._fold_one
                self.done.update((name, fold(raw)) for name, raw in zip(names, raws))
                continue
            for at in range(0, len(names), step := max(1, 2_000_000 // length)):
                self._fold(names[at:at + step], np.frombuffer(b"".join(raws[at:at + step]), dtype=np.uint8).reshape(-1, length))

    def _fold_one(self, raw: bytes) -> bytes:
        """The same fold for a single pre-token, without the arrays' overhead."""
        rank = self.ranks.get
        parts = [raw[i:i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i:i + 2], _NO_RANK) for i in range(len(raw) - 1)]
        while pairs and (best := min(pairs)) != _NO_RANK:
            at = pairs.index(best)
            joined = parts[at] + parts[at + 1]
            parts[at:at + 2] = [joined]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + joined, _NO_RANK)
            if at < len(pairs):
                pairs[at] = rank(joined + parts[at + 1], _NO_RANK)
        return np.array([self.ranks[part] for part in parts], dtype=np.int32).tobytes()

    def _fold_long(self, raw: bytes) -> bytes:
        """The same fold in n log n: pairs wait in a heap by rank and place, parts are linked to their neighbours."""
        rank, n = self.ranks.get, len(raw)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))           # of the part that starts at a place; 0: gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, at, end = heappop(heap)
            middle = ends[at]
            if not middle or middle == n or ends[middle] != end:
                continue                                                       # one of the two parts has changed since
            ends[at], ends[middle] = end, 0
            if end < n:
                before[end] = at
                if (r := rank(raw[at:ends[end]])) is not None:
                    heappush(heap, (r, at, ends[end]))
            if (left := before[at]) >= 0 and (r := rank(raw[left:end])) is not None:
                heappush(heap, (r, left, end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[raw[at:ends[at]]])
            at = ends[at]
        return np.array(out, dtype=np.int32).tobytes()

    def _fold(self, names: list[str], raw: np.ndarray) -> None:
        ids, rows = self.byte_ids[raw], np.arange(len(raw))
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if not ranks.shape[1]:                  # everything is one token
                best = np.full(len(rows), _NO_RANK)
                at = np.zeros(len(rows), dtype=np.int64)
            else:
                at = ranks.argmin(axis=1)           # the leftmost of the lowest
                best = ranks[np.arange(len(rows)), at]
            over = best == _NO_RANK
            for row, value in zip(rows[over].tolist(), ids[over], strict=True):
                self.done[names[row]] = value.tobytes()
            if over.any():
                ids, ranks, rows, at, best = ids[~over], ranks[~over], rows[~over], at[~over], best[~over]
            each = np.arange(len(rows))
            ids[each, at] = best
            place = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            place = place[:-1]
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), axis=1)
            for side in (at - 1, at):               # only the pairs with the new part change
                there = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                ranks[there, side[there]] = self.pairs.ranks(ids[there, side[there]], ids[there, side[there] + 1])

    def finish(self, words: set[str]) -> dict[str, bytes]:
        """The cache, with ``words`` in it."""
        if len(self.done) + len(words) > CACHE_WORDS:
            self.done.clear()
        if new := [word for word in words if word not in self.done]:    # set - keys() would walk the whole cache
            self.merge(new)
        return self.done

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.split(text) for text in texts]
        done = self.finish(set().union(*cut))
        return [np.frombuffer(b"".join([done[word] for word in words]), dtype=np.int32) for words in cut]

@lru_cache(maxsize=4)
def token_array(path: str) -> pa.Array:
    """The bytes of each id at its place; null where there is no such id."""
    pieces = token_bytes(path)
    return pa.array([pieces.get(i) for i in range(max(pieces) + 1)], pa.large_binary())


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id, once for each Python worker and rank file."""
    return {rank: token for token, rank in read_ranks(path).items()}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker and rank file."""
    return Encoder(path, pattern)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``: the token ids (array<int>) of each whole text.

    Null and empty texts have no ids (an empty array); rows are independent, so repeated rows
    get equal ids and an empty table stays empty. A column that is already named ``ids`` is
    replaced; ``keep_text=False`` leaves the text out. Text that looks like a special token is
    ordinary text. Every byte must be in the rank table, as it is in byte-level tables; a table
    without one raises KeyError.
    """
    def ids(texts: pa.Array) -> pa.Array:
        rows = encoder(ranks_path, pattern).encode([text or "" for text in texts.to_pylist()])
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))

    return with_arrow_column(docs, ids_col, "array<int>", text_col, keep_text, ids)


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``decoded``: the binary pieces of the ids, concatenated.

    Null or no ids give empty bytes; an id outside the rank table raises KeyError. A column
    that is already named ``decoded`` is replaced.
    """
    def decoded(rows: pa.Array) -> pa.Array:
        pieces, ids = token_array(ranks_path), rows.flatten()
        known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(pieces)))
        taken = pc.take(pieces, pc.if_else(known, ids, pa.scalar(None, ids.type)))
        if taken.null_count:
            raise KeyError(f"no such token: {ids[pc.index(pc.is_null(taken), True).as_py()]}")
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(rows), 0).to_pylist()])
        _, starts, data = taken.buffers()           # the pieces lie one behind the other
        starts = np.frombuffer(starts, dtype=np.int64)[taken.offset:] if len(taken) else np.zeros(1, dtype=np.int64)
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(starts[ends].astype(np.int32)), data or pa.py_buffer(b"")])

    return with_arrow_column(df, bytes_col, "binary", ids_col, True, decoded)


def fold_merges(word: Column, ranks: dict[bytes, int], buckets: int = 1 << 16) -> Column:
    """Token ids of one pre-token's bytes, folded by higher-order functions over a literal rank map.

    Spark looks a map's keys up one after the other, so the literal is an array of buckets by
    CRC-32, each with about one key. Empty bytes give no ids.
    """
    rows: list[tuple[list[str], list[int]]] = [([], []) for _ in range(buckets)]
    for token, rank in ranks.items():
        keys, values = rows[zlib.crc32(token) % buckets]
        keys.append(base64.b64encode(token).decode())
        values.append(rank)
    all_keys = F.from_json(F.lit(json.dumps([keys for keys, _ in rows])), "array<array<binary>>")
    all_ranks = F.from_json(F.lit(json.dumps([values for _, values in rows])), "array<array<int>>")
    none, no_ints = F.lit(_NO_RANK), F.array().cast("array<int>")

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), body)[0]

    def rank_of(token: Column) -> Column:
        return let(F.pmod(F.crc32(token), F.lit(buckets)).cast("int"), lambda bucket: let(
            F.array_position(all_keys[bucket], token).cast("int"),
            lambda at: F.when(at > 0, all_ranks[bucket][at - 1]).otherwise(none)))

    def step(state: Column, _: Column) -> Column:
        parts, pairs = state["parts"], state["pairs"]
        n = F.size(parts)

        def merged(at: Column, joined: Column) -> Column:
            left = F.when(at > 1, F.array(rank_of(F.concat(parts[at - 2], joined)))).otherwise(no_ints)
            right = F.when(at + 1 < n, F.array(rank_of(F.concat(joined, parts[at + 1])))).otherwise(no_ints)
            return F.struct(
                F.concat(F.slice(parts, 1, at - 1), F.array(joined), F.slice(parts, at + 2, n)).alias("parts"),
                F.concat(F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(pairs, at + 2, n)).alias("pairs"))

        return F.when(F.size(pairs) == 0, state).otherwise(let(F.array_min(pairs), lambda best: F.when(
            best < none, let(F.array_position(pairs, best).cast("int"), lambda at: let(
                F.concat(parts[at - 1], parts[at]), lambda joined: merged(at, joined)))).otherwise(state)))

    length = F.octet_length(word)
    first = F.struct(
        F.transform(F.sequence(F.lit(1), length), lambda i: F.substr(word, i, F.lit(1))).alias("parts"),
        F.when(length > 1, F.transform(F.sequence(F.lit(1), length - 1), lambda i: rank_of(F.substr(word, i, F.lit(2)))))
        .otherwise(no_ints).alias("pairs"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), first, step,
                         lambda state: F.transform(state["parts"], rank_of))
    return F.when(length == 0, no_ints).otherwise(folded)
