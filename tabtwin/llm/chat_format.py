"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth first.

Every turn becomes a segment ``<|start|>role<|message|>text<|end|>`` of token ids; a node of
the tree is a sequence of initial turns (a running digest), so conversations that begin alike
share nodes. ``format_conversations`` lays the segments of all nodes out one after the other
in depth-first order and gives each its offset, the position id of its first token in its own
conversations, the tokens under the loss (the text of assistant turns) and the offset
intervals of its ancestors, which are all that its tokens may attend to besides themselves.

Scale: distinct conversations are range-partitioned by their path of node digests, so that a
first turn that a third of them share spreads over many tasks. Each partition is laid out by
itself in one pass; one summary row per partition (its size, first and last path) goes to the
driver, where the offsets are added up and a path that continues over a partition's border is
joined. What a task holds is one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtwin.llm.bpe import encoder, token_bytes
from tabtwin.llm.common import written

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Strings that mean something to this template or to other common ones: none may appear in a role or text.
CONTROL = (START, MESSAGE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROLS = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Double every backslash and put one after the first character of each control string."""
    return _CONTROLS.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def merged_intervals(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring intervals as one; in their order."""
    out: list[tuple[int, int]] = []
    for start, end in intervals:
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _shared(a: list, b: list) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _paths(conversations: DataFrame, ranks_path: str, pattern: str, roles: tuple[str, ...]) -> DataFrame:
    """conv_id, leaf, path (a digest for each node) and its segments, one row per conversation."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows, some = [], batch["turns"][at:at + 500]
                parts = iter(coder.encode([x for turns in some for turn in turns for x in (START + escape(turn["role"]) + MESSAGE, escape(turn["text"]), END)]))
                for conv, turns in zip(batch["conv_id"][at:at + 500], some):
                    digest, path, segments = b"", [], []
                    for turn in turns:
                        head, body, tail = next(parts), next(parts), next(parts)
                        raw = turn["role"].encode()
                        digest = hashlib.blake2b(digest + len(raw).to_bytes(8, "little") + raw + turn["text"].encode(), digest_size=16).digest()
                        path.append(digest)
                        loss = (len(head), len(head) + len(body)) if turn["role"] in roles else (0, 0)
                        segments.append({"ids": np.concatenate([head, body, tail]), "loss_start": loss[0], "loss_end": loss[1]})
                    rows.append((conv, digest, path, segments))
                yield pd.DataFrame(rows, columns=["conv_id", "leaf", "path", "segments"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.mapInPandas(run, f"conv_id {kind}, leaf binary, path array<binary>, segments array<struct<ids:array<int>,loss_start:int,loss_end:int>>")


_NODES = ("part int, node binary, depth int, start long, position long, ids array<int>, loss_start int, loss_end int, opening boolean, on_first int, "
          "tail array<struct<start:long,end:long>>, summary struct<first:array<binary>,lengths:array<long>,last:array<binary>,starts:array<long>,last_lengths:array<long>,total:long>")
_COLUMNS = ["part", "node", "depth", "start", "position", "ids", "loss_start", "loss_end", "opening", "on_first", "tail", "summary"]
_SEGMENTS = "node binary, depth int, start long, position long, ids array<int>, loss_start int, loss_end int, attends array<struct<start:long,end:long>>"


def _lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The new nodes of each conversation of a partition sorted by path, at offsets from the partition's start.

    ``opening``: the node is on the partition's first path; ``on_first``: how many of its first
    ancestors are; ``tail``: the intervals of its other ancestors. A last row has the summary.
    """
    from pyspark import TaskContext

    part, offset, first, lengths = TaskContext.get().partitionId(), 0, None, []
    path: list[bytes] = []
    starts: list[int] = []
    sizes: list[int] = []
    for batch in batches:
        for at in range(0, len(batch), 500):
            rows = []
            for now, segments in zip(batch["path"][at:at + 500], batch["segments"][at:at + 500]):
                now, opening = [bytes(x) for x in now], first is None
                if opening:
                    first, lengths = now, [len(s["ids"]) for s in segments]
                same, on_first = _shared(path, now), _shared(first, now)
                del starts[same:], sizes[same:]
                position = sum(sizes)
                for depth in range(same, len(now)):
                    segment, f = segments[depth], min(depth, on_first)
                    tail = merged_intervals([(s, s + n) for s, n in zip(starts[f:], sizes[f:])])
                    rows.append((part, now[depth], depth, offset, position, segment["ids"], segment["loss_start"], segment["loss_end"],
                                 opening, f, [{"start": s, "end": e} for s, e in tail], None))
                    starts.append(offset)
                    sizes.append(len(segment["ids"]))
                    offset += sizes[-1]
                    position += sizes[-1]
                path = now
            yield pd.DataFrame(rows, columns=_COLUMNS)
    if first is not None:
        summary = {"first": first, "lengths": lengths, "last": path, "starts": starts, "last_lengths": sizes, "total": offset}
        yield pd.DataFrame([(part, *[None] * 10, summary)], columns=_COLUMNS)


def _borders(summaries: list) -> dict[int, tuple[int, list[tuple[int, int]], list[int]]]:
    """For each partition: the shift of its offsets, the intervals of nodes that it shares with what came before, and its first path's lengths."""
    out, base = {}, 0
    stack: list[tuple[bytes, int, int]] = []
    for part, s in sorted((r.part, r.summary) for r in summaries):
        first, last = [bytes(x) for x in s.first], [bytes(x) for x in s.last]
        k = _shared([node for node, _, _ in stack], first)
        shift = base - sum(s.lengths[:k])
        out[part] = (shift, [(start, start + n) for _, start, n in stack[:k]], list(s.lengths))
        keep = min(k, _shared(first, last))
        stack = stack[:keep] + [(last[i], s.starts[i] + shift, s.last_lengths[i]) for i in range(keep, len(last))]
        base = shift + s.total
    return out


def format_conversations(conversations: DataFrame, ranks_path: str, pattern: str, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(segments, conversations): the laid-out prefix tree, and the nodes of each conversation.

    Segments: node, depth, start (offset in the layout), position (of its first token within its
    conversations), ids, loss_start and loss_end (tokens of the segment under the loss; equal
    if none), attends (intervals of its ancestors). Conversations: conv_id, leaf, path (the
    nodes from the first turn to the leaf).

    Turns are ordered by turn, ties by role and text; repeated rows are repeated turns; null
    turns come first. A null text or role is an empty one; rows of a null conv_id are one
    conversation. Conversations that are equal share all nodes. Other columns, whatever their
    names, are not looked at. An empty table gives two empty tables.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    paths = written(_paths(grouped, ranks_path, pattern, loss_roles), "chat-paths")
    distinct = paths.select("leaf", "path", "segments").dropDuplicates(["leaf"]).select("path", "segments")
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(distinct.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInPandas(_lay_out, _NODES), "chat-layout")
    borders = _borders(laid.where("summary IS NOT NULL").select("part", "summary").collect())   # a row for each partition

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for part, node, depth, start, position, ids, loss_start, loss_end, opening, on_first, tail in batch[_COLUMNS[:-1]].itertuples(index=False):
                shift, before, lengths = borders[part]
                if opening and depth < len(before):
                    continue                        # an earlier partition has it
                m = min(on_first, len(before))
                on_path = [(sum(lengths[:i]) + shift, sum(lengths[:i + 1]) + shift) for i in range(m, on_first)]
                chain = merged_intervals([*before[:m], *on_path, *((t["start"] + shift, t["end"] + shift) for t in tail)])
                rows.append((node, depth, start + shift, position, ids, loss_start, loss_end, [{"start": s, "end": e} for s, e in chain]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _SEGMENTS.split(", ")])

    segments = laid.where("summary IS NULL").drop("summary").mapInPandas(settle, _SEGMENTS)
    return written(segments, "chat-segments"), paths.select("conv_id", "leaf", "path")


def restore_conversations(segments: DataFrame, conversations: DataFrame, ranks_path: str) -> DataFrame:
    """(leaf, turns, loss_text, formatted) of each distinct conversation, read from the segments of its path.

    ``turns`` are (role, text) as they were before escaping; ``loss_text`` is all text under
    the loss, unescaped; ``formatted`` is the whole formatted conversation.
    """
    wanted = conversations.select("leaf", "path").dropDuplicates(["leaf"]).select("leaf", F.explode("path").alias("node"))
    parts = (wanted.join(segments.select("node", "position", "depth", "ids", "loss_start", "loss_end"), "node")
             .groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "position", "ids", "loss_start", "loss_end"))).alias("parts")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = token_bytes(ranks_path)

        def decode(ids) -> str:
            return b"".join([pieces[i] for i in ids]).decode()

        for batch in batches:
            rows = []
            for leaf, segments_of in zip(batch["leaf"], batch["parts"]):
                turns, loss, formatted = [], [], []
                for part in segments_of:
                    ids = list(part["ids"])
                    whole = decode(ids)
                    role, _, text = whole.removeprefix(START).removesuffix(END).partition(MESSAGE)
                    turns.append({"role": unescape(role), "text": unescape(text)})
                    loss.append(unescape(decode(ids[part["loss_start"]:part["loss_end"]])))
                    formatted.append(whole)
                rows.append((leaf, turns, "".join(loss), "".join(formatted)))
            yield pd.DataFrame(rows, columns=["leaf", "turns", "loss_text", "formatted"])

    return parts.mapInPandas(run, "leaf binary, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
