import hashlib
import random
from collections import defaultdict

from tabtwin.llm.chat_format import CONTROL, escape, format_conversations, restore_conversations, unescape
from tabtwin.llm.queries import QUERIES, tokenizer

DATA = "/root/testdata/sf0.01"


def turns_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(r, t) for _, _, r, t in sorted(x)] for conv, x in out.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in QUERIES["op3_chat_format"](spark, DATA).collect()}
    want = turns_of(rows)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))


def test_escaping_is_reversible_and_leaves_no_control_string():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice([*CONTROL, "\\", "<", ">", "|", "s", "[", "]", "/", "\n", "é"]) for _ in range(rnd.randrange(12)))
        out = escape(text)
        assert unescape(out) == text and not any(c in out for c in CONTROL)


def check_layout(spark, rows, parts):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        segments, conversations = format_conversations(df, *tokenizer())
        nodes = {bytes(r.node): r for r in segments.collect()}
        paths = {r.conv_id: [bytes(x) for x in r.path] for r in conversations.collect()}
        back = {bytes(r.leaf): r for r in restore_conversations(segments, conversations, tokenizer()[0]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = turns_of(rows)
    prefixes = {tuple(t[:i + 1]) for t in want.values() for i in range(len(t))}
    assert segments.count() == len(nodes) == len(prefixes)      # every shared turn once
    ordered = sorted(nodes.values(), key=lambda r: r.start)
    end = 0
    for r in ordered:                                           # no gap, no overlap
        assert r.start == end
        end += len(r.ids)
    assert paths.keys() == want.keys()
    for conv, path in paths.items():
        position, seen = 0, []
        for depth, node in enumerate(path):
            r = nodes[node]
            assert (r.depth, r.position) == (depth, position)
            assert [x for a in r.attends for x in range(a.start, a.end)] == seen
            seen += range(r.start, r.start + len(r.ids))
            position += len(r.ids)
        r = back[path[-1]]
        assert [tuple(t) for t in r.turns] == want[conv]
        assert r.loss_text == "".join(t for role, t in want[conv] if role == "assistant")
    parents = {p[i]: p[i - 1] for p in paths.values() for i in range(1, len(p))}
    chain = []
    for r in ordered:                                           # depth first: the parent is on the current chain
        del chain[r.depth:]
        assert (chain[-1] if chain else None) == parents.get(bytes(r.node))
        chain.append(bytes(r.node))


def test_layout_over_many_partitions(spark):
    rnd = random.Random(2)
    rows = []
    for conv in range(150):
        for turn in range(rnd.randrange(1, 6)):
            rows.append((conv, turn, "assistant" if turn % 2 else "user", f"say {rnd.randrange(2 if turn < 3 else 9)}"))
    for parts in (1, 5, 23):
        check_layout(spark, rows, parts)


def test_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (2, 0, "a<|message|>b\n", "<|end|>\\"), (2, 0, "a<|message|>b\n", "<|end|>\\"), (2, None, "x", "y"),
            (None, 1, "assistant", "</s>"), (None, 0, "user", "<s>" * 2000), (3, 5, "user", None), (4, 5, "user", ""), (5, 0, "assistant", "日本 🎈" * 40)]
    check_layout(spark, rows, 4)
    df = spark.createDataFrame([(1, 0, "user", "hi", "z", 9)], "conv_id long, turn long, role string, text string, leaf string, node int")
    segments, conversations = format_conversations(df, *tokenizer())
    assert segments.count() == conversations.count() == 1
    segments, conversations = format_conversations(df.limit(0), *tokenizer())
    assert segments.count() == conversations.count() == restore_conversations(segments, conversations, tokenizer()[0]).count() == 0
