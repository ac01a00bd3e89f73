import hashlib
import random

import public_tokenizers
import tiktoken

from tabtwin.llm.bpe import encoder, read_ranks
from tabtwin.llm.queries import QUERIES, tokenizer
from tabtwin.llm.token_counts import CountTree, _counted, apply_edits, count_tokens, edit, n_tokens

DATA = "/root/testdata/sf0.001"


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(tokenizer()[0]), special_tokens={})


def test_edits_keep_the_tree_of_a_new_count():
    rnd, coder, lib = random.Random(1), encoder(*tokenizer()), library()
    parts = [" ", "  ", "\n", "a", "the", "'", "'re", "'ll", "12", "é", "日", "🎈", "!", "?!", "\t", " x", "　", "ing"]
    for _ in range(250):
        text = "".join(rnd.choices(parts, k=rnd.randrange(600)))
        tree = CountTree(_counted(coder, coder.split(text)))
        for _ in range(8):
            start = rnd.randrange(len(text) + 1)
            end = min(len(text), start + rnd.choice([0, 0, 1, 2, 5, 60]))
            put = "".join(rnd.choices(parts, k=rnd.choice([0, 1, 2, 4, 90])))
            want = text[:start] + put + text[end:]
            text, _ = edit(coder, text, tree, start, end, put)
            assert text == want
            assert tree.tokens == len(lib.encode_ordinary(text)) and tree.leaves[:, 0].sum() == len(text)
            fresh = CountTree(tree.leaves.copy())
            assert all((a == b).all() for a, b in zip(tree.levels, fresh.levels)) and len(tree.levels) == len(fresh.levels)
            at, border = 0, {0: 0}                      # leaves end where pre-tokens end, with the tokens up to there
            total = 0
            for word in coder.split(text):
                at, total = at + len(word), total + len(lib.encode_ordinary(word))
                border[at] = total
            assert all(border[c] == t for c, t in tree.leaves.cumsum(axis=0).tolist())


def test_an_edit_touches_little():
    coder = encoder(*tokenizer())
    text = "some words of a long text, again and again. " * 20_000
    tree = CountTree(_counted(coder, coder.split(text)))
    _, n = edit(coder, text, tree, 400_000, 400_004, "new")
    assert n < 1000


def test_query_equals_full_count(spark):
    lib = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op10_token_counts"](spark, DATA).collect()
    assert len(got) == len(texts)
    assert all(r.n_tokens == len(lib.encode_ordinary(texts[r.doc_id])) for r in got)
    assert all(r.edited_sha256 != hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)


def test_edge_cases(spark):
    lib = library()
    kind = "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, tree int, edited string, row string"
    rows = [(1, None, [(0, 0, "hello there")]), (2, "", None), (3, "abc def", [(-5, 2, "X"), None, (100, 200, " end")]), (3, "abc def", [(-5, 2, "X"), None, (100, 200, " end")]),
            (None, "abc", [(None, None, None)]), (5, "w " * 100_000, [(100_000, 100_001, "\n")]), (6, "abc", [(0, 3, None)]), (7, "ab cd", [(3, None, "z")])]
    want = ["hello there", "", "Xc def end", "Xc def end", "abc", "w " * 50_000 + "\n" + ("w " * 100_000)[100_001:], "", "ab zcd"]
    df = spark.createDataFrame([(*r, 1, "e", "r") for r in rows], kind)
    out = apply_edits(count_tokens(df, *tokenizer()), *tokenizer())
    assert set(out.columns) == {"doc_id", "text", "edits", "tree", "edited", "row"}
    got = out.select("doc_id", n_tokens().alias("before"), "edited.*").select("doc_id", "before", "text", n_tokens("tree").alias("after")).collect()
    full = [(d, len(lib.encode_ordinary(t or "")), w, len(lib.encode_ordinary(w))) for (d, t, _), w in zip(rows, want)]
    assert sorted(map(tuple, got), key=str) == sorted(full, key=str)
    assert count_tokens(df.limit(0), *tokenizer()).count() == 0
