import pyarrow as pa

from tabtwin.llm.lm_score import WORDS, Tokens


def test_arrow_texts_are_cut_as_python_cuts_them():
    """Texts stay in Arrow until they are tokens; white space is that of ``str.split`` for every character."""
    texts = [f"a{chr(i)}b" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts += [None, "", " ", "\x1c ", " lead", "trail \n", "\x85two　 words\xa0", "\x00 ​﻿ ᠎", "日本 🎈"] * 2
    tokens = Tokens([f"w{i}" for i in range(WORDS)])
    words, documents = tokens.of_texts(pa.array(texts, pa.string()).slice(7))
    cut = [(t or "").split() for t in texts[7:]]
    assert words.to_pylist() == [w for t in cut for w in t]
    assert [len(d) for d in documents] == [len(t) for t in cut]
    assert [d.tolist() for d in documents[-18:]] == [[tokens[w] for w in t] for t in cut[-18:]]
    assert tokens.of_texts(pa.array([None, " "], pa.string()))[1][1].tolist() == []
