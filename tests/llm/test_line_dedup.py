import hashlib
from collections import defaultdict

from tabtwin.llm.line_dedup import drop_shared_lines
from tabtwin.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_documents, min_chars=1):
    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            docs[key(line)].add(doc)
    gone = {k for k, ids in docs.items() if len(k) >= min_chars and len(ids) >= min_documents}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        yield doc, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows, 10))
    assert any(k for _, _, k, _ in want)
    assert sorted(map(tuple, QUERIES["op6_line_dedup"](spark, DATA).collect())) == want


def test_edge_cases(spark):
    rows = [(1, "Shared \n\n a\nb"), (2, "\tSHARED\nc\n"), (3, "shared"), (3, "shared"), (4, None), (5, ""), (None, "x\nshared\r"),
            (6, "é\n" + "shared\n" * 500), (7, "solo"), (7, "other\nsolo"), (8, " shared")]
    df = spark.createDataFrame([(d, t, i, "p") for i, (d, t) in enumerate(rows)], "doc_id long, text string, n_lines long, pos string")
    out = drop_shared_lines(df, min_documents=4)
    assert out.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped", "kept_text"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=str)
    assert got == sorted(brute(rows, 4), key=str)
    assert drop_shared_lines(df.limit(0)).count() == 0
