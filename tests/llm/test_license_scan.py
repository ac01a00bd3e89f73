import re

from tabtwin.llm.license_scan import K, PASSAGES, PHRASES, WORD, scan_licenses
from tabtwin.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(text):
    """Base columns by comparing every place of the text with every phrase."""
    found = words(text)
    places = [(i, label) for label, phrase in PHRASES for i in range(len(found)) if found[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})))


def scan(spark, rows, **options):
    return {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_query_equals_brute_force_on_every_place(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_license_scan"](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert sum(r.n_base for r in got.values()) > 0


def test_all_places_of_overlapping_phrases_and_separators(spark):
    rows = [(1, "Under-the\tMIT\nLICENSE"), (2, "cc by nc by nc cc/BY nc"), (3, "under the mit licenses"), (4, "xunder the mit license"),
            (5, "Apache License, Version 2.0 and under the MIT license"), (6, "cc by nç"), (7, "under the éMIT license")]
    got = scan(spark, rows)
    for doc, text in rows:
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), doc
    assert got[2].n_base == 2 and got[5].base_labels == "apache-2,mit"


def test_passages_with_a_word_put_in_left_out_or_replaced(spark):
    text = PASSAGES[0][1].split()
    put_in, left_out, replaced = text[:9] + ["very"] + text[9:], text[:9] + text[10:], text[:9] + ["x"] + text[10:]
    half = text[:len(text) // 2]
    got = scan(spark, [(i, "so it says: " + " ".join(t) + " and more") for i, t in enumerate((text, put_in, left_out, replaced, half))])
    assert [got[i].labels for i in range(5)] == ["mit"] * 4 + [""]
    assert got[0].score == 1.0 and got[0].base_labels == "" and got[0].n_base == 0
    assert got[0].license_spans[0].start == 3 and got[0].license_spans[0].end == 3 + len(text) - 1
    assert got[1].license_spans[0].end == 3 + len(text) and 0.9 < got[1].score < 1.0        # two diagonals, one span
    assert len(got[1].license_spans) == 1
    short = scan(spark, [(1, "Licensed under the GNU General Public License, version 3.")])[1]
    assert short.labels == "gpl-3" and short.score == 1.0


def test_copies_of_a_passage_are_told_apart(spark):
    text = PASSAGES[5][1]
    got = scan(spark, [(1, " ".join([text] * 50))])[1]
    assert len(got.license_spans) == 50 and {s.share for s in got.license_spans} == {1.0}
    assert [s.start for s in got.license_spans] == [i * len(text.split()) for i in range(50)]


def test_nulls_repeats_shared_ids_long_texts_and_clashing_columns(spark):
    schema = SCHEMA + ", score string, row int, `a.b` int, doc string"
    mit, cc = "under the mit license", "cc by nc"
    long = "wort " * 200_000 + mit
    rows = [(1, mit, "s", 1, 1, "d"), (1, mit, "s", 2, 1, "d"), (1, cc, "s", 3, 1, "d"), (None, cc, None, 4, None, None), (None, None, "s", 5, 1, "d"),
            (2, None, "s", 6, 1, "d"), (3, "", "s", 7, 1, "d"), (4, long, "s", 8, 1, "d"), (5, "a b", "s", 9, 1, "d")]
    out = scan_licenses(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "row", "a.b", "doc", "n_words", "license_spans", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = {r.row: r for r in out.collect()}
    assert {k: (r.n_words, r.n_base, r.labels) for k, r in got.items()} == {
        1: (4, 1, "mit"), 2: (4, 1, "mit"), 3: (3, 1, "cc-by-nc"), 4: (3, 1, "cc-by-nc"), 5: (0, 0, ""), 6: (0, 0, ""), 7: (0, 0, ""),
        8: (200_004, 1, "mit"), 9: (2, 0, "")}
    assert got[8].first_word == 200_000 and got[6].score == 0.0 and got[6].license_spans == []
    assert scan_licenses(spark.createDataFrame([], schema), keep_text=False).collect() == []


def test_main_path_is_native(spark):
    plan = scan_licenses(spark.createDataFrame([(1, "cc by nc")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert K == 3 and WORD.endswith("]+")
