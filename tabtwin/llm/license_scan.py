"""Scan of texts for license phrases and license passages by diagonal voting, in DataFrame operations only.

Every rolling run of three words of a document is joined, by its hash and then by its words, to the
places at which the templates hold it (a broadcast of the few templates that the caller names). A
match at document word p and template word t votes for the diagonal p - t; votes are counted per
document, template and diagonal. Diagonals of one passage that lie a few words apart (words put in
or left out) are merged, and the merged span is verified by the number of template words which it
holds, word for word, against the longer of template and span. A phrase has no tolerance: all of its
words stand on one diagonal.

Scale: documents' words never shuffle. The runs of words are hashed, exploded and joined within the
scan; only votes, of which there are as many as template pieces in the texts, are grouped, after
partial aggregation, by document and diagonal, and one narrow row per document meets its spans in an
equi-join whose skewed partitions adaptive execution splits. No group holds more than one
document's votes for one template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtwin.llm.common import lower_ascii, packed, unpacked, written

#: Runs of ASCII letters, digits and any character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a rolling run.
K = 3

# Labels and wordings.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the "
            "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 "
              "of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)


def words_of(text: Column) -> Column:
    """The text's words in order, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def template_grams(df: DataFrame, phrases: tuple[tuple[str, str], ...], passages: tuple[tuple[str, str], ...]) -> DataFrame:
    """(hash, gram, template, label, exact, length, at): every run of ``K`` words of every template."""
    rows = []
    for number, (label, text) in enumerate((*phrases, *passages)):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words or more: {text!r}")
        rows += [(" ".join(words[i:i + K]), number, label, number < len(phrases), len(words), i) for i in range(len(words) - K + 1)]
    grams = df.sparkSession.createDataFrame(rows, "gram string, template int, label string, exact boolean, length int, at int")
    return grams.select(F.xxhash64("gram").alias("hash"), "*")


def votes(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc, version, words) rows to (doc, version, template, label, exact, length, diagonal, ats): the template
    words at which a run of ``K`` words agrees, by diagonal."""
    gram = lambda w, i: F.concat_ws(" ", w, *[F.get("words", i + j) for j in range(1, K)])
    starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - (K - 1), F.lit(0)))
    runs = docs.select("doc", "version", F.posexplode(F.transform(starts, gram)).alias("pos", "run"))
    runs = runs.select("doc", "version", "pos", "run", F.xxhash64("run").alias("hash"))
    hits = runs.join(F.broadcast(templates), "hash").where(F.col("run") == F.col("gram"))      # the templates that the caller names
    return (hits.groupBy("doc", "version", "template", "label", "exact", "length", (F.col("pos") - F.col("at")).alias("diagonal"))
            .agg(F.collect_set("at").alias("ats")))


def spans(found: DataFrame, max_shift: int, min_votes: int, min_share: float) -> DataFrame:
    """(doc, version, label, exact, start, end, share): verified spans, as word numbers, ends included.

    ``share`` is the part of the longer of template and span that agrees word for word.
    """
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda t: F.sequence(t, t + (K - 1)))))
    placed = found.withColumn("held", covered).withColumn("start", F.col("diagonal") + F.array_min("held")).withColumn("end", F.col("diagonal") + F.array_max("held"))
    share = F.size("held") / F.greatest(F.col("length"), F.col("end") - F.col("start") + 1)
    exact = placed.where(F.col("exact") & (F.size("held") == F.col("length"))).select("doc", "version", "label", "exact", "start", "end", F.lit(1.0).alias("share"))
    near = placed.where(~F.col("exact") & (F.size("ats") >= min_votes)).withColumn("alone", share)
    order = Window.partitionBy("doc", "version", "template").orderBy("diagonal")        # one document's diagonals of one template
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > max_shift).cast("int"), F.lit(0))
    chained = near.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(order))
    merged = chained.groupBy("doc", "version", "template", "label", "length", "chain").agg(
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.max_by(F.struct("start", "end", "alone"), F.struct("alone", -F.col("diagonal"))).alias("best"))
    # A chain that runs over more than one copy is no better than its best diagonal.
    merged = merged.withColumn("share", share)
    whole = F.col("share") >= F.col("best.alone")
    picked = merged.select("doc", "version", "label", F.lit(False).alias("exact"), F.when(whole, F.col("start")).otherwise(F.col("best.start")).alias("start"),
                           F.when(whole, F.col("end")).otherwise(F.col("best.end")).alias("end"), F.greatest("share", "best.alone").alias("share"))
    return exact.unionByName(picked.where(F.col("share") >= min_share))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES,
                  passages: tuple[tuple[str, str], ...] = PASSAGES, max_shift: int = 5, min_votes: int = 3, min_share: float = 0.75,
                  keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``license_spans``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``.

    ``license_spans`` lists (start, end, label, exact, share) of every verified span, by start. Phrases are
    found exactly, each place counting in ``n_base``; ``first_word`` and ``last_word`` are their least and greatest
    start, null without one. A passage counts with ``min_share`` of it agreeing, over diagonals up to
    ``max_shift`` words apart of ``min_votes`` votes each. Label lists are distinct, sorted and joined by commas,
    empty without one; ``score`` is the greatest share, 0 without one. A null or empty text has no words.
    Repeated rows each get their own result; rows of different texts under one id (or a null id) are told apart by
    their text. An empty table gives an empty one. Columns named as a result are replaced, others stay (without
    ``keep_text`` the text goes).
    """
    names = [c for c in docs.columns if keep_text or c != text_col]
    base = docs.select(packed(docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names])).alias("row"),
                       F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    read = base.select("doc", F.xxhash64("text").alias("version"), words_of(F.col("text")).alias("words"))
    # Written, as phrases and passages both read the votes and the texts would else be scanned for each.
    voted = written(votes(read, template_grams(docs, phrases, passages)), "license-votes")
    found = spans(voted, max_shift, min_votes, min_share)
    base_start = F.when(F.col("exact"), F.col("start"))
    per_doc = found.groupBy("doc", "version").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "exact", "share"))).alias("spans"),
        F.count_if("exact").alias("n_base"), F.min(base_start).alias("first"), F.max(base_start).alias("last"),
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"), F.max("share").alias("score"))
    per_doc = per_doc.withColumnsRenamed({"doc": "d", "version": "v"})
    counted = F.coalesce(F.regexp_count("text", F.lit(ANY_CASE)), F.lit(0)).cast("long")
    slim = base.select("row", "doc", F.xxhash64("text").alias("version"), counted.alias("n_words"))
    joined = slim.join(per_doc, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    none = F.array().cast("array<struct<start:int,end:int,label:string,exact:boolean,share:double>>")
    return unpacked(joined, "row", names, {
        "n_words": F.col("n_words"), "license_spans": F.coalesce("spans", none), "n_base": F.coalesce("n_base", F.lit(0)).cast("long"),
        "first_word": F.col("first").cast("long"), "last_word": F.col("last").cast("long"),
        "base_labels": F.coalesce(F.array_join("base_labels", ","), F.lit("")), "labels": F.coalesce(F.array_join("labels", ","), F.lit("")),
        "score": F.coalesce("score", F.lit(0.0))})


def scan_sql(phrases: tuple[tuple[str, str], ...] = PHRASES, passages: tuple[tuple[str, str], ...] = PASSAGES, max_shift: int = 5,
             min_votes: int = 3, min_share: float = 0.75) -> str:
    """DuckDB twin of the scan's digest columns over ``documents``."""
    templates = ", ".join(f"({n}, '{label}', {str(n < len(phrases)).lower()}, string_split('{text}', ' '))" for n, (label, text) in enumerate((*phrases, *passages)))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {templates}) AS x(template, label, exact, words)),
tg AS (SELECT template, label, exact, len(words) AS length, i - 1 AS tpos, array_to_string(words[i:i + {K - 1}], ' ') AS gram
       FROM (SELECT *, unnest(range(1, len(words) - {K - 2})) AS i FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '{WORD}') AS words FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(words[i:i + {K - 1}], ' ') AS gram
      FROM (SELECT *, unnest(range(1, len(words) - {K - 2})) AS i FROM d)),
hits AS (SELECT g.doc_id, template, label, exact, length, pos - tpos AS diagonal, tpos FROM g JOIN tg USING (gram)),
held AS (SELECT DISTINCT doc_id, template, label, exact, length, diagonal, tpos + j AS w FROM hits, (SELECT unnest(range({K})) AS j)),
n_votes AS (SELECT doc_id, template, diagonal, count(DISTINCT tpos) AS votes FROM hits GROUP BY doc_id, template, diagonal),
diag AS (SELECT doc_id, template, label, exact, length, diagonal, count(*) AS held, diagonal + min(w) AS s, diagonal + max(w) AS e
         FROM held GROUP BY doc_id, template, label, exact, length, diagonal),
near AS (SELECT diag.*, held / greatest(length, e - s + 1) AS alone FROM diag JOIN n_votes USING (doc_id, template, diagonal)
         WHERE NOT exact AND votes >= {min_votes}),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {max_shift} THEN 1 ELSE 0 END AS f FROM near),
chains AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS chain FROM fresh),
merged AS (SELECT c.doc_id, c.template, c.label, c.chain, any_value(c.length) AS length, count(DISTINCT h.w) AS held,
                  min(c.s) AS s, max(c.e) AS e, max(c.alone) AS best
           FROM chains c JOIN held h USING (doc_id, template, diagonal) GROUP BY c.doc_id, c.template, c.label, c.chain),
found AS (SELECT doc_id, label, true AS exact, s, 1.0::DOUBLE AS share FROM diag WHERE exact AND held = length
          UNION ALL
          SELECT doc_id, label, false, NULL, greatest(held / greatest(length, e - s + 1), best) FROM merged
          WHERE greatest(held / greatest(length, e - s + 1), best) >= {min_share}),
per_doc AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(s) FILTER (WHERE exact) AS first_word, max(s) FILTER (WHERE exact) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN per_doc USING (doc_id)
"""
