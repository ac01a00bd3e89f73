"""Removal of lines that many documents share, in DataFrame operations only.

Every line of every document is exploded with its position and reduced to a 16-byte hash of
its key. Distinct (hash, document) pairs are counted per hash; the hashes over the threshold
are joined back to the exploded (hash, document, position) rows, which leaves for each
document the positions to drop, and the document is put together from the runs of lines
between them.

Scale: three shuffles hold 16-byte hashes instead of lines, and the text moves once. A line
that a third of all documents hold meets as (hash, document) pairs spread over all tasks; the
count per hash is combined before its shuffle, and the join back is a plain equi-join whose
large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtwin.llm.common import ASCII_SPACE, lower_ascii, packed, unpacked, written


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 10,
                      min_chars: int = 1, kept_col: str = "kept_text") -> DataFrame:
    """``docs`` with ``n_lines`` (before), ``n_dropped`` and ``kept_text`` (the lines that stay, joined by \\n).

    A line goes, in every document, if its key has ``min_chars`` code points or more and is
    found in ``min_documents`` documents or more. Documents are told apart by ``id_col``:
    repeated rows of one document count once and each keep their own result, as do rows of
    different texts that share an id; a null id counts as one document. A null or empty text
    has one empty line and gives an empty text. An empty table gives an empty table. Columns
    of the input which have the names of the three results are replaced by them; any other
    column stays as it is.
    """
    base = docs.select(packed(docs).alias("row"))
    doc, text = F.col("row").getField(id_col), F.coalesce(F.col("row").getField(text_col), F.lit(""))
    lines = (base.select(doc.alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
             .select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
             .where(F.length("key") >= min_chars)
             .select("doc", "version", "pos", F.unhex(F.md5("key")).alias("hash")))
    # Written, not chained: below the join both sides are then plain exchanges, whose large partitions Spark can split.
    shared = written(lines.select("hash", "doc").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
                     .where(F.col("n") >= min_documents).select("hash"), "shared-lines")
    drops = (lines.join(shared, "hash").groupBy(F.col("doc").alias("d"), F.col("version").alias("v"))
             .agg(F.sort_array(F.collect_set("pos")).alias("drops")))
    joined = base.join(drops, doc.eqNullSafe(F.col("d")) & (F.xxhash64(text) == F.col("v")), "left")
    split = joined.select("row", F.split(text, "\n").alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    runs = split.select("row", "lines", "drops", F.size("lines").alias("n"),
                        F.concat(F.array(F.lit(0)), F.transform("drops", lambda p: p + 1)).alias("starts"))
    ends = F.concat("drops", F.array("n"))
    kept = F.flatten(F.zip_with("starts", ends, lambda a, b: F.slice("lines", a + 1, b - a)))
    return unpacked(runs, "row", docs.columns, {
        "n_lines": F.col("n").cast("long"), "n_dropped": F.size("drops").cast("long"), kept_col: F.array_join(kept, "\n")})
