"""The corpus pipeline: documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir) and gets what the one before kept; all but the last
return the columns of ``documents``. ``run`` writes every stage's result as Parquet in the
shared checkpoint folder and reads it again, so that a lost executor costs one stage's tasks.
Null ids and texts, empty tables, repeated rows and extra columns are treated as the operators'
docstrings say; a row without an id is removed as a duplicate only of one with the same text and no id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtwin.llm.bpe import decode_ids, encode_texts
from tabtwin.llm.common import quoted, read_table, written
from tabtwin.llm.decontaminate import match_benchmark
from tabtwin.llm.line_dedup import drop_shared_lines
from tabtwin.llm.near_dup import near_duplicates
from tabtwin.llm.quality import fit_quality, score_quality
from tabtwin.llm.queries import QUALITY_THRESHOLD, held_out, tokenizer


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and, packed away from the operators' own column names, everything else."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]).alias("rest"))


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the quality classifier accepts; it learns from the labels outside the held-out quarter."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return unpacked(score_quality(carried(docs), model).where(F.col("score") >= QUALITY_THRESHOLD), docs)


def strip_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text."""
    done = unpacked(drop_shared_lines(carried(docs)).withColumn("text", F.col("kept_text")), docs)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the document with the smallest id, and one row of each document.

    Rows of one id and equal texts (of no id and equal texts as well) are one document; of rows with different texts
    under a kept id each text stays.
    """
    gone = near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").withColumn("__digest", F.xxhash64("text")).select("__digest", *[quoted(c) for c in docs.columns])
    # Only documents that have several rows are shuffled with their texts.
    several = kept.groupBy(F.col("doc_id").alias("__id"), F.col("__digest").alias("__same")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    several = written(several.drop("__n"), "repeated-rows")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__same"))
    single, repeated = kept.join(several, same, "left_anti"), kept.join(several, same, "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"])).drop("__digest")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = match_benchmark(carried(docs), read_table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(F.size("matches") == 0), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to.

    The ids are written before they are decoded, so that no task holds an encoding and a decoding Python worker at once.
    """
    encoded = written(encode_texts(docs.select("doc_id", "text"), *tokenizer(), keep_text=False), "encoded")
    return decode_ids(encoded, tokenizer()[0]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", strip_shared_lines),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: None: a learned classifier, sketches and edit distances aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"pipeline-stage{number}")
    return docs
