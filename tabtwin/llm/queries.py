"""Registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtwin.session import scratch_path
from tabtwin.llm.bpe import decode_ids, encode_texts
from tabtwin.llm.chat_format import format_conversations, restore_conversations
from tabtwin.llm.common import read_table
from tabtwin.llm.decontaminate import match_benchmark
from tabtwin.llm.importance import resample
from tabtwin.llm.license_scan import scan_licenses, scan_sql
from tabtwin.llm.line_dedup import drop_shared_lines
from tabtwin.llm.lm_score import score_documents, train_network, word_counts
from tabtwin.llm.near_dup import near_duplicates
from tabtwin.llm.periodic_runs import periodic_runs
from tabtwin.llm.quality import fit_quality, score_quality
from tabtwin.llm.token_counts import apply_edits, count_tokens, n_tokens
from tabtwin.llm.topk_search import top_k_search
from tabtwin.llm.warc import archive_pages


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records: written, normalised to a gzip member each, read back by offset."""
    records = archive_pages(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that is in its whole text with at most one edit in twenty characters."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_benchmark(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.groupBy("doc_id", F.col("m.item").alias("item_id")).agg(F.min("m.distance").alias("distance"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as a prefix tree of token segments, and what reading it back gives."""
    control = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema))
    segments, conversations = format_conversations(rows, *tokenizer())
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = restore_conversations(segments, conversations, tokenizer()[0]).select(
        "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    return conversations.select("conv_id", "leaf").join(read, "leaf").drop("leaf")


#: A document passes with this score or more.
QUALITY_THRESHOLD = 0.7


def held_out() -> Column:
    """Whether a doc_id is in the quarter whose labels are never learned from; a null one isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model that saw no label of the held-out quarter."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return score_quality(docs, model, keep_text=False).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and the bytes they decode to, as digests."""
    ranks, pattern = tokenizer()
    encoded = encode_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern, keep_text=False)
    both = decode_ids(encoded, ranks)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave every document."""
    done = drop_shared_lines(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five-word shingles, a similarity of 0.75 or more."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed log-probabilities of the tokens and of the words of all documents under a network and word counts of all of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = word_counts(docs)
    scored = score_documents(docs, *train_network(docs, counts=counts), keep_text=False, counts=counts)
    return scored.select("doc_id", F.col("lm.tokens").alias("n_tokens"), F.col("lm.log_prob").alias("log_prob"), F.col("lm.word_log_prob").alias("word_log_prob"),
                         F.expr("try_divide(lm.word_log_prob, lm.tokens)").alias("mean_log_prob"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector against all others."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k_search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each (a replacement, an insertion, a deletion)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    place = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.length("text") + 1).cast("int")
    edits = F.array(*[F.struct(place(seed).alias("start"), (place(seed) + gone).alias("end"), F.lit(put).alias("text"))
                      for seed, gone, put in ((1, 12, "replaced by this"), (2, 0, "\n\n  put in here's 42 "), (3, 40, None))])
    counted = count_tokens(docs.withColumn("edits", edits), *tokenizer())
    edited = apply_edits(counted, *tokenizer()).select("doc_id", n_tokens().alias("n_tokens"), "edited.*")
    return edited.select("doc_id", "n_tokens", n_tokens("tree").alias("n_tokens_after"), F.col("reencoded").alias("chars_reencoded"),
                         F.sha2("text", 256).alias("edited_sha256"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages in all documents, by diagonals of agreeing runs of words."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, keep_text=False).drop("license_spans")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the benchmark's texts."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, read_table(spark, sf_dir, "benchmark"), keep_text=False)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by id, repeat a stretch of their words from some word on to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    some = docs.select("doc_id", "text", F.expr("crc32(binary(string(doc_id))) div 10").alias("g"), words.alias("words"))
    n = F.size("words")
    some = some.withColumn("a", F.when(n > 0, F.col("g") % n))
    some = some.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    rewritten = F.array_join(F.transform("words", lambda w, i: F.get("words", place(i))), " ")
    return some.select("doc_id", F.when(n > 0, rewritten).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal periodic runs of words in all documents, and the texts without their repetitions."""
    found = periodic_runs(with_planted_periods(read_table(spark, sf_dir, "documents").select("doc_id", "text")), keep_text=False)
    runs = F.col("periodic.runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    read = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("best"),
                        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"))
    return read.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
                       F.expr("1000 * best.length div -best.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s USING (key)
GROUP BY k.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op4_quality": op4_quality,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dup": op7_near_dup,
    "op8_lm_score": op8_lm_score,
    "op9_topk_search": op9_topk_search,
    "op10_token_counts": op10_token_counts,
    "op11_license_scan": op11_license_scan,
    "op12_importance": op12_importance,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op6_line_dedup": LINE_DEDUP_SQL,
    "op11_license_scan": scan_sql(),
}
