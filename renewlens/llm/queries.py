"""Queries of the operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from renewlens.llm import alignment, bpe_tree, oracles
from renewlens.llm.archives import convert, read_warc, write_arc
from renewlens.llm.decontaminate import verdicts
from renewlens.llm.line_dedup import dedup_lines, dedup_runs
from renewlens.llm.mixing import mix
from renewlens.llm.neardup import near_duplicates
from renewlens.llm.pseudonyms import KINDS as PERSONAL
from renewlens.llm.pseudonyms import pseudonymise
from renewlens.llm.quality import STATS, cut_host_lines
from renewlens.llm.secrets import listed, scan
from renewlens.llm.spelling import spelling_variants
from renewlens.llm.substrings import dedup_substrings
from renewlens.llm.unigram import token_counts
from renewlens.session import shared_dir

#: Key of the pseudonyms in the query over public test tables; callers bring their own.
TEST_KEY = b"key of the test tables"


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_substrings(_table(spark, folder, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op2_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    found = pseudonymise(_table(spark, folder, "documents", "doc_id", "text"), TEST_KEY)
    return found.select("doc_id", *(f"n_{k}" for k in PERSONAL), "text")


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    found = mix(_table(spark, folder, "documents", "doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents", "doc_id", "text")).drop("tk")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = cut_host_lines(_table(spark, folder, "documents", "doc_id", "source", "text"))
    return found.select(
        "doc_id", *STATS, "base_failed", "kept", "words_left",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("left_sha256"),
    )


def op5_host_lines(spark: SparkSession, folder: str) -> DataFrame:
    return op5_quality_rules(spark, folder)


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(_table(spark, folder, "documents", "doc_id", "text"))
    base = ("assign", "access", "hex")
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed((*base, "model")).alias("spans"),
    )


def op7_archives(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(_table(spark, folder, "pages", "page_id", "url", "html"), f"{path}/arc")
    convert(spark, f"{path}/arc", f"{path}/warc")
    return read_warc(spark, f"{path}/warc").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "n_pretokens", "n_tokens")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = verdicts(
        _table(spark, folder, "documents", "doc_id", "text"),
        _table(spark, folder, "benchmark", "item_id", "text"),
    )
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(_table(spark, folder, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_lines", "n_chunks", "n_removed_lines",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op10_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_runs(_table(spark, folder, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_lines", "n_removed_lines",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    found = spelling_variants(_table(spark, folder, "documents", "doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(bpe_tree.VOCABULARY)
    docs = _table(spark, folder, "documents", "doc_id", "text")
    ids = bpe_tree.encode_texts(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe_tree.decode_ids(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    first, second = map(public_tokenizers.path, (alignment.FIRST, alignment.SECOND))
    docs = _table(spark, folder, "documents", "doc_id", "text")
    digest = lambda g: F.when(g == "", "").otherwise(F.sha2(g.cast("binary"), 256))
    found = alignment.align(docs, first, second, keep=digest)
    return found.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_pseudonyms, op3_mix_sources, op4_near_duplicates, op5_quality_rules,
        op6_secret_scan, op7_archives, op8_token_counts, op9_decontaminate, op10_line_chunks,
        op5_host_lines, op10_line_runs, op11_spelling_variants, op12_byte_bpe, op13_token_alignment,
    )
}
ORACLES = oracles.ORACLES
