"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapdiff.llm import ctw, decontam, filter_audit, line_dedup, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, sharding, substring_dedup, suffix_dedup, token_align, wrapper
from hapdiff.llm.common import read_table


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(read_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = F.col("failures").bitwiseAND(F.lit(quality_rules.POLICIES["base"].mask)) != 0
    return quality_rules.judge(led, quality_rules.POLICIES["v1"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failures"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, rejects alone, and what is kept without it, from the ledger of all documents."""
    return quality_rules.ablations(quality_rules.ledger(read_table(spark, sf_dir, "documents").select("text")), quality_rules.POLICIES["v1"])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(read_table(spark, sf_dir, "documents"), shards=16)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return ctw.score(docs, train=F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def op2_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    model = sentencepiece_codec.read_model(spark, vocabulary)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.cut_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.mark_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    n = F.size("leaked_items")
    return out.select(
        "doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.array_join("leaked_items", ",").alias("items")
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    held = quality_classifier.held_out()
    vectors, network = quality_classifier.train(docs.filter(~held), labels.filter(~held))
    out = quality_classifier.score(docs, vectors, network)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.cut_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_align(
    spark: SparkSession, sf_dir: str, first: str = "/opt/tokenizers/byte_bpe_50k.json", second: str = "/opt/tokenizers/piece_bpe_32k.model"
) -> DataFrame:
    files = [sentencepiece_codec.read_model(spark, path) for path in (first, second)]
    out = token_align.align(read_table(spark, sf_dir, "documents").select("doc_id", "text"), *files)
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", sha.alias("groups_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return filter_audit.interactions(filter_audit.judged(docs, read_table(spark, sf_dir, "labels"))).drop("filter")


QUERIES = {
    "op1_ctw": op1_ctw,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_near_dedup": op5_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_token_align": op12_token_align,
    "op13_filter_audit": op13_filter_audit,
    "quality_ablations": quality_ablations,
}
ORACLE_SQL = {
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_decontamination": decontam.ORACLE_SQL,
    "op5_near_dedup": near_dedup.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op8_sharding": sharding.ORACLE_SQL,
    "op11_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
    "quality_ablations": quality_rules.ABLATIONS_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
}
