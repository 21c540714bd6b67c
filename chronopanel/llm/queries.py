"""Queries of the numbered operators, by name; SQL for those that SQL can express is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import best_fit, chat_format, decontaminate, filter_audit, html_extract, line_rules, lm_score, merkle, near_dedup, packing, quality_lines, substring_dedup, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    one = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(one)
    chats = chat_format.format_chats(rows.withColumn("parts", chat_format.text_parts(F.col("text"))))
    turns = chat_format.read_turns(F.col("formatted"))
    chats = chats.select("conv_id", "formatted", turns.alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.without_repeats(docs, keep=["doc_id"])
    return out.select("doc_id", "result.n_words", "result.n_removed", F.sha2(F.col("result.text"), 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_words, n_hit = F.col("found.n_words"), decontaminate.n_hit()
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(n_hit, n_words).alias("contaminated"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _of_remainder(k: int):
    """Rows whose id falls to the k-th of five folds."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == k, F.lit(False))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_lines.train(docs, _table(spark, sf_dir, "labels").where(~_of_remainder(0)))
    scored = quality_lines.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", _of_remainder(0).alias("held_out"), "score", quality_lines.is_kept(F.col("score")).cast("int").alias("predicted"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.without_repeats(docs, keep=["doc_id"])
    return out.select("doc_id", "result.n_bytes", "result.n_removed", "result.n_spans", F.sha2(F.col("result.rest"), 256).alias("kept_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), _of_remainder(1))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.with_line_counts(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    rules = F.col("rules")
    failed = line_rules.base_failed(rules)
    kept = ~failed & ~line_rules.is_depleted(rules)
    return found.select("doc_id", *(rules[c].alias(c) for c in line_rules.COUNTS), failed.alias("base_failed"), kept.alias("kept"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=F.when(_of_remainder(0), F.translate("text", letters.upper(), letters)))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat_format": op2_chat_format,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_html_extract": op6_html_extract,
    "op7_line_quality": op7_line_quality,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_lm_score": op9_lm_score,
    "op10_line_rules": op10_line_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_best_fit": op13_best_fit,
}
