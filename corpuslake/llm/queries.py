"""The queries of the ten operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import contamination, hmm, html_text, language, oracles, packing, quality, secrets, simhash, substrings, url_rules
from corpuslake.llm.common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    held_out = F.coalesce(held_out, F.lit(False))
    model = language.train(docs, ~held_out)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contamination.contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), slop=contamination.SLOP)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    passed = quality.kept(quality.POLICIES["base"])
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passed).alias("base_failed"), quality.kept(quality.POLICIES["strict"]).alias("kept"), "failed_rules",
        quality.only_rule(quality.POLICIES["strict"]).alias("only_rule"),
    )


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return hmm.score(table(spark, sf_dir, "documents"), held_out)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"), label_key=url_rules.numbered())
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(
        "doc_id", *[secrets.count("base", k).alias(f"n_{k}") for k in secrets.PATTERNS],
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("base", "added").alias("spans"),
        "n_live", "n_copied",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_contamination": op2_contamination,
        "op3_quality": op3_quality,
        "op4_hmm": op4_hmm,
        "op5_url_rules": op5_url_rules,
        "op6_packing": op6_packing,
        "op7_html_text": op7_html_text,
        "op8_simhash": op8_simhash,
        "op9_substrings": op9_substrings,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
