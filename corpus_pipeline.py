"""A training-data pipeline over `documents`: language, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import contamination, language, near_copies, packing, secrets
from corpuslake.llm.common import ROW, forget, passing, stored, table


def wrapped(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads, and all others in one, so that no name of theirs meets its own."""
    return docs.select(passing([c for c in docs.columns if c not in needed]), *needed)


def unwrapped(docs: DataFrame, *needed: str, **changed: Column) -> list[Column]:
    """The columns of docs again, some of them changed."""
    found = {c: F.col(c) for c in needed} | changed
    return [found[c].alias(c) if c in found else F.col(ROW).getField(c).alias(c) for c in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network, trained on docs' own labels, recognises.

    Null, blank and letterless texts go, and those whose best language is hardly likelier than a
    guess among all (language.TIMES_CHANCE). Repeated rows share their fate; without a labelled
    row nothing is known and all go.
    """
    model = language.train(docs, F.lit(True))
    found = language.predict(wrapped(docs, "text"), model)
    least = model.least_score if model else 1.0
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select(*unwrapped(docs, "text"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the document with the smallest doc_id; repeated rows once.

    Of texts without an id one stays if no document with one is near. Rows that share an id but
    not the text go or stay together.
    """
    return near_copies.without_copies(wrapped(docs, "doc_id", "text")).select(*unwrapped(docs, "doc_id", "text"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole window of 13 benchmark words, and less than a twentieth of whose words are benchmark passages.

    The second rule is for items of fewer than 13 words: one such item, of a word maybe, must not
    empty the corpus. Null and blank texts stay, repeated rows share their fate, an empty benchmark
    drops nothing.
    """
    found = contamination.contamination(wrapped(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.filter(~F.col("contaminated") & ~F.col("whole_window")).select(*unwrapped(docs, "doc_id", "text"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of a secret replaced by a mark, and n_chars by the new length.

    Null texts and those without a span stay as they are; repeated rows are cleaned each.
    """
    found = secrets.scan(wrapped(docs, "doc_id", "source", "n_chars", "text"), with_text=True)
    marked = found.withColumn("spans", F.concat("base", "added"))
    clean = marked.withColumn("clean", F.when(F.size("spans") > 0, secrets.redact("text", F.col("spans"))).otherwise(F.col("text")))
    n_chars = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return clean.select(*unwrapped(docs, "doc_id", "source", text=F.col("clean"), n_chars=n_chars))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: one row for each piece. A null text is its end alone; repeated rows are packed each."""
    import public_tokenizers

    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", known_language),
    ("near_copies", without_near_copies),
    ("contamination", uncontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The network, the near copies and the tokeniser are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(docs)  # the stage before, but not the documents
        docs = done
    return docs
