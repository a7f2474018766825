"""Duplicate pages of one tenant: same words in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicate(documents: DataFrame, tenant: str = "domain") -> tuple[DataFrame, DataFrame]:
    """Survivors, and outcomes of the others.

    documents: tenant, url, kind, content_hash, stable_hash and more. Of the documents of a
    tenant with one stable_hash the smallest url survives, with duplicate_urls (sorted),
    kind_conflicts (other kinds, sorted) and duplicate_reason (identical, or reordered).
    The others are (tenant, url, survivor, outcome duplicate_content, detail). The tenant is
    part of the key: two tenants may share boilerplate. Groups are summed before they are
    shuffled, and only their keys are, not the texts; the join back on url is even.
    """
    key = [tenant, "stable_hash"]
    groups = documents.groupBy(*key).agg(
        F.min("url").alias("__survivor"), F.sort_array(F.collect_set("url")).alias("__urls"),
        F.sort_array(F.collect_set("kind")).alias("__kinds"), F.count_distinct("content_hash").alias("__texts"),
    )
    reason = F.when(F.col("__texts") > 1, "reordered").otherwise("identical")
    found = groups.select(
        F.col(tenant).alias("__tenant"), F.col("stable_hash").alias("__hash"), "__survivor", "__urls", "__kinds", reason.alias("__reason")
    )
    once = documents.dropDuplicates([tenant, "url"])
    same = (F.col(tenant) == F.col("__tenant")) & (F.col("stable_hash") == F.col("__hash")) & (F.col("url") == F.col("__survivor"))
    survivors = once.join(found, same).select(
        *documents.columns, F.array_except("__urls", F.array("url")).alias("duplicate_urls"),
        F.array_except("__kinds", F.array("kind")).alias("kind_conflicts"),
        F.when(F.size("__urls") > 1, F.col("__reason")).alias("duplicate_reason"),
    )
    others = found.select("__tenant", "__survivor", "__reason", F.explode(F.array_except("__urls", F.array("__survivor"))).alias("url"))
    outcomes = others.select(
        F.col("__tenant").alias(tenant), "url", F.col("__survivor").alias("survivor"), F.lit("duplicate_content").alias("outcome"),
        F.concat(F.lit("same words as "), "__survivor", F.lit(" ("), "__reason", F.lit(")")).alias("detail"),
    )
    return survivors, outcomes
