"""Rules that Parquet does not enforce: each gives rows that break it; check() raises on any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.sources.schemas import KEYS, NULLABLE, TABLES, VOCABULARY


class IntegrityError(ValueError):
    """A table that must not be published."""


def violations(name: str, table: DataFrame, dimensions: int | None = None) -> DataFrame:
    """rule, n for the row rules and the natural key of a table that are broken."""
    rules = {f"{c} is null": F.col(c).isNull() for c in TABLES[name].names if c not in NULLABLE and c in table.columns}
    rules |= {f"{c} is not one of its vocabulary": ~F.col(c).isin(*v) for (t, c), v in VOCABULARY.items() if t == name and c in table.columns}
    if name == "chunks":
        rules["embedding without model, or model without embedding"] = F.col("embedding").isNull() != F.col("embedding_model").isNull()
        rules["token_count below one"] = F.col("token_count") < 1
        if dimensions:
            rules["embedding of another size"] = F.col("embedding").isNotNull() & (F.size("embedding") != dimensions)
    if name == "prospects":
        rules["domain is not lower case"] = F.col("domain") != F.lower("domain")
    if name == "crawl_runs":
        rules["max_pages below one"] = F.col("max_pages") < 1
    counts = table.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(k) for k, rule in rules.items()])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n")) for k in rules])).alias("x")).select("x.*")
    keys = table.groupBy(*KEYS[name]).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("natural key repeats").alias("rule"), "n")
    return rows.unionByName(keys).filter("n > 0")


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of child without a parent. For chunks the key is (document, tenant), so a chunk cannot belong to another tenant."""
    p = parent.select(*[F.col(b).alias(f"__{i}") for i, b in enumerate(keys.values())])
    on = [child[a] == p[f"__{i}"] for i, a in enumerate(keys)]
    return child.join(p, on, "left_anti")


def check(name: str, table: DataFrame, parents: tuple[tuple[DataFrame, dict[str, str]], ...] = (), dimensions: int | None = None) -> DataFrame:
    """The table, or an error that names the broken rules."""
    broken = [f"{r.rule} ({r.n})" for r in violations(name, table, dimensions).collect()]
    broken += [f"rows without a parent by {list(keys)}" for parent, keys in parents if not orphans(table, parent, keys).isEmpty()]
    if broken:
        raise IntegrityError(f"{name}: " + "; ".join(broken))
    return table


def cascade(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """child without the rows whose parent is gone."""
    p = parent.select(*[F.col(b).alias(f"__{i}") for i, b in enumerate(keys.values())]).distinct()
    return child.join(p, [child[a] == p[f"__{i}"] for i, a in enumerate(keys)], "left_semi")


def refuse_dimension_change(chunks: DataFrame, dimensions: int) -> None:
    """Raise while vectors of another size are stored."""
    if not chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") != dimensions)).isEmpty():
        raise IntegrityError(f"vectors of another size than {dimensions} are stored")
