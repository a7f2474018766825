"""Commands over a warehouse folder: python -m corpuslake.cli COMMAND ...

crawl, load, embed, ask, answer, eval, validate, scaffold and show, as the reference has
them; crawl reads a table of fetched pages, as the engine fetches nothing itself. A command
that writes makes a new version of the tables and then names it current, so a reader never
sees half of a load and a failed one changes nothing.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import answering, chunking, embedding, evaluation, loading, retrieval
from corpuslake.operators import report as lines
from corpuslake.plans import integrity, pipeline, tenancy
from corpuslake.settings import DEFAULTS
from corpuslake.sources import artifact, ground_truth
from corpuslake.sources.schemas import TABLES


#: Tables that every question of a tenant reads; they are stored by tenant.
BY_TENANT = ("documents", "chunks")


class Warehouse:
    """Versions of the tables below one folder of any file system that Spark has."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        where, fs = self._pointer()
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0] if fs.exists(where) else None

    def _read(self, v: str | None, t: str, tenant: int | None = None) -> DataFrame:
        if v is None:
            return self.spark.createDataFrame([], TABLES[t])
        if t in BY_TENANT:
            return tenancy.read(self.spark, f"{self.path}/{v}/{t}", TABLES[t], tenant)
        return self.spark.read.schema(TABLES[t]).parquet(f"{self.path}/{v}/{t}")

    def tables(self) -> loading.Tables:
        v = self.version()
        return loading.Tables(**{t: self._read(v, t) for t in TABLES})

    def scope(self, tenant: int, model: str) -> retrieval.TenantScope:
        """One tenant's chunks and documents; nothing else is read."""
        v = self.version()
        return retrieval.TenantScope(self._read(v, "chunks", tenant), self._read(v, "documents", tenant), tenant, model)

    def publish(self, tables: loading.Tables, dimensions: int = DEFAULTS.embedding_dimensions) -> loading.Tables:
        """Write a new version, check it as written, name it current."""
        v = f"v-{uuid.uuid4().hex}"
        for t in TABLES:
            rows = getattr(tables, t).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[t].fields])
            if t in BY_TENANT:
                tenancy.write(rows, f"{self.path}/{v}/{t}")
            else:
                rows.write.parquet(f"{self.path}/{v}/{t}")
        new = loading.Tables(**{t: self._read(v, t) for t in TABLES})
        integrity.check("prospects", new.prospects)
        integrity.check("documents", new.documents, ((new.prospects, {"prospect_id": "id"}),))
        integrity.check("chunks", new.chunks, ((new.documents, {"document_id": "id", "prospect_id": "prospect_id"}),), dimensions)
        integrity.check("crawl_runs", new.crawl_runs, ((new.prospects, {"prospect_id": "id"}),))
        integrity.check("crawl_page_outcomes", new.crawl_page_outcomes, ((new.crawl_runs, {"crawl_run_id": "id"}),))
        where, fs = self._pointer()
        out = fs.create(where, True)
        out.write(bytearray(v.encode()))
        out.close()
        return new

    def tenant(self, domain: str) -> int | None:
        row = self.tables().prospects.filter(F.col("domain") == domain.lower()).select("id").first()
        return row[0] if row else None


def make_embedder(model: str = DEFAULTS.embedding_model) -> embedding.Embedder:
    """Embedders by name. Only the deterministic stand-in is built in; others are plugged in by code."""
    if model.startswith("hash-"):
        return embedding.HashEmbedder(int(model[5:]))
    raise ValueError(f"no embedder is known for {model}")


def crawl(spark: SparkSession, pages: str, out: str, crawled_at: str) -> int:
    """Artifacts of a Parquet table of fetched pages (url, html). 1 if some tenant has no document."""
    table = spark.read.parquet(pages)
    docs, outcomes, facts, _ = pipeline.crawl_tables(table.select("url", "html"))
    made = pipeline.artifacts(docs, outcomes, facts, crawled_at)
    artifact.write_artifacts(made, out)
    return int(not artifact.read_artifacts(spark, out).filter(F.size("documents") == 0).isEmpty())


def load(spark: SparkSession, warehouse: str, artifacts: str, now: str | None = None, counter: chunking.Counter | None = None) -> tuple[int, DataFrame]:
    """Load a path of artifacts, one JSON object a line or a file. 1 if one is refused; the others are loaded."""
    found = artifact.read_artifacts(spark, artifacts)
    at = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    store = Warehouse(spark, warehouse)
    tables, report = loading.load(store.tables(), found, at, pipeline.chunker(counter or chunking.word_counter()))
    rows = spark.createDataFrame(report.collect(), report.schema)  # one row a tenant of this load; read before the swap
    store.publish(tables)
    return int(not rows.filter("refused is not null").isEmpty()), rows


def embed(spark: SparkSession, warehouse: str, domain: str, dry_run: bool = False, embedder: embedding.Embedder | None = None) -> int:
    """Vectors for a tenant's chunks without one. 2 if the tenant is unknown; a dry run only counts."""
    store = Warehouse(spark, warehouse)
    tenant = store.tenant(domain)
    if tenant is None:
        print(f"  no tenant with domain {domain!r}")
        return 2
    model = embedder or make_embedder()
    tables = store.tables()
    counts = store.scope(tenant, model.name).counts().first()
    own = tables.chunks.filter(F.col("prospect_id") == tenant)
    over = own.agg(embedding.over_window("token_count", model.window)).first()[0]
    print("\n".join(lines.embed_lines(counts, model.name, over, embedding.cost(model.name, counts.pending_tokens))))
    if not dry_run and counts.embedded < counts.chunks:
        pending = tables.chunks.filter((F.col("prospect_id") == tenant) & F.col("embedding").isNull())
        new = embedding.embed(pending, model).join(pending.select("id", "prospect_id"), "id")
        tables.chunks = embedding.write_embeddings(tables.chunks, new, model.dimensions, ["id", "prospect_id"])
        store.publish(tables, model.dimensions)
    return 0


def _scope(store: Warehouse, domain: str, model: embedding.Embedder) -> retrieval.TenantScope | None:
    tenant = store.tenant(domain)
    if tenant is None:
        print(f"  no tenant with domain {domain!r}; crawl and load it first")
        return None
    scope = store.scope(tenant, model.name)
    if not scope.counts().first()["embedded"]:
        print(f"  {domain} has no embedded chunks; embed it first")
        return None
    return scope


def ask(spark: SparkSession, warehouse: str, domain: str, question: str, question_id: str | None = None, k: int | None = DEFAULTS.retrieval_k, embedder=None) -> DataFrame | None:
    """rank, score, kind, source_url, content of a tenant's nearest chunks; of all of them if k is None."""
    model = embedder or make_embedder()
    scope = _scope(Warehouse(spark, warehouse), domain, model)
    if scope is None:
        return None
    search = answering.QUERIES.get(question_id or "", question)
    (vector,) = model.encode([embedding.query_text(model.name, search)])
    hits = scope.top_chunks(vector, k) if k else scope.ranking(vector).orderBy(F.desc("score"), "id")
    resolved = scope.source_urls(hits)
    retrieval.check_no_leakage(hits, resolved)
    from pyspark.sql import Window

    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))) if k else hits
    return ranked.join(resolved, "id").orderBy(F.desc("score"), "id")


def answer(spark: SparkSession, warehouse: str, domain: str, question: str, question_id: str | None = None, k: int = DEFAULTS.retrieval_k, embedder=None, generator=None):
    model = embedder or make_embedder()
    store = Warehouse(spark, warehouse)
    scope = _scope(store, domain, model)
    if scope is None:
        return None
    facts = store.tables().prospects.filter(F.col("domain") == domain.lower()).select("signals.*").withColumnRenamed("technical_roles_named", "technical_role_mentions")
    return answering.answer(scope, model, generator or answering.DecliningGenerator(), chunking.word_counter(), question, question_id, facts, k)


def evaluate(spark: SparkSession, warehouse: str, directory: str, embedder=None, cutoffs=evaluation.CUTOFFS) -> dict[str, DataFrame]:
    """pairs (with status), recalls, coverage and signals of a directory of ground truth. A leak voids the run."""
    store = Warehouse(spark, warehouse)
    tables = store.tables()
    model = embedder or make_embedder()
    pairs = ground_truth.read_pairs(spark, directory).withColumn("status", evaluation.pair_status(F.col("expected_outcome"), F.col("reference"), F.col("source_urls")))
    tenants = tables.prospects.select("domain", F.col("id").alias("tenant"), "signals")
    scored = pairs.filter(F.col("status") == evaluation.SCORED).join(tenants, "domain")
    asked = [(r.domain, r.question_id, r.tenant, model.encode([embedding.query_text(model.name, answering.QUERIES.get(r.question_id, r.question))])[0]) for r in scored.collect()]
    queries = spark.createDataFrame([(f"{d} {q}", t, v) for d, q, t, v in asked], "query_id string, tenant long, query array<double>")
    chunks = tables.chunks.withColumnRenamed("prospect_id", "tenant")
    ranking = retrieval.ranked(queries, chunks)
    sources = tables.chunks.join(tables.documents.select(F.col("id").alias("document_id"), "prospect_id", "source_url"), ["document_id", "prospect_id"])
    named = ranking.join(sources.select("id", F.col("source_url").alias("url"), "prospect_id"), "id").join(queries.select("query_id", "tenant"), "query_id")
    if not named.filter("prospect_id <> tenant").isEmpty():
        raise retrieval.LeakageError("a retrieved chunk is not the tenant's; the run is void")
    expected = scored.select(F.concat_ws(" ", "domain", "question_id").alias("query_id"), F.explode("source_urls").alias("url"))
    crawled = tables.documents.join(tenants.select(F.col("tenant").alias("prospect_id"), "domain"), "prospect_id").select("domain", F.col("source_url").alias("url"))
    runs = tables.crawl_runs.join(tenants.select(F.col("tenant").alias("prospect_id"), "domain"), "prospect_id").select(F.col("id").alias("crawl_run_id"), "domain", "started_at")
    named_outcomes = tables.crawl_page_outcomes.join(runs.select("crawl_run_id", "domain"), "crawl_run_id")
    outcomes = evaluation.latest_outcomes(named_outcomes, tables.crawl_runs, ["domain", "url"])
    wanted = pairs.filter(F.col("status") == evaluation.SCORED).select("domain", F.explode("source_urls").alias("url")).distinct()
    facts = tenants.select("domain", *[F.col(f"signals.{f}").alias(f) for f in evaluation.COMPARED])
    return {
        "pairs": pairs, "recalls": evaluation.recalls(named.select("query_id", "rank", "url"), expected, ["query_id"], cutoffs),
        "coverage": evaluation.coverage(wanted, crawled, outcomes, ["domain"]),
        "signals": evaluation.signal_accuracy(ground_truth.read_signals(spark, directory), facts, "domain"),
    }


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpuslake")
    parser.add_argument("--warehouse", default="warehouse")
    sub = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.add_parser(name), *args][0]
    p = add("crawl"); p.add_argument("pages"); p.add_argument("out"); p.add_argument("--at", required=True)  # noqa: E702
    p = add("load"); p.add_argument("artifacts"); p.add_argument("--now")  # noqa: E702
    p = add("embed"); p.add_argument("domain"); p.add_argument("--dry-run", action="store_true")  # noqa: E702
    for name in ("ask", "answer"):
        p = add(name)
        p.add_argument("domain")
        which = p.add_mutually_exclusive_group(required=True)
        which.add_argument("--question")
        which.add_argument("--id", choices=[*answering.QUERIES, answering.SUGGESTION_ID])
        many = p.add_mutually_exclusive_group()
        many.add_argument("-k", type=int, default=DEFAULTS.retrieval_k)
        many.add_argument("--full", action="store_true")
    p = add("eval"); p.add_argument("directory"); p.add_argument("--json")  # noqa: E702
    p = add("validate"); p.add_argument("directory")  # noqa: E702
    p = add("scaffold"); p.add_argument("artifact"); p.add_argument("out")  # noqa: E702
    p = add("show"); p.add_argument("artifacts"); p.add_argument("needle", nargs="?", default="")  # noqa: E702
    a = parser.parse_args(argv)
    if getattr(a, "k", 1) is not None and getattr(a, "k", 1) < 1:
        parser.error("k must be 1 or more")
    if a.command == "scaffold":
        from pathlib import Path

        if Path(a.out).exists():
            print(f"  {a.out} exists and is not overwritten")
            return 2
        Path(a.out).write_text(ground_truth.scaffold(json.loads(Path(a.artifact).read_text()), a.artifact), encoding="utf-8")
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "validate":
        report = ground_truth.validate(spark, a.directory)
        print("\n".join(lines.validation_lines(report)))
        return int(not report.ok)
    if a.command == "crawl":
        return crawl(spark, a.pages, a.out, a.at)
    if a.command == "load":
        code, report = load(spark, a.warehouse, a.artifacts, a.now)
        print("\n".join(lines.load_lines(report.collect())))
        return code
    if a.command == "embed":
        return embed(spark, a.warehouse, a.domain, a.dry_run)
    if a.command == "ask":
        hits = ask(spark, a.warehouse, a.domain, a.question or a.id, a.id, None if a.full else a.k)
        if hits is not None:
            print("\n".join(lines.hit_lines(hits.collect())))
        return int(hits is None)
    if a.command == "answer":
        got = answer(spark, a.warehouse, a.domain, a.question or a.id, a.id, a.k)
        if got is not None:
            print("\n".join(lines.answer_lines(got)))
        return int(got is None)
    if a.command == "eval":
        found = evaluate(spark, a.warehouse, a.directory)
        if a.json:
            for name, table in found.items():
                table.write.mode("overwrite").json(f"{a.json}/{name}")
        recall = evaluation.recall_at(found["recalls"]).orderBy("k").collect()
        print("\n".join(lines.run_lines(found["pairs"].collect(), recall, found["coverage"].collect(), found["signals"].collect())))
        return 0
    found = artifact.find_documents(artifact.read_artifacts(spark, a.artifacts), a.needle)
    rows = found.collect()
    print("\n".join(lines.text_lines(rows[0]) if len(rows) == 1 else lines.document_lines(rows)))
    return int(not rows)


if __name__ == "__main__":
    sys.exit(main())
