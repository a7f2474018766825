"""Context under a token budget, messages, and a checked answer. The generator is a plug-in."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import text
from corpuslake.settings import DEFAULTS

PROMPT_VERSION, QUERY_VERSION = "prompt-1", "queries-v1"
SUGGESTION_ID = "q5_first_approach"
#: Facts that a model sees, and what they mean to it.
SHOWN = {
    "has_team_page": "whether a page of the site lists its people", "people_listed": "people on that page, which is not a headcount",
    "technical_role_mentions": "technical role words on team pages", "has_careers_page": "whether the site has a careers page",
    "open_roles_seen": "vacancies listed when the site was crawled", "technical_roles_open": "technical ones among those vacancies",
    "blog_posts_seen": "blog posts crawled, which is not how many there are", "latest_post_date": "newest date that a crawled post declares",
}
#: Question ids, and the words to search with for each (fixed values).
QUERIES = {
    "q1_what_and_to_whom": "what we do: our products and services, what we build for customers, and the customers and industries we work with",
    "q2_technical_capacity": "our team: the people who work here, developers, engineers and designers, and their job titles",
    "q3_growth_signals": "company news: funding raised, investment, hiring and open positions, new offices, new products and teams launched",
    "q4_stated_need": "we are looking for someone to join us; in this role you will; what we need to build, fix or rebuild next",
}
SCOPE = {
    "q1_what_and_to_whom": "What the company sells and to whom.", "q2_technical_capacity": "Evidence that its own staff build technology.",
    "q3_growth_signals": "Hiring, funding, new offices, products or teams of its own.", "q4_stated_need": "Something it says in its own words that it cannot do yet.",
}
SYSTEM = (
    "Answer one question about one company from the given facts and passages only. Cite each claim: "
    f"[{text.SIGNALS_MARK}] for a fact, [1], [2] for a passage. If they do not answer it, reply with exactly "
    f'"{text.INSUFFICIENT}" and one sentence on what is missing. Do not infer or guess.'
)


def query_version(enabled: bool = DEFAULTS.use_retrieval_queries) -> str:
    return QUERY_VERSION if enabled else "question"


def retrieval_query(question: Column, question_id: Column, enabled: bool = DEFAULTS.use_retrieval_queries) -> Column:
    """The written query of a known question, else the question's own words."""
    written = F.create_map(*[F.lit(x) for pair in QUERIES.items() for x in pair])
    return F.coalesce(written[F.coalesce(question_id, F.lit(""))], question) if enabled else question


def signals_block(names: list[str]) -> Column:
    """The facts of a row that it has among names, one line each with its meaning."""
    head = f"COMPUTED FACTS [{text.SIGNALS_MARK}], counted from the company's own pages:"
    lines = [
        F.when(F.col(n).isNotNull(), F.concat(F.lit(f"- {n} = "), F.regexp_replace(F.to_json(F.struct(F.col(n).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1"), F.lit(f": {m}")))
        for n, m in SHOWN.items() if n in names
    ]
    listed = F.array_compact(F.array(*lines)) if lines else F.array().cast("array<string>")
    none = F.array(F.lit("- none were computed for this company"))
    return F.array_join(F.concat(F.array(F.lit(head)), F.when(F.size(listed) > 0, listed).otherwise(none)), "\n")


def admit(hits: DataFrame, by: list[str], rank: str, tokens: str, budget: int = DEFAULTS.context_tokens, used: Column | None = None) -> DataFrame:
    """Every column of hits, and running_tokens, admitted, number (null if dropped), over_budget.

    In order of rank a passage is admitted while all before it and it fit the budget, of
    which `used` is spent already; the first always is. One overflow ends admission,
    and as token counts are not negative, a running sum says the same.
    """
    w = Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(tokens).over(w) + (F.lit(0) if used is None else used)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(rank)) == 1
    out = hits.withColumn("running_tokens", spent).withColumn("__first", first)
    out = out.withColumn("admitted", F.col("__first") | (F.col("running_tokens") <= budget))
    number = F.when(F.col("admitted"), F.sum(F.col("admitted").cast("int")).over(w).cast("int"))
    return out.withColumn("number", number).withColumn("over_budget", F.col("admitted") & (F.col("running_tokens") > budget)).drop("__first")


def contexts(admitted: DataFrame, by: list[str]) -> DataFrame:
    """by, passages, dropped (ids by rank), rendered: the numbered passages of each group, most similar first.

    admitted: by, rank, id, kind, source_url, content, admitted, number.
    """
    item = F.struct("rank", "number", "id", "kind", "source_url", F.when(F.col("admitted"), text.collapse("content")).alias("content"), "admitted")
    grouped = admitted.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("p"))
    shown = F.filter("p", lambda p: p["admitted"])
    line = lambda p: F.concat(F.lit("["), p["number"].cast("string"), F.lit("] ("), p["kind"], F.lit(") "), F.coalesce(p["source_url"], F.lit("(source not resolved)")), F.lit("\n"), p["content"])
    body = F.when(F.size(shown) > 0, F.array_join(F.transform(shown, line), "\n\n")).otherwise("(none were retrieved)")
    return grouped.select(
        *by, F.transform(shown, lambda p: p["id"]).alias("passages"), F.transform(F.filter("p", lambda p: ~p["admitted"]), lambda p: p["id"]).alias("dropped"),
        F.concat(F.lit("RETRIEVED PASSAGES, most similar first:\n\n"), body).alias("rendered"),
    )


def messages(question: str, context: str, question_id: str | None = None) -> list[dict[str, str]]:
    """System rules, then the context, what counts as an answer, and the question last."""
    extra = " This asks for a suggestion: ground it in the material and cite it." if question_id == SUGGESTION_ID else ""
    counts = f"WHAT COUNTS AS AN ANSWER: {SCOPE[question_id]}\n\n" if question_id in SCOPE else ""
    return [{"role": "system", "content": SYSTEM + extra}, {"role": "user", "content": f"{context}\n\n{counts}QUESTION: {question}"}]


def message_columns(question: Column, context: Column, question_id: Column) -> Column:
    """messages() of a row: an array of struct(role, content)."""
    suggests = F.when(question_id.eqNullSafe(F.lit(SUGGESTION_ID)), messages("", "", SUGGESTION_ID)[0]["content"]).otherwise(SYSTEM)
    scope = F.create_map(*[F.lit(x) for pair in SCOPE.items() for x in pair])[F.coalesce(question_id, F.lit(""))]
    counts = F.coalesce(F.concat(F.lit("WHAT COUNTS AS AN ANSWER: "), scope, F.lit("\n\n")), F.lit(""))
    user = F.concat(context, F.lit("\n\n"), counts, F.lit("QUESTION: "), question)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", suggests), message("user", user))


class Generator(Protocol):
    name: str
    load_seconds: float

    def complete(self, messages: list[dict[str, str]], max_tokens: int, temperature: float) -> str: ...


class DecliningGenerator:
    """A deterministic stand-in that always declines."""

    name, load_seconds = "declining", 0.0

    def complete(self, messages, max_tokens, temperature) -> str:
        return f"{text.INSUFFICIENT} No model is configured."


class AnswerUnavailable(RuntimeError):
    """There is nothing to answer from."""


@dataclass
class Answer:
    question: str
    text: str
    declined: bool
    passages: list[int]
    cites_signals: bool
    invalid: list[str]
    problems: list[str]
    context: DataFrame = field(repr=False)
    model: str = ""
    prompt_version: str = PROMPT_VERSION
    seconds: float = 0.0


def checked(replies: DataFrame, reply: str = "reply", n_passages: str = "n_passages") -> DataFrame:
    """Every column of replies, and clean, declined, decline_form, citations, problems."""
    clean = replies.withColumn("clean", text.strip_reasoning(reply)).withColumn("citations", text.citations("clean", n_passages))
    return clean.withColumns({
        "declined": text.is_decline("clean"), "decline_form": text.decline_form("clean"), "problems": text.answer_problems("clean", F.col("citations")),
    })


def answer(scope, embedder, generator: Generator, counter, question: str, question_id: str | None = None, signals: DataFrame | None = None, k: int = DEFAULTS.retrieval_k) -> Answer:
    """One question to one tenant: search, context, generation, checks.

    scope: a TenantScope; counter: a named token counter; signals: the tenant's row.
    The k hits, a handful, come to the driver, as the generator does its work there.
    """
    from corpuslake.operators.embedding import query_text

    spark = scope._chunks.sparkSession
    if not scope.counts().first()["embedded"]:
        raise AnswerUnavailable("the tenant has no embedded chunks")
    search = QUERIES.get(question_id or "", question) if DEFAULTS.use_retrieval_queries else question
    (vector,) = embedder.encode([query_text(embedder.name, search)])
    hits = scope.top_chunks(vector, k).collect()
    found = spark.createDataFrame(hits, "id long, content string, kind string, score double")
    urls = {r["id"]: r["source_url"] for r in scope.source_urls(found).collect()}
    facts = signals.select(signals_block(signals.columns)).first()[0] if signals is not None else signals_text_none()
    rows = [(0, i + 1, h["id"], h["kind"], urls.get(h["id"]), h["content"], counter.count(" ".join(h["content"].split()))) for i, h in enumerate(hits)]
    ranked = spark.createDataFrame(rows, "q int, rank int, id long, kind string, source_url string, content string, tokens int")
    kept = admit(ranked, ["q"], "rank", "tokens", used=F.lit(counter.count(facts)))
    context = contexts(kept, ["q"])
    shown = context.first()
    rendered = facts + "\n\n" + (shown["rendered"] if shown else "RETRIEVED PASSAGES, most similar first:\n\n(none were retrieved)")
    began = time.perf_counter()
    reply = generator.complete(messages(question, rendered, question_id), DEFAULTS.answer_tokens, DEFAULTS.temperature)
    seconds = time.perf_counter() - began
    r = checked(spark.createDataFrame([(reply, len(shown["passages"]) if shown else 0)], "reply string, n_passages int")).first()
    c = r["citations"]
    return Answer(question, r["clean"], r["declined"], list(c["passages"]), c["signals"], list(c["invalid"]), list(r["problems"]), context, generator.name, seconds=seconds)


def signals_text_none() -> str:
    return f"COMPUTED FACTS [{text.SIGNALS_MARK}], counted from the company's own pages:\n- none were computed for this company"
