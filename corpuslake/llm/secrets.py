"""Secrets in texts, told from widely copied examples by who owns them.

Three kinds are found by pattern (PATTERNS). Further candidates, long mixed tokens, are
hashed and counted over the whole corpus by distinct owners and repositories: one that
few owners have looks live and is added as kind `token`, one that many share is an
example and is not. Built-in expressions only; texts stay where they are read, and
what is shuffled is hashes of candidates, counted by owner before and after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import ROW, passed, passing, stored, unnamed

#: kind: (pattern, characters that the match, or its second group, has at least)
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]{16,}", 16),
}
#: Candidates of the method: long tokens with a digit, a capital and a small letter.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Any candidate of any kind may start so; texts without are not searched further.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_-]{20}"
#: A candidate of at most so many owners looks live.
OWNERS = 2
KINDS = [*PATTERNS, "token"]
#: Matches of a text that are summed together.
BLOCK = 128
#: Parts into which the spans of a hash are dealt.
SALTS = 16
_SPAN = "struct<start:int,rank:int,end:int,kind:string,hash:string>"
#: SQL: candidates that touch no base span. One pass over all spans by start, in blocks: candidates do not overlap each
#: other, so one (p) waits for the next; m is the largest end of the base spans so far. At one start base spans come first.
_APART = f"""element_at(transform(array(array_sort(concat(base, candidates))), e ->
  aggregate(sequence(0, cast((size(e) - 1) div {BLOCK} as int)), named_struct('m', 0, 'p', cast(null as {_SPAN}), 'out', cast(array() as array<array<{_SPAN}>>)),
    (a, b) -> element_at(transform(array(
      aggregate(slice(e, b * {BLOCK} + 1, {BLOCK}), named_struct('m', a.m, 'p', a.p, 'out', cast(array() as array<{_SPAN}>)),
        (c, s) -> if(s.kind = 'token',
          named_struct('m', c.m, 'p', if(c.m > s.start, cast(null as {_SPAN}), s), 'out', if(c.p is null, c.out, concat(c.out, array(c.p)))),
          named_struct('m', greatest(c.m, s.end), 'p', if(s.start < c.p.end, cast(null as {_SPAN}), c.p), 'out', c.out)))),
      z -> named_struct('m', z.m, 'p', z.p, 'out', concat(a.out, array(z.out)))), 1),
    a -> if(a.p is null, flatten(a.out), concat(flatten(a.out), array(a.p))))), 1)"""


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _spans(kind: str, pattern: str, keep: str) -> str:
    """SQL: array of spans (start, rank, end, kind, m) of a pattern's leftmost matches in `text`, in code points.

    The gaps between matches come from split(), the matches from regexp_extract_all();
    their lengths, summed, are the places. Sums run in blocks of matches, each block's
    spans appended at once, so the cost follows the number of matches. keep: SQL over y.
    """
    rank, p = KINDS.index(kind), _literal(pattern)
    span = "struct<start:int,rank:int,end:int,kind:string,m:string>"
    one = f"""named_struct('at', c.at + length(element_at(x.g, i)) + length(element_at(x.m, i)),
          'out', concat(c.out, array(named_struct('start', c.at + length(element_at(x.g, i)), 'rank', {rank},
            'end', c.at + length(element_at(x.g, i)) + length(element_at(x.m, i)), 'kind', '{kind}', 'm', element_at(x.m, i)))))"""
    block = f"""aggregate(sequence(b * {BLOCK} + 1, least(size(x.m), (b + 1) * {BLOCK})), named_struct('at', a.at, 'out', cast(array() as array<{span}>)), (c, i) -> {one})"""
    return f"""filter(element_at(transform(array(named_struct('m', regexp_extract_all(text, {p}, 0), 'g', split(text, {p}, -1))), x ->
      aggregate(sequence(0, cast(greatest(size(x.m) - 1, 0) div {BLOCK} as int)), named_struct('at', 0, 'out', cast(array() as array<array<{span}>>)),
        (a, b) -> element_at(transform(array({block}), z -> named_struct('at', z.at, 'out', concat(a.out, array(z.out)))), 1),
        a -> flatten(a.out))), 1), y -> {keep})"""


def _found(kind: str) -> str:
    pattern, least = PATTERNS[kind]
    value = f"regexp_extract(y.m, {_literal(pattern)}, 2)" if kind == "assign" else "y.m"
    spans = _spans(kind, pattern, f"length({value}) >= {least}")
    hashed = f"transform({spans}, y -> named_struct('start', y.start, 'rank', y.rank, 'end', y.end, 'kind', y.kind, 'hash', sha2({value}, 256)))"
    return f"if(text rlike {_literal(pattern)}, {hashed}, cast(array() as array<{_SPAN}>))"


def _tokens() -> str:
    mixed = "y.m rlike '[0-9]' and y.m rlike '[A-Z]' and y.m rlike '[a-z]'"
    spans = _spans("token", TOKEN, mixed)
    hashed = f"transform({spans}, y -> named_struct('start', y.start, 'rank', y.rank, 'end', y.end, 'kind', y.kind, 'hash', sha2(y.m, 256)))"
    return f"if(text rlike {_literal(TOKEN)}, {hashed}, cast(array() as array<{_SPAN}>))"


def _listed(spans: Column) -> Column:
    """kind:start:end of spans, by start and then kind, comma-joined."""
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def _find(rows: DataFrame) -> DataFrame:
    """base and candidates beside every column of rows but text; rows: text and columns of no such names."""
    others = [c for c in rows.columns if c != "text"]
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    flagged = rows.select(*others, "text", hinted.alias("hinted"))
    base = flagged.withColumn(
        "base", F.when(F.col("hinted"), F.concat(*[F.expr(_found(k)) for k in PATTERNS])).otherwise(none)
    ).withColumn("candidates", F.when(F.col("hinted"), F.expr(_tokens())).otherwise(none))
    some = (F.size("candidates") > 0) & (F.size("base") > 0)
    return base.select(*others, "base", F.when(some, F.expr(_APART)).otherwise(F.col("candidates")).alias("candidates"))


def find(docs: DataFrame) -> DataFrame:
    """Every column of docs, base and candidates: arrays of spans (start, rank, end, kind, hash).

    candidates are tokens that do not touch a base span. A null or empty text has none.
    Columns of these two names, in any case, are replaced.
    """
    names = unnamed(docs, "base", "candidates")
    return _find(docs.select(passing(names), F.col("text").cast("string").alias("text"))).select(*passed(names), "base", "candidates")


def ownership(each: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories of every hash of each (owner, repository, hash)."""
    by_repository = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = OWNERS, with_text: bool = False) -> DataFrame:
    """Every column of docs, and base, added (arrays of spans), n_live, n_copied; text only if with_text.

    added: tokens that at most `owners` owners have. n_live and n_copied count the row's
    spans, base ones included, on either side of that bound. A null owner or repository counts
    as one of its own, a null or empty text has no spans. Repeated rows are returned each; an
    empty table gives no rows. Columns of the four names, in any case, are replaced; others pass
    through as they are. Rows are written to the shared folder, and only those with a span are
    joined with what the corpus knows of their hashes: a row's number is its own key, and a
    hash that one owner has everywhere is dealt out by salt.
    """
    names = unnamed(docs, "base", "added", "n_live", "n_copied", *([] if with_text else ["text"]))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(passing(names), key(owner).alias("owner"), key(repository).alias("repository"), F.col("text").cast("string").alias("text"))
    spans = stored(_find(rows).withColumn("row", F.monotonically_increasing_id()), "secrets")
    n_spans = F.size("base") + F.size("candidates")
    some, none = spans.filter(n_spans > 0), spans.filter(n_spans == 0)
    each = some.select("row", "owner", "repository", F.explode(F.concat("base", "candidates")).alias("s"))
    owned = ownership(each.select("owner", "repository", F.col("s.hash").alias("hash")))
    live = owned.filter(F.col("n_owners") <= owners).select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = each.select("row", "s", F.col("s.hash").alias("hash"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    by_row = dealt.join(live, ["hash", "salt"]).groupBy("row").agg(
        F.collect_list(F.when(F.col("s.kind") == "token", F.col("s"))).alias("added"), F.count("*").alias("n_live")
    )
    nothing = F.expr(f"cast(array() as array<{_SPAN}>)")
    joined = some.join(by_row, "row", "left").select(ROW, "base", F.coalesce("added", nothing).alias("added"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), n_spans.cast("long").alias("n"))
    alone = none.select(ROW, "base", nothing.alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n"))
    return joined.unionByName(alone).select(*passed(names), "base", "added", "n_live", (F.col("n") - F.col("n_live")).alias("n_copied"))


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(*spans: str) -> Column:
    return _listed(F.concat(*spans))


def redact(text: str, spans: Column, mark: str = "[secret]") -> Column:
    """The text column with each of its spans replaced by mark; spans that overlap share one."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], gap).otherwise(a["out"]).alias("out")
        )

    return F.aggregate(F.array_sort(spans), begin, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
