"""Quality rules as a bitmask ledger.

measure() takes each text once; ledger() evaluates every rule once on its measurements and
stores them with one bit for each rule that fails. A policy is a named,
versioned mask over those bits: to apply it, or to ask what each of its rules drops
alone, reads the stored ledger and never the texts again. Everything is built-in expressions in
one scan; the ablation counts failure patterns (at most 2^rules groups, combined before
the shuffle).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import ROW, passed, passing, stored, unnamed

WINDOW = 5
#: Rules in the order of their bits, as SQL over the measurements; true: the text fails.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 4 * n_lines",
    "short_or_long_words": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
    "shouting": "3 * n_capitals > word_chars",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


_ALL = (
    Policy("base", 1, ("few_words", "repeated_words")),
    Policy("strict", 1, tuple(r for r in RULES if r != "shouting")),
    Policy("strict", 2, tuple(RULES)),
)
VERSIONS = {(p.name, p.version): p for p in _ALL}
#: The latest version of each policy.
POLICIES = {p.name: p for p in sorted(_ALL, key=lambda p: p.version)}

#: Low bits that hold a window's place when it is packed with its hash.
_PLACE = (1 << 21) - 1

#: Sorted first words (from 0) of the windows that another window of the text equals,
#: from h, the windows' hashes, and w, the words, which are compared where hashes agree. Hash
#: and place are packed in one long, which sorts as a primitive; where the place does not fit
#: or cutting the hash makes two windows alike, pairs are sorted instead.
def _packed(a: str, b: str) -> str:
    place = lambda x: f"slice(w, cast({x} & {_PLACE}L as int) + 1, {WINDOW})"
    return f"coalesce(({a} & ~{_PLACE}L) = ({b} & ~{_PLACE}L) and {place(a)} = {place(b)}, false)"


def _paired(a: str, b: str) -> str:
    return f"coalesce({a}.x = {b}.x and slice(w, cast({a}.i as int) + 1, {WINDOW}) = slice(w, cast({b}.i as int) + 1, {WINDOW}), false)"


_REPEATED = f"""
if(size(h) <= {_PLACE} and size(array_distinct(transform(h, x -> x & ~{_PLACE}L))) = size(array_distinct(h)),
  element_at(transform(array(sort_array(transform(h, (x, i) -> (x & ~{_PLACE}L) | i))), p ->
    sort_array(transform(filter(p, (x, j) -> {_packed("x", "get(p, j - 1)")} or {_packed("x", "get(p, j + 1)")}), x -> x & {_PLACE}L))), 1),
  element_at(transform(array(array_sort(transform(h, (x, i) -> struct(x as x, bigint(i) as i)))), p ->
    sort_array(transform(filter(p, (x, j) -> {_paired("x", "get(p, j - 1)")} or {_paired("x", "get(p, j + 1)")}), x -> x.i))), 1))
"""
_COVERED = f"""
if(size(array_distinct(h)) = size(h), 0L,
  element_at(transform(array({_REPEATED}), s ->
    aggregate(transform(s, (x, k) -> least({WINDOW}L, coalesce(get(s, k + 1) - x, {WINDOW}L))), 0L, (a, b) -> a + b)), 1))
"""


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def measure(docs: DataFrame) -> DataFrame:
    """Every column of docs and the measurements of the whole text, all long: n_words,
    word_chars, n_symbols, n_lines and n_dup_lines (lines with a word), n_repeat_words,
    n_capitals.

    A null or blank text has no words and all measurements 0 (n_symbols too: a symbol is
    in a word). Repeated rows are measured each; columns that have a measurement's name, or
    failed_rules, in any case, are replaced; others pass through as they are.
    """
    names = unnamed(docs, *MEASURES, "failed_rules")
    blank = r" \t\n\x0B\f\r"
    whole = docs.select(passing(names), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("s"))
    first = whole.select(ROW, "s", F.expr("trim(both ' \\t\\n\\u000B\\f\\r' from s)").alias("t"))
    words = first.withColumn("w", F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", f"[{blank}]+")))
    windows = words.withColumn(
        "h", F.expr(f"if(size(w) >= {WINDOW}, transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))), cast(array() as array<bigint>))")
    )
    lines = F.filter(F.split("s", "\n"), lambda x: x.rlike(f"[^{blank}]"))
    counted = windows.select(
        ROW, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), _lines_of(lines).alias("l"),
        F.expr(_COVERED).alias("n_repeat_words"), F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    return counted.select(
        *passed(names), "n_words", "word_chars", "n_symbols", F.col("l.n").alias("n_lines"),
        (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), "n_repeat_words", "n_capitals",
    )


def _lines_of(lines: Column) -> Column:
    """How many lines, and how many different ones; lines is evaluated once."""
    pair = F.transform(
        F.array(lines),
        lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")),
    )
    return F.element_at(pair, 1)


def ledger(measured: DataFrame) -> DataFrame:
    """measured and failed_rules: a bit for each rule that the row fails (see BITS), written once to the shared folder."""
    bits = None
    for rule, bit in BITS.items():
        one = F.when(F.expr(RULES[rule]), F.lit(bit)).otherwise(F.lit(0)).cast("long")
        bits = one if bits is None else bits.bitwiseOR(one)
    return stored(measured.withColumn("failed_rules", bits), "quality-ledger")


def kept(policy: Policy) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failed_rules").bitwiseAND(F.lit(policy.mask)) == 0


def only_rule(policy: Policy) -> Column:
    """The rule without which alone a policy would keep a row that it drops; null for others."""
    bits = F.col("failed_rules").bitwiseAND(F.lit(policy.mask))
    found = F.lit(None).cast("string")
    for rule in policy.rules:
        found = F.when(bits == BITS[rule], F.lit(rule)).otherwise(found)
    return found


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """rule, n_failed, n_only: rows that fail each rule of a policy, and those that the
    policy would keep without that rule alone; sums over failure patterns."""
    patterns = book.groupBy(F.col("failed_rules").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
