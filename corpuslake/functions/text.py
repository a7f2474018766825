"""Text functions as Column expressions. None of them needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware string splitting has it (fixed value).
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHITE_CHARS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The reply that declines (fixed value).
INSUFFICIENT = "Insufficient evidence."
#: The mark that cites the computed facts (fixed value).
SIGNALS_MARK = "S"
HEADING_WORDS, HEADING_CHARS, PROSE_WORDS = 10, 70, 12
#: Role words on team pages, and words of a job title (fixed values).
TECHNICAL_ROLE = (
    r"(?iU)\b(developer|engineer|cto|programmer|architect|devops|sre|data\s+scientist|"
    r"desarrollador|ingenier[oa]|programador|tech\s+lead)\b"
)
JOB_TITLE = (
    r"(?iU)\b(manager|engineer|developer|coordinator|analyst|specialist|director|designer|associate|assistant|lead|"
    r"architect|consultant|representative|gerente|desarrollador|analista|coordinador|responsable)\b"
)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column | str) -> Column:
    """Array of a text's words; empty for null."""
    spaced = F.translate(_text(c), _WHITE_CHARS, " " * len(_WHITE_CHARS))  # one character is split at without a pattern
    return F.array_remove(F.split(spaced, " "), "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), f"^{WHITE}+|{WHITE}+$", "")


def collapse(c: Column | str) -> Column:
    """White space runs to one space, none at the ends."""
    return F.array_join(words(c), " ")


def content_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(_text(c), 256), 1, 16)


def stable_hash(c: Column | str) -> Column:
    """Hash of the multiset of words: the same for a text whose records were shuffled."""
    return F.substring(F.sha2(F.array_join(F.sort_array(words(c)), "\0"), 256), 1, 16)


def provenance_header(title: Column | str, kind: Column | str, published: Column | str) -> Column:
    """Title, kind and date, those there are, joined by a middle dot."""
    return F.concat_ws(" · ", *[F.nullif(x, F.lit("")) for x in (strip(title), _text(kind), _text(published))])


def is_list_line(c: Column) -> Column:
    return c.rlike(rf"^{WHITE}*([-*•]|\d+[.)]){WHITE}+")


def is_table_line(c: Column) -> Column:
    return c.rlike(rf"^{WHITE}*\|")


def is_atx_heading(c: Column) -> Column:
    return c.rlike(rf"^{WHITE}*#{{1,6}}{WHITE}+[^\t-\r\x1c-\x20\x85\xa0]")


def looks_like_heading(line: Column | str) -> Column:
    """Whether one line, alone, reads like a heading: a short run of mostly capitalised words without a stop."""
    s, w = strip(line), words(line)
    capitals = F.size(F.filter(w, lambda x: F.lower(F.substring(x, 1, 1)) != F.substring(x, 1, 1)))
    plain = (
        ~is_list_line(s) & ~is_table_line(s) & (F.length(s) <= HEADING_CHARS) & F.size(w).between(2, HEADING_WORDS)
        & ~s.rlike("[.!?:;,]$") & (capitals >= F.greatest(F.lit(1), F.floor(F.size(w) / 2)))
    )
    return (s != "") & (is_atx_heading(s) | plain)


def strip_reasoning(c: Column | str) -> Column:
    """A reply without its <think> passages, an unclosed one to the end."""
    return strip(F.regexp_replace(F.regexp_replace(_text(c), "(?s)<think>.*?</think>", ""), "(?s)<think>.*$", ""))


_PHRASE = INSUFFICIENT.rstrip(".").lower()


def is_decline(c: Column | str) -> Column:
    return F.lower(strip(c)).startswith(_PHRASE)


def decline_form(c: Column | str) -> Column:
    """starts, wrapped_start (after marks only), inside, or absent."""
    low = F.lower(strip(c))
    return (
        F.when(low.startswith(_PHRASE), "starts")
        .when(F.regexp_replace(low, r"(?U)^[\W_]+", "").startswith(_PHRASE), "wrapped_start")
        .when(low.contains(_PHRASE), "inside").otherwise("absent")
    )


#: A range of a citation is named number by number up to so many; the rest of a longer one is one entry, low-high.
_LONGEST_RANGE = 100_000


def citations(reply: Column | str, n_passages: Column | str) -> Column:
    """struct(passages sorted, signals, invalid in order of appearance) of [n], [n, m], [n-m] and [S].

    A bracket has at most 24 characters; other brackets are ignored. Of a range of more than
    100,000 numbers the rest is named as one invalid range.
    """
    n = F.col(n_passages) if isinstance(n_passages, str) else n_passages
    groups = F.regexp_extract_all(_text(reply), F.lit(r"\[([^\[\]]{1,24})\]"), F.lit(1))
    parts = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), strip)
    low = lambda p: F.regexp_extract(p, rf"^(\d+){WHITE}*-{WHITE}*(\d+)$", 1).try_cast("bigint")
    high = lambda p: F.regexp_extract(p, rf"^(\d+){WHITE}*-{WHITE}*(\d+)$", 2).try_cast("bigint")
    none = F.array().cast("array<string>")
    numbers = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(p.rlike(r"^\d+$"), F.array(p))
            .when(
                low(p).isNotNull() & high(p).isNotNull() & (low(p) <= high(p)),
                F.concat(
                    F.transform(F.sequence(low(p), F.least(high(p), low(p) + _LONGEST_RANGE)), lambda i: i.cast("string")),
                    F.when(high(p) - low(p) > _LONGEST_RANGE, F.array(F.concat((low(p) + _LONGEST_RANGE + 1).cast("string"), F.lit("-"), high(p).cast("string")))).otherwise(none),
                ),
            )
            .otherwise(none),
        )
    )
    valid = lambda p: F.coalesce(p.try_cast("bigint").between(1, n), F.lit(False))
    cited = F.array_sort(F.array_distinct(F.transform(F.filter(numbers, valid), lambda p: p.cast("bigint"))))
    return F.struct(
        cited.alias("passages"), F.exists(parts, lambda p: F.upper(p) == SIGNALS_MARK).alias("signals"),
        F.array_distinct(F.filter(numbers, lambda p: ~valid(p))).alias("invalid"),
    )


def answer_problems(reply: Column | str, cited: Column) -> Column:
    """Array of what is detectably wrong with a reply, given its citations()."""
    declined = is_decline(reply)
    nothing = (F.size(cited["passages"]) == 0) & ~cited["signals"]
    listed = F.array_join(F.transform(cited["invalid"], lambda c: F.concat(F.lit("["), c, F.lit("]"))), ", ")
    return F.array_compact(
        F.array(
            F.when(F.size(cited["invalid"]) > 0, F.concat(F.lit("cites passages that were not in the context: "), listed)),
            F.when(~declined & nothing, "makes claims without citing anything"),
            F.when(~declined & F.lower(_text(reply)).contains(INSUFFICIENT.lower()), "answers and declines in the same reply"),
        )
    )


def lexemes(c: Column | str) -> Column:
    """Lower-cased letter and digit runs, an approximation of a plain full-text index."""
    return F.filter(F.split(F.lower(_text(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def technical_mentions(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(TECHNICAL_ROLE))
