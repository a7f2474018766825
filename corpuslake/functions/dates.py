"""Publication dates by evidence: the URL, declared metadata, a byline; else none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.urls import path

#: How much of a text may hold a byline, and how far before the date its cue may stand.
HEAD, CUE_WINDOW = 400, 24
SOURCES = ("url_path", "metadata", "byline", "none")
#: Which dates count in a URL and in a text, and which words announce one (fixed values).
_URL_DATE = r"/(20[12]\d)[/-](\d{1,2})[/-](\d{1,2})(?:[/-]|$)"
_NUMERIC = r"\b(20[12]\d)[-/](\d{1,2})[-/](\d{1,2})\b"
_CUE = r"(?i)(post|publish|updat|writ|releas)\w*\s*(on|at|:)?\s*$"
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
#: The parts of a date that is written out, and the two orders in which they stand.
_PARTS = {"month": rf"({'|'.join(_MONTHS)})[a-z]*\.?", "day": r"(\d{1,2})(?:st|nd|rd|th)?", "year": r"(20[12]\d)"}
_ORDERS = (("month", "day", "year"), ("day", "month", "year"))


def iso(year: Column, month: Column, day: Column) -> Column:
    """The date as yyyy-mm-dd, or null if the calendar has no such day."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def from_url(url: Column | str) -> Column:
    p = path(url)
    part = [F.regexp_extract(p, _URL_DATE, i) for i in (1, 2, 3)]
    return F.when(p.rlike(_URL_DATE), iso(*part))


def from_byline(text: Column | str) -> Column:
    """A date near the top that a publication cue stands before: the first numeric one, else the first written out."""
    t = F.col(text) if isinstance(text, str) else text
    head = F.substring(F.coalesce(t, F.lit("")), 1, HEAD)

    def found(pattern: str, order: tuple[str, ...]) -> Column:
        """struct(at, cued, day) of the first match; null if there is none."""
        before = F.element_at(F.split(head, pattern, 2), 1)
        part = {name: F.regexp_extract(head, pattern, i + 1) for i, name in enumerate(order)}
        names = F.create_map(*[F.lit(x) for m, n in _MONTHS.items() for x in (m, str(n))])
        month = F.coalesce(names[F.lower(part["month"])], part["month"])
        cued = F.substring(before, -CUE_WINDOW, CUE_WINDOW).rlike(_CUE)
        return F.when(head.rlike(pattern), F.struct(F.length(before).alias("at"), cued.alias("cued"), iso(part["year"], month, part["day"]).alias("day")))

    def written(order: tuple[str, ...]) -> str:
        # a comma may stand before the year, and nowhere else
        return r"(?i)\b" + rf"{_PARTS[order[0]]}\s+{_PARTS[order[1]]},?\s+{_PARTS[order[2]]}" + r"\b"

    numeric = found(_NUMERIC, ("year", "month", "day"))
    worded = F.array_min(F.array_compact(F.array(*[found(written(o), o) for o in _ORDERS])))  # the one that stands first
    return F.when(numeric["cued"], numeric["day"]).when(worded["cued"], worded["day"])


def published(url: Column | str, declared: Column | str, text: Column | str) -> Column:
    """struct(date, source): the best evidence there is. declared: the metadata's date, see operators.html."""
    d = F.col(declared) if isinstance(declared, str) else declared
    found = [from_url(url), F.nullif(d, F.lit("")), from_byline(text)]
    source = F.lit(SOURCES[-1])
    for name, value in reversed(list(zip(SOURCES, found))):
        source = F.when(value.isNotNull(), name).otherwise(source)
    return F.struct(F.coalesce(*found).alias("date"), source.alias("source"))


def parse_published(value: Column | str) -> Column:
    """The stored date of an artifact's published string: its first ten characters if they are a day, else null."""
    v = F.col(value) if isinstance(value, str) else value
    day = F.substring(v, 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
