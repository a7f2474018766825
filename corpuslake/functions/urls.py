"""URL functions as Column expressions. They split by pattern, as Spark's own URL parser gives null for a URL with a space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.text import strip

#: Whole path segments that tell a page's kind (fixed values).
JOB_SEGMENT = r"^(careers?|jobs?|vacantes?|empleos?|join-us|trabaja[\w-]*)$"
BLOG_SEGMENT = r"^(blog|news|insights|posts?|articles?|noticias|novedades)$"
#: Parts of a path that name a team or an about page (fixed values).
TEAM_PATH = r"/(team|equipo|people|leadership|nosotros)"
ABOUT_PATH = r"/(about|about-us|company|quienes-somos|sobre-nosotros)"
#: Paths that list vacancies, names that are files and no vacancies, and a site's name after a separator at the end of a
#: title: what counts as a vacancy must be the same to compare counts (fixed values).
LISTING_PATH = r"(?i)^/(careers?|jobs?|empleos?|vacantes?|join-us|trabaja[\w-]*)/?$"
#: Paths worth following (fixed value).
WORTH_READING = (
    r"(?i)/(about|nosotros|quienes|team|equipo|people|careers?|jobs?|empleos?|blog|news|noticias|insights|"
    r"services?|servicios|products?|solutions?)"
)
NOT_A_ROLE = r"(?i)\.(xml|json|rss|atom|pdf|ics|txt)$"
TITLE_SUFFIX = r"\s*[·|»]\s*[^·|»]{1,40}$|\s+[—–]\s+[^—–]{1,40}$"
KINDS = ("website", "job_posting", "blog_post")

_ORIGIN = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?"


def _url(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def origin(c: Column | str) -> Column:
    """Scheme and host as written."""
    return F.regexp_extract(_url(c), _ORIGIN, 0)


def netloc(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_url(c), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path(c: Column | str) -> Column:
    return F.regexp_extract(_url(c), _ORIGIN + r"([^?#]*)", 3)


def normalise(c: Column | str) -> Column:
    """The crawler's form: no query, no fragment, no slash at the end; scheme and host untouched."""
    p = F.regexp_replace(path(c), "/+$", "")
    return F.concat(origin(c), F.when(p == "", "/").otherwise(p))


def normalise_for_evaluation(c: Column | str) -> Column:
    """Another form, for comparing sources: origin lower-cased, slashes at the end cut, query and fragment kept."""
    s = strip(c)
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)(.*)$"
    split = F.concat(F.lower(F.regexp_extract(s, pattern, 1)), F.regexp_replace(F.regexp_extract(s, pattern, 2), "/+$", ""))
    return F.when(s.rlike(pattern), split).otherwise(F.regexp_replace(s, "/+$", ""))


def page_kind(c: Column | str) -> Column:
    """job_posting if any whole path segment says so, else blog_post, else website."""
    segments = F.split(F.lower(path(c)), "/")
    return (
        F.when(F.exists(segments, lambda s: s.rlike(JOB_SEGMENT)), "job_posting")
        .when(F.exists(segments, lambda s: s.rlike(BLOG_SEGMENT)), "blog_post").otherwise("website")
    )


def on_team_path(c: Column | str) -> Column:
    return F.lower(path(c)).rlike(TEAM_PATH)


def on_about_path(c: Column | str) -> Column:
    return F.lower(path(c)).rlike(ABOUT_PATH)


def is_listing(c: Column | str) -> Column:
    return path(c).rlike(LISTING_PATH)


def is_file(c: Column | str) -> Column:
    return _url(c).rlike(NOT_A_ROLE)


def role_name(url: Column | str, title: Column | str) -> Column:
    """A role's name: the page title without the site's name, else the last path segment in words."""
    t = F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    slug = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    return strip(F.when(t != "", F.regexp_replace(t, TITLE_SUFFIX, "")).otherwise(F.translate(slug, "-_", "  ")))
