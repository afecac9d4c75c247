"""URL column functions.

URL parts are cut by regular expressions that follow the generic URI syntax
(``scheme://netloc/path?query#fragment``) the way Python's ``urlparse`` does:
the netloc keeps port and user-info, the scheme is lower-cased, and the last
path segment loses its ``;params``.  Regexes stay inside whole-stage codegen
and, unlike ``parse_url``, still answer for URLs with spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"

# Fixed values that must match the reference behaviour.
PAGINATED_URL_PATTERN = r"page[-=/]?\d+"      # URL is part of a numbered series
PAGINATION_LINK_PATTERN = r"page[-=]\d+"      # link inside a page points to a numbered page
PAGE_NUMBER_PATTERN = r"(page[-=/]?)(\d+)"    # group 2 is the page number
ENCODED_CHAR_PATTERN = r"%[0-9A-F]{2}"        # upper-case percent escapes only


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _SCHEME, 1))


def netloc(url) -> Column:
    """P1 ``get_domain``: network location including port and user-info."""
    return F.regexp_extract(_c(url), _NETLOC, 1)


def path(url) -> Column:
    """Path without query/fragment and without ``;params`` of the last segment."""
    p = F.regexp_extract(_c(url), _PATH, 1)
    return F.regexp_replace(p, r";[^/]*$", "")


def host_last_label(url) -> Column:
    return F.substring_index(netloc(url), ".", -1)


def is_well_formed(url) -> Column:
    """scheme and netloc both present."""
    u = _c(url)
    return F.coalesce((scheme(u) != "") & (netloc(u) != ""), F.lit(False))


def strip_encoded(url) -> Column:
    """P3 ``remove_encoded_chars``."""
    return F.regexp_replace(_c(url), ENCODED_CHAR_PATTERN, "")


def screenshot_filename(url) -> Column:
    """P2 ``generate_filename``: ``<netloc with _>_<last part>_<md5(path)[:8]>.png``."""
    u = _c(url)
    p = F.regexp_replace(path(u), "/+$", "")
    last = F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", -1)).otherwise(F.lit("index"))
    return F.concat(F.replace(netloc(u), F.lit("."), F.lit("_")), F.lit("_"), last, F.lit("_"),
                    F.substring(F.md5(p), 1, 8), F.lit(".png"))


def base_name(p) -> Column:
    """P25: last path part of a file name."""
    return F.substring_index(_c(p), "/", -1)


def is_paginated(url) -> Column:
    """The URL belongs to a numbered page series."""
    return F.coalesce(_c(url).rlike(PAGINATED_URL_PATTERN), F.lit(False))


def page_number(s) -> Column:
    """Page number of the first ``page<sep><n>`` match, null when none."""
    n = F.regexp_extract(_c(s), PAGE_NUMBER_PATTERN, 2)
    return F.when(n != "", n.try_cast("long"))


def resolve(base, link) -> Column:
    """P11 ``urljoin(base, link)``.

    Absolute and ``//host`` links are kept as they are, ``?q`` and ``#f`` replace the tail; of all
    others the path is joined to the base's folder (``/path``: to the host) and its dot segments are
    resolved, however many there are.  A link's query and fragment take no part in that.
    """
    b, l = _c(base), _c(link)
    sch, net = scheme(b), netloc(b)
    origin = F.concat(sch, F.lit("://"), net)
    bpath = path(b)
    bdir = F.regexp_replace(bpath, r"[^/]*$", "")
    bquery = F.regexp_extract(b, r"^[^?#]*(\?[^#]*)?", 1)
    lpath = F.regexp_extract(l, r"^[^?#]*", 0)
    ltail = F.regexp_replace(l, r"^[^?#]*", "")
    full = F.when(l.startswith("/"), lpath).otherwise(F.concat(F.when(bdir == "", F.lit("/")).otherwise(bdir), lpath))
    return (
        F.when(l.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), l)
        .when(l.startswith("//"), F.concat(sch, F.lit(":"), l))
        .when(l.startswith("?"), F.concat(origin, bpath, l))
        .when(l.startswith("#"), F.concat(origin, bpath, bquery, l))
        .when(l == "", b)
        .otherwise(F.concat(origin, _remove_dot_segments(full, l.startswith("/")), ltail))
    )


def _remove_dot_segments(p: Column, keep_empty: Column) -> Column:
    """A fold over the segments of an absolute path: ``..`` drops the one before, ``.`` goes, and so do
    empty ones unless ``keep_empty``."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)
    inner = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: keep_empty | (s != ""))

    def step(done, s):
        return (F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
                .when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    kept = F.aggregate(F.concat(inner, F.array(last)), F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))
