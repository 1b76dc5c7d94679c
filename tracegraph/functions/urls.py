"""URL column functions.

``parse_url`` rejects hosts with ``_`` and paths with blanks, so the parts are
taken with the generic-syntax regular expressions instead.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracegraph.functions.fixed import TWO_LABEL_SUFFIXES
from tracegraph.functions.text import count_char

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
NETLOC_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY_RE = r"^[^?#]*\?([^#]*)"
IP_RE = r"^\d{1,3}(\.\d{1,3}){3}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), SCHEME_RE, 1))


def netloc(url) -> Column:
    return F.regexp_extract(_col(url), NETLOC_RE, 1)


def path(url) -> Column:
    return F.regexp_extract(_col(url), PATH_RE, 1)


def query(url) -> Column:
    return F.regexp_extract(_col(url), QUERY_RE, 1)


def domain_of(url) -> Column:
    """Network location before the port, lower-cased; empty when there is none."""
    return F.lower(F.split_part(netloc(url), F.lit(":"), F.lit(1)))


def hostname(url) -> Column:
    """Like domain_of but without user information."""
    return F.regexp_replace(F.lower(F.regexp_replace(netloc(url), r"^.*@", "")), r":\d*$", "")


def domain_or_path(url) -> Column:
    loc = netloc(url)
    return F.lower(F.split_part(F.when(loc != "", loc).otherwise(path(url)), F.lit(":"), F.lit(1)))


def num_params(url, parsed: bool = False) -> Column:
    """Distinct query keys that carry a non-blank value, of a URL or of a query string."""
    kept = F.filter(F.split(_col(url) if parsed else query(url), "&"), lambda p: p.rlike("^[^=]*=.+"))
    return F.size(F.array_distinct(F.transform(kept, lambda p: F.split_part(p, F.lit("="), F.lit(1)))))


def tld_of(domain) -> Column:
    d = _col(domain)
    return F.when(F.instr(d, ".") > 0, F.substring_index(d, ".", -1)).otherwise(F.lit(""))


def suffix_of(domain) -> Column:
    """Public suffix by the longest match: a listed two-label suffix or the last label."""
    d = _col(domain)
    two = F.substring_index(d, ".", -2)
    return (
        F.when(d.rlike(IP_RE) | (F.instr(d, ".") == 0), F.lit(""))
        .when(two.isin(TWO_LABEL_SUFFIXES) & (count_char(d, ".") >= 2), two)
        .otherwise(F.substring_index(d, ".", -1))
    )


def sld_of(domain) -> Column:
    """The label in front of the public suffix (the whole text when there is none)."""
    d = _col(domain)
    s = suffix_of(d)
    head = F.substring(d, F.lit(1), F.length(d) - F.length(s) - 1)
    return F.when(s == "", d).otherwise(F.substring_index(head, ".", -1))


def registered_of(domain) -> Column:
    d = _col(domain)
    s = suffix_of(d)
    return F.when(s == "", F.lit("")).otherwise(F.concat(sld_of(d), F.lit("."), s))


def subdomain_of(domain) -> Column:
    d = _col(domain)
    cut = F.length(d) - F.length(registered_of(d)) - 1
    return F.when((suffix_of(d) == "") | (cut <= 0), F.lit("")).otherwise(F.substring(d, F.lit(1), cut))
