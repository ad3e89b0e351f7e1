"""URL expressions: hash, domain, safety check, relative resolution, link lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _c

# scheme per RFC 3986 (letter first); "//" authority up to the next / ? #
_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"
AUTHORITY_RX = r"^(?:" + _SCHEME + r":)?//([^/?#]*)"
SCHEME_RX = r"^(" + _SCHEME + r"):"


def url_hash(url) -> Column:
    """md5 hex of the UTF-8 url (the article id)."""
    return F.md5(_c(url))


def url_domain(url) -> Column:
    """Network location including port and user info; '' when there is none."""
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), AUTHORITY_RX, 1)


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(_c(url), F.lit("")), SCHEME_RX, 1))


def safe_url(url) -> Column:
    """Keep http(s) URLs that have a host, else '#'."""
    u = _c(url)
    ok = url_scheme(u).isin("http", "https") & (url_domain(u) != "")
    return F.when(ok, u).otherwise(F.lit("#"))


def dir_name_trim(name) -> Column:
    return F.regexp_replace(_c(name), r"/+$", "")


def file_name(href) -> Column:
    """Last path segment of a link."""
    return F.element_at(F.split(_c(href), "/"), -1)


def fold_dots(url) -> Column:
    """``.`` and ``..`` segments of a URL's path folded as a browser does."""
    u = _c(url)
    origin = F.regexp_extract(u, r"^(" + _SCHEME + r"://[^/?#]*)", 1)
    path = F.regexp_extract(u, r"^" + _SCHEME + r"://[^/?#]*(/[^?#]*)", 1)
    rest = F.regexp_extract(u, r"^[^?#]*([?#].*)$", 1)
    ends = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    folded = F.aggregate(
        F.filter(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), lambda s: s != "."),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    whole = F.concat(origin, F.lit("/"), F.array_join(folded, "/"), F.when(F.size(folded) > 0, ends).otherwise(F.lit("")), rest)
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), whole).otherwise(u)


def resolve_url(base, href) -> Column:
    """Join a link to its page URL: absolute, scheme-relative, root-relative, or relative to the base folder; dots folded."""
    b = _c(base)
    h = _c(href)
    scheme = F.regexp_extract(b, SCHEME_RX, 1)
    origin = F.regexp_extract(b, r"^(" + _SCHEME + r"://[^/?#]*)", 1)
    folder = F.regexp_extract(b, r"^(" + _SCHEME + r"://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(h.isNull() | (h == ""), b)
        .when(h.rlike(SCHEME_RX), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), fold_dots(F.concat(origin, h)))
        .when(h.startswith("?") | h.startswith("#"), F.concat(F.regexp_extract(b, r"^([^?#]*)", 1), h))
        .otherwise(fold_dots(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), h)))
    )


def attribute(tag, name: str) -> Column:
    """An attribute's value in a tag: double-quoted, single-quoted or bare, entities decoded; null if absent.

    The pattern passes over the attributes before it, so nothing inside their values counts.
    """
    from .text import decode_entities

    value = r"""("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
    other = r"""(?:[\s/]++(?!""" + name + r"""[\s=])[^\s=>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+"""
    raw = F.regexp_extract(_c(tag), r"(?is)^<[a-z][^\s/>]*+" + other + r"[\s/]++" + name + r"\s*+=\s*+" + value, 1)
    bare = F.when(F.substring(raw, 1, 1).isin('"', "'"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(raw != "", decode_entities(bare))


def href_list(html) -> Column:
    """All ``<a href>`` values of a page in document order; links in comments and scripts don't count."""
    from .text import markup

    return F.filter(F.transform(markup(html, "a"), lambda tag: attribute(tag, "href")), lambda v: v.isNotNull())
