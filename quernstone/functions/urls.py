"""URL expressions: parts, normal form, corpus rules, official hosts. All built-in, so filters on them run before any UDF.

A null URL has null parts and is neither relevant nor official.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.config import OFFICIAL_DOMAINS, TRANSLATED_SOURCE, UrlRules

ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def origin(url: Column) -> Column:
    """Scheme and host in lower case; null if the URL isn't absolute."""
    found = F.concat(F.lower(F.regexp_extract(url, ABSOLUTE, 1)), F.lit("://"), F.lower(F.regexp_extract(url, ABSOLUTE, 2)))
    return F.when(url.rlike(ABSOLUTE), F.regexp_replace(found, "^(https://.*):443$|^(http://.*):80$", "$1$2"))


def host(url: Column) -> Column:
    return F.when(url.rlike(ABSOLUTE), F.regexp_replace(F.lower(F.regexp_extract(url, ABSOLUTE, 2)), "^[^@]*@|:[0-9]*$", ""))


def path(url: Column) -> Column:
    """The path, ``/`` if empty; a relative URL's own path, taken from the root."""
    own = F.when(url.rlike(ABSOLUTE), F.regexp_extract(url, ABSOLUTE, 3)).otherwise(F.regexp_extract(url, "^([^?#]*)", 1))
    return F.when(own.startswith("/"), own).otherwise(F.concat(F.lit("/"), own))


def normalize_url(url: Column, base: Column | str) -> Column:
    """Origin and path on ``base``; no query, fragment, double or trailing slash; null on another origin or scheme."""
    base = F.lit(base) if isinstance(base, str) else base
    one = F.regexp_replace(path(url), "/{2,}", "/")
    ours = F.when(url.rlike(ABSOLUTE), origin(url) == base).otherwise(~url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^//"))
    return F.when(ours, F.concat(base, F.when(F.length(one) > 1, F.regexp_replace(one, "/$", "")).otherwise(one)))


def under(p: Column, prefixes: tuple[str, ...]) -> Column:
    """The path is one of ``prefixes`` or lies below it."""
    return reduce(lambda a, b: a | b, [(p == x) | p.startswith(f"{x}/") for x in prefixes], F.lit(False))


def is_relevant(url: Column, rules: UrlRules = UrlRules(), disallowed: tuple[str, ...] = ()) -> Column:
    """Whether a URL belongs to the corpus; a robots rule is a plain prefix."""
    return F.element_at(F.transform(F.array(path(normalize_url(url, rules.origin))), lambda p: _relevant_path(p, rules, disallowed)), 1)  # so that the path is worked out once


def _relevant_path(p: Column, rules: UrlRules, disallowed: tuple[str, ...]) -> Column:
    files = p.rlike(rf"(?i)\.({'|'.join(map(re.escape, rules.exclude_extensions))})$")
    robots = reduce(lambda a, b: a | b, [p.startswith(x) for x in disallowed if x], F.lit(False))
    out = files | p.isin(list(rules.exclude_exact)) | robots | under(p, rules.exclude_prefixes)
    return F.coalesce(~out & (p.isin(list(rules.include_exact)) | under(p, rules.include_prefixes)), F.lit(False))


def is_official(url: Column, domains: tuple[str, ...] = OFFICIAL_DOMAINS) -> Column:
    h = host(url)
    return F.coalesce(reduce(lambda a, b: a | b, [(h == d) | h.endswith(f".{d}") for d in domains]), F.lit(False))


def is_translated_source(url: Column) -> Column:
    return F.coalesce(path(url).rlike(TRANSLATED_SOURCE), F.lit(False))


def canonical_source(url: Column) -> Column:
    """Origin and path without a trailing slash."""
    return F.regexp_replace(F.concat(origin(url), path(url)), "/$", "")


def client_address(forwarded: Column, remote: Column) -> Column:
    """The first forwarded address, else the peer's."""
    first = F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    return F.when(first != "", first).otherwise(F.coalesce(remote, F.lit("unknown")))
