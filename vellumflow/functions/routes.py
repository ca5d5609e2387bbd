"""Which page of a portal an address is of. Portal and routes are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_route(url: Column, route: str) -> Column:
    """Whether an address holds the path ``route`` with nothing or a query after it, whatever the case."""
    return F.coalesce(url.rlike(r"(?i)\Q" + route + r"\E(?:\?|$)"), F.lit(False))


def origin(url: Column) -> Column:
    """Scheme, host and port of an http address in lower case, without the port that the scheme implies; null of others."""
    found = F.regexp_extract(F.lower(url), r"^(https?://)(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?", 0)
    plain = F.regexp_replace(F.regexp_replace(found, r"//[^/?#@]*@", "//"), r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.nullif(plain, F.lit(""))


def at_portal(url: Column, portal: str) -> Column:
    """Whether an address has the origin of ``portal``."""
    return F.coalesce(origin(url) == origin(F.lit(portal)), F.lit(False))


def on_host(url: Column, host: str) -> Column:
    """Whether an address is of ``host``, whatever the scheme."""
    return F.coalesce(F.regexp_replace(origin(url), "^https?://", "") == host.lower(), F.lit(False))
