"""Keys, hosts and dates of articles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import non_empty

#: Public suffixes of two labels that the fallback rule knows; a full list can be joined in instead.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.au", "gov.uk", "net.au", "org.au", "org.uk")


def item_key(url: Column) -> Column:
    """The md5 of the URL in hexadecimal."""
    return F.md5(url.cast("string"))


def netloc(url: Column) -> Column:
    """What stands between ``//`` and the path, with user and port."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def registered_domain(url: Column) -> Column:
    """The last labels of the host by a suffix rule; ``unknown`` if there is no host."""
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), ":\\d*$", ""))
    labels = F.split(host, "\\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    three = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3))
    numeric = F.rlike(host, F.lit("^[0-9.]+$"))
    return F.when(host == "", F.lit("unknown")).when(numeric, host).when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def entry_url(link: Column, ident: Column) -> Column:
    return F.coalesce(non_empty(link), non_empty(ident), F.lit(""))


def parsed_time(text: Column) -> Column:
    """An ISO-8601 or RFC-822 time, null if neither; without a zone it is UTC (the session's zone must be UTC)."""
    plain = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9},?\\s+", "")
    zone = F.regexp_replace(F.regexp_replace(plain, "\\s+(GMT|UTC|UT|Z)$", " +0000"), "\\s+", " ")
    return F.coalesce(
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm Z")),
        F.when(F.rlike(text, F.lit("^\\s*\\d{4}-\\d{2}-\\d{2}")), F.try_to_timestamp(F.trim(text))),
    )


def published(first: Column, second: Column, third: Column, as_of: Column) -> Column:
    """The first of three dates that parses, else ``as_of``."""
    return F.coalesce(parsed_time(first), parsed_time(second), parsed_time(third), as_of)


def is_recent(when: Column, as_of: Column, days: int = 3) -> Column:
    return when >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")
