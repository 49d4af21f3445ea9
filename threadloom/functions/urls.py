"""URL parts by the same rules for every caller: no re-ordering, no lower-casing of hosts, ports kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host_port(url: Column) -> Column:
    """Host with its port, without user information."""
    return F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"^.*@", "")


def decoded_path(url: Column) -> Column:
    """Percent-decoded path; NULL if an escape is malformed."""
    raw = F.regexp_extract(url, _PATH, 1)
    return F.when(~raw.contains("%"), raw).otherwise(
        F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    )


def is_remote(url: Column) -> Column:
    """Absolute URL whose scheme starts with http."""
    malformed = url.rlike(r"[\x00-\x1f\x7f]") | F.regexp_extract(url, _PATH, 1).rlike(r"%(?![0-9A-Fa-f]{2})")
    return url.rlike(r"^(?i)http[a-z0-9+.\-]*:") & ~malformed


def extension(url: Column) -> Column:
    """Last dot suffix of the raw URL, query string included."""
    return F.regexp_extract(url, r"(\.[^./]*)\z", 1)
