"""String and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space when whole strings are trimmed, and when a content body is.
SPACE = r"[\s\x{0B}\x{85}\x{A0}\p{Z}]"
BODY_SPACE = " \n\r\t"

# Fixed value: characters that get a backslash in titles.
_MARKDOWN_SPECIAL = r"([\\`*_{}\[\]()#+\-.!|])"


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def unicode_fields(text: Column) -> Column:
    """Split on runs of white space, without empty first or last parts."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda part: part != "")


def body_trim(text: Column) -> Column:
    return F.trim(text, F.lit(BODY_SPACE))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, _MARKDOWN_SPECIAL, r"\\$1")


# The formats of post times. Seconds may carry a fraction.
TIME_FORMATS = ("yyyy-M-d H:mm:ss", "yyyy-M-d H:mm:ss[.SSSSSS][.SSS]", "yyyy-M-d H:mm")


def post_time(text: Column, fallback: Column) -> Column:
    """Read a post time. NULL stays NULL; an unreadable text becomes ``fallback``; a year 0 gets the fallback's year."""
    trimmed = unicode_trim(text)
    # Time parsing knows no year 0, so such a text is read with the year already replaced.
    dated = F.when(trimmed.startswith("0000-"), F.concat(F.date_format(fallback, "yyyy"), F.substr(trimmed, F.lit(5)))).otherwise(trimmed)
    parsed = F.coalesce(*[F.try_to_timestamp(dated, F.lit(form)) for form in TIME_FORMATS])
    return F.when(text.isNotNull(), F.coalesce(parsed, fallback))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
