"""Parsed pages to posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import SPACE, body_trim, post_time

# The expressions below read a post element ``p`` of the parser's ``posts`` array.

# Cell id, else content id, else the fragment of the first link that has one. A prefix goes once.
_POST_ID = r"""CASE WHEN p.td_id <> '' THEN regexp_replace(p.td_id, '^td_', '')
  WHEN p.read_id <> '' THEN regexp_replace(p.read_id, '^read_', '')
  WHEN contains(p.hash_href, '#') THEN substring_index(p.hash_href, '#', -1) ELSE '' END"""


def _trimmed(text: str) -> str:
    return rf"regexp_replace({text}, r'^{SPACE}+|{SPACE}+\z', '')"


def _first_in_infos(pattern: str) -> str:
    """Group 1 of the first author line that matches, '' if none does."""
    return rf"coalesce(get(filter(transform(p.infos, x -> regexp_extract(x, r'{pattern}', 1)), x -> x <> ''), 0), '')"


_WS = r"[\t\n\f\r ]*"
# Fixed patterns: how the author block words its fields. A post count of 0 counts as not given.
_COUNTS = rf"transform(p.infos, x -> try_cast(regexp_extract(x, r'发帖:{_WS}([0-9]+)', 1) AS INT))"
_AUTHOR = rf"""named_struct(
  'username', {_trimmed("CASE WHEN p.has_user_link_strong THEN p.user_link_strong ELSE p.any_strong END")},
  'uid', coalesce(nullif(regexp_extract(p.user_href, r'uid[=-]([0-9]+)', 1), ''), {_first_in_infos(f"UID:{_WS}([0-9]+)")}),
  'avatar', p.avatar_src,
  'post_count', coalesce(get(filter({_COUNTS}, n -> n <> 0), 0), 0),
  'register_date', {_first_in_infos(f"注册时间:{_WS}([0-9-]+)")},
  'last_login', {_first_in_infos(f"最后登录:{_WS}([0-9-]+)")},
  'signature', regexp_replace(regexp_replace({_trimmed("p.sign_text")}, '^（', ''), r'）\z', ''))"""


def floor_label(i: Column) -> Column:
    return F.when(i == 0, F.lit("GF")).otherwise(F.concat(F.lit("B"), i.cast("string"), F.lit("F")))


def extract_posts(parsed: DataFrame, fallback_ts: Column, carry: list[str] | None = None) -> DataFrame:
    """One row per post table of a page: ord, floor, post_id, post_time, author, content_html, content_md.

    Floor labels restart on each page; ``fallback_ts`` stands in for times that cannot be read.
    """
    carry = ["tid", "page"] if carry is None else carry
    rows = parsed.select(*carry, F.explode("posts").alias("p"))
    ord_ = F.col("p.ord").cast("bigint")
    return rows.select(
        *carry,
        ord_.alias("ord"),
        floor_label(ord_).alias("floor"),
        F.expr(_POST_ID).alias("post_id"),
        post_time(F.col("p.time_text"), fallback_ts).alias("post_time"),
        F.expr(_AUTHOR).alias("author"),
        body_trim(F.col("p.content_html")).alias("content_html"),
        F.col("p.content_md").alias("content_md"),
    )
