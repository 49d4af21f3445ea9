"""Pages of many threads to threads, posts and completeness reports.

A thread is never built as one nested value: its header is one row, its posts are rows with a position, and lists come
in blocks. One huge thread is then no different from many small ones.

``pages`` below are with_page_fields() rows, unique by (tid, page). What is worked out about pages goes through a small
index first; post contents are read once, and moved once, when the index is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import post_time
from threadloom.operators.posts import extract_posts, floor_label
from threadloom.operators.spread import PAGE_BLOCK, lookup, running_offsets
from threadloom.session import written

LIST_BLOCK = 1000


def _planned(pages: DataFrame) -> DataFrame:
    """(tid, planned, has_first) as page 1 states them; one row per thread that has a page 1."""
    return pages.where(F.col("page") == 1).select(
        "tid", F.col("total_pages").alias("planned"), F.col("error").isNull().alias("has_first")
    )


def _page_block() -> Column:
    return F.floor(F.col("page") / PAGE_BLOCK)


def thread_checks(pages: DataFrame) -> DataFrame:
    """(tid, total_pages, n_present, n_missing, has_first, first_present), counting only pages up to the count page 1 states.

    A thread without page 1 states none; its last page stands in, and ``has_first`` is false.
    """
    rows = lookup(pages.select("tid", "page"), _planned(pages), ["tid"], _page_block(), "left")
    return (
        rows.where(F.col("planned").isNull() | (F.col("page") <= F.col("planned")))
        .groupBy("tid")
        .agg(
            F.coalesce(F.max("planned"), F.max("page")).alias("total_pages"),
            F.count(F.lit(1)).alias("n_present"),
            F.coalesce(F.bool_or("has_first"), F.lit(False)).alias("has_first"),
            (F.count("planned") > 0).alias("first_present"),
        )
        .select("tid", "total_pages", "n_present", (F.col("total_pages") - F.col("n_present")).alias("n_missing"), "has_first", "first_present")
    )


def page_completeness(checks: DataFrame, strict: bool = True) -> DataFrame:
    """thread_checks() rows with ``accepted``: strict refuses any missing page, lenient only a missing first one."""
    complete = F.col("n_missing") == 0 if strict else F.lit(True)
    return checks.select("tid", "total_pages", "n_present", "n_missing", (F.col("has_first") & complete).alias("accepted"))


def rejected_threads(checks: DataFrame, strict: bool = True) -> DataFrame:
    """Threads that page_completeness() does not accept, and why: (tid, reason, total_pages, n_missing)."""
    reason = (
        F.when(~F.col("first_present"), "first page absent")
        .when(~F.col("has_first"), "first page in error")
        .when(F.lit(strict) & (F.col("n_missing") > 0), "pages missing")
    )
    return checks.withColumn("reason", reason).where("reason IS NOT NULL").select("tid", "reason", "total_pages", "n_missing")


def page_index(
    pages: DataFrame, strict: bool = True, mode: str = "reference", repeats_main_post: bool = True, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(tid, page, skipped, kept, offset) of the pages that go into threads; reads no post contents.

    A thread whose page 1 is absent or in error is left out; a later page without a post table is passed over, and so
    are pages beyond page 1's count. With ``strict``, a thread that lacks one of its pages is left out.
    ``skipped`` posts at the start of the page are no posts of the thread, ``kept`` are, and ``offset`` counts the kept
    ones on earlier pages.

    ``mode='reference'`` takes the first table of page 1 as the main post and drops the first table of every later page;
    ``mode='continuous'`` drops it only if pages repeat the main post.
    """
    if mode not in ("reference", "continuous"):
        raise ValueError(mode)
    drops_first = mode == "reference" or repeats_main_post
    skipped = F.when(F.col("page") == 1, 0).otherwise(1 if drops_first else 0)
    light = pages.select(
        "tid", "page", *carry, "n_posts", skipped.alias("skipped"),
        F.greatest(F.col("n_posts") - skipped, F.lit(0)).cast("bigint").alias("kept"),
    )
    rows = lookup(light, _planned(pages).where("has_first"), ["tid"], _page_block()).where(F.col("page") <= F.col("planned"))
    placed = running_offsets(rows, "tid", "page", "kept", count="n_present")
    if strict:
        placed = placed.where(F.col("n_present") == F.col("planned"))
    return placed.where(F.col("n_posts") > 0).select("tid", "page", *carry, "skipped", "kept", "offset")


def _on(pages: DataFrame, index: DataFrame) -> list[str]:
    return [c for c in ("tid", "page", "gen") if c in pages.columns and c in index.columns]


def assemble_posts(pages: DataFrame, index: DataFrame, fallback_ts: Column, mode: str = "reference") -> DataFrame:
    """Posts of each thread with their position in it; position 0 is the main post.

    Floor labels restart on each page in reference mode and number the thread in continuous mode. Keys of the join are
    unique on both sides, and an index partition is tiny beside its pages, so it is hashed and page contents are not sorted.
    """
    joined = pages.join(index, _on(pages, index))
    posts = extract_posts(joined, fallback_ts, ["tid", "page", "skipped", "offset"]).where(F.col("ord") >= F.col("skipped"))
    placed = posts.withColumn("position", F.col("offset") + F.col("ord") - F.col("skipped"))
    if mode == "continuous":
        placed = placed.withColumn("floor", floor_label(F.col("position")))
    return placed.select(
        "tid", "position", "page", "floor", "post_id", "post_time", "author", "content_html", "content_md"
    )


def assemble_threads(pages: DataFrame, index: DataFrame, fallback_ts: Column) -> DataFrame:
    """One header row per thread: title, forum and URL of page 1, time of the main post, number of floors."""
    on = _on(pages, index)
    heads = (
        pages.where(F.col("page") == 1)
        .select(*on, "title", F.col("base_url").alias("url"), "forum", post_time(F.col("first_time_text"), fallback_ts).alias("created_at"))
        .join(index.select(*on), on, "left_semi")
    )
    floors = index.groupBy("tid").agg(F.sum("kept").alias("total_floors"))
    return heads.join(floors, "tid").select(
        "tid", "title", "url", "forum", "total_floors", (F.col("total_floors") - 1).alias("last_position"), "created_at"
    )


def assemble(
    pages: DataFrame, fallback_ts: Column, strict: bool = True, mode: str = "reference", repeats_main_post: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(threads, posts) of ``pages``, which should be a written table when it comes from a parse."""
    index = written(page_index(pages, strict, mode, repeats_main_post), "page-index")
    return assemble_threads(pages, index, fallback_ts), assemble_posts(pages, index, fallback_ts, mode)


def missing_pages(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Planned pages that are not there."""
    return plan.join(pages.select("tid", "page"), ["tid", "page"], "left_anti")


def missing_page_lists(missing: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """Sorted page numbers per thread, one array for each ``block`` page numbers."""
    return (
        missing.groupBy("tid", F.floor((F.col("page") - 1) / block).cast("bigint").alias("block"))
        .agg(F.sort_array(F.collect_list("page")).alias("missing"))
    )


def reply_blocks(posts: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """Replies nested as arrays of at most ``block`` posts: (tid, block, replies)."""
    reply = F.struct("position", "floor", "post_id", "post_time", "author", "content_html")
    return (
        posts.where(F.col("position") > 0)
        .groupBy("tid", F.floor((F.col("position") - 1) / block).cast("bigint").alias("block"))
        .agg(F.array_sort(F.collect_list(reply)).alias("replies"))
    )
