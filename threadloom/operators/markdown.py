"""Threads as Markdown.

A document is a sequence of parts of at most ``part_posts`` posts; read in part order they give the whole text. Grouping
by (tid, part) keeps every group bounded, and most threads are a single part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import clock, escape_markdown

PART_POSTS = 1000


def title_line(title: Column) -> Column:
    """Fixed format: heading and rule that open a document."""
    return F.concat(F.lit("## "), escape_markdown(title), F.lit("\n\n----\n\n"))


def entry_header(
    post_id: Column, floor: Column, position: Column, post_time: Column, uid: Column, username: Column,
    escape: bool = False,
) -> Column:
    """Fixed format: heading of a post. The main post's floor shows as 0; the user name is written as it is."""
    shown = F.when(position == 0, F.lit("0")).otherwise(floor)
    name = escape_markdown(username) if escape else username
    # A post without a time prints the zero time.
    return F.concat(
        F.lit('##### <span id="pid'), post_id, F.lit('">'), shown, F.lit(".["), position.cast("string"),
        F.lit("] \\<pid:"), post_id, F.lit("\\> "), F.coalesce(clock(post_time), F.lit("0001-01-01 00:00:00")),
        F.lit(" by UID:"), uid, F.lit("("), name, F.lit(")</span>"),
    )


def entry(header: Column, body: Column) -> Column:
    """Header and body; a post without content has its header only."""
    return F.concat(header, F.lit("\n\n"), F.when(body != "", F.concat(body, F.lit("\n\n"))).otherwise(""))


def footer(generated_at: Column | None, generator: str) -> Column:
    """Fixed format: rule, generator line, time line."""
    made = F.lit(f"---\n\n*本文档由 {generator} 自动生成*\n\n*生成时间: ")
    return F.concat(made, clock(generated_at), F.lit("*\n"))


def render_threads(
    threads: DataFrame,
    entries: DataFrame,
    generated_at: Column | None = None,
    generator: str = "threadloom",
    part_posts: int = PART_POSTS,
) -> DataFrame:
    """(tid, part, markdown) from threads (tid, title, last_position) and entries (tid, position, markdown).

    Title and footer join the stream as two more rows per thread, so nothing is joined to the posts and their text is
    shuffled once, by (tid, part). Without ``generated_at`` there is no footer.
    """
    part = lambda position: F.floor(position / part_posts).cast("bigint")
    rows = entries.select(
        "tid",
        part(F.col("position")).alias("part"),
        F.col("position").alias("at"),
        F.concat("markdown", F.lit("\n")).alias("md"),
    )
    opening = threads.select(
        "tid", F.lit(0).cast("bigint").alias("part"), F.lit(-1).cast("bigint").alias("at"),
        title_line(F.col("title")).alias("md"),
    )
    rows = rows.unionByName(opening)
    if generated_at is not None:
        rows = rows.unionByName(
            threads.select(
                "tid", part(F.col("last_position")).alias("part"), (F.col("last_position") + 1).alias("at"),
                footer(generated_at, generator).alias("md"),
            )
        )
    return rows.groupBy("tid", "part").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "md"))), lambda row: row["md"]), ""
        ).alias("markdown")
    )


def frames(threads: DataFrame, generated_at: Column | None = None, generator: str = "threadloom", part_posts: int = PART_POSTS) -> DataFrame:
    """``threads`` with a row for each document part: ``part``, ``opening`` (the title, on the first) and ``closing`` (the footer, on the last)."""
    last = F.floor(F.greatest(F.coalesce("last_position", F.lit(0)), F.lit(0)) / part_posts).cast("bigint")
    rows = threads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    closing = F.lit("") if generated_at is None else F.when(F.col("part") == last, footer(generated_at, generator)).otherwise("")
    return rows.withColumns({"opening": F.when(F.col("part") == 0, title_line(F.col("title"))).otherwise(""), "closing": closing})


def render_posts(posts: DataFrame, body: str = "content_md", carry: tuple[str, ...] = ()) -> DataFrame:
    """Posts with (tid, position, floor, post_id, post_time, author, body) to entries (tid, position, markdown), and columns to carry."""
    header = entry_header(
        F.col("post_id"), F.col("floor"), F.col("position"), F.col("post_time"),
        F.col("author.uid"), F.col("author.username"),
    )
    return posts.select("tid", "position", *carry, entry(header, F.col(body)).alias("markdown"))
