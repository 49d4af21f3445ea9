"""Posts with their cached links as Markdown documents, in one move of the post texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.links import (
    SHARE_MARK, annotate_share_links, image_links, link_rows, resolve_links, rewrite_image_links, share_links,
)
from threadloom.operators.markdown import PART_POSTS, frames, render_posts
from threadloom.operators.spread import lookup
from threadloom.session import written


def link_targets(posts: DataFrame, threads: DataFrame, images: DataFrame, shares: DataFrame, body: str = "content_md", part_posts: int = PART_POSTS) -> DataFrame:
    """(tid, gen, part, _images, _shares): maps from URL to target for all links of a document part that have one.

    Bounded by the links of ``part_posts`` posts. Texts are read for their links only, which are written as a small table.
    """
    may_link = F.col(body).contains("![") | F.col(body).contains(SHARE_MARK)
    found = posts.where(may_link).select(
        "tid", "gen", "position", image_links(F.col(body)).alias("images"), share_links(F.col(body)).alias("shares")
    )
    found = written(lookup(found, threads.select("tid", "gen"), ["tid", "gen"], F.floor(F.col("position") / 100_000)), "links")
    pictures = resolve_links(link_rows(found, F.col("images")), images, "inner").withColumnRenamed("local", "image")
    shared = resolve_links(link_rows(found, F.col("shares")), shares, "inner").withColumnRenamed("local_dir", "share")
    part = F.floor(F.col("position") / part_posts).cast("bigint").alias("part")
    hits = pictures.unionByName(shared, allowMissingColumns=True).select("tid", part, "url", "image", "share").distinct()

    def mapped(target: str) -> Column:
        pairs = F.collect_list(F.when(F.col(target).isNotNull(), F.struct("url", target)))
        return F.when(F.count(target) > 0, F.map_from_entries(pairs))

    return hits.groupBy("tid", "part").agg(mapped("image").alias("_images"), mapped("share").alias("_shares"))


def render_localised(
    threads: DataFrame, posts: DataFrame, images: DataFrame, shares: DataFrame, generated_at: Column | None = None,
    generator: str = "threadloom", body: str = "content_md", part_posts: int = PART_POSTS,
) -> DataFrame:
    """(tid, part, markdown) of ``threads`` (tid, gen, title, last_position), with image links rewritten and share links annotated.

    ``posts`` (tid, gen, position, ...) may hold bodies of other generations too; ``images`` (tid, url, local) and ``shares``
    (tid, url, local_dir) are unique by (tid, url). Title, footer, generation and link targets of a document part are one row. Posts
    meet it by (tid, part, gen) and are rendered in that distribution: their texts are shuffled once, and in blocks of ``part_posts``.
    A thread without posts has its title and footer.
    """
    targets = link_targets(posts, threads, images, shares, body, part_posts)
    framed = frames(threads.select("tid", "gen", "title", "last_position"), generated_at, generator, part_posts).join(targets, ["tid", "part"], "left")
    placed = posts.withColumn("part", F.floor(F.col("position") / part_posts).cast("bigint"))
    joined = framed.join(placed, ["tid", "part", "gen"], "left")
    text = annotate_share_links(rewrite_image_links(F.col(body), F.col("_images")), F.col("_shares"))
    entries = render_posts(joined.withColumn(body, text), body, carry=("part", "gen", "opening", "closing"))
    entry = F.when(F.col("position").isNotNull(), F.struct(F.col("position").alias("at"), F.concat("markdown", F.lit("\n")).alias("md")))
    bodies = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda row: row["md"]), "")
    document = F.concat(F.first("opening"), bodies, F.first("closing"))
    return entries.groupBy("tid", "part", "gen").agg(document.alias("markdown")).drop("gen")
