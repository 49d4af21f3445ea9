"""Image and share links in Markdown: extraction, look-up in asset and share records, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.urls import extension, is_remote
from threadloom.operators.spread import hash_block, lookup, number_within
from threadloom.session import written

_WS = r"[\t\n\f\r ]"

# Fixed value: an image link, cut into what precedes its URL, the URL, and what follows.
IMAGE_LINK = rf"(!\[[^\]]*\]\({_WS}*<?)([^)>\t\n\f\r ]+)(>?[^)]*\))"
# Fixed value: a share link; group 1 is its content id.
SHARE_LINK = r"https?://(?:www\.)?gofile\.io/d/([A-Za-z0-9]+)"
# Every share link holds this text.
SHARE_MARK = "gofile.io/d/"

IMAGE_DIR = "images"
SHARE_DIR = "shares"


def image_links(markdown: Column) -> Column:
    """Distinct remote image URLs in order of first use."""
    urls = F.regexp_extract_all(markdown, F.lit(IMAGE_LINK), F.lit(2))
    return F.array_distinct(F.filter(urls, is_remote))


def share_links(markdown: Column) -> Column:
    """Distinct share URLs, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(markdown, F.lit(SHARE_LINK), F.lit(0))))


def share_content_id(url: Column) -> Column:
    return F.regexp_extract(url, SHARE_LINK, 1)


def _woven(gaps: Column, pieces: Column) -> Column:
    """Text gaps with a piece after each one; there is one more gap than there are pieces."""
    return F.array_join(
        F.zip_with(gaps, pieces, lambda gap, piece: F.concat(gap, F.coalesce(piece, F.lit("")))), ""
    )


def rewrite_image_links(markdown: Column, local_by_url: Column) -> Column:
    """Point image links that ``local_by_url`` (a map column, may be NULL) knows at their local file.

    The text is searched for the links and split at them; head, URL and tail are then read from each link alone.
    """

    def moved(link: Column) -> Column:
        url = F.regexp_extract(link, IMAGE_LINK, 2)
        local = F.concat(F.lit(f"{IMAGE_DIR}/"), F.try_element_at(local_by_url, url))
        return F.concat(F.regexp_extract(link, IMAGE_LINK, 1), F.coalesce(local, url), F.regexp_extract(link, IMAGE_LINK, 3))

    found = F.regexp_extract_all(markdown, F.lit(IMAGE_LINK), F.lit(0))
    rewritten = _woven(F.split(markdown, IMAGE_LINK, -1), F.transform(found, moved))
    return F.when(local_by_url.isNull(), markdown).otherwise(rewritten)


def annotate_share_links(markdown: Column, dir_by_url: Column) -> Column:
    """Write ``url (local: dir)`` for share links that ``dir_by_url`` (a map column, may be NULL) knows."""
    urls = F.regexp_extract_all(markdown, F.lit(SHARE_LINK), F.lit(0))
    noted = lambda url: F.coalesce(
        F.concat(url, F.lit(" (local: "), F.try_element_at(dir_by_url, url), F.lit(")")), url
    )
    rewritten = _woven(F.split(markdown, SHARE_LINK, -1), F.transform(urls, noted))
    return F.when(dir_by_url.isNull(), markdown).otherwise(rewritten)


def link_rows(posts: DataFrame, links: Column) -> DataFrame:
    """One row per post and link: (tid, position, url)."""
    return posts.select("tid", "position", F.explode(links).alias("url"))


def usable_assets(assets: DataFrame) -> DataFrame:
    """(tid, url, local): the last usable record of each URL in a thread."""
    return _last_usable(assets, "local")


def usable_shares(shares: DataFrame) -> DataFrame:
    """(tid, url, local_dir): the last usable record of each URL in a thread."""
    return _last_usable(shares, "local_dir")


def _last_usable(records: DataFrame, target: str) -> DataFrame:
    usable = records.where(F.col("downloaded") & (F.col("url") != "") & (F.col(target) != ""))
    return usable.groupBy("tid", "url").agg(F.max_by(target, "seq").alias(target))


def resolve_links(links: DataFrame, records: DataFrame, how: str = "left", block: int = 100_000) -> DataFrame:
    """Join link rows to unique (tid, url) records: hits and misses (left), hits (inner) or misses (left_anti).

    A URL repeated all over a huge thread is spread by post position.
    """
    return lookup(links, records, ["tid", "url"], F.floor(F.col("position") / block), how)


def pending_assets(links: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct (tid, url) still without a usable asset."""
    return links.select("tid", "url").distinct().join(usable_assets(assets), ["tid", "url"], "left_anti")


def link_maps(resolved: DataFrame) -> DataFrame:
    """(tid, position, _images, _shares): maps from URL to ``image`` or ``share`` of each post that has a hit.

    Bounded by the links of one post.
    """

    def mapped(target: str) -> Column:
        pairs = F.collect_list(F.when(F.col(target).isNotNull(), F.struct("url", target)))
        return F.when(F.count(target) > 0, F.map_from_entries(pairs))

    return resolved.groupBy("tid", "position").agg(mapped("image").alias("_images"), mapped("share").alias("_shares"))


def localise_posts(posts: DataFrame, assets: DataFrame, shares: DataFrame, body: str = "content_md") -> DataFrame:
    """Posts with image links rewritten first and share links annotated after that.

    ``posts`` should be a written table when it comes from a parse. Texts are read twice: once for their links, which
    are written as a small table that the look-ups work on, and once to be rewritten. They are shuffled once, by
    (tid, position); the link maps of a partition are small beside its texts, so they are hashed and texts not sorted.
    """
    may_link = F.col(body).contains("![") | F.col(body).contains(SHARE_MARK)
    found = posts.where(may_link).select(
        "tid", "position", image_links(F.col(body)).alias("images"), share_links(F.col(body)).alias("shares")
    )
    found = written(found, "links")
    images = resolve_links(link_rows(found, F.col("images")), usable_assets(assets), "inner")
    shared = resolve_links(link_rows(found, F.col("shares")), usable_shares(shares), "inner")
    maps = link_maps(images.withColumnRenamed("local", "image").unionByName(shared.withColumnRenamed("local_dir", "share"), allowMissingColumns=True))
    joined = posts.join(maps, ["tid", "position"], "left")
    text = annotate_share_links(rewrite_image_links(F.col(body), F.col("_images")), F.col("_shares"))
    return joined.withColumn(body, text).drop("_images", "_shares")


def content_address(payloads: DataFrame) -> DataFrame:
    """(tid, url, content) to asset rows named by content: md5 of the bytes plus the extension of the raw URL."""
    return payloads.select(
        "tid",
        "url",
        F.concat(F.md5("content"), extension(F.col("url"))).alias("local"),
        F.lit("").alias("alt"),
        F.octet_length("content").cast("bigint").alias("file_size"),
        F.lit(True).alias("downloaded"),
        "seq",
    )


def asset_files(assets: DataFrame) -> DataFrame:
    """Files to write: the same bytes of a thread once."""
    return assets.groupBy("tid", "local").agg(
        F.min("file_size").alias("file_size"), F.count(F.lit(1)).alias("n_records")
    )


def append_assets(assets: DataFrame, new: DataFrame) -> DataFrame:
    """Old records first, new ones after them: new places count on from the last one of their thread."""
    return assets.unionByName(_after(assets, new))


def _after(old: DataFrame, new: DataFrame) -> DataFrame:
    last = old.groupBy("tid").agg(F.max("seq").alias("_last"))
    placed = lookup(new, last, ["tid"], hash_block("url"), "left")
    return placed.withColumn("seq", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("seq")).select(*new.columns)


def share_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the record of a URL within its thread, or append it behind the thread's last one; a replaced record keeps its place."""
    rows = old.withColumn("_gen", F.lit(0)).unionByName(_after(old, new).withColumn("_gen", F.lit(1)))
    others = [c for c in old.columns if c not in ("tid", "url", "seq")]
    return (
        rows.groupBy("tid", "url")
        .agg(
            F.min(F.struct("_gen", "seq"))["seq"].alias("seq"),
            F.max_by(F.struct(*others), F.struct("_gen", "seq")).alias("_r"),
        )
        .select("tid", "url", *[F.col(f"_r.{c}").alias(c) for c in others], "seq")
        .select(*old.columns)
    )


def share_manifest(links: DataFrame, files: DataFrame, exclude_aux: bool = False, base: str = SHARE_DIR) -> DataFrame:
    """Share records of links (tid, url, seq) from the files (tid, content_id, path) that are really there.

    ``exclude_aux`` leaves digest sidecars and partial files out of the count.
    """
    if exclude_aux:
        files = files.where(~F.col("path").rlike(r"\.(part|digest\.json)\z"))
    counts = files.groupBy("tid", "content_id").agg(F.count(F.lit(1)).alias("n_files"))
    wanted = links.withColumn("content_id", share_content_id(F.col("url"))).where(F.col("content_id") != "")
    n = F.coalesce("n_files", F.lit(0).cast("bigint"))
    return wanted.join(counts, ["tid", "content_id"], "left").select(
        "tid",
        "url",
        "content_id",
        F.concat(F.lit(f"{base}/"), "content_id").alias("local_dir"),
        n.alias("n_files"),
        (n > 0).alias("downloaded"),
        F.when(n > 0, "").otherwise("download_failed").alias("error"),
        "seq",
    )


def files_of_shares(shares: DataFrame, lists: DataFrame) -> DataFrame:
    """share_file_lists() rows by URL: (tid, url, block, files) for each share record that is downloaded."""
    wanted = shares.where("downloaded").select("tid", "content_id", "url").distinct()
    return lists.join(wanted, ["tid", "content_id"]).select("tid", "url", "block", "files")


def share_file_lists(files: DataFrame, block: int = 1000, base: str = SHARE_DIR) -> DataFrame:
    """Sorted relative file lists per content id, at most ``block`` files to an array: (tid, content_id, block, files)."""
    full = F.concat(F.lit(f"{base}/"), "content_id", F.lit("/"), "path")
    placed = number_within(
        files.select("tid", "content_id", full.alias("path")), ["tid", "content_id"], "path", "_i"
    )
    return placed.groupBy("tid", "content_id", F.floor(F.col("_i") / block).cast("bigint").alias("block")).agg(
        F.sort_array(F.collect_list("path")).alias("files")
    )
