"""Pages that keep arriving, kept up to date in the store.

The page state is a table of generations (sources/generations.py), one per batch, each dealt into buckets by thread: publishing reads the
buckets of touched threads only, and files of a bucket are sorted by thread and page.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from threadloom.operators.assemble import assemble_posts, assemble_threads, page_index
from threadloom.operators.pages import parse_pages, with_page_fields
from threadloom.operators.spread import PAGE_BLOCK, lookup
from threadloom.page_profile import FORUM, PageProfile
from threadloom.session import written
from threadloom.sources import generations
from threadloom.sources.generations import FANOUT, Part
from threadloom.sources.readers import dealt_out
from threadloom.sources.store import next_generation, store_threads

# Fixed for the life of a store.
PAGE_BUCKETS = 64
_BUCKET = T.StructField("bucket", T.IntegerType())


def _base(store: str) -> str:
    return f"{store}/state"


def _write(parsed: DataFrame, store: str, part: Part) -> None:
    bucket = F.pmod(F.xxhash64("tid"), F.lit(PAGE_BUCKETS)).cast("int")
    # rebalance splits the bucket that one huge thread fills, and keeps tasks from opening a file for each bucket.
    laid = parsed.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "tid", "page")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{_base(store)}/pages/part={part.name}")


def ingest_batch(batch: DataFrame, batch_id: int, store: str, profile: PageProfile = FORUM) -> None:
    """Parse arrived pages (tid, page, html) and keep them as generation ``batch_id`` of the page state.

    A thread's pages may come in different batches, so pages, not threads, are the state. A batch costs what its own
    pages cost, whatever the state holds. Its pages are shuffled twice: dealt out before they are parsed, as the splits of a few files
    are few and uneven and parsing a page costs many times its move, and then to their buckets. Doing a batch twice writes the same pages.
    """
    spark = batch.sparkSession
    part = generations.new_part(spark, _base(store), batch_id)
    arrived = dealt_out(batch.select("tid", "page", "html"))
    _write(parse_pages(arrived, profile, with_markdown=True), store, part)
    generations.add(spark, _base(store), part)


def last_page_generation(spark: SparkSession, store: str) -> int:
    return generations.last_generation(spark, _base(store))


def page_state(spark: SparkSession, store: str, parts: list[Part] | None = None, buckets: list[int] | None = None, profile: PageProfile = FORUM) -> DataFrame:
    """Parsed pages of the live (or given) parts and of the given buckets, with ``gen`` and ``bucket``."""
    parsed = parse_pages(spark.createDataFrame([], "tid string, page bigint, html string"), profile, with_markdown=True)
    rows = generations.read(spark, _base(store), "pages", parsed.schema, parts, [_BUCKET])
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def touched_threads(spark: SparkSession, store: str, since: int) -> tuple[DataFrame, list[int]]:
    """Threads (tid) that generations from ``since`` on have pages of, and the buckets they are in.

    A merged part counts by its last generation, so threads touched somewhat earlier may be among them.
    """
    recent = [p for p in generations.live_parts(spark, _base(store)) if p.last >= since]
    found = written(page_state(spark, store, recent).select("tid", "bucket").distinct(), "touched-threads")
    # At most PAGE_BUCKETS numbers.
    buckets = sorted(r.bucket for r in found.select("bucket").distinct().collect())
    return found.select("tid"), buckets


def newest_pages(spark: SparkSession, store: str, since: int = 0, touched: tuple[DataFrame, list[int]] | None = None) -> DataFrame:
    """Newest version (tid, page, gen, ...) of each page of the threads that generations from ``since`` on have touched.

    Holds what page_index() and headers need, and no post contents: those are fetched later by exact (tid, page, gen).
    """
    if since > 0 and touched is None:
        touched = touched_threads(spark, store, since)
    state = with_page_fields(page_state(spark, store, buckets=touched[1] if touched else None))
    light = state.select(
        "tid", "page", "gen", "title", "forum", "base_url", "total_pages", "error", "n_posts", "first_time_text"
    )
    if touched:
        light = lookup(light, touched[0], ["tid"], F.floor(F.col("page") / PAGE_BLOCK))
    rest = [c for c in light.columns if c not in ("tid", "page")]
    return light.groupBy("tid", "page").agg(F.max_by(F.struct(*rest), "gen").alias("_p")).select("tid", "page", "_p.*")


def publish(
    spark: SparkSession, store: str, since: int, fallback_ts: Column, strict: bool = False, mode: str = "reference",
    repeats_main_post: bool = True, assets: DataFrame | None = None, shares: DataFrame | None = None, share_files: DataFrame | None = None,
) -> None:
    """Put the threads touched since generation ``since`` together again and store them, with asset and share records found meanwhile.

    Run it as often as readers need fresh threads; it reads the buckets of the touched threads once for all batches in between. Every run
    is a generation of its own in the store, so doing it twice adds the same threads again and replaces no others.
    """
    touched = touched_threads(spark, store, since) if since > 0 else None
    newest = written(newest_pages(spark, store, since, touched), "newest-pages")
    index = written(page_index(newest, strict, mode, repeats_main_post, carry=("gen",)), "page-index")
    contents = page_state(spark, store, buckets=touched[1] if touched else None).select("tid", "page", "gen", "posts")
    posts = assemble_posts(contents, index, fallback_ts, mode)
    threads = assemble_threads(newest, index, fallback_ts)
    store_threads(store, next_generation(spark, store), threads, posts, assets, shares, share_files)


def compact_pages(spark: SparkSession, store: str, fanout: int = FANOUT) -> list[Part]:
    """Merge generations of the page state in tiers, of each page the newest version; the parts made."""

    def merge(parts: list[Part], into: Part) -> None:
        rows = page_state(spark, store, parts)
        newest = rows.groupBy("tid", "page").agg(F.max("gen").alias("gen"))
        _write(rows.join(newest, ["tid", "page", "gen"], "left_semi").drop("gen", "bucket"), store, into)

    return generations.compact(spark, _base(store), merge, fanout)


def expire_pages(spark: SparkSession, store: str) -> list[str]:
    """Delete page files that no commit list names any more; see generations.expire()."""
    return generations.expire(spark, _base(store), ["pages"])


def first_generation(spark: SparkSession, store: str, checkpoint: str) -> int:
    """The page generation that this checkpoint's batch 0 is; named once, when the checkpoint is new."""
    path = f"{checkpoint}/first_generation"
    try:
        named = spark.read.schema("first long").parquet(path).agg(F.max("first")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        named = None
    if named is None:
        named = last_page_generation(spark, store) + 1
        spark.range(1).select(F.lit(named).cast("long").alias("first")).write.mode("overwrite").parquet(path)
    return named


def ingest_pages_stream(
    spark: SparkSession, source: str, store: str, checkpoint: str, profile: PageProfile = FORUM,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Run ingest_batch() over Parquet files of pages as they arrive; this run ends when all present files are in.

    Batches count from 0 with every new checkpoint, so a checkpoint is given the first page generation that was free when it was
    new, and keeps it: a second source, or a fresh checkpoint, adds generations and overwrites none.
    """
    first = first_generation(spark, store, checkpoint)
    arriving = (
        spark.readStream.schema("tid string, page bigint, html string")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source)
    )
    return (
        arriving.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch, first + batch_id, store, profile))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
