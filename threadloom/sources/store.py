"""The thread store: Parquet tables of threads, posts, assets, shares and their files, added to in generations.

A run writes only what it changed, as generation N of each table; the header row of a thread names the generation its
posts live in. All tables are read through one commit list (sources/generations.py), so a failed run leaves nothing visible, repeating it
overwrites the same generation, and compact_tiers() swaps generations for merged ones in one step. Files are sorted by tid, which lets
a look-up of a few threads skip most row groups.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators import links
from threadloom.operators.documents import render_localised
from threadloom.operators.links import append_assets
from threadloom.operators.spread import hash_block, lookup
from threadloom.sources import generations, tables
from threadloom.sources.generations import FANOUT, Part

GENERATION_STEP = 1 << 40
# Tables with the column that orders a thread's rows in a file.
TABLES = {
    "posts": (tables.POSTS, "position"), "assets": (tables.ASSETS, "seq"), "shares": (tables.SHARES, "seq"),
    "share_files": (tables.SHARE_FILES, "block"), "threads": (tables.THREADS, "created_at"),
}


def _write(df: DataFrame | None, spark: SparkSession, store: str, name: str, part: Part) -> None:
    schema, order = TABLES[name]
    if df is None:
        return generations.clear(spark, store, name, part)
    # rebalance lets adaptive execution split a partition that one huge thread fills and merge small ones.
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    laid = df.select(*columns).hint("rebalance", "tid").sortWithinPartitions("tid", order)
    laid.write.mode("overwrite").parquet(f"{store}/{name}/part={part.name}")


def _read(spark: SparkSession, store: str, name: str, parts: list[Part] | None = None) -> DataFrame:
    return generations.read(spark, store, name, TABLES[name][0], parts)


def store_threads(
    store: str, gen: int, threads: DataFrame, posts: DataFrame, assets: DataFrame | None = None,
    shares: DataFrame | None = None, share_files: DataFrame | None = None,
) -> None:
    """Write one generation. Threads replace their earlier body; asset and share records add to the earlier ones.

    ``share_files`` has the files of the shares among ``shares``, as share_file_lists() gives them by URL.
    """
    spark = threads.sparkSession
    part = generations.new_part(spark, store, gen)
    given = {"posts": posts, "assets": assets, "shares": shares, "share_files": share_files, "threads": threads}
    for name, rows in given.items():
        _write(rows, spark, store, name, part)
    # From here on the generation is visible, in all tables.
    generations.add(spark, store, part)


def next_generation(spark: SparkSession, store: str) -> int:
    return generations.last_generation(spark, store) + 1


def _only(df: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Rows of the threads in ``wanted`` (tid)."""
    return df if wanted is None else lookup(df, wanted.select("tid").distinct(), ["tid"], hash_block(*df.columns), "inner")


def stored_threads(spark: SparkSession, store: str, wanted: DataFrame | None = None, parts: list[Part] | None = None) -> DataFrame:
    """Current header of each thread, with ``gen``."""
    rows = _read(spark, store, "threads", parts)
    rows = rows if wanted is None else rows.join(wanted.select("tid").distinct(), "tid", "left_semi")
    fields = [f.name for f in tables.THREADS.fields if f.name != "tid"]
    return rows.groupBy("tid").agg(F.max_by(F.struct(*fields, "gen"), "gen").alias("_t")).select("tid", "_t.*")


def stored_posts(spark: SparkSession, store: str, wanted: DataFrame | None = None, parts: list[Part] | None = None) -> DataFrame:
    """Posts of the current body of each thread."""
    parts = generations.live_parts(spark, store) if parts is None else parts
    current = stored_threads(spark, store, wanted, parts).select("tid", "gen")
    rows = _read(spark, store, "posts", parts)
    return lookup(rows, current, ["tid", "gen"], F.floor(F.col("position") / 100_000)).drop("gen")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", F.col("gen") * GENERATION_STEP + F.col("seq"))


def stored_assets(spark: SparkSession, store: str, wanted: DataFrame | None = None, parts: list[Part] | None = None) -> DataFrame:
    """All asset records; ``seq`` runs on over generations."""
    return _placed(_only(_read(spark, store, "assets", parts), wanted)).drop("gen")


def stored_shares(spark: SparkSession, store: str, wanted: DataFrame | None = None, parts: list[Part] | None = None) -> DataFrame:
    """Share records, the last one of each URL at the place of the first."""
    rows = _placed(_only(_read(spark, store, "shares", parts), wanted))
    others = [f.name for f in tables.SHARES.fields if f.name not in ("tid", "url", "seq")]
    return rows.groupBy("tid", "url").agg(
        F.min("seq").alias("place"), F.max_by(F.struct(*others), "seq").alias("_s")
    ).select("tid", "url", "_s.*", F.col("place").alias("seq"))


def stored_share_files(spark: SparkSession, store: str, wanted: DataFrame | None = None, parts: list[Part] | None = None) -> DataFrame:
    """Files of each share, in blocks: those of the generation that its last record is of. An upsert replaces the whole list."""
    parts = generations.live_parts(spark, store) if parts is None else parts
    last = _only(_read(spark, store, "shares", parts), wanted).groupBy("tid", "url").agg(F.max("gen").alias("gen"))
    rows = _read(spark, store, "share_files", parts)
    return lookup(rows, last, ["tid", "url", "gen"], F.floor(F.col("block") / 1000)).drop("gen")


def load_threads(spark: SparkSession, store: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) for a table of tids. An empty tid is missing."""
    asked = wanted.select("tid").distinct()
    found = stored_threads(spark, store).join(asked.where(F.col("tid") != ""), "tid", "left_semi")
    missing = asked.join(found.select("tid"), "tid", "left_anti").select(
        "tid", F.when(F.col("tid") == "", "tid is empty").otherwise("thread not found in store").alias("error")
    )
    return found.drop("gen"), missing


def merge_threads(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Header rows after an upsert: new ones replace stored ones of the same tid."""
    return stored.join(new.select("tid"), "tid", "left_anti").unionByName(new)


def carry_records(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Asset records after an upsert: stored ones stay; of new ones the first of each (tid, url) follows, unless a usable one is there."""
    usable = stored.where(F.col("downloaded") & (F.col("url") != "") & (F.col("local") != ""))
    rest = [c for c in new.columns if c not in ("tid", "url")]
    first = new.groupBy("tid", "url").agg(F.min_by(F.struct(*rest), "seq").alias("_r"))
    first = first.select("tid", "url", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*new.columns)
    return append_assets(stored, first.join(usable.select("tid", "url").distinct(), ["tid", "url"], "left_anti"))


def compact_tiers(spark: SparkSession, store: str, fanout: int = FANOUT) -> list[Part]:
    """Merge generations in tiers; the parts made. What readers see does not change, and a failed run changes nothing.

    Of the merged generations the last body of each thread and all asset and share records stay. Merged rows count as of the part's last
    generation; a record's ``seq`` is shifted by as much, so that its place among all generations stays.
    """

    def merge(parts: list[Part], into: Part) -> None:
        def shifted(rows: DataFrame) -> DataFrame:
            return _placed(rows).withColumn("seq", F.col("seq") - F.lit(into.last) * F.lit(GENERATION_STEP)).drop("gen")

        merged = {
            "posts": stored_posts(spark, store, None, parts),
            "assets": shifted(_read(spark, store, "assets", parts)),
            "shares": shifted(_read(spark, store, "shares", parts)),
            "share_files": stored_share_files(spark, store, None, parts),
            "threads": stored_threads(spark, store, None, parts).drop("gen"),
        }
        for name, rows in merged.items():
            _write(rows, spark, store, name, into)

    return generations.compact(spark, store, merge, fanout)


def expire_store(spark: SparkSession, store: str) -> list[str]:
    """Delete what the newest commit list does not name; see generations.expire()."""
    return generations.expire(spark, store, list(TABLES))


def compact_store(spark: SparkSession, store: str, target: str) -> None:
    """Write the current state as the only generation of a new store."""
    store_threads(
        target, 0, stored_threads(spark, store).drop("gen"), stored_posts(spark, store),
        stored_assets(spark, store), stored_shares(spark, store), stored_share_files(spark, store),
    )


def render_stored(spark: SparkSession, store: str, wanted: DataFrame | None = None, generated_at=None) -> DataFrame:
    """Documents (tid, part, markdown) of stored threads, with links to the assets and shares that the store has.

    Post text is shuffled once, to where it is rendered.
    """
    parts = generations.live_parts(spark, store)
    images = links.usable_assets(stored_assets(spark, store, wanted, parts))
    shares = links.usable_shares(stored_shares(spark, store, wanted, parts))
    threads = stored_threads(spark, store, wanted, parts)
    return render_localised(threads, _read(spark, store, "posts", parts), images, shares, generated_at)


def export_stored(spark: SparkSession, store: str, out: str, wanted: DataFrame | None = None, generated_at=None, layout: str = "shards") -> DataFrame:
    """Export stored threads, or those in ``wanted`` (tid): documents under ``documents``, and their metadata beside them, as tables
    ``threads``, ``assets``, ``shares`` and ``share_files``. Needs the store only. Gives the (tid, error) rows of ``wanted`` that it lacks.
    """
    export_threads(render_stored(spark, store, wanted, generated_at), f"{out}/documents", layout)
    metadata = {
        "threads": stored_threads(spark, store, wanted).drop("gen"), "assets": stored_assets(spark, store, wanted),
        "shares": stored_shares(spark, store, wanted), "share_files": stored_share_files(spark, store, wanted),
    }
    for name, rows in metadata.items():
        order = TABLES[name][1]
        rows.hint("rebalance", "tid").sortWithinPartitions("tid", order).write.mode("overwrite").parquet(f"{out}/{name}")
    return load_threads(spark, store, spark.createDataFrame([], "tid string") if wanted is None else wanted)[1]


EXPORT = "value string, tid string, part bigint"
# What partitionBy() writes as % and two hexadecimal digits in a folder's name.
_ESCAPED = re.compile(r"""[\x01-\x1F\x7F"#%'*/:=?\\{\[\]^]""")


def _folder_name(column: str, value: str | None) -> str:
    """As partitionBy() names it."""
    return f"{column}=" + (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__")


def _file_writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (tid, part) as files ``tid=<t>/part=<p>/part-<task>.txt``; a try that runs again replaces its files."""
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.txt"
        hidden, done, file, n = f".{name}.{context.taskAttemptId()}", None, None, 0
        for batch in batches:
            for value, tid, part in zip(*(batch.column(c).to_pylist() for c in ("value", "tid", "part")), strict=True):
                folder = f"{root}/{_folder_name('tid', tid)}/{_folder_name('part', part)}"
                if folder != done:
                    if file:
                        file.close()
                        os.replace(file.name, f"{done}/{name}")
                    os.makedirs(folder, exist_ok=True)
                    file, done, n = open(f"{folder}/{hidden}", "wb"), folder, n + 1
                file.write((value or b"") + b"\n")
        if file:
            file.close()
            os.replace(file.name, f"{done}/{name}")
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n_files"])

    return write


def _write_files(rows: DataFrame, out: str) -> None:
    """A folder and a file for each document part, in place of what ``out`` has.

    On a mounted folder the tasks write the files themselves, beside ``out``, and the driver puts them in its place in one step when all
    are there: Spark's sink goes through Hadoop's local file system, which starts a process for each folder, file and checksum it makes.
    """
    spark = rows.sparkSession
    folder, files = generations.folder_of(spark, out)
    if files.getScheme() != "file":
        return rows.hint("rebalance", "tid", "part").write.mode("overwrite").partitionBy("tid", "part").text(out)
    made, _ = generations.folder_of(spark, f"{out.rstrip('/')}-{uuid.uuid4().hex}")
    files.mkdirs(made)
    try:
        # Null and empty share a folder, so they are one value before rows are sorted.
        names = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("tid", "part")]
        laid = rows.select(*names, F.col("value").cast("binary").alias("value")).hint("rebalance", "tid", "part")
        laid.sortWithinPartitions("tid", "part").mapInArrow(_file_writer(made.toUri().getPath()), "n_files long").agg(F.sum("n_files")).collect()
        files.create(made.suffix("/_SUCCESS")).close()
        files.delete(folder, True)
        if not files.rename(made, folder):
            raise OSError(f"{made} cannot be renamed to {out}")
    except BaseException:
        files.delete(made, True)
        raise


def export_threads(rendered: DataFrame, out: str, layout: str = "shards") -> None:
    """Write rendered parts (tid, part, markdown).

    ``files`` gives a folder per document part, ``tid=<t>/part=<p>``; ``shards`` gives Parquet sorted by tid and part,
    the form for large corpora.
    """
    # The text sink ends a row with a line break, so the document's own last one is left to it.
    body = F.regexp_replace("markdown", r"\n\z", "").alias("value") if layout == "files" else F.col("markdown").alias("value")
    rows = rendered.select(body, "tid", "part")
    if layout == "files":
        _write_files(rows, out)
    elif layout == "shards":
        rows.hint("rebalance").sortWithinPartitions("tid", "part").write.mode("overwrite").parquet(out)
    else:
        raise ValueError(layout)


def read_export(spark: SparkSession, out: str, layout: str = "shards") -> DataFrame:
    if layout == "files":
        return spark.read.schema(EXPORT).text(out, wholetext=True).select("tid", "part", F.col("value").alias("markdown"))
    return spark.read.schema(EXPORT).parquet(out).select("tid", "part", F.col("value").alias("markdown"))
