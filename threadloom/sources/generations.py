"""Tables that grow by generations: which parts are live, and merging them in tiers.

A generation is written as a part of its own, ``part=<first>-<last>`` under each table, and counts from the moment that a commit list
naming it is there. A commit list is one small file and holds all live parts; the newest one counts. So a part that failed half-way is
never seen, and merging parts swaps them for the merged one in a single step: a reader holds to the list that it began with.

Merging goes in tiers: as soon as ``fanout`` parts of a level are live, the oldest of them become one part of the next level. What is
live stays logarithmic in the number of generations, and each row is rewritten once per level. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 8


class Part(NamedTuple):
    """Generations ``first`` to ``last``; ``level`` counts the merges."""

    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}"


def _listed(spark: SparkSession, base: str) -> tuple[int, list[Part]]:
    """Number and parts of the newest commit list; (-1, []) before the first."""
    try:
        rows = spark.read.schema("first long, last long, level long, version long").parquet(f"{base}/commits")
        newest = rows.agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    if newest is None:
        return -1, []
    # As many rows as parts are live.
    found = rows.where(F.col("version") == newest).select("first", "last", "level").collect()
    return newest, sorted(Part(*row) for row in found)


def live_parts(spark: SparkSession, base: str) -> list[Part]:
    return _listed(spark, base)[1]


def last_generation(spark: SparkSession, base: str) -> int:
    """Largest committed generation; -1 if there is none."""
    return max((p.last for p in live_parts(spark, base)), default=-1)


def _commit(spark: SparkSession, base: str, version: int, parts: list[Part]) -> None:
    rows = spark.createDataFrame([tuple(p) for p in sorted(parts)], "first long, last long, level long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/version={version}")


def new_part(spark: SparkSession, base: str, gen: int) -> Part:
    """The part to write generation ``gen`` to. A generation can be repeated until it is merged with others."""
    if any(p.first <= gen <= p.last and p.level for p in live_parts(spark, base)):
        raise ValueError(f"generation {gen} is merged already")
    return Part(gen, gen, 0)


def add(spark: SparkSession, base: str, part: Part) -> None:
    """Make a written part visible."""
    version, parts = _listed(spark, base)
    if part not in parts:
        _commit(spark, base, version + 1, [*parts, part])


def read(spark: SparkSession, base: str, table: str, schema: T.StructType, parts: list[Part] | None = None, extra: list[T.StructField] | None = None) -> DataFrame:
    """Rows of the live (or the given) parts, with ``gen``, the last generation of their part; other parts' files are not read.

    A part without files of this table has no rows.
    """
    parts = live_parts(spark, base) if parts is None else parts
    layout = T.StructType([*schema.fields, T.StructField("part", T.StringType()), *(extra or [])])
    folder, files = folder_of(spark, f"{base}/{table}")
    if parts and files.exists(folder):
        rows = spark.read.schema(layout).parquet(f"{base}/{table}").where(F.col("part").isin([p.name for p in parts]))
    else:
        rows = spark.createDataFrame([], layout)
    return rows.withColumn("gen", _last("part")).drop("part")


def folder_of(spark: SparkSession, path: str):
    """The path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def clear(spark: SparkSession, base: str, table: str, part: Part) -> None:
    """Drop what an earlier try may have written of a table."""
    folder, files = folder_of(spark, f"{base}/{table}/part={part.name}")
    files.delete(folder, True)


def _last(part: str) -> Column:
    return F.substring_index(part, "-", -1).cast("long")


def _due(parts: list[Part], fanout: int) -> list[Part]:
    """The oldest ``fanout`` parts of the lowest level that has as many."""
    for level in sorted({p.level for p in parts}):
        of = [p for p in parts if p.level == level]
        if len(of) >= fanout:
            return of[:fanout]
    return []


def compact(spark: SparkSession, base: str, merge: Callable[[list[Part], Part], None], fanout: int = FANOUT) -> list[Part]:
    """Merge parts until no level has ``fanout`` of them; the parts made. ``merge(parts, into)`` writes the merged part's tables."""
    made = []
    while True:
        version, parts = _listed(spark, base)
        group = _due(parts, fanout)
        if not group:
            return made
        into = Part(group[0].first, group[-1].last, group[0].level + 1)
        merge(group, into)
        _commit(spark, base, version + 1, [p for p in parts if p not in group] + [into])
        made.append(into)


def expire(spark: SparkSession, base: str, tables: list[str]) -> list[str]:
    """Delete parts that the newest commit list does not name, and older lists; the folders deleted.

    Run it when no reader works on an older list any more, and no writer is at work.
    """
    version, parts = _listed(spark, base)
    wanted = {f"part={p.name}" for p in parts} | {f"version={version}"}
    gone = []
    for table in [*tables, "commits"]:
        folder, files = folder_of(spark, f"{base}/{table}")
        for entry in files.listStatus(folder) if files.exists(folder) else []:
            name = entry.getPath().getName()
            if entry.isDirectory() and name.startswith(("part=", "version=")) and name not in wanted:
                files.delete(entry.getPath(), True)
                gone.append(f"{table}/{name}")
    return sorted(gone)
