"""Line dedup by overlapping three-line windows.

Any three consecutive lines form a window. Windows that occur more than once in the corpus keep their first occurrence (by
document id, then place); all later ones are removed, with the lines they cover merged into stretches. Boilerplate shorter
than three lines stays, and a passage of three lines or more is found wherever it starts.

Windows are compared by two independent 64-bit hashes. The first occurrence is a partial aggregate, so a window that a third of
all documents share costs one row per task; the look-up of later occurrences is a plain equi-join on the hashes, whose hot
partitions adaptive execution splits. Texts move once, to meet their stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.store import kept

WINDOW = 3


def _windows(lines: Column, size: int) -> Column:
    """One struct for each window that is not white space only: place and two hashes."""

    def one(at: Column) -> Column:
        parts = [lines[at + i] for i in range(size)]
        return F.struct(
            at.alias("pos"),
            F.xxhash64(*parts).alias("h1"),
            F.xxhash64(F.lit(size), *reversed(parts)).alias("h2"),
            F.concat(*parts).rlike(r"[^\x20\x09-\x0D]").alias("full"),
        )

    last = F.size(lines) - size
    return F.filter(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)), lambda w: w["full"])


def covered_lines(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """Stretches to remove: ``doc_id``, ``text_hash`` and ``ranges``, sorted [from, to) pairs of line numbers."""
    windows = documents.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines")
    )
    windows = windows.select("doc_id", "text_hash", F.explode(_windows(F.col("lines"), size)).alias("w"))
    # Rows that agree in id and text are one document.
    windows = kept(windows.select("doc_id", "text_hash", "w.pos", "w.h1", "w.h2"), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "pos")
    firsts = (
        windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h1", "h2", "first")
    )
    later = windows.join(firsts, ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "text_hash", "pos").distinct()
    along = Window.partitionBy("doc_id", "text_hash").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(along) > size
    stretches = (
        later.withColumn("gap", F.coalesce(gap.cast("int"), F.lit(0)))
        .withColumn("stretch", F.sum("gap").over(along))
        .groupBy("doc_id", "text_hash", "stretch")
        .agg(F.struct(F.min("pos").alias("from"), (F.max("pos") + size).alias("to")).alias("range"))
    )
    return stretches.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("range")).alias("ranges"))


def dedup_lines(documents: DataFrame, size: int = WINDOW) -> DataFrame:
    """``documents`` with ``text`` cleaned, and ``n_lines`` (before) and ``n_removed`` beside it.

    A null text stays null with no lines; an empty text is one empty line; texts of fewer lines than a window are left alone.
    Documents with a null id come last in order. Rows that agree in id and text get the same result. Columns named ``n_lines``
    or ``n_removed`` are replaced, all others pass through.
    """
    base = documents.drop("n_lines", "n_removed")
    found = covered_lines(base.select("doc_id", "text"), size).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("ranges").alias("_ranges"))
    joined = base.withColumn("_text_hash", F.xxhash64("text")).join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left"
    )
    lines, ranges = F.col("_lines"), F.col("_ranges")

    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(ranges[i - 1]["to"])
        stop = F.when(i == F.size(ranges), F.size(lines)).otherwise(ranges[i]["from"])
        return F.slice(lines, start + 1, stop - start)

    text = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(ranges)), between)), "\n")
    removed = F.aggregate(ranges, F.lit(0), lambda n, r: n + r["to"] - r["from"])
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("bigint")
    return (
        joined.withColumn("_lines", F.split("text", "\n", -1))
        .withColumn("n_lines", n_lines)
        .withColumn("n_removed", F.coalesce(removed, F.lit(0)).cast("bigint"))
        .withColumn("text", F.when(ranges.isNull(), F.col("text")).otherwise(text))
        .select(*[F.col(f"`{c}`") for c in base.columns], "n_lines", "n_removed")
    )


ORACLE = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
windows AS (
  SELECT * FROM (
    SELECT doc_id, pos, [line, lead(line, 1) OVER o, lead(line, 2) OVER o] AS w, lead(pos, 2) OVER o AS whole
    FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
  WHERE whole IS NOT NULL AND regexp_matches(array_to_string(w, ''), '[^\\x20\\x09-\\x0D]')),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM later, (VALUES (0), (1), (2)) v(i)),
left_over AS (
  SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, o.text
FROM documents d LEFT JOIN left_over o USING (doc_id)
"""
