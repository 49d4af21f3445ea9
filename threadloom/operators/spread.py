"""Keeping hot keys apart.

One thread, folder or URL may own a large share of all rows. The helpers here cut such a group into blocks whose size
does not depend on the group, so no task ever holds a whole group, and no row is dropped or sampled to get there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import written

# Pages per block when counting along a thread.
PAGE_BLOCK = 1024
# A key is heavy in a look-up if it owns this many rows and more than one row in HEAVY_SHARE: some times what one of a thousand tasks
# should hold. Fewer than HEAVY_SHARE keys can be, so at most SALTS * HEAVY_SHARE table rows are copies.
HEAVY_ROWS, HEAVY_SHARE, SALTS = 100_000, 200, 256
# Keys that a sketch tracks. In its worst case it is off by 3.5 rows in this number, less than a heavy key's share.
TRACKED = 1024


def heavy_keys(rows: DataFrame, on: list[str], least: int = HEAVY_ROWS) -> list[int]:
    """Hashes of the keys that own at least ``least`` rows and more than one row in HEAVY_SHARE.

    One pass over the key columns: each task tracks its frequent keys in a sketch of some 16 kB, and only sketches are merged. Fewer than
    2 * HEAVY_SHARE hashes come back. A key above both bounds is always among them; the sketch may add some below.
    """
    top = F.expr(f"approx_top_k(_key, {2 * HEAVY_SHARE}, {TRACKED})")
    found = rows.select(F.xxhash64(*on).alias("_key")).agg(top.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return sorted(k["item"] for k in found["top"] or [] if k["count"] >= least and k["count"] * HEAVY_SHARE > found["n"])


def lookup(rows: DataFrame, table: DataFrame, on: list[str], block: Column, how: str = "inner", least: int = HEAVY_ROWS) -> DataFrame:
    """Join ``rows`` to ``table``, which should hold one row or few per key.

    Keys that own a large share of ``rows`` are found first, by heavy_keys(). Only those are salted: their rows by ``block``, which
    numbers the rows within a key (position // size, or a hash), and their few table rows by a copy for each of SALTS salts. All other
    keys meet unsalted, so the plan reads ``rows`` once and is a plain join where no key is heavy. ``how`` is inner, left or left_anti.
    """
    heavy = heavy_keys(rows, on, least)
    if not heavy:
        return rows.join(table, on, how)
    is_heavy = F.xxhash64(*on).isin(heavy)
    salt = F.coalesce(F.pmod(block.cast("bigint"), F.lit(SALTS)), F.lit(0))
    salted = rows.withColumn("_salt", F.when(is_heavy, salt).otherwise(0))
    copies = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = table.withColumn("_salt", F.explode(copies.cast("array<bigint>")))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def running_offsets(
    counts: DataFrame, key: str, step: str, value: str, block: int = PAGE_BLOCK, count: str | None = None
) -> DataFrame:
    """Add ``offset``: the sum of ``value`` over smaller ``step`` values of the same key.

    ``step`` is a non-negative integer, unique within its key. Sums are taken inside blocks of ``block`` steps and
    then over block totals, so the largest sort is over ``block`` rows or over max(step) / block totals. ``count`` names
    a further column for the number of rows of the key.
    """
    rows = counts.withColumn("_block", F.floor(F.col(step) / block).cast("bigint"))
    inside = Window.partitionBy(key, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_block").agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_n"))
    before = [F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_before")]
    if count:
        before.append(F.sum("_n").over(Window.partitionBy(key)).alias(count))
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals.select(key, "_block", *before), [key, "_block"])
        .withColumn("offset", F.col("_before") + F.col("_inside"))
        .drop("_block", "_before", "_inside")
    )


def number_within(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... along ``order`` (non-NULL, unique within its group) inside each group of ``keys``.

    Gives what row_number() - 1 gives, with one plan for every size: rows are range-partitioned by keys and order, numbered inside
    (keys, partition), and shifted by the number of rows that earlier partitions hold of the group. A hot group is shared by as
    many partitions as its rows fill; a small one, however narrow its range, lies in one or two. The partitioned rows are
    written, so that a row stays in its partition however often they are read.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(df.repartitionByRange(partitions, *keys, order).withColumn("_cut", F.spark_partition_id()), "numbered")
    earlier = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        cut.groupBy(*keys, "_cut")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_cut", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy(*keys, "_cut").orderBy(order)
    return (
        cut.withColumn("_rank", F.row_number().over(inside).cast("bigint") - 1)
        .join(shift, [*keys, "_cut"])
        .withColumn(name, F.col("_shift") + F.col("_rank"))
        .drop("_cut", "_shift", "_rank")
    )


def hash_block(*columns: str, blocks: int = 256) -> Column:
    """Block by hash, for rows that have no position within their key."""
    return F.pmod(F.xxhash64(*columns), F.lit(blocks))
