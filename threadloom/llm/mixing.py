"""Mixing sources to target weights by a low-discrepancy source schedule.

Every source's documents are put in a fixed shuffled order and cut into blocks of equally many words. Slot k of the mix takes
the golden-ratio point frac(k * phi), which the cumulative targets map to a source; the r-th slot of a source gets block r of
that source, starting over after the last one. A source is thus spread evenly over the mix, and its share is off by a few
blocks at most, whatever its size.

Only DataFrame operations. No group grows with a source: documents are ordered inside hash buckets, slots inside chunks, and
both get their place from running sums over bucket and chunk totals. The one table held in one task has a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.store import kept
from threadloom.operators.spread import running_offsets

# Words per block of the mix.
BLOCK_WORDS = 64
# Share of all words that the mix holds, and how often a document may be taken at most.
SHARE, MOST = 1.5, 2
WEIGHTS = (5, 2, 1)
# 2^32 / golden ratio as an odd integer, so that points are exact integers below 2^32.
STEP, RANGE = 2654435769, 4294967296
CELL = 1 << 20
# Slots are numbered in two halves of HALF; slots per chunk when they are ranked; hash buckets (four hexadecimal digits) when
# documents are put in order.
HALF, CHUNK, DIGITS = 65536, 4096, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: ``s`` (its place by code point, null last), ``source``, ``source_size``, ``target``, ``lo``, ``hi``.

    Targets share ``share`` times all words by weight and stop at ``most`` times the source's words; what is over goes to the
    others by weight. With sources in order of cap / weight, the level is the first one that the next source can hold.
    ``lo`` and ``hi`` bound the source's part of [0, 2^32).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "s")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("double")
    rows = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("s", F.row_number().over(by_name).cast("bigint") - 1)
        .withColumn("weight", weight)
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("goal", F.sum("source_size").over(everything).cast("double") * F.lit(share))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("left"))
        .withColumn("level", F.min(F.when(F.col("room") >= F.col("level"), F.struct("room", "s", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.coalesce("level", F.lit(0.0)) * F.col("weight"), F.col("cap")))
    )
    in_order = Window.orderBy("s")
    edge = lambda upto: F.coalesce(F.floor(upto / F.nullif("all_words", F.lit(0)) * RANGE), F.lit(0)).cast("bigint")
    return (
        rows.withColumn("words", F.floor("target").cast("bigint"))
        .withColumn("upto", F.sum("words").over(in_order))
        .withColumn("all_words", F.sum("words").over(everything))
        .withColumn("lo", edge(F.col("upto") - F.col("words")))
        .withColumn("hi", edge(F.col("upto")))
        .select("s", "source", "source_size", "target", "words", "lo", "hi")
    )


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST) -> DataFrame:
    """Slots of the mix: ``slot``, ``s`` and ``block``. A source that has been gone through ``most`` times gets no more."""
    total = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    spark = sources.sparkSession
    k = F.col("id")
    point = ((k % HALF) * STEP + (F.floor(k / HALF) % HALF) * ((STEP * HALF) % RANGE)) % RANGE
    slots = spark.range(-(-total // block_words)).select(k.alias("slot"), point.alias("point"), F.floor(k / CHUNK).alias("chunk"))
    cells = sources.where("hi > lo").select(
        "s",
        "lo",
        "hi",
        F.ceil(F.col("source_size") / block_words).alias("blocks"),
        F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))).alias("cell"),
    )
    placed = (
        slots.withColumn("cell", F.floor(F.col("point") / CELL))
        .join(cells, "cell")
        .where("point >= lo and point < hi")
        .select("slot", "chunk", "s", "blocks")
    )
    starts = running_offsets(placed.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n")), "s", "chunk", "n")
    inside = Window.partitionBy("s", "chunk").orderBy("slot")
    ranked = (
        placed.withColumn("inside", F.row_number().over(inside) - 1)
        .join(starts.select("s", "chunk", "offset"), ["s", "chunk"])
        .withColumn("rank", F.col("offset") + F.col("inside"))
    )
    return ranked.where(F.col("rank") < F.col("blocks") * most).select("slot", "s", (F.col("rank") % F.col("blocks")).alias("block"))


def shuffled(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their first word's place ``at`` in their source's shuffled order, and a key (s, bucket, nth)."""
    rows = (
        sized.join(sources.select("s", "source", "source_size", "target"), sized["source"].eqNullSafe(sources["source"]))
        .drop(sources["source"])
        .withColumn("deal", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("bucket", F.conv(F.substring("deal", 1, DIGITS), 16, 10).cast("bigint"))
    )
    order = Window.partitionBy("s", "bucket").orderBy("deal", "doc_id", "size")
    starts = running_offsets(rows.groupBy("s", "bucket").agg(F.sum("size").alias("n")), "s", "bucket", "n")
    return (
        rows.withColumn("nth", F.row_number().over(order))
        .withColumn("inside", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(starts.select("s", "bucket", "offset"), ["s", "bucket"])
        .withColumn("at", F.col("offset") + F.col("inside"))
        .drop("deal", "inside", "offset")
    )


def mix(documents: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents it is made of.

    The first table has a row for each stretch of a document in the mix: ``slot``, key (``s``, ``bucket``, ``nth``),
    ``first_word`` and ``n_words``; read in order of slot and place it is the mixed corpus. The second has all documents with
    ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and the key.

    Null or empty texts have size 0 and are in no slot; a null source is a source of its own, last in order; null ids are dealt
    as the empty text; rows that repeat are separate documents. An empty table gives empty tables. Further columns are ignored.
    """
    sized = kept(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = kept(source_targets(sized, share, most, weights), "mix-sources")
    dealt = kept(shuffled(sized, sources), "mix-dealt")
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    start = F.greatest(F.col("at"), F.col("block") * block_words)
    stop = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = (
        dealt.where("size > 0")
        .select("s", "bucket", "nth", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
        .select("s", "bucket", "nth", "block", (start - F.col("at")).alias("first_word"), (stop - start).alias("n_words"))
    )
    return schedule(sources, block_words, most).join(pieces, ["s", "block"]), dealt


def taken_words(documents: DataFrame, **options) -> DataFrame:
    """All documents with ``taken``: the words of each that the mix holds, repeats counted."""
    mixed, dealt = mix(documents, **options)
    key = ["s", "bucket", "nth"]
    taken = mixed.groupBy(*key).agg(F.sum("n_words").alias("taken"))
    return dealt.join(taken, key, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source"
    )


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS deal
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(s % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap FROM named),
levels AS (
  SELECT *, cap / weight AS room,
         ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER before, 0)) /
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT *, least((SELECT level FROM levels WHERE room >= level ORDER BY room, s LIMIT 1) * weight, cap) AS target FROM levels),
summed AS (
  SELECT *, floor(target)::BIGINT AS words, sum(floor(target)::BIGINT) OVER (ORDER BY s)::BIGINT AS upto,
         sum(floor(target)::BIGINT) OVER ()::BIGINT AS all_words FROM aimed),
sources AS (
  SELECT *, floor((upto - words)::DOUBLE / all_words::DOUBLE * {RANGE})::BIGINT AS lo, floor(upto::DOUBLE / all_words::DOUBLE * {RANGE})::BIGINT AS hi,
         (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks FROM summed),
slots AS (
  SELECT k, (k::HUGEINT * {STEP} % {RANGE})::BIGINT AS point
  FROM (SELECT unnest(range((SELECT (max(all_words) + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} FROM sources))) AS k)),
ranked AS (
  SELECT s, blocks, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS r FROM slots JOIN sources ON point >= lo AND point < hi),
used AS (SELECT s, r % blocks AS block, count(*) AS times FROM ranked WHERE r < 2 * blocks GROUP BY ALL),
placed AS (
  SELECT d.doc_id, d.size, n.s, n.source_size, n.target, n.source,
         coalesce(sum(d.size) OVER (PARTITION BY n.s ORDER BY deal, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place,
         row_number() OVER () AS key
  FROM sized d JOIN sources n ON d.source IS NOT DISTINCT FROM n.source),
pieces AS (SELECT key, s, place, size, unnest(range((place // {BLOCK_WORDS})::BIGINT, ((place + size - 1) // {BLOCK_WORDS} + 1)::BIGINT)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT key, sum((least(place + size, (block + 1) * {BLOCK_WORDS}) - greatest(place, block * {BLOCK_WORDS})) * times)::BIGINT AS taken
  FROM pieces JOIN used USING (s, block) GROUP BY key)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, source FROM placed LEFT JOIN taken USING (key)
"""
