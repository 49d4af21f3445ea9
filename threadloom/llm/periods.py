"""Periodic runs of words by dyadic square catching.

A run is a stretch of words with a smallest period that no neighbouring word extends. Words are read in order, and for each power of
two L every completed block of L words gets a catcher. While the next L words arrive, the catcher compares the suffix that begins at
each of them with its block; where they agree over L words it has caught the beginning of a square whose period, the distance, lies
between L and 2L - 1. A run of period q and three periods or more holds such a block within its first two periods, so every run is
caught at the level of its own period. Neighbouring catchers that catch the same period merge, and the ends are found by comparing
ever smaller blocks. Periods that are multiples of a smaller one give the same stretch, of which the smallest period stays.

Blocks are compared by 64-bit hashes that are doubled from level to level, for all words of a run of texts at once: n log n steps for
n words, whatever they are. Each text is whole in one task and needs no other; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.words import BY_SPACE, Words, _fmix, pieces

LEAST_WORDS, LEAST_REPEATS = 24, 3
WORD = r"[^\x20\x09-\x0D]+"

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MARK = np.uint64(1 << 63)


def runs_of(hashes: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> tuple[np.ndarray, ...]:
    """All runs of ``least_words`` words and ``least_repeats`` (3 or more) periods: text number, start, length, period, in this order.

    Text t has the words ``hashes[bounds[t] : bounds[t + 1]]``.
    """
    n_texts = len(bounds) - 1
    firsts = bounds[:-1] + np.arange(n_texts)
    # A mark that equals nothing ends each text, so that no stretch crosses into another one.
    row = np.empty(len(hashes) + n_texts, np.uint64)
    marks = bounds[1:] + np.arange(n_texts)
    inside = np.ones(len(row), bool)
    inside[marks] = False
    row[inside] = hashes
    row[marks] = _fmix(np.arange(1, n_texts + 1, dtype=np.uint64) | _MARK)
    longest = int(np.diff(bounds).max(initial=0))

    levels, caught, size = [row], [], 1
    while size * least_repeats <= longest:
        caught.append(_catch(levels, size))
        names = levels[-1]
        levels.append(_fmix(names[: len(names) - size] * _LEFT + names[size:] * _RIGHT))
        size *= 2
    if not caught:
        return (np.empty(0, np.int64),) * 4
    start, stop, period = (np.concatenate(c) for c in zip(*caught))
    long_enough = stop - start >= np.maximum(least_words, least_repeats * period)
    start, stop, period = start[long_enough], stop[long_enough], period[long_enough]
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[smallest], stop[smallest], period[smallest]
    text = np.searchsorted(firsts, start, "right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - firsts[text])[order], (stop - start)[order], period[order]


def _catch(levels: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches with a period of ``size`` to 2 * ``size`` - 1 that hold a whole block: start, stop, period. ``levels[-1]`` names blocks."""
    names, row = levels[-1], levels[0]
    if len(names) <= size:
        return (np.empty(0, np.int64),) * 3
    # Place i is compared with the beginning of the block before its own.
    hit = np.zeros(len(names) + size, bool)
    hit[size : len(names)] = names[size:] == np.repeat(names[::size], size)[: len(names) - size]
    places = np.flatnonzero(hit)
    opens, closes = places[~hit[places - size]], places[~hit[places + size]]
    # Neighbouring catchers of one period lie ``size`` places apart: opens and closes pair up by place modulo size.
    opens, closes = (x[np.lexsort((x, x % size))] for x in (opens, closes))
    start = (opens // size - 1) * size
    period = opens - start
    stop = closes // size * size
    for k in range(len(levels) - 2, -1, -1):
        step, name = 1 << k, levels[k]
        back = np.maximum(start - step, 0)
        start = np.where((start >= step) & (name[back] == name[back + period]), back, start)
        on = np.minimum(stop + period, len(name) - 1)
        fits = stop + period + step <= len(row)
        stop = np.where(fits & (name[on - period] == name[on]), stop + step, stop)
    return start, stop + period, period


def _find(least_words: int, least_repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last, data, offsets in pieces(texts):
                words = Words(data, offsets, BY_SPACE)
                text, start, length, period = runs_of(words.hashes, words.bounds, least_words, least_repeats)
                of = np.searchsorted(text, np.arange(last - first + 1))
                fields = [pa.array(x, pa.int64()) for x in (start, length, period)]
                runs = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                collapsed = []
                for t in range(last - first):
                    found = data[offsets[t] : offsets[t + 1]].tobytes().split()
                    if of[t] < of[t + 1]:
                        gone = np.zeros(len(found) + 1, np.int64)
                        mine = slice(of[t], of[t + 1])
                        np.add.at(gone, start[mine] + period[mine], 1)
                        np.add.at(gone, start[mine] + length[mine], -1)
                        found = [found[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                    collapsed.append(b" ".join(found))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(np.diff(words.bounds), pa.int64()), runs.cast(kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(documents: DataFrame, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the
    words that no run repeats, joined by one space.

    Words are what stands between white space (space, tab to carriage return). Null and empty texts have no words, no runs and an empty
    ``collapsed``. Null ids pass through; rows that repeat are separate documents with equal results; an empty table gives an empty one.
    Further columns are ignored. Of ties (one stretch, many periods) the smallest period is the run's. ``least_repeats`` is 3 or more.
    A text of n words takes about 8 * n * log2(n) bytes of its task.
    """
    if least_repeats < 3:
        raise ValueError("squares are caught for three repeats or more")
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return documents.select("doc_id", "text").mapInArrow(_find(least_words, least_repeats), schema)


def with_repeated_tails(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; a tenth of the texts, chosen by crc32 of the id, repeat some of their words to the end.

    With h the crc32 of the decimal id and g = h // 10, texts with h % 10 = 0 and n > 0 words keep the words before a = g % n, and from
    there on repeat 1 + (n - a) // (3 + g % 8) words. Texts without words or without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    chosen = documents.select("doc_id", "text", h.alias("h"), g.alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size(words)
    a = (F.col("g") % F.nullif(n, F.lit(0))).cast("int")
    period = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    cycle = F.slice(words, a + 1, period)
    repeated = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / period).cast("int"))), F.lit(1), n - a)
    edited: Column = F.array_join(F.concat(F.slice(words, F.lit(1), a), repeated), " ")
    return chosen.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), edited).otherwise(F.col("text")).alias("text"))


def run_summary(documents: DataFrame) -> DataFrame:
    """The digest of ``periodic_runs`` over ``with_repeated_tails``: a row per document with its count of runs, the run of the greatest
    length / period (ties: smallest start, then period; no run: nulls) and hashes of all runs and of the collapsed text."""
    found = periodic_runs(with_repeated_tails(documents))
    runs = F.col("runs")
    # Runs are in order of start and period, so a later one wins only by a greater exponent.
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))
    best = F.when(F.size(runs) > 0, best)
    line = lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
