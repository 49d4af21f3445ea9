"""Toxicity by class-conditional Kneser-Ney models.

One bigram model is trained on labelled toxic texts and one on labelled ordinary texts. Both are smoothed by discounts for counts of
1, 2 and more that follow from their own counts of counts, and both back off to counts that they share: a bigram to the pooled
bigrams of both classes, those to pooled words, and those to the number of contexts that a word stands in. What a class's words lose
to discounts goes to the words that are about as frequent in both classes together (a bin of pooled counts), in proportion to their
pooled counts. A rare expression so weighs about the same under both models, whichever of them has seen it, and says little; a word
that was never seen says nothing.
A text is scored by its log-likelihood ratio: per word over the whole text, per square root of its length, per word in its most
suspicious short window, and what its words have beyond STRONG, per square root of the length. A logistic curve, fitted on labelled
texts kept out of the counts, turns these into a score.

The counts come from the texts of all labelled rows outside the folds HELD_OUT and CURVE. They stay in Spark tables, bucketed by
hash, and grow with the corpus: every word and bigram has a count of its own, whatever the size. Tasks add up their own counts before
they are shuffled. A bucket's bigrams are one row, packed in order of their keys, and so are its words. To score, a task sends the distinct words and bigrams of a chunk of texts to their buckets, once each, and the
counts come back to the chunk. Texts are scored in SLICES rounds, so that what waits on disk is that much smaller. No model is
broadcast or collected, only a table of bits of fixed size: bigrams that it rules out have no entry and are not asked for. As it
fills up, more is asked for; the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.store import BATCH_CONF as _BATCH_CONF  # noqa: F401
from threadloom.llm.store import kept, small_batches
from threadloom.llm.words import BY_ALNUM, PIECE, Words, _fmix, pieces

# Labelled rows that the curve is fitted on, at most, and labelled rows that are broadcast to meet their texts; more are joined by shuffle.
MAX_CURVE, MAX_BROADCAST = 50_000, 1_000_000
# Words of the window, and the log-likelihood ratio from which a word counts as strong evidence.
WINDOW, STRONG = 2, 2.0
SLICES = 6
# Buckets for each file that a slice's features are written to. They are a few numbers per text, and on a mounted folder Hadoop starts
# processes for each file.
_FILE_BUCKETS = 16
FOLDS, HELD_OUT, CURVE = 5, 0, 1
_BUCKET_BYTES = 16 << 20

# Words of texts that are scored together, and of these words or bigrams that are looked at together.
_CHUNK, _BLOCK = 3 << 19, 1 << 18
# Bytes of text whose words are found together. Words and bigrams that wait to be added up, and sums of a task, from which these
# leave it.
_PIECE = PIECE >> 2
_WAITING, _HELD = 1 << 19, 1 << 20

_COUNTS = pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in ("words", "word_counts", "before", "after", "pair_counts"))])
_COUNTS_SQL = "bucket long, words binary, word_counts binary, before binary, after binary, pair_counts binary"
# Of a bucket, a row for each word: how often it stands in either class and in how many contexts, and of the bigrams that it begins
# how often they stand there and how many do so once, twice and more often. And a row for its bigrams; ``times`` is how many of these
# were counted 1, 2, 3 and 4 times.
_GROUPS = ("toxic", "other", "pooled")
_BY_WORD = ("toxic", "other", "contexts", "begun_toxic", "begun_other", *(f"{n}{k}" for n in _GROUPS for k in (1, 2, 3)))
_SUMS = pa.schema([*((n, pa.int64()) for n in ("bucket", "key", *_BY_WORD, "n")), ("keys", pa.binary()), ("counts", pa.binary()), ("times", pa.list_(pa.int64()))])
_SUMS_SQL = ", ".join([*(f"{n} long" for n in ("bucket", "key", *_BY_WORD, "n")), "keys binary, counts binary, times array<long>"])
_WORD, _BIGRAM = 0, 1
_ENTRIES_SQL = "bucket long, kind int, n long, keys binary, counts binary"
_PACKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_PACKED_SQL = "bucket long, chunk long, kind int, a binary, b binary, c binary"
_TEXTS = 2
# The table of bits: its size and how many parts it is made in, as powers of two.
_BITS, _BIT_PARTS = 27, 6
_CLASSES = ("toxic", "other")
_FEATURES = ("per_word", "per_root", "peak", "strong")
_VALUES = ("toxic", "other", "contexts", "after_toxic", "after_other", "after_pooled")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; the empty text for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def bigram_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _fmix(before * np.uint64(0xD6E8FEB86659FD93) + _fmix(word ^ np.uint64(0xA0761D6478BD642F)))


def _begins(bounds: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words begin a text."""
    begins = np.zeros(n, bool)
    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return begins


def _buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cuts(ranked: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where the values of a sorted array are equal."""
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])).tolist() if len(ranked) else []
    return zip(begin, [*begin[1:], len(ranked)][: len(begin)], strict=True)


def _table(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and bigrams with their counts in toxic and other texts of the task. A word's key is the word itself."""
        none = [np.empty(0, np.uint64)] * 3 + [np.empty(0, np.uint32)] * 2
        sums, waiting, held = none, [], 0

        def add() -> None:
            nonlocal sums, waiting, held
            # One column is joined at a time, and its parts are let go.
            parts = [list(c) for c in zip(sums, *waiting, strict=True)]
            sums, waiting, held = none, [], 0
            keys = np.concatenate(parts[0])
            parts[0] = []
            order = np.argsort(keys)
            keys = keys[order]
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            keys, first, out = keys[begin], order[begin], []
            for i in (1, 2):
                out.append(np.concatenate(parts[i])[first])
                parts[i] = []
            for i in (3, 4):
                x = np.concatenate(parts[i])
                parts[i] = []
                out.append(np.add.reduceat(x[order], begin, dtype=np.uint32) if len(begin) else x)
            sums = [keys, *out]

        def flush() -> pa.RecordBatch:
            ranked = _buckets_of(sums[0], buckets)  # sums are sorted by key, and so by bucket
            rows = []
            for x, y in _cuts(ranked):
                keys, before, word, toxic, other = (c[x:y] for c in sums)
                single, counts = keys == word, np.column_stack((toxic, other))
                parts = (word[single].tobytes(), _packed(counts[single].ravel()), before[~single].tobytes(), word[~single].tobytes(), _packed(counts[~single].ravel()))
                rows.append((int(ranked[x]), *parts))
            return pa.RecordBatch.from_arrays(_table(rows, _COUNTS), schema=_COUNTS)

        for batch in batches:
            flags = np.array(batch.column("toxic").cast(pa.int32())) == 1
            for at, stop, data, offsets in pieces(batch.column("text"), _PIECE):
                words = Words(data, offsets, BY_ALNUM)
                h = words.hashes
                flag = np.repeat(flags[at:stop], np.diff(words.bounds)).astype(np.uint32)
                ends = np.flatnonzero(~_begins(words.bounds, len(h)))
                waiting.append((h, h, h, flag, 1 - flag))
                waiting.append((bigram_keys(h[ends - 1], h[ends]), h[ends - 1], h[ends], flag[ends], 1 - flag[ends]))
                held += len(h) + len(ends)
                if held > _WAITING:
                    add()
                    if len(sums[0]) > _HELD:
                        yield flush()
                        sums = none
        if waiting:
            add()
        if len(sums[0]):
            yield flush()

    return count


def _add_bucket(group: pa.Table) -> pa.Table:
    """Sums of a bucket: a row for its bigrams, packed, and one for each of its words."""
    bucket = group.column("bucket")[0].as_py()
    columns = [group.column(n).to_pylist() for n in _COUNTS.names[1:]]
    one, before, after = (np.frombuffer(b"".join(columns[i]), np.uint64) for i in (0, 2, 3))
    counts = [_unpacked(c, np.uint32, len(w) // 4) for i, j in ((0, 1), (2, 4)) for w, c in zip(columns[i], columns[j], strict=True)]
    toxic, other = np.concatenate(counts).reshape(-1, 2).astype(np.int64).T
    keys = np.concatenate((one, bigram_keys(before, after)))
    before, word = np.concatenate((one, before)), np.concatenate((one, after))
    order = np.argsort(keys)
    ranked = keys[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    keys, before, word = (x[order[begin]] for x in (keys, before, word))
    toxic, other = (np.add.reduceat(x[order], begin) for x in (toxic, other))
    single = keys == word
    pairs = [toxic[~single], other[~single], (toxic + other)[~single]]

    words, place = np.unique(np.concatenate((word[single], word[~single], before[~single])), return_inverse=True)
    own, after, before = np.split(place, np.cumsum([single.sum(), (~single).sum()]))
    by = {"key": words.view(np.int64)} | {n: np.zeros(len(words), np.int64) for n in _BY_WORD}
    by["toxic"][own], by["other"][own] = toxic[single], other[single]
    by["contexts"] += np.bincount(after, minlength=len(words))
    for n, c in zip(_GROUPS, pairs, strict=True):
        if n != "pooled":
            np.add.at(by[f"begun_{n}"], before, c)
        for k in (1, 2, 3):
            by[f"{n}{k}"] += np.bincount(before[np.minimum(c, 3) == k], minlength=len(words))
    out = [pa.table({f.name: pa.array(by[f.name], f.type) if f.name in by else pa.nulls(len(words), f.type) for f in _SUMS if f.name != "bucket"})]
    times = [int((c == k).sum()) for c in pairs for k in (1, 2, 3, 4)]
    packed = {"n": len(pairs[0]), "keys": _packed_keys(keys[~single]), "counts": _packed(np.concatenate(pairs[:2])), "times": times}
    if len(pairs[0]):
        out.append(pa.table({f.name: pa.array([packed.get(f.name)], f.type) for f in _SUMS if f.name != "bucket"}))
    out = pa.concat_tables(out)
    return out.add_column(0, _SUMS.field("bucket"), pa.array(np.full(out.num_rows, bucket)))


def text_features(ratios: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[texts, 4]: ratio per word, per square root of the number of words, per word in the highest window, and beyond STRONG."""
    out = np.zeros((len(bounds) - 1, 4))
    if len(ratios) == 0:
        return out
    length = np.diff(bounds)
    filled = length > 0
    total = np.append(0.0, np.cumsum(ratios))
    whole = (total[bounds[1:]] - total[bounds[:-1]])[filled]
    out[filled, 0] = whole / length[filled]
    out[filled, 1] = whole / np.sqrt(length[filled])
    at = np.arange(len(total) - 1)
    stop = np.minimum(at + WINDOW, np.repeat(bounds[1:], length))
    out[filled, 2] = np.maximum.reduceat((total[stop] - total[:-1]) / WINDOW, bounds[:-1][filled])
    out[filled, 3] = np.add.reduceat(np.maximum(ratios - STRONG, 0), bounds[:-1][filled]) / np.sqrt(length[filled])
    return out


def discounts(times: list[float]) -> list[float]:
    """Discounts of counts of 0, 1, 2 and more, from how many things were counted 1, 2, 3 and 4 times; half a count if any is missing."""
    if not all(times):
        return [0.0, 0.5, 1.0, 1.5]
    share = times[0] / (times[0] + 2 * times[1])
    return [0.0, *(min(max(k - (k + 1) * share * times[k] / times[k - 1], 0.1), 0.98 * k) for k in (1, 2, 3))]


def _less(count: Column, by: list[float]) -> Column:
    """The count less its discount."""
    return F.when(count == 0, 0.0).when(count == 1, 1 - by[1]).when(count == 2, 2 - by[2]).otherwise(count - by[3])


def _remains(counts: np.ndarray, by: list[float]) -> np.ndarray:
    return counts - np.array(by)[np.minimum(counts, 3).astype(np.int64)]


def _bin(pooled: Column) -> Column:
    return F.when(pooled < 4, pooled.cast("int")).otherwise((4 + F.floor(F.log2(pooled / 4))).cast("int"))


def _bin_of(pooled: np.ndarray) -> np.ndarray:
    return np.where(pooled < 4, pooled, 4 + np.floor(np.log2(np.maximum(pooled, 4) / 4))).astype(np.int64)


@dataclass
class Facts:
    """What holds for all words: a few numbers, whatever the size of the corpus."""

    totals: list[float]  # words by class, toxic and other
    word_discounts: list[list[float]]  # toxic, other, pooled
    pair_discounts: list[list[float]]
    passed: np.ndarray  # [2, bins]: what a class's words of a bin lost to discounts, per pooled occurrence
    left: float  # share of the pooled words left for contexts
    contexts: float  # of all words, each with a half added


@dataclass
class Tables:
    """The models in Spark: ``packed`` (the words and the bigrams of a bucket, a row each), and what holds for all words."""

    packed: DataFrame
    buckets: int
    facts: Facts
    bits: np.ndarray  # which bigrams have an entry

    @property
    def entries(self) -> DataFrame:
        """A row for each word and bigram."""
        return self.packed.mapInArrow(_unfolded, "kind int, key long, toxic double, other double")


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys, columns = _entries_of(row["kind"], row["n"], row["keys"], row["counts"])
            arrays = [np.full(len(keys), row["kind"], np.int32), keys.view(np.int64), *(c.astype(np.float64) for c in columns[:2])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["kind", "key", "toxic", "other"])


def _pack_words(group: pa.Table) -> pa.Table:
    keys = np.array(group.column("key"), np.int64).view(np.uint64)
    order = np.argsort(keys)
    values = np.concatenate([np.array(group.column(n), np.float64)[order] for n in _VALUES])
    row = {"bucket": group.column("bucket")[0].as_py(), "kind": _WORD, "n": len(keys), "keys": _packed_keys(keys[order]), "counts": _packed(values)}
    return pa.table({n: pa.array([row[n]], kind) for n, kind in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)})


def _entries_of(kind: int, n: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys, and what belongs to them, a line for each of _VALUES or _CLASSES."""
    values = _unpacked(counts, np.float64, len(_VALUES) * n) if kind == _WORD else _unpacked(counts, np.int64, 2 * n)
    return _unpacked_keys(keys, n), values.reshape(-1, n)


def fit_tables(labelled: DataFrame, total: int) -> Tables | None:
    """The models of ``text`` and ``toxic`` (0 or 1) for ``total`` bytes of texts to score; None if a class has no words."""
    buckets = max(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // _BUCKET_BYTES)
    with small_batches(labelled.sparkSession):
        sums = kept(labelled.mapInArrow(_counter(buckets), _COUNTS_SQL).groupBy("bucket").applyInArrow(_add_bucket, _SUMS_SQL), "toxic-counts")
    pooled = F.col("toxic") + F.col("other")
    count_of = {"toxic": F.col("toxic"), "other": F.col("other"), "pooled": pooled}
    seen = sums.agg(
        *(F.count(F.when(c == k, 1)).alias(f"word_{n}{k}") for n, c in count_of.items() for k in (1, 2, 3, 4)),
        *(F.coalesce(F.sum(F.col("times")[4 * i + k - 1]), F.lit(0)).alias(f"pair_{n}{k}") for i, n in enumerate(_GROUPS) for k in (1, 2, 3, 4)),
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _CLASSES),
    ).first()
    totals = [float(seen[n]) for n in _CLASSES]
    if not all(totals):
        return None
    word_by, pair_by = ([discounts([seen[f"{of}_{n}{k}"] for k in (1, 2, 3, 4)]) for n in _GROUPS] for of in ("word", "pair"))

    words = sums.where("key is not null").groupBy("key").agg(*(F.sum(n).cast("double").alias(n) for n in _BY_WORD))
    begun = {"toxic": F.col("begun_toxic"), "other": F.col("begun_other"), "pooled": F.col("begun_toxic") + F.col("begun_other")}
    # What the bigrams that a word begins have left after their discounts.
    after = [(begun[n] - sum((F.col(f"{n}{k}") * d[k] for k in (1, 2, 3)), F.lit(0.0))).alias(f"after_{n}") for n, d in zip(_GROUPS, pair_by, strict=True)]
    words = kept(words.select("key", *_VALUES[:3], *after), "toxic-words")
    lost = [F.sum(c - _less(c, d)).alias(f"lost_{n}") for (n, c), d in zip(count_of.items(), word_by, strict=True)]
    bins = words.groupBy(_bin(pooled).alias("bin")).agg(F.sum(pooled).alias("pooled"), F.sum("contexts").alias("contexts"), F.count(F.lit(1)).alias("n"), *lost).collect()
    passed = np.ones((2, 1 + max(row.bin for row in bins)))
    for row in bins:
        # Half an occurrence more, so that no bin is empty for a class.
        passed[:, row.bin] = [(row[f"lost_{n}"] + 0.5) / row.pooled for n in _CLASSES]
    left = sum(row.lost_pooled for row in bins) / sum(totals)
    contexts = sum(row.contexts + 0.5 * row.n for row in bins) + 0.5
    facts = Facts(totals, word_by, pair_by, passed, left, contexts)

    bucket = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(buckets), 32)
    bigrams = sums.where("key is null").select("bucket", F.lit(_BIGRAM).alias("kind"), "n", "keys", "counts")
    with small_batches(labelled.sparkSession):
        words = kept(words.select(bucket.cast("long").alias("bucket"), "key", *_VALUES).groupBy("bucket").applyInArrow(_pack_words, _ENTRIES_SQL), "toxic-entries")
        return Tables(words.union(bigrams), buckets, facts, _bits(bigrams))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of a task's keys, by part."""
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, packed in zip(batch.column("n").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            at = _unpacked_keys(packed, n) >> np.uint64(64 - _BITS)
            # Keys ascend, and so do their parts.
            for x, y in _cuts(at >> np.uint64(_BITS - _BIT_PARTS)):
                bits = parts.setdefault(int(at[x] >> np.uint64(_BITS - _BIT_PARTS)), np.zeros(1 << _BITS - _BIT_PARTS, bool))
                bits[(at[x:y] & np.uint64((1 << _BITS - _BIT_PARTS) - 1)).astype(np.int64)] = True
    for p, bits in parts.items():
        yield pa.record_batch([pa.array([p], pa.int32()), pa.array([_packed(np.packbits(bits))], pa.binary())], names=["part", "bits"])


def _one_part(group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << _BITS - _BIT_PARTS - 3, np.uint8)
    for packed in group.column("bits").to_pylist():
        bits |= _unpacked(packed, np.uint8, len(bits))
    return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def _bits(packed: DataFrame) -> np.ndarray:
    """Table of bits by the first _BITS bits of a key, set for keys that have an entry."""
    parts = packed.select("n", "keys").mapInArrow(_mark, "part int, bits binary").groupBy("part").applyInArrow(_one_part, "part int, bits binary").collect()
    bits = np.zeros((1 << _BIT_PARTS, 1 << _BITS - _BIT_PARTS - 3), np.uint8)
    for row in parts:
        bits[row.part] = np.frombuffer(row.bits, np.uint8)
    return bits.ravel()


def _packed(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes: what is shuffled is mostly small numbers."""
    if len(values) == 0:
        return b""
    return pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind, n: int) -> np.ndarray:
    if n == 0:
        return np.empty(0, kind)
    planes = pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(-1, n).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their steps, whose first bytes are zero where there are many."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64, n), dtype=np.uint64)


def _asker(buckets: int, shipped):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of texts: their ids and words by number, and their distinct words and bigrams, packed by bucket."""
        chunk = TaskContext.get().partitionId() << 32
        ids, hashes, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, code, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            hashes.clear()
            often = np.argsort(-times, kind="stable")
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often), dtype=np.uint32)
            words, code = words[often], rank[code]
            length = np.concatenate(lengths)
            may = ~_begins(np.append(0, np.cumsum(length)), len(code))
            # Bigrams in blocks: beside the chunk's words, only a block's values wait.
            pairs = []
            for x in range(0, len(code), _BLOCK):
                ends = x + np.flatnonzero(may[x : x + _BLOCK])
                place = bigram_keys(words[code[ends - 1]], words[code[ends]]) >> np.uint64(64 - _BITS)
                may[ends] = (shipped.value[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1
                ends = ends[may[ends]]
                pairs.append(np.unique((code[ends - 1].astype(np.int64) << 32) | code[ends]))
            pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
            keys = np.empty(len(pairs), np.uint64)
            for x in range(0, len(pairs), _BLOCK):
                block = pairs[x : x + _BLOCK]
                keys[x : x + _BLOCK] = bigram_keys(words[block >> 32], words[block & 0xFFFFFFFF])
            sink = pa.BufferOutputStream()
            column = pa.chunked_array(ids)
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", column.type)])) as stream:
                stream.write_table(pa.table({"doc_id": column}))
            facts = np.append(len(length), length).astype(np.int64).tobytes() + np.packbits(may).tobytes()
            rows = [(chunk % buckets, chunk, _TEXTS, sink.getvalue().to_pybytes(), facts, _packed(code))]
            for kind, asked in ((_WORD, words), (_BIGRAM, keys)):
                bucket = _buckets_of(asked, buckets)
                order = np.argsort(bucket, kind="stable")
                ranked = bucket[order]
                for x, y in _cuts(ranked):
                    place = order[x:y].astype(np.uint32)
                    rows.append((int(ranked[x]), chunk, kind, asked[order[x:y]].tobytes(), _packed(np.diff(place, prepend=np.uint32(0))), b""))
            return pa.RecordBatch.from_arrays(_table(rows, _PACKED), schema=_PACKED)

        for batch in batches:
            for at, stop, data, offsets in pieces(batch.column("text"), _PIECE):
                words = Words(data, offsets, BY_ALNUM)
                ids.append(batch.column("doc_id").slice(at, stop - at))
                hashes.append(words.hashes)
                lengths.append(np.diff(words.bounds))
                held += len(words.hashes) + stop - at
                if held > _CHUNK:
                    yield flush()
                    chunk += 1
                    ids, hashes, lengths, held = [], [], [], 0
        if ids:
            yield flush()

    return ask


def _answer(asked: pa.Table, entries: pa.Table) -> pa.Table:
    """What a bucket has of the words and bigrams that it is asked for, back to their chunks. Texts pass through."""
    held = {row["kind"]: _entries_of(**row) for row in entries.select(["kind", "n", "keys", "counts"]).to_pylist()}
    out = []
    for row in zip(*(asked.column(n).to_pylist() for n in _PACKED.names), strict=True):
        bucket, chunk, kind, a, b, _ = row
        if kind == _TEXTS:
            out.append(row)
        elif kind in held:
            keys, values = held[kind]
            wanted, place = np.frombuffer(a, np.uint64), np.cumsum(_unpacked(b, np.uint32, len(a) // 8), dtype=np.uint32)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            if hit.any():
                found = np.column_stack([c[at[hit]].astype(np.float64) for c in values])
                # Places ascend within a bucket, so their steps are small.
                steps = _packed(np.diff(place[hit], prepend=np.uint32(0)))
                out.append((bucket, chunk, kind, steps, _packed(found.ravel()), int(hit.sum()).to_bytes(8, "little")))
    return pa.Table.from_arrays(_table(out, _PACKED), schema=_PACKED)


def _scorer(facts: Facts):
    def score(group: pa.Table) -> pa.Table:
        """Features of the texts of a chunk."""
        found = {_WORD: [], _BIGRAM: []}
        for kind, a, b, c in zip(*(group.column(n).to_pylist() for n in ("kind", "a", "b", "c")), strict=True):
            if kind == _TEXTS:
                ids = pa.ipc.open_stream(a).read_all().column("doc_id")
                texts = int(np.frombuffer(b, np.int64, 1)[0])
                bounds = np.append(0, np.cumsum(np.frombuffer(b, np.int64, texts, 8)))
                n = int(bounds[-1])
                may = np.unpackbits(np.frombuffer(b, np.uint8, offset=8 + 8 * texts), count=n).astype(bool)
                code = _unpacked(c, np.uint32, n).astype(np.int64)
            else:
                hits = int.from_bytes(c, "little")
                place = np.cumsum(_unpacked(a, np.uint32, hits), dtype=np.uint32)
                found[kind].append((place, _unpacked(b, np.float64, hits * (len(_VALUES) if kind == _WORD else 2))))
        # Per word: counts by class and pooled, and beside them what the models make of these.
        word = np.zeros((int(code.max()) + 1 if n else 0, len(_VALUES)))
        for place, values in found[_WORD]:
            word[place] = values.reshape(len(place), -1)
        pooled = word[:, 0] + word[:, 1]
        total = sum(facts.totals)
        shared = _remains(pooled, facts.word_discounts[2]) / total + facts.left * (word[:, 2] + 0.5) / facts.contexts
        counts = [word[:, 0], word[:, 1], pooled]
        spare = [np.where(c > 0, np.maximum(1 - word[:, 3 + k] / np.maximum(c, 1), 1e-6), 1.0) for k, c in enumerate(counts)]
        # How much likelier a class has a word than both have it together.
        bins = _bin_of(pooled)
        tilt = []
        for k in (0, 1):
            own = _remains(counts[k], facts.word_discounts[k]) + facts.passed[k][bins] * pooled
            tilt.append(np.where(pooled > 0, own / facts.totals[k] * total / np.maximum(pooled, 1), 1.0))
        ratios = (np.log(tilt[0]) - np.log(tilt[1]))[code]
        begins, alone = _begins(bounds, n), np.log(spare[0]) - np.log(spare[1])
        for x in range(0, n, _BLOCK):
            ends = x + np.flatnonzero(~begins[x : x + _BLOCK])
            ratios[ends] += alone[code[ends - 1]]
        met = np.flatnonzero(may)
        pair = np.empty(len(met), np.int64)
        for x in range(0, len(met), _BLOCK):
            ends = met[x : x + _BLOCK]
            pair[x : x + _BLOCK] = (code[ends - 1] << 32) | code[ends]
        pairs, pair = np.unique(pair, return_inverse=True)
        bigram = np.zeros((len(pairs), 2))
        for place, values in found[_BIGRAM]:
            bigram[place] = values.reshape(len(place), -1)
        found.clear()
        apart, known = np.empty(len(pairs)), np.empty(len(pairs), bool)
        for x in range(0, len(pairs), _BLOCK):
            before, after = pairs[x : x + _BLOCK] >> 32, pairs[x : x + _BLOCK] & 0xFFFFFFFF
            times = [bigram[x : x + _BLOCK, 0], bigram[x : x + _BLOCK, 1], bigram[x : x + _BLOCK].sum(axis=1)]
            part = [_remains(t, d) / np.maximum(c[before], 1) for t, d, c in zip(times, facts.pair_discounts, counts, strict=True)]
            back = part[2] + spare[2][before] * shared[after]
            log = [np.log(part[k] + spare[k][before] * back * tilt[k][after]) for k in (0, 1)]
            known[x : x + _BLOCK] = times[2] > 0  # the bits let some through that have no entry
            apart[x : x + _BLOCK] = log[0] - log[1]
        known = known[pair]
        ratios[met[known]] = apart[pair[known]]
        features = text_features(ratios, bounds)
        return pa.Table.from_arrays([ids, *map(pa.array, features.T.copy())], names=["doc_id", *_FEATURES])

    return score


def _with_features(rows: DataFrame, model: Tables) -> DataFrame:
    """Features of each of ``rows`` (``doc_id`` and ``text``), written slice by slice."""
    bits = rows.sparkSession.sparkContext.broadcast(model.bits)
    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *(f"{n} double" for n in _FEATURES)])
    out = []
    for i in range(SLICES):
        asked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == i).mapInArrow(_asker(model.buckets, bits), _PACKED_SQL)
        answered = asked.groupBy("bucket").cogroup(model.packed.groupBy("bucket")).applyInArrow(_answer, _PACKED_SQL)
        with small_batches(rows.sparkSession):
            features = answered.groupBy("chunk").applyInArrow(_scorer(model.facts), schema)
            out.append(kept(features.repartition(1 + model.buckets // _FILE_BUCKETS), "toxic-features"))
    return reduce(DataFrame.union, out)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights by Newton steps with a small ridge; also mean and spread of the features."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, spread


def _evenly(rows: DataFrame, most: int) -> DataFrame:
    """All rows, or about ``most`` of them, taken evenly by the hash of the id."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * most // n)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score`` from 0 to 1 and ``predicted``.

    Labels are learned only from rows whose fold is not HELD_OUT; fold CURVE fits the curve and the others the models. Labels of
    null ids or null ``toxic`` are left out; of labels that repeat the largest counts. A null text reads as empty; texts without
    words get the curve's value for no evidence. If the labels are empty or name one class only, every score is the share of
    toxic labels (0 without labels). Repeated documents are scored alike; further columns are ignored.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    known = kept(known.withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT), "toxic-labels")
    base = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    train = known.where(F.col("fold") != CURVE)
    train = F.broadcast(train) if train.count() <= MAX_BROADCAST else train
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    model = fit_tables(base.join(train, "doc_id").select("text", "toxic"), total)
    held_out = (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")
    fitted = None
    if model is not None:
        features = _with_features(base, model)
        found = features.join(F.broadcast(_evenly(known.where(F.col("fold") == CURVE), MAX_CURVE)), "doc_id").toArrow()
        y = np.array(found.column("toxic"), np.float64)
        if len(np.unique(y)) == 2:
            fitted = _curve(np.column_stack([np.array(found.column(n)) for n in _FEATURES]), y)
    if fitted is None:
        share = known.agg(F.avg("toxic")).first()[0] or 0.0
        score = F.lit(float(share))
        return base.select("doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    w, mean, spread = fitted
    line = F.lit(float(w[0])) + sum(((F.col(n) - float(m)) / float(s) * float(k) for n, m, s, k in zip(_FEATURES, mean, spread, w[1:], strict=True)), F.lit(0.0))
    scored = features.withColumn("score", 1 / (1 + F.exp(-line)))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
