"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages. Passages and benchmark items become TF-IDF vectors over the benchmark's terms, and
these are mapped to a latent space: a distributed randomised SVD (one pass that multiplies the passages' Gram matrix with a random
matrix, then a Nystrom decomposition on the driver) gives the leading directions in which terms vary together over the
whole corpus. A passage whose latent cosine with a part of an item is high enough is a candidate; the longest common subsequence
of item and surrounding words, and a check for the item's last words as its answer, decide.

Words are looked up, counted and projected in tasks; nothing of a document is shuffled, and a document is searched where it is
read. Shuffled are per-term sums only. The benchmark goes to the tasks in blocks of bounded size, a pass over the corpus for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.store import empty, kept, small_batches
from threadloom.llm.words import BY_ALNUM, PIECE, Words, pieces

# Words of a passage and from one passage to the next.
PASSAGE, STRIDE = 24, 12
RANK = 64
# Terms in more than these shares of passages and of items (SEVERAL items at least) have no weight, unless an item has fewer than
# LEAST_TERMS others. What is common in the corpus but not in the benchmark may be so because it has leaked, and keeps its weight.
COMMON, COMMON_ITEMS, SEVERAL, LEAST_TERMS = 0.01, 0.05, 3, 4
COSINE = 0.35
# Share of an item's words found in order: enough alone; enough if the answer is there too, and for the words that have weight.
# Share of the answer's words found.
COVERED, PARAPHRASED, ANSWERED = 0.75, 0.6, 0.75
ANSWER_SHARE, SHORT = 4, 8
# Benchmark text that one pass over the corpus looks for, in bytes.
BLOCK_BYTES = 1 << 20
# Bytes of text whose words are found together.
_PIECE = PIECE >> 2

_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("coverage", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int64())])
_HITS_SQL = "doc_id long, item_id long, cosine double, coverage double, answer double, first_word long"


def common_subsequence(left: list, right: list) -> int:
    """Length of the longest common subsequence, with one bit for each word of ``left``."""
    masks: dict = {}
    for i, word in enumerate(left):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(left)) - 1
    row = full
    for word in right:
        met = row & masks.get(word, 0)
        row = ((row + met) | (row - met)) & full
    return len(left) - row.bit_count()


def contains(words: list, part: list) -> bool:
    return any(words[i : i + len(part)] == part for i in range(len(words) - len(part) + 1))


@dataclass
class Items:
    """A block of the benchmark: its terms (sorted hashes), item ids and words, and later weights, vectors and queries."""

    terms: np.ndarray
    ids: list[int]
    words: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))
    queries: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))
    query_item: list[int] = field(default_factory=list)
    query_at: list[int] = field(default_factory=list)

    @property
    def code(self):
        return np.uint16 if len(self.terms) < 65535 else np.uint32

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 for words that are not in the benchmark."""
        if len(self.terms) == 0:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def read_items(rows: list) -> Items:
    ids, found = [], []
    for row in rows:
        for _, _, data, offsets in pieces(pa.array([row.text], pa.string())):
            words = Words(data, offsets, BY_ALNUM).hashes
            if len(words):
                ids.append(row.item_id)
                found.append(words)
    return Items(np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64), ids, found)


def _encoder(shipped):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as the number of each word's term, plus one; 0 for words that are not in the benchmark."""
        items = Items(**shipped.value)
        for batch in batches:
            for at, stop, data, offsets in pieces(batch.column("text"), _PIECE):
                words = Words(data, offsets, BY_ALNUM)
                codes = (items.find(words.hashes) + 1).astype(items.code)
                cuts = pa.array(words.bounds * codes.itemsize, pa.int64())
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - at, [None, cuts.buffers()[1], pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, stop - at), packed.cast(pa.binary())], names=["doc_id", "terms"])

    return encode


def _texts(batch: pa.RecordBatch, code, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of encoded texts: first row, term of each word (-1 for none), and the range of each text's words."""
    column = batch.column("terms")
    for at in range(0, batch.num_rows, rows):
        part = column.slice(at, rows)
        raw = part.to_pylist()
        term = np.frombuffer(b"".join(raw), code).astype(np.int64) - 1
        yield at, term, np.append(0, np.cumsum([len(r) for r in raw])) // np.dtype(code).itemsize


def _blocks(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word's block of ``size`` words, counted over all texts, and the first block of each text (and the end)."""
    length = np.diff(bounds)
    first = np.append(0, np.cumsum(-(-length // size)))
    nth = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length)
    return np.repeat(first[:-1], length) + nth // size, first


def _term_counter(shipped):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(**shipped.value)
        many, passages = np.zeros(len(items.terms), np.int64), 0
        for batch in batches:
            for _, term, bounds in _texts(batch, items.code):
                block, first = _blocks(bounds, PASSAGE)
                passages += int(first[-1])
                has = term >= 0
                pair = np.sort(block[has] * len(items.terms) + term[has])
                pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
                many += np.bincount(pair % max(len(items.terms), 1), minlength=len(many))
        seen = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, seen)), pa.array(np.append(passages, many[seen]))], names=["term", "n"])

    return count


def _projector(shipped, random):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (A^T A) R for the passages A of the task and the random matrix R, by term."""
        items = Items(**shipped.value)
        weighted = (random.value * items.weights[:, None]).astype(np.float32)
        total = np.zeros(weighted.shape)
        for batch in batches:
            for _, term, bounds in _texts(batch, items.code):
                block, _ = _blocks(bounds, PASSAGE)
                has = (term >= 0) & (items.weights[term] > 0)
                block, term = block[has], term[has]
                if len(term) == 0:
                    continue
                begin = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                sums = np.add.reduceat(weighted[term], begin)
                nth = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(block))))
                order = np.argsort(term, kind="stable")
                ranked = term[order]
                starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
                total[ranked[starts]] += np.add.reduceat(sums[nth[order]], starts)
        seen = np.flatnonzero(total.any(axis=1))
        out = total[seen] * items.weights[seen, None]
        yield pa.RecordBatch.from_arrays([pa.array(seen), *map(pa.array, out.T.copy())], names=["term", *(f"y{i}" for i in range(out.shape[1]))])

    return project


def latent_vectors(product: np.ndarray, random: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Term vectors from Y = G R: Nystrom G ~ F F^T, then an SVD of F; directions count by the root of their spread."""
    shift = 1e-9 * max(float(np.linalg.norm(product)), 1e-12)
    moved = product + shift * random
    middle = random.T @ moved
    values, basis = np.linalg.eigh((middle + middle.T) / 2)
    good = values > max(values.max(), 0) * 1e-10
    factor = moved @ (basis[:, good] / np.sqrt(values[good]))
    directions, spread, _ = np.linalg.svd(factor, full_matrices=False)
    good = spread > (spread.max() if len(spread) else 0) * 1e-3
    return (directions[:, good] / np.sqrt(spread[good]) * weights[:, None]).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-20)


def _searcher(shipped):
    def judge(wanted: list, item: int, region: list, rare: list) -> tuple[float, float, bool]:
        words = wanted[item]
        if len(words) < SHORT:
            found = contains(region, words)
            return float(found), float(found), found
        coverage = common_subsequence(words, region) / len(words)
        kept_words = [w for w, r in zip(words, rare, strict=True) if r]
        if common_subsequence(kept_words, region) < PARAPHRASED * len(kept_words):
            return coverage, 0.0, False
        answer = words[-max(3, len(words) // ANSWER_SHARE) :]
        answered = common_subsequence(answer, region) / len(answer)
        return coverage, answered, coverage >= COVERED or (coverage >= PARAPHRASED and answered >= ANSWERED)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(**shipped.value)
        # Which weighted terms an item has (and none in the last column), how many of its words have weight, and its length.
        own_term = np.zeros((len(items.words), len(items.terms) + 1), bool)
        weighed = np.zeros(len(items.words))
        item_size = np.array([len(w) for w in items.words], np.int64)
        query_item, query_at = np.array(items.query_item, np.int64), np.array(items.query_at, np.int64)
        for item, words in enumerate(items.words):
            found = items.find(words)
            found = found[items.weights[found] > 0]
            own_term[item, found] = True
            weighed[item] = len(found)
        own = own_term.ravel()
        wanted = [items.find(w).tolist() for w in items.words]
        rare = [(items.weights[w] > 0).tolist() for w in wanted]
        for batch in batches:
            ids = batch.column("doc_id")
            for at, term, bounds in _texts(batch, items.code):
                block, first = _blocks(bounds, STRIDE)
                has = (term >= 0) & (items.weights[term] > 0) if len(items.weights) else term >= 0
                weighted = np.where(has, term, len(items.terms))
                sums = np.zeros((int(first[-1]) + 1, items.vectors.shape[1]), np.float32)
                if has.any():
                    blocks = block[has]
                    begin = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
                    sums[blocks[begin]] = np.add.reduceat(items.vectors[term[has]], begin)
                first_word = np.zeros(len(sums), np.int64)
                for_each = np.diff(first)
                first_word[:-1] = np.repeat(bounds[:-1] - first[:-1] * STRIDE, for_each) + np.arange(first[-1]) * STRIDE
                # A passage is two blocks of one text; the last block of a text also stands alone.
                last = np.zeros(len(sums), bool)
                last[first[1:][first[1:] > first[:-1]] - 1] = True
                passage = sums.copy()
                passage[:-1][~last[:-1]] += sums[1:][~last[:-1]]
                rows: list[tuple] = []
                best: dict[tuple[int, int], tuple] = {}
                close = np.empty((0, 2), np.int64)
                cosines = np.empty(0)
                if len(items.queries) and len(passage) > 1:
                    like = _unit(passage[:-1]) @ items.queries.T
                    close = np.argwhere(like >= COSINE)
                    cosines = like[close[:, 0], close[:, 1]]
                text = np.searchsorted(first, close[:, 0], "right") - 1
                item = query_item[close[:, 1]] if len(close) else np.empty(0, np.int64)
                begin = first_word[close[:, 0]] - query_at[close[:, 1]] if len(close) else item
                low, high = np.maximum(begin - STRIDE, bounds[text]), np.minimum(begin + item_size[item] + PASSAGE, bounds[text + 1])
                # The judge wants PARAPHRASED of the item's weighted words in order; where the region has fewer in any order, they cannot be.
                met = np.zeros(len(close), np.int64)
                # Longest regions first: the n-th words of all that have as many are a leading stretch.
                size = high - low
                longest = np.argsort(-size)
                place, owner = low[longest], item[longest] * own_term.shape[1]
                counted = np.zeros(len(close), np.int64)
                for n in np.searchsorted(-size[longest], -np.arange(int(size.max(initial=0)))).tolist():
                    counted[:n] += own.take(owner[:n] + weighted.take(place[:n]))
                    place[:n] += 1
                met[longest] = counted
                enough = (met >= PARAPHRASED * weighed[item]) | (item_size[item] < SHORT)
                cosines = cosines[enough]
                found = zip(*(x[enough].tolist() for x in (text, item, low, high)), strict=True)
                for k, (doc, item, low, high) in enumerate(found):
                    coverage, answered, leaked = judge(wanted, item, term[low:high].tolist(), rare[item])
                    if leaked:
                        old = best.get((doc, item))
                        new = (coverage, answered, float(cosines[k]), low - int(bounds[doc]))
                        if old is None or new > old:
                            best[doc, item] = new
                for (doc, item), (coverage, answered, cosine, low) in sorted(best.items()):
                    rows.append((ids[at + doc].as_py(), items.ids[item], cosine, coverage, answered, low))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

    return search


def _prepare(items: Items, docs: DataFrame, rank: int, seed: int) -> Items:
    """Weights, latent vectors and queries of a block of items, from statistics over all documents."""
    context = docs.sparkSession.sparkContext
    counted = docs.mapInArrow(_term_counter(context.broadcast(vars(items))), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (np.array(counted.column(c), np.int64) for c in ("term", "n"))
    passages = int(n[term == -1].sum())
    many = np.zeros(len(items.terms), np.int64)
    many[term[term >= 0]] = n[term >= 0]
    own_items = np.bincount(np.concatenate([np.unique(items.find(words)) for words in items.words]), minlength=len(items.terms))
    idf = np.log(np.maximum((1 + passages) / (1 + many), (1 + len(items.ids)) / (1 + own_items))) + 1e-9
    weighed = (many <= COMMON * passages) | (own_items <= max(COMMON_ITEMS * len(items.ids), SEVERAL))
    for words in items.words:
        own = np.unique(items.find(words))
        if weighed[own].sum() < LEAST_TERMS:
            weighed[own[np.argsort(many[own], kind="stable")[:LEAST_TERMS]]] = True
    items.weights = np.where(weighed, idf, 0.0)
    random = np.random.default_rng(seed).standard_normal((len(items.terms), min(rank, len(items.terms))))
    columns = [f"y{i}" for i in range(random.shape[1])]
    projected = docs.mapInArrow(_projector(context.broadcast(vars(items)), context.broadcast(random)), "term long, " + ", ".join(f"{c} double" for c in columns))
    summed = projected.groupBy("term").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    product = np.zeros(random.shape)
    product[np.array(summed.column("term"), np.int64)] = np.column_stack([np.array(summed.column(c), np.float64) for c in columns]) if summed.num_rows else 0
    items.vectors = latent_vectors(product, random, items.weights)
    queries = []
    for item, words in enumerate(items.words):
        term = items.find(words)
        size = -(-len(words) // -(-len(words) // PASSAGE))
        for low in range(0, len(words), size):
            queries.append(items.vectors[term[low : low + size]].sum(axis=0))
            items.query_item.append(item)
            items.query_at.append(low)
    items.queries = _unit(np.array(queries, np.float32).reshape(len(queries), -1)).astype(np.float32)
    return items


def leaks(documents: DataFrame, benchmark: DataFrame, rank: int = RANK, seed: int = 7) -> DataFrame:
    """A row for each document and benchmark item that it holds, whole or paraphrased.

    Columns: ``doc_id``, ``item_id``, ``cosine``, ``coverage`` (share of the item's words found in order), ``answer`` (the same for
    its last words) and ``first_word`` (where the searched words begin, from 0). Items and texts without words match nothing; items of
    fewer than SHORT words must stand together. Null texts read as empty; documents or items with a null id are searched and come
    with that null. Repeated documents or items give repeated rows. An empty benchmark or table gives no rows. Further columns are
    ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = kept(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "benchmark")
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES)
    found = empty(spark, _HITS)
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES of text
        items = read_items(sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text or "")))
        if items.ids:
            # Texts are read once; what follows reads the terms.
            with small_batches(spark):
                coded = kept(docs.mapInArrow(_encoder(spark.sparkContext.broadcast(vars(items))), "doc_id long, terms binary"), "benchmark-terms")
            items = _prepare(items, coded, rank, seed)
            found = found.union(coded.mapInArrow(_searcher(spark.sparkContext.broadcast(vars(items))), _HITS_SQL))
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a benchmark item. Documents with a null id stay."""
    return documents.join(leaks(documents, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)
