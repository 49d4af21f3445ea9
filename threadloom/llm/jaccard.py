"""N-gram Jaccard join of whole texts, and the components of its links.

Every text becomes its set of word n-grams. Two texts link when |a & b| / |a | b| reaches the threshold. All n-grams are ordered
by how many texts have them, rarest first; texts that link must share one of their first n - ceil(t n) + 1 n-grams, the prefix.

1. Each task cuts its texts into chunks, drops exact copies inside a chunk and sends the n-grams, packed by hash bucket, to
   be counted. Only n-grams that a second text has come back to their chunk: the others cannot be shared. A text whose prefix
   is made up of n-grams of its own alone is out; the others are kept as rare-first arrays.
2. Equal sets are one node. Nodes meet on prefix n-grams. In a first pass every node of a posting list is paired with one
   leader of that list only, so a list that a third of all texts are in gives a row per text, not all pairs. Linked nodes form
   components; the next pass takes one node per component and list. At last, nodes that still meet in different components
   are compared block by block inside tasks, which give links only, so that no link between components is lost.
3. Pairs pass the length, positional and suffix filters and are verified once, on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.graph import components
from threadloom.llm.store import empty, kept, small_batches
from threadloom.llm.words import BY_SPACE, Words, grams, pieces

WORDS, PERCENT = 5, 75
# Text per hash bucket when n-grams are counted; the number of buckets follows the size of the input.
BUCKET_BYTES = 4 << 20
LEADER_PASSES = 2
# n-grams of a block when what is left of a cluster is compared.
MATCH_GRAMS = 500_000
_PARTS = 4

_PACKED = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_PACKED_SQL = "key long, chunk long, kind int, a binary, b binary, c binary"
_SETS = pa.schema(
    [("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), *((f"q{i}", pa.int32()) for i in range(_PARTS)), ("own", pa.int32()), ("central", pa.float64()), ("hashes", pa.list_(pa.int64()))]
)
_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_SETS_SQL = "doc_id long, node binary, n int, " + ", ".join(f"q{i} int" for i in range(_PARTS)) + ", own int, central double, hashes array<long>"


def prefix_length(n, percent: int):
    """n - ceil(t n) + 1, for columns and arrays alike."""
    return n - (n * percent + 99) // 100 + 1


def text_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words has its whole sequence, one without words nothing."""
    words = Words(data, offsets, BY_SPACE)
    runs = grams(words.hashes, size)
    sets = []
    for low, high in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if high - low >= size:
            found = np.sort(runs[low : high - size + 1])
            sets.append(found[np.append(True, found[1:] != found[:-1])])
        else:
            sets.append(grams(words.hashes[low:high], high - low) if high > low else runs[:0])
    return sets


def _emitter(size: int, buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id")
            for at, stop, data, offsets in pieces(batch.column("text")):
                rows: list[tuple] = []
                sets = text_sets(data, offsets, size)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in sets]
                seen: set[bytes] = set()
                values, owners = [], []
                facts = np.zeros((len(sets), 1 + _PARTS), np.uint32)
                for i, s in enumerate(sets):
                    facts[i, 0] = len(s)
                    if len(s):
                        facts[i, 1:] = np.bincount(s & np.uint64(_PARTS - 1), minlength=_PARTS)
                        if digests[i] not in seen:
                            seen.add(digests[i])
                            values.append(s)
                            owners.append(np.full(len(s), i, np.uint16))
                block = ids.slice(at, stop - at)
                known = np.array(block.is_valid(), np.uint8)
                rows.append((chunk % buckets, chunk, 1, np.array(block.fill_null(0), np.int64).tobytes(), facts.tobytes(), known.tobytes() + b"".join(d.ljust(16, b"\0") for d in digests)))
                if values:
                    value, owner = np.concatenate(values), np.concatenate(owners)
                    bucket = ((value >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    order = np.argsort(bucket.astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")
                    bucket, value, owner = bucket[order], value[order], owner[order]
                    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
                    low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint8)
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                        rows.append((int(bucket[x]), chunk, 0, np.diff(owner[x:y], prepend=np.uint16(0)).tobytes(), low[x:y].tobytes(), high[x:y].tobytes()))
                chunk += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

    return emit


def _count_bucket(group: pa.Table) -> pa.Table:
    """n-grams of a bucket that two chunks or more have, back to their chunks with their counts. Document lists pass through."""
    columns = group.to_pydict()
    out: list[tuple] = []
    packed = []
    for key, chunk, kind, a, b, c in zip(*(columns[n] for n in _PACKED.names), strict=True):
        if kind == 1:
            out.append((key, chunk, kind, a, b, c))
        else:
            packed.append((chunk, np.cumsum(np.frombuffer(a, np.uint16), dtype=np.uint16), np.frombuffer(b, np.uint32), np.frombuffer(c, np.uint8)))
    if packed:
        key = columns["key"][0]
        value = np.concatenate([(hi.astype(np.uint64) << np.uint64(32)) | lo for _, _, lo, hi in packed])
        order = np.argsort(value)
        ranked = value[order]
        begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        times = np.diff(np.append(begin, len(ranked)))
        count = np.empty(len(value), np.uint32)
        count[order] = np.repeat(times, times)
        at = 0
        for chunk, owner, lo, hi in packed:
            own = count[at : at + len(lo)]
            at += len(lo)
            shared = own > 1
            if shared.any():
                out.append((key, chunk, 0, owner[shared].tobytes(), lo[shared].tobytes(), hi[shared].tobytes() + own[shared].tobytes()))
    return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_PACKED)], schema=_PACKED)


def _collector(percent: int):
    def collect(group: pa.Table) -> pa.Table:
        """The texts of a chunk; those that can link have their shared n-grams, rarest first."""
        columns = group.to_pydict()
        owners, values, counts = [np.empty(0, np.uint16)], [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for key, kind, a, b, c in zip(*(columns[n] for n in ("key", "kind", "a", "b", "c")), strict=True):
            if kind == 1:
                ids = np.frombuffer(a, np.int64)
                facts = np.frombuffer(b, np.uint32).reshape(-1, 1 + _PARTS).astype(np.int32)
                known = np.frombuffer(c, np.uint8, len(ids)).astype(bool)
                nodes = [c[len(ids) + 16 * i : len(ids) + 16 * i + 16] for i in range(len(ids))]
            else:
                n = len(a) // 2
                owners.append(np.frombuffer(a, np.uint16))
                values.append((np.int64(key) << np.int64(40)) | (np.frombuffer(c, np.uint8, n).astype(np.int64) << 32) | np.frombuffer(b, np.uint32).astype(np.int64))
                counts.append(np.frombuffer(c, np.uint32, offset=n) if n % 4 == 0 else np.frombuffer(c[n:], np.uint32))
        owner, value, count = np.concatenate(owners), np.concatenate(values), np.concatenate(counts)
        size = facts[:, 0]
        shared = np.bincount(owner, minlength=len(ids))
        own = size - shared
        # How many texts share an n-gram of this text on average: highest for the text that near copies are made from.
        central = (np.bincount(owner, count, minlength=len(ids)) + own) / np.maximum(size, 1)
        alive = (own < prefix_length(size, percent)) & (size > 0)
        keep = alive[owner]
        owner, value, count = owner[keep], value[keep], count[keep]
        order = np.lexsort((value, count, owner))
        lengths = np.where(alive, shared, 0)
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        hashes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(~alive, False)), pa.array(value[order]))
        arrays = [
            pa.array(ids, pa.int64(), mask=~known),
            pa.array([d if n else None for d, n in zip(nodes, size.tolist(), strict=True)], pa.binary()),
            *(pa.array(facts[:, i]) for i in range(1 + _PARTS)),
            pa.array(own.astype(np.int32)),
            pa.array(central),
            hashes,
        ]
        return pa.Table.from_arrays(arrays, schema=_SETS)

    return collect


def ngram_sets(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per document: id, ``node`` (digest of its set, null if empty), ``n``, part sizes, and ``own`` and ``hashes`` where it can link."""
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(1 << 22, max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64, total // BUCKET_BYTES))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(_emitter(size, buckets), _PACKED_SQL)
    shared = packed.groupBy("key").applyInArrow(_count_bucket, _PACKED_SQL)
    with small_batches(documents.sparkSession):
        return kept(shared.groupBy("chunk").applyInArrow(_collector(percent), _SETS_SQL), "ngram-sets")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for name in ("x", "y"):
            column = batch.column(name)
            sides.append((np.asarray(column.offsets), np.asarray(column.values)))
        (ox, vx), (oy, vy) = sides
        both = np.empty(batch.num_rows, np.int32)
        for i in range(batch.num_rows):
            merged = np.sort(np.concatenate((vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]])))
            both[i] = np.count_nonzero(merged[1:] == merged[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(both)], names=["a", "b", "na", "nb", "both"])


def _can_link(percent: int) -> Column:
    """Length, positional and suffix filters on two members ``l`` and ``r`` of a posting list.

    ``least`` is the smallest overlap that links. At the first n-gram that two rare-first arrays share, no more than what
    follows in both can be shared beside it. And sets whose parts (by hash) differ in size by d in all differ in d n-grams.
    """
    n1, n2 = F.col("l.n"), F.col("r.n")
    least = F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)
    length = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    position = F.least(n1 - F.col("l.pos"), n2 - F.col("r.pos")) >= least
    apart = sum((F.abs(F.col(f"l.q{i}") - F.col(f"r.q{i}")) for i in range(_PARTS)), F.lit(0))
    return length & position & (apart <= n1 + n2 - 2 * least)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Pairs with ``linked``; each is compared once, on whole sets."""
    side = lambda node, n, hashes: sets.select(F.col("node").alias(node), F.col("n").alias(n), F.col("hashes").alias(hashes))
    joined = pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")
    checked = joined.mapInArrow(_verify, "a binary, b binary, na int, nb int, both int")
    linked = F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent
    with small_batches(sets.sparkSession):
        return kept(checked.select("a", "b", linked.alias("linked")), name)


def _matcher(percent: int):
    def match(group: pa.Table) -> pa.Table:
        """Links between two blocks of a cluster, or inside one: of those, only what joins components."""
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        nodes, comps = group.column("node").to_pylist(), group.column("comp").to_pylist()
        block = np.array(group.column("block"))
        sets = [np.asarray(h.values) for h in group.column("hashes")]
        size = np.array(group.column("n"), np.int64)
        right = np.flatnonzero(block == j)
        owner = np.repeat(np.arange(len(right)), [len(sets[k]) for k in right])
        value = np.concatenate([sets[k] for k in right]) if len(right) else np.empty(0, np.int64)
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while x in parent:
                x = parent[x]
            return x

        found = []
        for k in np.flatnonzero(block == i).tolist():
            low, high = np.searchsorted(value, sets[k], "left"), np.searchsorted(value, sets[k], "right")
            times = high - low
            at = np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
            both = np.bincount(owner[at], minlength=len(right))
            for m in right[both * 100 >= (size[k] + size[right] - both) * percent].tolist():
                x, y = root(comps[k]), root(comps[m])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((nodes[k], nodes[m]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return match


def _links_between(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that still meet in a list.

    Nodes that lists connect form a cluster. A cluster is cut into blocks of about MATCH_GRAMS n-grams, and any two blocks are
    compared in one task, which gives links and no other pairs. A cluster of one block costs a row per node.
    """
    first = members.groupBy("h").agg(F.min("node").alias("b"))
    cluster = components(members.join(first, "h").select(F.col("node").alias("a"), "b"))
    rows = members.select("node", "comp").distinct().join(cluster.withColumnRenamed("comp", "cluster"), "node").join(sets.select("node", "n", "hashes"), "node")
    rows = kept(rows, "clusters")
    cut = rows.groupBy("cluster").agg(F.ceil(F.sum("n") / MATCH_GRAMS).alias("blocks"))
    rows = rows.join(cut, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n", "hashes")
    return kept(rows.groupBy("cluster", "i", "j").applyInArrow(_matcher(percent), "a binary, b binary"), "links-between")


def set_components(sets: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``comp`` of all nodes that link with another. ``sets`` has one row per node that can link."""
    spark = sets.sparkSession
    fields = ["node", "n", "pos", *(f"q{i}" for i in range(_PARTS)), "central"]
    prefix = F.expr(f"slice(hashes, 1, n - CAST(ceil(n * {percent} / 100.0D - 1e-9) AS INT) + 1 - own)")
    members = sets.where("own < n").select(F.posexplode(prefix).alias("pos", "h"), "node", "n", "own", *fields[3:])
    members = members.withColumn("pos", F.col("own") + F.col("pos")).withColumn("comp", F.col("node")).select("h", "comp", *fields)
    links = empty(spark, _LINKS)
    done = empty(spark, _LINKS.append(pa.field("linked", pa.bool_())))
    for nth in range(LEADER_PASSES + 1):
        mixed = members.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("h")
        members = kept(members.join(mixed, "h"), "postings")
        if members.isEmpty():
            break
        if nth == LEADER_PASSES:
            links = links.union(_links_between(members, sets, percent))
            break
        # The most central text leads a list first, then any.
        deal = F.xxhash64("node", F.lit(nth)).alias("deal")
        member = F.struct(F.col("central").alias("first") if nth == 0 else deal, deal, *fields)
        one = members.groupBy("h", "comp").agg(F.max(member).alias("l"))
        leader = one.groupBy("h").agg(F.max("l").alias("r"))
        met = one.join(leader, "h").where(F.col("l.node") != F.col("r.node")).where(_can_link(percent))
        counted = met.groupBy(F.col("l.node").alias("from"), F.col("r.node").alias("to")).agg(F.count(F.lit(1)).alias("times"))
        best = counted.groupBy("from").agg(F.max(F.struct("times", "to")).alias("best"))
        pairs = best.select(F.least("from", "best.to").alias("a"), F.greatest("from", "best.to").alias("b")).distinct()
        checked = _verified(pairs.join(done, ["a", "b"], "left_anti"), sets, percent, "verified")
        done, links = done.union(checked), links.union(checked.where("linked").select("a", "b"))
        label = components(links).select("node", F.col("comp").alias("new"))
        members = members.join(label, "node", "left").withColumn("comp", F.coalesce("new", "comp")).select("h", "comp", *fields)
    return components(links)


def jaccard_components(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links, its own included.

    Null, empty and blank texts have no n-grams and link with nothing; a text of fewer than ``size`` words is one n-gram. A null id
    takes part in links but is never the smallest; alone, its component is null. Rows that repeat are separate documents with the
    same result. An empty table gives an empty table. Further columns are ignored. ``percent`` is the similarity in hundredths.
    """
    sets = ngram_sets(documents, size, percent)
    nodes = sets.where(F.col("hashes").isNotNull()).drop("doc_id").dropDuplicates(["node"])
    label = set_components(kept(nodes, "ngram-nodes"), percent)
    named = kept(
        sets.select("doc_id", "n", "node").join(label, "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("comp")), "ngram-components"
    )
    smallest = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "comp", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id")
    )


def jaccard_join(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies: all columns of ``documents``, rows whose id is the group's smallest, once.

    Documents without n-grams stay, and so do those with a null id.
    """
    found = jaccard_components(documents, size, percent).where("doc_id != component_id").select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti")
