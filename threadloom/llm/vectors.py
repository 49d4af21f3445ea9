"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a rotation, the vectors are cut into blocks of few dimensions; if two
vectors are within the whole distance, some block of theirs is within its share of the squared distance, in proportion to
its dimensions. So each block is range-joined alone, and the union of what is found is verified exactly.

The range join of a block puts vectors into a grid on its first dimensions, with cells twice as wide as the radius. A vector lies in
its home cell, and is copied to those neighbours that it is within the radius of. A pair is looked at where one of the two is at home,
and only in the first block that it is close in, so each direction of a link is counted once and nothing needs to be made distinct.

Equal vectors are one node, with a count. Cells that hold more rows than one task should compare are cut into chunks of home
vectors and chunks of copies. Tasks give back the number of links of each vector and the links that join components, never
all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.graph import components
from threadloom.llm.store import kept

COSINE = 0.98
BLOCKS = 8
# Vectors of one label that a cell of the shuffle should hold, rows above which a task cuts a cell, and rows of a task's share.
CELL_ROWS, CELL_AIM, SHARE_ROWS = 8192, 200, 4096

_PLACED = pa.schema(
    [("label", pa.int64()), ("block", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_()), ("node", pa.binary()), ("n", pa.int64()), ("vec", pa.binary())]
)
_PLACED_SQL = "label long, block int, cell long, home boolean, node binary, n long, vec binary"
_FOUND_SQL = "a binary, b binary, n long"


def _rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated. Summed in a fixed order, so that a vector gets the same values in every task."""
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        total += vectors[:, k] * vectors[:, k]
    unit = vectors / np.sqrt(total)[:, None]
    turn, out = _rotation(vectors.shape[1]), np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k, None] * turn[k]
    return out


def _edges(size: int, blocks: int) -> list[int]:
    """Where blocks begin and end."""
    blocks = min(blocks, size)
    return [size * i // blocks for i in range(blocks + 1)]


def _unpack(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, width)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids with a node (digest of label and vector) and the vector; both null where the row links with nothing."""
    for batch in batches:
        nodes, vecs = [], []
        embedding = batch.column("embedding")
        values = embedding.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        known = embedding.values.is_valid().to_numpy(zero_copy_only=False)
        offsets, valid = np.asarray(embedding.offsets), embedding.is_valid().to_numpy(zero_copy_only=False)
        for i, label in enumerate(batch.column("label").to_pylist()):
            low, high = offsets[i], offsets[i + 1]
            x = values[low:high]
            # Scaled first, so that very large or small components neither overflow nor vanish when squared.
            if label is None or not valid[i] or high == low or not known[low:high].all() or not np.isfinite(x).all() or not x.any():
                nodes.append(None)
                vecs.append(None)
                continue
            raw = x.tobytes()
            nodes.append(hashlib.blake2b(label.to_bytes(8, "little", signed=True) + raw, digest_size=16).digest())
            vecs.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "label", "node", "vec"])


def _scaled(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def _cells(x: np.ndarray, radius: float, dims: int, seed: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Keys of the cells that vectors lie in (first, and marked) or are copied to; one cell for all if ``dims`` is 0."""
    scaled = x[:, :dims] / (2 * radius)
    own = np.floor(scaled).astype(np.int64)
    side = np.where(scaled - own < 0.5, -1, 1)
    for corner in range(1 << dims):
        moved = own + side * np.array([corner >> d & 1 for d in range(dims)], np.int64)
        key = np.full(len(x), seed, np.uint64)
        for d in range(dims):
            key = (key ^ moved[:, d].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        yield key.view(np.int64), corner == 0


def _radius(width: int, low: int, high: int, distance: float) -> float:
    return float(np.sqrt(distance * (high - low) / width)) * (1 + 1e-6)


def _placer(width: int, blocks: int, grid: int, distance: float, with_vectors: bool):
    edges = _edges(width, blocks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                x = _rotated(_scaled(_unpack(piece.column("vec").to_pylist(), width)))
                for b, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for key, home in _cells(x[:, low:high], _radius(width, low, high, distance), min(grid, high - low), b + 1):
                        vec = piece.column("vec") if with_vectors else pa.nulls(len(x), pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [piece.column("label"), pa.array(np.full(len(x), b, np.int32)), pa.array(key), pa.array(np.full(len(x), home)), piece.column("node"), piece.column("n"), vec], schema=_PLACED
                        )

    return place


def _near_cells(x: np.ndarray, at_home: np.ndarray, compared: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inside a task, the same grid again on more dimensions: home rows of each cell with the rows that lie in it or beside it."""
    if len(at_home) == 0 or len(compared) == 0:
        return
    dims = min(x.shape[1], 3 if len(compared) > CELL_AIM else 0)
    mine, _ = next(_cells(x[at_home], radius, dims, 0))
    copies = [key for key, _ in _cells(x[compared], radius, dims, 0)]
    theirs, rows = np.concatenate(copies), np.tile(compared, len(copies))
    order, back = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
    mine, at_home, theirs, rows = mine[order], at_home[order], theirs[back], rows[back]
    begin = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
    left, right = np.searchsorted(theirs, mine[begin], "left"), np.searchsorted(theirs, mine[begin], "right")
    for low, high, a, b in zip(begin, np.append(begin[1:], len(mine)), left, right, strict=True):
        for start in range(low, high, 512):
            for other in range(a, b, 8192):
                yield at_home[start : min(start + 512, high)], rows[other : min(other + 8192, b)]


def _joiner(width: int, blocks: int, cosine: float, distance: float):
    edges = _edges(width, blocks)
    budgets = [distance * (high - low) / width * (1 + 1e-9) for low, high in zip(edges[:-1], edges[1:], strict=True)]

    def join(group: pa.Table) -> pa.Table:
        vectors = _unpack(group.column("vec").to_pylist(), width)
        turned = _rotated(_scaled(vectors))
        length = np.sqrt((_scaled(vectors) ** 2).sum(axis=1))
        unit = _scaled(vectors) / length[:, None]
        nodes, times = group.column("node").to_pylist(), np.array(group.column("n"), np.int64)
        home, compared = np.array(group.column("home")), np.array(group.column("far"))
        names = {node: i for i, node in enumerate(dict.fromkeys(nodes))}
        number = np.array([names[node] for node in nodes])
        keys = np.column_stack([np.array(group.column(c), np.int64) for c in ("label", "block", "cell", "x", "y")])
        order = np.lexsort(keys.T[::-1])
        keys = keys[order]
        cuts = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))), len(keys)).tolist()
        links = np.zeros(len(names), np.int64)
        parent = np.arange(len(names))
        joined = []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return int(i)

        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[low:high]
            b = int(keys[low, 1])
            dims = slice(edges[b], edges[b + 1])
            for near_rows, rows in _near_cells(turned[:, dims], rows[home[rows]], rows[compared[rows]], _radius(width, dims.start, dims.stop, distance)):
                near, far = turned[near_rows, dims], turned[rows, dims]
                apart = (near**2).sum(axis=1)[:, None] + (far**2).sum(axis=1) - 2 * near @ far.T
                i, j = np.nonzero(apart <= budgets[b] + 1e-6)
                i, j = near_rows[i], rows[j]
                differ = number[i] != number[j]
                i, j = i[differ], j[differ]
                first = np.ones(len(i), bool)
                for e in range(b + 1):
                    total = np.zeros(len(i))
                    for d in range(edges[e], edges[e + 1]):
                        total += (turned[i, d] - turned[j, d]) ** 2
                    first &= (total <= budgets[e]) == (e == b)
                i, j = i[first], j[first]
                linked = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                i, j = i[linked], j[linked]
                np.add.at(links, number[i], times[j])
                for p, q in np.unique(np.column_stack([number[i], number[j]]), axis=0).tolist():
                    p_root, q_root = root(p), root(q)
                    if p_root != q_root:
                        parent[p_root] = q_root
                        joined.append((p, q))
        every = list(names)
        counted = np.flatnonzero(links)
        a = [every[i] for i in counted.tolist()] + [every[p] for p, _ in joined]
        other = [None] * len(counted) + [every[q] for _, q in joined]
        n = [*links[counted].tolist(), *([0] * len(joined))]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(other, pa.binary()), "n": pa.array(n, pa.int64())})

    return join


def _links(nodes: DataFrame, width: int, cosine: float, blocks: int) -> DataFrame:
    """Links of nodes of one vector length: (a, null, n) how many vectors a links with, (a, b, 0) links that join components."""
    distance = 2 - 2 * cosine
    total, largest = nodes.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    # A cell side covers about a third of the values of one dimension of random unit vectors. Tasks cut cells further.
    grid = 0 if largest <= CELL_ROWS else min(-(-width // blocks), int(np.ceil(np.log(largest / CELL_ROWS) / np.log(3))))
    rows = total * min(blocks, width) << grid
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // SHARE_ROWS)
    key = ["label", "block", "cell"]
    counted = nodes.mapInArrow(_placer(width, blocks, grid, distance, False), _PLACED_SQL)
    counted = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.sum(F.col("home").cast("long")).alias("homes"))
    crowded = kept(counted.where(F.col("copies") > 2 * CELL_ROWS), "crowded-cells")
    placed = nodes.mapInArrow(_placer(width, blocks, grid, distance, True), _PLACED_SQL)
    if crowded.isEmpty():
        placed = placed.withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    else:
        # Chunk x of the home vectors meets chunk y of all rows: a home vector goes to every y, any row to every x.
        deal = F.xxhash64("node")
        xs, ys = (F.coalesce(F.ceil(F.col(c) / CELL_ROWS), F.lit(1)) for c in ("homes", "copies"))
        cut = placed.join(crowded, key, "left").withColumn("xs", xs).withColumn("ys", ys)
        own_x = F.when(F.col("home"), F.pmod(deal, "xs"))
        own_y = F.pmod(F.xxhash64("node", F.lit(1)), F.col("ys"))
        spread = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda j: F.struct(i.alias("x"), j.alias("y"))))))
        cut = cut.withColumn("own_x", own_x).withColumn("own_y", own_y).withColumn("to", spread)
        cut = cut.where((F.col("to.x") == F.col("own_x")) | (F.col("to.y") == F.col("own_y")))
        cut = cut.withColumn("home", F.col("home") & (F.col("to.x") == F.col("own_x"))).withColumn("far", F.col("to.y") == F.col("own_y"))
        placed = cut.withColumn("x", F.col("to.x")).withColumn("y", F.col("to.y"))
    if "far" not in placed.columns:
        placed = placed.withColumn("far", F.lit(True))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(*key, "x", "y"), F.lit(parts)))
    return placed.select("part", *key, "x", "y", "home", "far", "node", "n", "vec").groupBy("part").applyInArrow(_joiner(width, blocks, cosine, distance), _FOUND_SQL)


def vector_components(embeddings: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors link if their labels are equal and not null, they are equally long, and their cosine in double precision is ``cosine`` or
    more. Vectors that are null, empty or zero or hold null or non-finite components link with nothing and are components of their
    own. Rows that repeat are vectors of their own; if they repeat an id, so do their results. A null id never names a
    component; if a component has no other, its id is null and ``kept`` false. Further columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = kept(rows.mapInArrow(_reader, "vec_id long, label long, node binary, vec binary"), "vectors")
    nodes = read.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    nodes = kept(nodes, "vector-nodes")
    found = spark.createDataFrame([], _FOUND_SQL)
    for row in nodes.select((F.octet_length("vec") / 8).cast("int").alias("width")).distinct().sort("width").collect():
        same = nodes.where(F.octet_length("vec") == row.width * 8).select("node", "label", "vec", "n")
        found = found.union(kept(_links(same, row.width, cosine, blocks), "vector-links"))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    comp = components(found.where("b is not null").select("a", "b"))
    named = nodes.select("node", "n", "least").join(degree, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "comp").select("node", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = read.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
