"""Merkle manifest of a dataset: one tree of documents per source, and one tree over the sources' roots.

Nodes of a level are rows (tree, i, h). Conditional aggregates spread the children of each parent over three columns (slot pivot): the
columns joined are hashed to the parent, and without a child's own slot they are its siblings. A parent that would be alone in its
tree's first level of one node is that node itself.

Levels are taken four at a time. A block of 81 neighbouring nodes goes to one task by (tree, block), and its four levels need no further
shuffle; its top is a node of the next tier. No group is larger than a block, however large a source is. On the way down each tier
adds its siblings to the path of the block's top, so what is shuffled of a path is one row in 81.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.store import kept
from threadloom.operators.spread import number_within

FANOUT, TIER = 3, 4
BLOCK = FANOUT**TIER
SLOTS = [f"slot{k}" for k in range(FANOUT)]
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and itself; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    """The leaf of a document row; ``text`` stands in for its text."""
    columns = [F.col(c) if c != "text" or text is None else text for c in LEAF_FIELDS]
    return F.sha2(F.concat(*map(field, columns)), 256)


def _spread() -> list[Column]:
    """Conditional aggregates: the hash of the child in each slot."""
    return [F.max(F.when(F.expr(f"i % {FANOUT}") == k, F.col("h"))) for k in range(FANOUT)]


def _parent_hash() -> Column:
    alone = (F.col("up") == 0) & F.col(SLOTS[1]).isNull()
    return F.when(alone, F.col(SLOTS[0])).otherwise(F.sha2(F.concat_ws("", *SLOTS), 256))


def tops(nodes: DataFrame) -> DataFrame:
    """The next tier: of each block of ``nodes`` (tree, i, h) the node ``TIER`` levels up, with ``i`` the number of the block."""
    level = nodes.select("tree", F.expr(f"i div {BLOCK}").alias("block"), "i", "h").repartition("tree", "block")
    for _ in range(TIER):
        children = level.withColumn("up", F.expr(f"i div {FANOUT}"))
        spread = [c.alias(name) for c, name in zip(_spread(), SLOTS)]
        level = children.groupBy("tree", "block", "up").agg(*spread).select("tree", "block", F.col("up").alias("i"), _parent_hash().alias("h"))
    return level.select("tree", "i", "h")


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with the ``path`` to their tree's root and beyond: structs ``l`` and ``r``, the siblings left and right of the way up.

    ``above`` has a row (tree, i, path) for each block's top; its further columns pass down.
    """
    rows = nodes.withColumnRenamed("i", "place").withColumnRenamed("h", "own").withColumn("block", F.expr(f"place div {BLOCK}"))
    rows = rows.repartition("tree", "block").withColumns({"i": F.col("place"), "h": F.col("own")})
    steps = []
    for level in range(TIER):
        family = Window.partitionBy("tree", "block", "up")
        rows = rows.withColumn("up", F.expr(f"i div {FANOUT}"))
        rows = rows.withColumns({name: c.over(family) for c, name in zip(_spread(), SLOTS)})
        slot = F.expr(f"i % {FANOUT}")
        left = F.concat_ws("", *[F.when(slot > k, F.col(name)) for k, name in enumerate(SLOTS)])
        right = F.concat_ws("", *[F.when(slot < k, F.col(name)) for k, name in enumerate(SLOTS)])
        alone = (F.col("up") == 0) & F.col(SLOTS[1]).isNull()
        steps.append(f"step{level}")
        rows = rows.withColumn(steps[-1], F.when(~alone, F.struct(left.alias("l"), right.alias("r"))))
        rows = rows.withColumn("h", _parent_hash()).withColumn("i", F.col("up")).drop("up", *SLOTS)
    path = F.concat(F.filter(F.array(*steps), lambda s: s.isNotNull()), F.col("path"))
    joined = rows.drop("i", "h").join(above.withColumnRenamed("i", "block"), ["tree", "block"])
    return joined.withColumn("path", path).drop("block", *steps).withColumnRenamed("place", "i").withColumnRenamed("own", "h")


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """All tiers of a forest, from ``nodes`` (tree, i, h) to the roots, which have i = 0."""
    tiers, last = [nodes], nodes.agg(F.max("i")).first()[0]
    while last:
        tiers.append(kept(tops(tiers[-1].select("tree", "i", "h")), f"{name}-tier"))
        last //= BLOCK
    return tiers


def descend(tiers: list[DataFrame], crown: DataFrame, name: str) -> DataFrame:
    """The nodes of the lowest tier with their paths. ``crown`` has a row (tree, path) for each root; its other columns pass down."""
    above = crown.withColumn("i", F.lit(0).cast("bigint"))
    for tier in reversed(tiers[1:-1]):
        above = kept(paths(tier, above).drop("h"), f"{name}-paths")
    return paths(tiers[0], above)


def proofs(leaves: DataFrame) -> DataFrame:
    """Inclusion proofs of ``leaves`` (doc_id, source, leaf and any columns): adds ``path``, ``subroot`` and ``root``.

    Leaves of a source are in order of doc_id, those of equal ids in order of leaf; a null id comes first. Sources are in order of
    their UTF-8 bytes, a null source first; it is a source of its own. Equal rows are separate leaves. A source of one leaf has that leaf
    as its subroot, and a single source's subroot is the root. An empty table has no proofs. Names of further columns must not be tree,
    i, h, place, own, block, up, path, subroot or root.
    """
    ordered = leaves.withColumn("tree", field(F.col("source"))).withColumn("place", F.struct("doc_id", "leaf"))
    numbered = kept(number_within(kept(ordered, "merkle-leaves"), ["tree"], "place", "i").drop("place"), "merkle-numbered")
    documents = climb(numbered.withColumnRenamed("leaf", "h"), "merkle")
    subroots = documents[-1].select(F.col("tree").alias("of"), F.col("h").alias("subroot"))
    named = numbered.select("source", F.col("tree").alias("of")).distinct()
    sources = subroots.join(named, "of").withColumn("tree", F.lit(""))
    sources = kept(number_within(sources, ["tree"], "source", "i").withColumnRenamed("subroot", "h"), "merkle-sources")
    forest = climb(sources, "merkle-sources")
    nothing = F.array().cast("array<struct<l: string, r: string>>")
    root = forest[-1].select("tree", F.col("h").alias("root"), nothing.alias("path"))
    crown = kept(descend(forest, root, "merkle-sources").select(F.col("of").alias("tree"), F.col("h").alias("subroot"), "root", "path"), "merkle-crown")
    return descend(documents, crown, "merkle").withColumnRenamed("h", "leaf").drop("tree", "i")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["l"], h, step["r"]), 256))


def manifest_check(documents: DataFrame) -> DataFrame:
    """Proofs of all documents, verified against texts of which some were tampered with.

    Where crc32 of the decimal id is even, the tampered text lacks its line ends; a null text or id stays as it is, and so does a
    text of one line, which still verifies. One row per row of ``documents``; columns other than the leaf's are ignored.
    """
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claim = F.when(even & F.contains("text", F.lit("\n")), leaf_hash(F.replace("text", F.lit("\n"), F.lit(""))))
    found = proofs(documents.select("doc_id", "source", leaf_hash().alias("leaf"), claim.alias("claim")))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["l"], step["r"])), "")
    folded = fold(F.coalesce("claim", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def _sql_crc32(text: str) -> str:
    """CRC-32 (polynomial 0xEDB88320, reflected) of a VARCHAR of plain ASCII, in DuckDB."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _sql_leaf(text: str) -> str:
    values = [c if c != "text" else text for c in LEAF_FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT key, doc_id, coalesce('=' || source, '') AS tree, source, leaf, claim,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (
    SELECT row_number() OVER () AS key, doc_id, source, {_sql_leaf("text")} AS leaf,
           CASE WHEN {_sql_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} END AS claim
    FROM documents)),
nodes(tree, level, i, h, n) AS (
  SELECT tree, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), max((n + 2) // 3) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 3),
subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper(level, i, h, n) AS (
  SELECT 0, i, h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), max((n + 2) // 3) FROM upper WHERE n > 1 GROUP BY level, i // 3),
steps AS (
  SELECT a.key, b.level AS place, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i // (3 ** b.level)::BIGINT), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i // (3 ** b.level)::BIGINT), '') AS r
  FROM leaves a JOIN nodes b ON a.tree = b.tree AND b.n > 1 AND b.i // 3 = a.i // (3 ** (b.level + 1))::BIGINT GROUP BY a.key, b.level
  UNION ALL
  SELECT a.key, 1000 + b.level, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < s.i // (3 ** b.level)::BIGINT), ''),
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > s.i // (3 ** b.level)::BIGINT), '')
  FROM leaves a JOIN subroots s ON a.tree = s.tree JOIN upper b ON b.n > 1 AND b.i // 3 = s.i // (3 ** (b.level + 1))::BIGINT GROUP BY a.key, b.level),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place) AS nth FROM steps),
folds(key, nth, h) AS (
  SELECT key, 0, coalesce(claim, leaf) FROM leaves
  UNION ALL
  SELECT f.key, f.nth + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN numbered s ON s.key = f.key AND s.nth = f.nth + 1),
folded AS (SELECT key, arg_max(h, nth) AS folded_root FROM folds GROUP BY key),
proofs AS (SELECT key, string_agg(l || r, '' ORDER BY place) AS siblings FROM steps GROUP BY key)
SELECT a.doc_id, a.leaf, s.h AS subroot, u.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.folded_root, f.folded_root = u.h AS verified
FROM leaves a JOIN subroots s ON a.tree = s.tree JOIN upper u ON u.n = 1 JOIN folded f ON a.key = f.key LEFT JOIN proofs p ON a.key = p.key
"""
