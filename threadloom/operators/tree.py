"""Content trees kept as parent-child rows: name collisions and full paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.spread import hash_block, lookup, number_within
from threadloom.session import fresh_path, written


def suffixed_name(name: Column, repeat: Column, is_dir: Column) -> Column:
    """The first use of a name keeps it; repeat n gets (n), for files in front of the extension."""
    number = F.concat(F.lit("("), repeat.cast("string"), F.lit(")"))
    ext = F.regexp_extract(name, r"(\.[^.]*)\z", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(repeat == 0, name).when(is_dir, F.concat(name, number)).otherwise(F.concat(base, number, ext))


def dedupe_names(nodes: DataFrame) -> DataFrame:
    """Add ``repeat`` and ``final_name`` to nodes (parent_id, key, type, name); order within a folder is by ``key``.

    Keys are unique within their folder.
    """
    numbered = number_within(nodes, ["parent_id", "name"], "key", "repeat")
    return numbered.withColumn(
        "final_name", suffixed_name(F.col("name"), F.col("repeat"), F.col("type") == "folder")
    )


def _counted(rows: DataFrame, path: str, what: Column) -> int:
    """Write ``rows``; for how many ``what`` holds."""
    seen = Observation()
    rows.observe(seen, F.count_if(what).alias("n")).write.parquet(path)
    return seen.get["n"]


def climb(steps: DataFrame, merged: dict[str, Column], name: str) -> DataFrame:
    """Follow the ``up`` pointers of all nodes to their tops by pointer doubling.

    ``steps`` has ``id``, ``up`` (NULL at a top, else the id of a row) and any columns. In each round every open node takes over the
    pointer of the node that it points to and merges its columns with that node's: ``merged`` gives them as expressions over own columns
    and those above, prefixed ``above_``; columns not named in it come from above. A chain of d nodes takes log2(d) rounds, and a round
    writes only nodes that are still open. A node that no round brings to a top is in a cycle or hangs on one; it keeps its ``up``.
    """
    spark = steps.sparkSession
    base = fresh_path(spark, name)
    others = [c for c in steps.columns if c != "id"]
    layout = T.StructType([*steps.schema.fields, T.StructField("round", T.LongType())])
    n_open, number = None, 0
    still = _counted(steps, f"{base}/round=0", F.col("up").isNotNull())
    while True:
        # Files of a round hold the nodes that were open before it; those that it left open are in the last round.
        rows = spark.read.schema(layout).parquet(base)
        rows = rows.where(F.col("up").isNull() | (F.col("round") == number)).drop("round")
        if still == 0 or still == n_open:
            return rows
        n_open, number = still, number + 1
        above = rows.select(F.col("id").alias("up"), *[F.col(c).alias(f"above_{c}") for c in others])
        met = lookup(rows.where(F.col("up").isNotNull()), above, ["up"], hash_block("id"))
        values = [merged.get(c, F.col(f"above_{c}")).alias(c) for c in others]
        still = _counted(met.select("id", *values), f"{base}/round={number}", F.col("up").isNotNull())


def folder_paths(tree: DataFrame, named: DataFrame) -> DataFrame:
    """Folders with the root they hang on, their ``path`` and ``walk``, and ``protected``.

    ``up`` is set for folders in a cycle or below one, and ``root`` is NULL for those that hang on a missing folder. A folder placed in a
    directory that already carries its id stays in that directory.
    """
    spark = tree.sparkSession
    last = lambda path: F.element_at(F.split(path, "/"), -1)
    nothing, no_walk = F.lit(None).cast("string"), F.array().cast("array<string>")
    top = tree.where((F.col("parent_id") == "") & (F.col("type") == "folder")).select(
        "id", nothing.alias("up"), F.col("id").alias("root"), F.col("id").alias("path"), no_walk.alias("walk"),
        _protected().alias("protected"), F.lit(False).alias("alike"),
    )
    inner = named.where(F.col("type") == "folder").select("id", "parent_id", "key", "final_name", _protected().alias("protected"))
    seats = top.select("id", last(F.col("id")).alias("seat")).unionByName(inner.select("id", last(F.col("final_name")).alias("seat")))
    seated = lookup(inner, seats.withColumnRenamed("id", "parent_id"), ["parent_id"], hash_block("id"), "left")
    inner = seated.select(
        "id", F.when(F.col("seat").isNotNull(), F.col("parent_id")).alias("up"), nothing.alias("root"),
        F.concat(F.lit("/"), "final_name").alias("path"), F.array("key").alias("walk"), "protected",
        F.coalesce(F.col("seat") == F.col("id"), F.lit(False)).alias("alike"),
    )
    rows, path = top.unionByName(inner), fresh_path(spark, "tree-folders")
    n_alike = _counted(rows, path, F.col("alike"))
    folders = spark.read.schema(rows.schema).parquet(path)
    if n_alike:
        # A folder is alike if its id is the name of the folder above. If that one stays in its directory, the directory's name is
        # another, so along a chain of such folders every second one stays.
        alike = folders.where("alike").select("id", "up")
        chained = alike.join(alike.select(F.col("id").alias("up"), F.lit(True).alias("more")), "up", "left")
        chains = climb(chained.select("id", F.when(F.col("more"), F.col("up")).alias("up"), F.lit(1).cast("bigint").alias("n")), {"n": F.col("n") + F.col("above_n")}, "tree-alike")
        stays = chains.where("n % 2 = 1").select("id", F.lit(True).alias("stays"))
        folders = folders.join(stays, "id", "left").withColumn("path", F.when(F.col("stays"), "").otherwise(F.col("path"))).drop("stays")
    merged = {"path": F.concat("above_path", "path"), "walk": F.concat("above_walk", "walk"), "protected": F.col("protected")}
    return climb(folders.drop("alike"), merged, "tree-paths")


def _named(tree: DataFrame) -> DataFrame:
    """All nodes below a root with their final names."""
    # A root folder uses up its own name among its children, so it counts as the first of them.
    own = tree.where((F.col("parent_id") == "") & (F.col("type") == "folder")).select(
        F.col("id").alias("parent_id"), F.lit("").alias("key"), F.col("name"), F.lit(True).alias("_seat")
    )
    below = tree.where(F.col("parent_id") != "").withColumn("_seat", F.lit(False))
    return written(dedupe_names(below.unionByName(own, allowMissingColumns=True)).where(~F.col("_seat")).drop("_seat"), "tree-names")


def flatten_tree(tree: DataFrame) -> DataFrame:
    """Files of each root with their full folder path and their place in a depth-first walk (``walk_key``).

    ``tree`` has id, parent_id ('' for a root), key, type, name, link, size, md5, password, password_status. Folders find their root
    and path by pointer doubling against folders only: a tree of any depth takes the logarithm of it in joins. Files look
    their folder up in one join. A root with a protected root or folder is left out whole. Nodes that hang on no root are left
    out here and listed by tree_faults().
    """
    named = _named(tree)
    rooted = folder_paths(tree, named).where("up IS NULL AND root IS NOT NULL")
    barred = rooted.where("protected").select("root").distinct()
    paths = lookup(rooted, barred, ["root"], hash_block("id"), "left_anti")
    files = lookup(
        named.where(F.col("type") != "folder"),
        paths.select(F.col("root").alias("root_id"), F.col("id").alias("parent_id"), "path", "walk"),
        ["parent_id"],
        hash_block("id"),
    ).select(
        "root_id", "id", "path", F.col("final_name").alias("filename"), "link", "size", "md5",
        F.concat("walk", F.array("key")).alias("walk_key"),
    )
    single = tree.where((F.col("parent_id") == "") & (F.col("type") != "folder") & ~_protected()).select(
        F.col("id").alias("root_id"), "id", F.col("id").alias("path"), F.col("name").alias("filename"), "link", "size",
        "md5", F.array().cast("array<string>").alias("walk_key"),
    )
    return files.unionByName(single)


def tree_faults(tree: DataFrame) -> DataFrame:
    """Nodes that hang on no root: ``id`` and ``reason``, 'cycle' (they are in one, or below one) or 'no parent'.

    A parent that is a file is none. Protected roots are no fault.
    """
    named = _named(tree)
    reason = F.when(F.col("up").isNotNull(), "cycle").when(F.col("root").isNull(), "no parent").otherwise("").alias("reason")
    state = folder_paths(tree, named).select("id", reason)
    files = lookup(
        named.where(F.col("type") != "folder").select("id", "parent_id"), state.withColumnRenamed("id", "parent_id"), ["parent_id"], hash_block("id"), "left"
    )
    return state.unionByName(files.select("id", F.coalesce("reason", F.lit("no parent")).alias("reason"))).where("reason != ''")


def name_clashes(nodes: DataFrame) -> DataFrame:
    """Final names that more than one node of a folder ends up with: ``parent_id``, ``final_name``, ``n_nodes`` and ``first_key``.

    Numbered repeats can meet a name that is there as it stands: ``a``, ``a`` and ``a(1)`` give ``a(1)`` twice, and the later file
    replaces the earlier one when a folder is written out.
    """
    return (
        dedupe_names(nodes).groupBy("parent_id", "final_name").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("key").alias("first_key")).where("n_nodes > 1")
    )


def _protected() -> Column:
    """A password is set and has not been accepted."""
    return (F.col("password") != "") & (F.col("password_status") != "") & (F.col("password_status") != "passwordOk")
