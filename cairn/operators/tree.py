"""Traversal of a directory tree, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.cut import cut


def walk(children: DataFrame, root: DataFrame, limit: int) -> DataFrame:
    """All nodes below ``root`` (inode, kind), itself included: entry, inode, kind, parent, name, path, depth, place.

    ``children``: parent, entry, inode, name (bytes), kind. ``place`` is the array of entries on the way; sorting by it
    is pre-order in the order on disk. ``limit`` is the number of directories: a deeper tree has a cycle.
    """
    level = root.select(F.lit(None).cast("long").alias("entry"), "inode", "kind", F.lit(None).cast("long").alias("parent"), F.lit(b"").alias("name"), F.lit(b"").alias("path"), F.lit(0).alias("depth"), F.array().cast("array<long>").alias("place"))
    level = cut(level)
    levels = [level]
    while True:
        above = level.filter("kind = 'directory'").select(F.col("inode").alias("parent"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("place").alias("_place"))
        below = children.join(above, "parent")
        path = F.concat("_path", F.lit(b"/"), "name")
        level = cut(below.select("entry", "inode", "kind", "parent", "name", path.alias("path"), (F.col("_depth") + 1).alias("depth"), F.concat("_place", F.array("entry")).alias("place")))
        if level.isEmpty():
            break
        levels.append(level)
        if len(levels) > limit + 1:
            raise ValueError("the directories form a cycle")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def rebuilt_links(members: DataFrame, entries: DataFrame, directories: int) -> DataFrame:
    """``inode, parent_entry, self_entry`` of each directory, from which entries name it; the root has 0 and 0.

    ``members``: parent, entry; ``entries``: entry, inode. The first naming entry, 0 only for want of another, and the
    last parent win.
    """
    named = members.join(entries.filter((F.col("inode") > 0) & (F.col("inode") < directories)), "entry")
    own = named.groupBy("inode").agg(F.coalesce(F.min(F.when(F.col("entry") > 0, F.col("entry"))), F.lit(0).cast("long")).alias("self_entry"), F.max("parent").alias("parent"))
    above = own.select(F.col("inode").alias("parent"), F.col("self_entry").alias("parent_entry"))
    links = own.join(above, "parent", "left").select("inode", F.coalesce("parent_entry", F.lit(0)).cast("long").alias("parent_entry"), "self_entry")
    root = entries.sparkSession.range(1).select(F.col("id").alias("inode"), F.lit(0).cast("long").alias("parent_entry"), F.lit(0).cast("long").alias("self_entry"))
    return links.unionByName(root)
