"""Merkle manifest of a table: a tree of hashes for each group of rows, one over the groups' trees, and a proof for each row.

Levels are tables. The rows of a level have an index in their group; those whose index has the same quotient by the fanout are
a run, gathered as one sorted array and hashed into a row of the next level, until a group has one node left. The way back goes
from the root down: a run meets the path of its parent and each of its nodes gets that path with its siblings in front, so
that a level costs one join of its runs, not of all rows. No rows are gathered beyond a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenfold.llm.common import stored

OWN = ("index", "subroot", "root", "path")
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """The hash of a row's values: each is ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value, so that no two
    rows of different values are written alike. Numbers are decimal."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def indexed(rows: DataFrame) -> DataFrame:
    """(g, at, digest, row) with each row's index from 0 in its group by (at, digest) and the group's size n.

    Rows are dealt by ranges of that order and kept, so that no task sees a whole group; equal rows are dealt by their place in
    the input. What stands before a range is a sum over one row for each range and group.
    """
    order = ["g", "at", "digest"]
    placed = rows.withColumn("copy", F.monotonically_increasing_id())
    dealt = stored(placed.repartitionByRange(*order, "copy").drop("copy").withColumn("range", F.spark_partition_id()), "leaves", "zstd")
    sizes = dealt.groupBy("g", "range").agg(F.count("*").alias("here"))
    own = Window.partitionBy("g")
    before = sizes.select("g", "range", (F.sum("here").over(own.orderBy("range")) - F.col("here")).alias("before"), F.sum("here").over(own).alias("n"))
    place = F.row_number().over(Window.partitionBy("g", "range").orderBy("at", "digest"))
    return dealt.withColumn("index", place).join(before, ["g", "range"]).select("g", (F.col("index") - 1 + F.col("before")).alias("index"), "n", "digest", "row")


def runs(nodes: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """(g, up, n, nodes): the runs of a level, each with its nodes in order."""
    node = F.struct("index", "digest", *carried)
    return nodes.groupBy("g", F.floor(F.col("index") / fanout).alias("up")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(node), lambda a, b: (a["index"] - b["index"]).cast("int")).alias("nodes"))


def above(level: DataFrame, fanout: int) -> DataFrame:
    """The next level: a node for each run; the lone node of a group is the same node there."""
    joined = F.array_join(F.transform("nodes", lambda x: x["digest"]), "")
    return level.select("g", F.col("up").alias("index"), F.ceil(F.col("n") / fanout).alias("n"), F.when(F.col("n") > 1, F.sha2(joined, 256)).otherwise(F.col("nodes")[0]["digest"]).alias("digest"))


def below(level: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of a level's runs with their paths: the step in their run, and then their parent's (g, index, path, ...)."""
    texts = F.transform("nodes", lambda x: x["digest"])
    met = level.join(paths.withColumnRenamed("index", "up"), ["g", "up"])
    node = met.withColumn("texts", texts).select("*", F.posexplode("nodes").alias("place", "node"))
    step = F.struct(F.array_join(F.slice("texts", F.lit(1), F.col("place")), "").alias("before"), F.array_join(F.slice("texts", F.col("place") + 2, F.size("texts")), "").alias("after"))
    path = F.when(F.col("n") > 1, F.concat(F.array(step), "path")).otherwise(F.col("path"))
    return node.select("g", F.col("node.index").alias("index"), path.alias("path"), *(c for c in paths.columns if c not in ("g", "index", "path")), "node")


def forest(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """From (g, index, n, digest, row): the runs of each level, and the nodes that are left of groups after each level."""
    levels, ends = [stored(runs(leaves, fanout, "row"), "runs", "zstd")], []
    while True:
        nodes = above(levels[-1], fanout)
        ends.append(nodes.where("n = 1").select("g", "index", "digest"))
        more = nodes.where("n > 1")
        if more.isEmpty():
            return levels, ends
        levels.append(stored(runs(more, fanout), "runs", "zstd"))


def descend(levels: list[DataFrame], ends: list[DataFrame]) -> DataFrame:
    """(g, index, path, ..., node) of every leaf, from the paths (g, index, path, ...) of the nodes that were left."""
    paths = ends[-1]
    for level, end in zip(levels[:0:-1], ends[-2::-1], strict=True):
        paths = below(level, paths).drop("node").unionByName(end)
    return below(levels[0], paths)


def manifest(df: DataFrame, group_col: str = "lang", id_col: str = "doc_id", leaf_col: str = "leaf", fanout: int = 8) -> DataFrame:
    """All columns of the input with (index long, subroot string, root string, path array<struct<before, after>>): the row's
    place in its group by id, the roots of the group's tree and of the tree over all groups, and the siblings on the way to the
    root, those before and those after, level by level. Input columns of those names are replaced.

    A group's rows ascend by id (null ids first) and then by leaf; groups ascend bytewise, null first. Every ``fanout`` nodes
    make one, the last run may be shorter; a lone node is the root itself and has an empty path. Rows with the same id are leaves
    of their own; equal rows get neighbouring places in any order. A table without rows has no rows.
    """
    if fanout < 2:
        raise ValueError("a run needs two nodes")
    base = df.drop(*OWN)
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null stands before all texts
    leaves = indexed(base.select(group.alias("g"), F.col(id_col).alias("at"), F.col(leaf_col).alias("digest"), F.struct(*(F.col(f"`{c}`") for c in base.columns)).alias("row")))
    levels, ends = forest(leaves, fanout)
    tops = ends[0]
    for e in ends[1:]:
        tops = tops.unionByName(e)
    tops = stored(tops, "subroots")
    over = indexed(tops.select(F.lit("").alias("g"), F.col("g").alias("at"), "digest", F.struct("g").alias("row")))
    high, (*_, last) = forest(over, fanout)
    start = [last.where("false").select("g", "index", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))] * (len(high) - 1)
    start.append(last.select("g", "index", F.array().cast(STEP).alias("path"), F.col("digest").alias("root")))
    named = stored(descend(high, start).select(F.col("node.row.g").alias("g"), F.col("node.digest").alias("subroot"), "root", "path"), "subroots")
    found = descend(levels, [e.drop("digest").join(named, "g").select("g", "index", "path", "subroot", "root") for e in ends])
    return found.select("node.row.*", "index", "subroot", "root", "path")


def proof(path: Column | str) -> Column:
    """The hash of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: Column | str) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def verified(df: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, folded_root, verified): rows of another copy of the table (keys, leaf) against a manifest's paths, one to one by
    keys; a row that the manifest lacks has no folded root and is not verified."""
    paths = found.select(*keys, "path", "root")
    folded = F.when(F.col("path").isNotNull(), fold(F.col("leaf"), "path"))
    return df.join(paths, list(keys), "left").select(*keys, folded.alias("folded_root"), F.coalesce(folded == F.col("root"), F.lit(False)).alias("verified"))
