"""Connected components by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenfold.llm.common import release, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a long, b long); component: the least id reachable.

    In each round every root hangs itself under its least neighbour, pointers are followed once more, and the edges are
    carried over to the new roots. Stars take one round and paths in any mixed order few; a path whose ids ascend all along
    loses only two of its nodes in a round, for which ``alternating`` is the better way.
    Loops and repeated edges are harmless; rows with a null end are ignored; no edges give no rows.
    """
    flat = edges.where("a IS NOT NULL AND b IS NOT NULL")
    labels = stored(flat.select("a").union(flat.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("component")), "labels")
    left = stored(flat.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not left.isEmpty():
        under = left.select(F.col("a").alias("to"), F.col("b").alias("root")).union(left.select(F.col("b").alias("to"), F.col("a").alias("root")))
        first = stored(under.groupBy("root").agg(F.least(F.min("to"), F.col("root")).alias("parent")), "parents")
        above = first.select(F.col("root").alias("parent"), F.col("parent").alias("grand"))
        parent = stored(first.join(above, "parent", "left").select("root", F.coalesce("grand", "parent").alias("parent")), "parents")
        named = stored(labels.join(parent, labels.component == parent.root, "left").select("id", F.coalesce("parent", "component").alias("component")), "labels")
        a, b = (parent.select(F.col("root").alias(x), F.col("parent").alias(f"to_{x}")) for x in "ab")
        moved = left.join(a, "a").join(b, "b").where("to_a <> to_b")
        carried = stored(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        release(labels, left, first, parent)
        labels, left = named, carried
    release(left)
    return labels


def alternating(edges: DataFrame) -> DataFrame:
    """The same by alternating large-star and small-star (Kiveris and others, 2014): (id, component) of every id in ``edges``.

    Large-star hangs a node's greater neighbours under the least of its neighbourhood, small-star its lesser ones and itself;
    neither parts what is connected. They alternate until the edges stay as they are: then each node hangs under the
    least of its component. A neighbourhood is a minimum and a join, never gathered, so a node may have any number of neighbours.
    """
    flat = edges.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = flat.select("a").union(flat.select("b")).distinct().select(F.col("a").alias("id"))
    left = stored(flat.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(left)
    while True:
        both = left.union(left.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(under, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(moved.union(under).distinct(), "edges")
        release(left, large)
        left, before, mark = after, mark, _mark(after)
        if mark == before:
            return nodes.join(left, nodes.id == left.u, "left").select("id", F.coalesce("v", "id").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart: their number and two sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit((1 << 31) - 1)))).first())
