"""The property graph as vertex and edge tables: lookups, traversals, projection and integrity, all as joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lumenfold.operators.relational import held, shared_by_all, top_k

#: Edge types by credit type.
EDGES = {"ACTOR": "ACTED_IN", "DIRECTOR": "DIRECTED", "WRITER": "WROTE", "PRODUCER": "PRODUCED"}


def by_newest(df: DataFrame, limit: int, *, key: str = "work") -> DataFrame:
    """The graph store's order: newest first, works without a date before all."""
    return df.orderBy(F.desc_nulls_first("start_date"), key).limit(limit)


def persons_by_name(people: DataFrame, names: Sequence[str]) -> DataFrame:
    return people.where(F.col("name").isin(list(names)))


def works_of(edges: DataFrame, person) -> DataFrame:
    """(work, type) of a person, distinct; two roles in one work are two rows."""
    return edges.where(F.col("person") == person).select("work", "type").distinct()


def works_shared(edges: DataFrame, people: Sequence) -> DataFrame:
    return shared_by_all(edges, "work", "person", people)


def collaborators(edges: DataFrame, person, kind: str = "ACTED_IN") -> DataFrame:
    """(other, works array, strength): who played in the same works. The person's works are the small side."""
    acts = edges.where(F.col("type") == kind).select("work", "person").distinct()
    mine = acts.where(F.col("person") == person).select("work")
    rows = acts.join(mine, "work").where(F.col("person") != person)
    return rows.groupBy(F.col("person").alias("other")).agg(F.array_sort(F.collect_set("work")).alias("works")).withColumn("strength", F.size("works").cast("long"))


def related_by_people(edges: DataFrame, work, without: str = "PRODUCED") -> DataFrame:
    """(related, via array, strength): works with a person in common, once a person and role in the other work."""
    rows = edges.where(F.col("type") != without)
    people = rows.where(F.col("work") == work).select("person").distinct()
    others = rows.join(people, "person").where(F.col("work") != work)
    return others.groupBy(F.col("work").alias("related")).agg(F.collect_set(F.struct("person", "type")).alias("via")).withColumn("strength", F.size("via").cast("long"))


def related_by_artists(features: DataFrame, songs: DataFrame, work) -> DataFrame:
    """(related, artists): works whose songs have an artist in common. ``features``: (work, song); ``songs``: (song, artist)."""
    artists = features.where(F.col("work") == work).join(songs, "song").select("artist").distinct()
    theirs = songs.join(artists, "artist").join(features, "song").where(F.col("work") != work)
    return theirs.groupBy(F.col("work").alias("related")).agg(F.countDistinct("artist").alias("artists"))


def ordered_union(credits: DataFrame, people: Sequence) -> DataFrame:
    """(work, rank): works of several people, person by person and in order, each once."""
    order = credits.sparkSession.createDataFrame([(p, i) for i, p in enumerate(people)], "person long, place int")
    first = credits.join(F.broadcast(order), "person").groupBy("work").agg(F.min("place").alias("place"))
    return first.withColumn("rank", F.row_number().over(Window.orderBy("place", "work")).cast("long")).select("work", "rank")


def traverse(edges: DataFrame, start, depth: int = 1, limit: int = 20, second: int = 5, fan: int = 10, relations: Sequence[str] | None = None) -> DataFrame:
    """(node, hop): bounded traversal over (src, dst, type). The second hop expands ``second`` nodes by at most ``fan`` each,
    never returns to a visited node, and ``limit`` nodes are kept."""
    rows = edges if relations is None else edges.where(F.col("type").isin(list(relations)))
    seen = rows.where(F.col("src") == start).where(F.col("dst") != start).select(F.col("dst").alias("node")).distinct().orderBy("node").limit(limit).withColumn("hop", F.lit(1).cast("long"))
    if depth > 1:
        frontier = seen.orderBy("node").limit(second).select(F.col("node").alias("src"))
        fresh = rows.join(frontier, "src").select("src", "dst").distinct()
        place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        found = fresh.withColumn("n", place).where(F.col("n") <= fan).select(F.col("dst").alias("node")).where(F.col("node") != start).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(found.withColumn("hop", F.lit(2).cast("long"))).orderBy("hop", "node").limit(limit)
    return seen


def project(works: DataFrame, credits: DataFrame, features: DataFrame, songs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of all works: vertices (label, id), edges (src_label, src, type, dst_label, dst)."""

    def vertex(label: str, df: DataFrame, c: str) -> DataFrame:
        return df.where(F.col(c).isNotNull()).select(F.lit(label).alias("label"), F.col(c).cast("string").alias("id")).distinct()

    def edge(df: DataFrame, a: tuple[str, str], kind, b: tuple[str, str]) -> DataFrame:
        s = lambda c: F.col(c).cast("string")
        return df.where(F.col(a[1]).isNotNull() & F.col(b[1]).isNotNull()).select(F.lit(a[0]).alias("src_label"), s(a[1]).alias("src"), kind.alias("type"), F.lit(b[0]).alias("dst_label"), s(b[1]).alias("dst")).distinct()

    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in EDGES.items() for x in kv)), F.col("credit_type")), F.lit("CREDITED_IN"))
    vertices = vertex("Drama", works, "work").unionByName(vertex("Broadcaster", works, "channel")).unionByName(vertex("Person", credits, "person")).unionByName(vertex("Song", features, "song")).unionByName(vertex("Artist", songs, "artist")).distinct()
    edges = edge(works, ("Drama", "work"), F.lit("AIRED_ON"), ("Broadcaster", "channel")).unionByName(edge(credits, ("Person", "person"), kind, ("Drama", "work"))).unionByName(edge(features, ("Drama", "work"), F.lit("HAS_SONG"), ("Song", "song"))).unionByName(edge(songs, ("Song", "song"), F.lit("PERFORMED_BY"), ("Artist", "artist")))
    return vertices, edges


def to_rebuild(canonical: DataFrame, graph: DataFrame) -> DataFrame:
    """Works that the graph lacks or has in an older version."""
    g = graph.select("id", F.col("version").alias("has"))
    return canonical.join(g, "id", "left").where("has IS NULL OR has < version").select("id")


def replaced(edges: DataFrame, fresh: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after the changed works' were replaced and the unpublished ones' dropped."""
    out = changed.select("work").unionByName(gone.select("work")).distinct()
    return edges.join(out, "work", "left_anti").unionByName(fresh)


def orphans(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return vertices.join(ends, "id", "left_anti")


def integrity(edges: DataFrame, works: DataFrame) -> DataFrame:
    """One row: works, edges, edges without a work, works without a channel, the greatest degree."""
    known = works.select("work").distinct()
    degree = edges.groupBy("person").count().agg(F.max("count").alias("max_degree"))
    lost = edges.join(known, "work", "left_anti").agg(F.count("*").alias("orphans"))
    total = works.agg(F.countDistinct("work").alias("works"), F.count_if(F.col("channel").isNull()).alias("no_channel"))
    return total.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(lost).crossJoin(degree)


def integrity_errors(stats: dict[str, int], published: int, max_degree: int = 500) -> tuple[list[str], list[str]]:
    """(errors, warnings) for the figures of ``integrity``."""
    errors = [f"{stats['works']} works in the graph, {published} published"] if stats["works"] != published else []
    if stats["orphans"]:
        errors.append(f"{stats['orphans']} edges without a work")
    warnings = [f"{stats['no_channel']} works without a channel"] if stats["no_channel"] else []
    if stats["max_degree"] > max_degree:
        warnings.append(f"a person has {stats['max_degree']} edges")
    return errors, warnings


def communities(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, label): label propagation; each vertex takes its neighbours' most frequent label, the least of equal ones."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").count()
        labels = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label")).withColumnRenamed("src", "id")
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b), the least id that is reachable; loops and repeated edges are harmless.

    Large-star and small-star in turn (Kiveris and others, 2014): a node's greater neighbours are hung under the least of its
    neighbourhood, then its lesser ones and itself. The number of rounds grows with the logarithm of a path's length, where
    passing labels on would take its length. Neighbourhoods are minima and joins, so a node may have any number of neighbours.
    """
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    left = held(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    h = F.xxhash64("u", "v")
    mark = [F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit((1 << 31) - 1)))]  # equal for equal sets of edges
    before, after = None, tuple(left.agg(*mark).first())
    while before != after:
        both = left.union(left.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = held(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        left = held(large.join(under, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(under).distinct())
        before, after = after, tuple(left.agg(*mark).first())
    return held(nodes.join(left, nodes.id == left.u, "left").select("id", F.coalesce("v", "id").alias("component")))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity): the share of the edges (src, dst, undirected, each once) that lie within a community, less the share that would
    if edges were dealt at random among vertices of the same degrees. Null without edges."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    a, b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst"))
    named = both.join(a, "src").join(b, "dst")
    of = named.groupBy(F.col("src_label").alias("label")).agg(F.count("*").alias("ends"), F.count_if(F.col("src_label") == F.col("dst_label")).alias("inside"))
    total = of.agg(F.sum("ends").alias("all"))
    part = F.col("inside") / F.col("all") - F.pow(F.col("ends") / F.col("all"), 2)
    return of.crossJoin(F.broadcast(total)).agg(F.sum(part).alias("modularity"))


def settled_communities(edges: DataFrame, patience: int = 4, most: int = 50) -> DataFrame:
    """(id, label): label propagation until it settles. A vertex takes the label that is most frequent among its neighbours and
    itself, the least of equal ones; the vertices of either half, by a hash, move in turn, so that two neighbours do not swap labels
    for ever. It ends when neither half moves, or when modularity has not grown for ``patience`` rounds, and gives the labels
    of the greatest modularity seen. Labels are held from round to round; votes are counted before they are shuffled, and a hub's
    edges are rows of a join, which is split where it is skewed."""
    both = held(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    labels = held(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    best, top, since, still = labels, modularity(both, labels).first().modularity, 0, 0
    for n in range(most):
        theirs = both.join(labels.withColumnRenamed("id", "dst"), "dst").select("src", "label")
        votes = theirs.union(labels.select("id", "label")).groupBy("src", "label").count()
        won = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("won"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == n % 2
        next_ = labels.join(won, labels.id == won.src).select("id", F.when(turn, F.col("won")).otherwise(F.col("label")).alias("label"), (turn & (F.col("won") != F.col("label"))).alias("moved"))
        next_ = held(next_)
        still = 0 if next_.where("moved").head(1) else still + 1
        labels = next_.select("id", "label")
        if still == 2:
            break
        if still == 0:
            now = modularity(both, labels).first().modularity
            best, top, since = (labels, now, 0) if now > top else (best, top, since + 1)
            if since == patience:
                break
    return best


def similar_works(works: DataFrame, sets: dict[str, DataFrame], work, weights: dict[str, float], k: int = 20) -> DataFrame:
    """(related, one column for each feature, score) of the k works most like a given one. ``works``: (work, channel, year);
    ``sets``: (work, member) of cast, genres, artists and so on, each row once. A set's feature is the Jaccard similarity of the two works'
    members, ``year`` is 1 / (1 + years between them), ``channel`` whether it is the same; the score is their sum by ``weights``.

    Only works that share a member of a set are compared: each set is joined with the given work's own members, so no pairs of other
    works come up."""
    found = None
    for name, rows in sets.items():
        own = rows.where(F.col("work") == work).select("member").distinct()
        mine = own.agg(F.count("*").alias("mine"))
        shared = rows.where(F.col("work") != work).join(own, "member").groupBy("work").agg(F.count("*").alias("shared"))
        size = rows.join(shared.select("work"), "work", "left_semi").groupBy("work").agg(F.count("*").alias("size"))
        like = F.col("shared") / (F.col("size") + F.col("mine") - F.col("shared"))
        part = shared.join(size, "work").crossJoin(F.broadcast(mine)).select("work", F.lit(name).alias("set"), like.alias("like"))
        found = part if found is None else found.unionByName(part)
    by_work = found.groupBy("work").agg(*(F.coalesce(F.max(F.when(F.col("set") == name, F.col("like"))), F.lit(0.0)).alias(name) for name in sets))
    given = works.where(F.col("work") == work).select(F.col("channel").alias("own_channel"), F.col("year").alias("own_year")).limit(1)
    met = by_work.join(works, "work").crossJoin(F.broadcast(given))
    near = F.coalesce(1.0 / (1 + F.abs(F.col("year") - F.col("own_year"))), F.lit(0.0))
    same = F.coalesce((F.col("channel") == F.col("own_channel")).cast("double"), F.lit(0.0))
    features = {**{name: F.col(name) for name in sets}, "year": near, "channel": same}
    score = sum((weights.get(name, 0.0) * c for name, c in features.items()), F.lit(0.0))
    rows = met.select(F.col("work").alias("related"), *(c.alias(name) for name, c in features.items()), F.round(score, 6).alias("score"))
    return top_k(rows, k, F.desc("score"), F.asc("related"))


def collaboration_scores(acts: DataFrame) -> DataFrame:
    """(a, b, score): works in common, each weighted by 1 / (cast - 1). All pairs of a cast, which is as many as a work credits."""
    size = acts.groupBy("work").agg(F.count("*").alias("cast"))
    rows = acts.join(size.where("cast > 1"), "work")
    other = rows.select("work", F.col("person").alias("b"))
    return rows.select("work", F.col("person").alias("a"), "cast").join(other, "work").where("a < b").groupBy("a", "b").agg(F.sum(1 / (F.col("cast") - 1)).alias("score"))


#: Works of one artist that stand in a list together, and pairs that a task counts.
LISTED, COUNTED = 512, 1_000_000


def works_by_shared(own: DataFrame, name: str) -> DataFrame:
    """(work, related, ``name``): for each two works the number of artists they share, from distinct rows (work, artist).

    Lists go to the lesser work of a pair, that of an artist's greater works: a pair is shuffled once, as one number of a list,
    and shown both ways where it was counted. An artist with many works has several lists, each of which meets all.
    """
    rows = own.where("work IS NOT NULL AND artist IS NOT NULL")
    lots = rows.groupBy("artist").agg(F.ceil(F.count("*") / LISTED).alias("lots"))
    dealt = rows.join(lots, "artist").withColumn("lot", F.pmod(F.xxhash64("work"), "lots"))
    lists = held(dealt.groupBy("artist", "lot").agg(F.sort_array(F.collect_list("work")).alias("works")))
    each = lists.groupBy("artist").agg(F.sum(F.size("works").cast("long")).alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0]
    first = lists.select("artist", F.explode("works").alias("work"))
    met = first.join(lists, "artist").select("work", F.filter("works", lambda x: x > F.col("work")).alias("greater")).where(F.size("greater") > 0)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((each or 0) / COUNTED))
    counted = met.repartition(tasks, "work").select("work", F.explode("greater").alias("related")).groupBy("work", "related").agg(F.count("*").alias(name))
    return counted.select(F.explode(F.array(F.struct("work", "related", name), F.struct(F.col("related").alias("work"), F.col("work").alias("related"), name))).alias("p")).select("p.*")
