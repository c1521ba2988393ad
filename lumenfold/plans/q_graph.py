"""Queries of the graph: suppliers are people, orders and parts works, return flags credit types, customers artists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import graph as G
from lumenfold.operators.services import Graph
from lumenfold.plans.registry import query

EDGE_SQL = "(SELECT DISTINCT l_orderkey AS work, l_suppkey AS person, CASE l_returnflag WHEN 'A' THEN 'ACTED_IN' WHEN 'R' THEN 'DIRECTED' ELSE 'PRODUCED' END AS type FROM lineitem)"


def edges(t):
    kind = F.when(F.col("l_returnflag") == "A", "ACTED_IN").when(F.col("l_returnflag") == "R", "DIRECTED").otherwise("PRODUCED")
    return t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("person"), kind.alias("type")).distinct()


#: Works' ids in one space of vertices with people's; above any person's.
WORKS_FROM = 1 << 40


def listed(c):
    return F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_name IN ('Supplier#000000001', 'Supplier#000000007', 'nobody', 'Supplier#000000009', 'Supplier#1')")
def g01_people_by_name(t):
    found = G.persons_by_name(t.supplier.withColumnRenamed("s_name", "name"), ["Supplier#000000001", "Supplier#000000007", "nobody", "Supplier#000000009", "Supplier#1"])
    return found.select("s_suppkey", F.col("name").alias("s_name"))


@query(f"SELECT work, type FROM {EDGE_SQL} WHERE person = 3")
def g02_works_of_person(t):
    return G.works_of(edges(t), 3)


@query(f"SELECT work FROM {EDGE_SQL} WHERE person IN (1, 2) GROUP BY 1 HAVING count(DISTINCT person) = 2")
def g03_works_shared(t):
    return G.works_shared(edges(t), [1, 2])


@query(f"SELECT other, count(*) AS strength, string_agg(CAST(work AS VARCHAR), ',' ORDER BY work) AS works FROM (SELECT DISTINCT b.person AS other, b.work FROM {EDGE_SQL} a JOIN {EDGE_SQL} b ON a.work = b.work AND a.person <> b.person WHERE a.person = 5 AND a.type = 'ACTED_IN' AND b.type = 'ACTED_IN') GROUP BY 1")
def g04_collaborators(t):
    return G.collaborators(edges(t), 5).select("other", "strength", listed(F.col("works")).alias("works"))


@query(f"SELECT related, count(*) AS strength FROM (SELECT DISTINCT b.work AS related, b.person, b.type FROM {EDGE_SQL} a JOIN {EDGE_SQL} b ON a.person = b.person AND a.work <> b.work WHERE a.work = 1 AND a.type <> 'PRODUCED' AND b.type <> 'PRODUCED') GROUP BY 1")
def g05_related_by_people(t):
    return G.related_by_people(edges(t), 1).select("related", "strength")


@query("""SELECT f2.l_partkey AS related, count(DISTINCT s2.o_custkey) AS artists FROM lineitem f1 JOIN orders s1 ON s1.o_orderkey = f1.l_orderkey JOIN orders s2 ON s2.o_custkey = s1.o_custkey
JOIN lineitem f2 ON f2.l_orderkey = s2.o_orderkey WHERE f1.l_partkey = 2 AND f2.l_partkey <> 2 GROUP BY 1""")
def g06_related_by_artists(t):
    features = t.lineitem.select(F.col("l_partkey").alias("work"), F.col("l_orderkey").alias("song")).distinct()
    return G.related_by_artists(features, t.orders.select(F.col("o_orderkey").alias("song"), F.col("o_custkey").alias("artist")), 2)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem WHERE l_quantity > 40 UNION SELECT DISTINCT l_partkey + 1000000, l_suppkey FROM lineitem WHERE l_quantity > 40),
h1 AS (SELECT DISTINCT dst AS node FROM e WHERE src = 4 ORDER BY node LIMIT 20), f AS (SELECT node AS src FROM h1 ORDER BY node LIMIT 5),
h2 AS (SELECT DISTINCT dst AS node FROM (SELECT e.src, dst, row_number() OVER (PARTITION BY e.src ORDER BY dst) AS n FROM e JOIN f USING (src)) WHERE n <= 10 AND dst <> 4 AND dst NOT IN (SELECT node FROM h1))
SELECT node, hop FROM (SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2) ORDER BY hop, node LIMIT 20""")
def g07_bounded_traversal(t):
    half = t.lineitem.where("l_quantity > 40").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).distinct().withColumn("type", F.lit("ACTED_IN"))
    both = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    return G.traverse(both, 4, depth=2, limit=20, relations=["ACTED_IN"])


@query("""SELECT src_label, type, dst_label, count(*) AS n FROM (
SELECT DISTINCT 'Drama' AS src_label, CAST(o_orderkey AS VARCHAR) AS src, 'AIRED_ON' AS type, 'Broadcaster' AS dst_label, o_orderpriority AS dst FROM orders
UNION ALL SELECT DISTINCT 'Person', CAST(l_suppkey AS VARCHAR), CASE l_returnflag WHEN 'A' THEN 'ACTED_IN' WHEN 'R' THEN 'DIRECTED' ELSE 'CREDITED_IN' END, 'Drama', CAST(l_orderkey AS VARCHAR) FROM lineitem
UNION ALL SELECT DISTINCT 'Drama', CAST(l_orderkey AS VARCHAR), 'HAS_SONG', 'Song', CAST(l_partkey AS VARCHAR) FROM lineitem
UNION ALL SELECT DISTINCT 'Song', CAST(l_partkey AS VARCHAR), 'PERFORMED_BY', 'Artist', CAST(l_suppkey AS VARCHAR) FROM lineitem) GROUP BY ALL""")
def g08_projection(t):
    works = t.orders.select(F.col("o_orderkey").alias("work"), F.col("o_orderpriority").alias("channel"))
    kind = F.when(F.col("l_returnflag") == "A", "ACTOR").when(F.col("l_returnflag") == "R", "DIRECTOR").otherwise("GUEST")
    credits = t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("person"), kind.alias("credit_type"))
    features = t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("song"))
    songs = t.lineitem.select(F.col("l_partkey").alias("song"), F.col("l_suppkey").alias("artist"))
    return G.project(works, credits, features, songs)[1].groupBy("src_label", "type", "dst_label").agg(F.count("*").alias("n"))


@query(f"SELECT work, person, type FROM {EDGE_SQL} WHERE work % 10 NOT IN (0, 1) UNION ALL SELECT work, person, 'ACTED_IN' FROM (SELECT DISTINCT work, person FROM {EDGE_SQL} WHERE work % 10 = 0)")
def g09_replace_aggregates(t):
    own = edges(t)
    changed, gone = own.where("work % 10 = 0").select("work").distinct(), own.where("work % 10 = 1").select("work").distinct()
    fresh = own.where("work % 10 = 0").select("work", "person").distinct().withColumn("type", F.lit("ACTED_IN"))
    return G.replaced(own, fresh, changed, gone)


INTEGRITY_SQL = f"(SELECT count(DISTINCT o_orderkey) AS works, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS no_channel FROM orders WHERE o_orderkey > 100) a, (SELECT count(*) AS edges FROM {EDGE_SQL}) b, (SELECT count(*) AS orphans FROM {EDGE_SQL} WHERE work <= 100) c, (SELECT max(n) AS max_degree FROM (SELECT count(*) AS n FROM {EDGE_SQL} GROUP BY person)) d"


def _integrity(t):
    works = t.orders.where("o_orderkey > 100").select(F.col("o_orderkey").alias("work"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority")).alias("channel"))
    return G.integrity(edges(t), works)


@query(f"SELECT works, no_channel, edges, orphans, max_degree FROM {INTEGRITY_SQL}")
def g10_integrity(t):
    return _integrity(t)


@query(f"SELECT orphans > 0 AS has_orphans, no_channel > 0 AS lacks_channel, max_degree > 500 AS hub FROM {INTEGRITY_SQL}")
def q03_graph_gate(t):
    return _integrity(t).select((F.col("orphans") > 0).alias("has_orphans"), (F.col("no_channel") > 0).alias("lacks_channel"), (F.col("max_degree") > 500).alias("hub"))


def _votes(before: str) -> str:
    return f"SELECT id, arg_min(label, struct_pack(m := -n, label)) AS label FROM (SELECT b.src AS id, l.label, count(*) AS n FROM b JOIN {before} l ON l.id = b.dst GROUP BY 1, 2) GROUP BY 1"


@query(f"""WITH a AS (SELECT work + {WORKS_FROM} AS src, person AS dst FROM {EDGE_SQL} WHERE type = 'ACTED_IN'), b AS (SELECT src, dst FROM a UNION SELECT dst, src FROM a),
l0 AS (SELECT DISTINCT src AS id, src AS label FROM b), l1 AS ({_votes('l0')}), l2 AS ({_votes('l1')}) {_votes('l2')}""")
def g11_communities(t):
    """Design only in the reference: label propagation, and collaboration weighted by the size of the cast."""
    acts = edges(t).where("type = 'ACTED_IN'").select("work", "person").distinct()
    return G.communities(acts.select((F.col("work") + WORKS_FROM).alias("src"), F.col("person").alias("dst")))


@query("SELECT 1 AS one, true AS better, true AS settled")
def g11_settled(t):
    """Communities of works and their cast until they settle: better than no communities, and each vertex has one."""
    acts = edges(t).where("type = 'ACTED_IN'").select((F.col("work") + WORKS_FROM).alias("src"), F.col("person").alias("dst")).distinct()
    labels = G.settled_communities(acts)
    alone = labels.select("id", F.col("id").alias("label"))
    gain = G.modularity(acts, labels).select(F.col("modularity").alias("q")).crossJoin(G.modularity(acts, alone).select(F.col("modularity").alias("q0")))
    count = labels.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    return gain.crossJoin(count).select(F.lit(1).alias("one"), (F.col("q") > F.col("q0")).alias("better"), (F.col("n") == F.col("d")).alias("settled"))


def _like(name: str, member: str) -> str:
    rows = f"(SELECT DISTINCT l_orderkey AS work, {member} AS member FROM lineitem)"
    return f"""{name}_s AS (SELECT r.work, count(*) AS shared FROM {rows} r WHERE work <> 7 AND member IN (SELECT member FROM {rows} WHERE work = 7) GROUP BY 1),
{name} AS (SELECT work, shared / ((SELECT count(*) FROM {rows} r WHERE r.work = {name}_s.work) + (SELECT count(*) FROM {rows} WHERE work = 7) - shared) AS v FROM {name}_s)"""


@query(f"""WITH {_like("cast_", "l_suppkey")}, {_like("genre_", "l_returnflag")}, {_like("artist_", "l_partkey")},
w AS (SELECT o_orderkey AS work, o_orderpriority AS channel, year(o_orderdate) AS year FROM orders),
f AS (SELECT w.work AS related, coalesce(c.v, 0) AS cast_, coalesce(g.v, 0) AS genre_, coalesce(a.v, 0) AS artist_, 1.0 / (1 + abs(w.year - o.year)) AS near, CAST(w.channel = o.channel AS INT) AS same
 FROM w JOIN (SELECT * FROM w WHERE work = 7) o ON true LEFT JOIN cast_ c ON c.work = w.work LEFT JOIN genre_ g ON g.work = w.work LEFT JOIN artist_ a ON a.work = w.work WHERE c.v IS NOT NULL OR g.v IS NOT NULL OR a.v IS NOT NULL)
SELECT related, round(3 * cast_ + genre_ + 2 * artist_ + 0.5 * near + 0.25 * same, 6) AS score FROM f ORDER BY score DESC, related LIMIT 20""")
def g11_similar_works(t):
    """Design only in the reference: works like one work by cast, genres, artists, years and channel."""
    works = t.orders.select(F.col("o_orderkey").alias("work"), F.col("o_orderpriority").alias("channel"), F.year("o_orderdate").alias("year"))
    of = lambda c: t.lineitem.select(F.col("l_orderkey").alias("work"), F.col(c).alias("member")).distinct()
    found = G.similar_works(works, {"cast": of("l_suppkey"), "genre": of("l_returnflag"), "artist": of("l_partkey")}, 7, {"cast": 3.0, "genre": 1.0, "artist": 2.0, "year": 0.5, "channel": 0.25})
    return found.select("related", "score")


@query(f"SELECT other, strength FROM (SELECT other, count(DISTINCT work) AS strength FROM (SELECT b.person AS other, b.work FROM {EDGE_SQL} a JOIN {EDGE_SQL} b ON a.work = b.work AND a.person <> b.person WHERE a.person = 8 AND a.type = 'ACTED_IN' AND b.type = 'ACTED_IN') GROUP BY 1) ORDER BY strength DESC, other LIMIT 10")
def h04_collaborators_route(t):
    own = edges(t)
    return Graph(own, own, own).collaborators(8, 10).select("other", "strength")
