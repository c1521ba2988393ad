"""Queries of the rules, decisions and write steps that work on records; parts are candidates, a customer's orders the mentions of a record."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import rules
from lumenfold.operators import merge as M
from lumenfold.operators import quality as Q
from lumenfold.operators import resolve as E
from lumenfold.operators import retrieval as V
from lumenfold.operators.services import Graph, ReviewQueue
from lumenfold.plans.q_graph import EDGE_SQL, edges
from lumenfold.plans.q_resolve import E07_SQL, e07_resolve_songs
from lumenfold.plans.registry import query


def _choice(n, *values):
    """One of the values, by a number's remainder."""
    return F.get(F.array(*(v if isinstance(v, F.Column) else F.lit(v) for v in values)), (n % len(values)).cast("int"))


def _texts(*values: str):
    return F.array(*map(F.lit, values)).cast("array<string>")


def _part():
    return F.col("p_partkey")


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(CASE p_partkey % 6 WHEN 0 THEN ['romance', 'comedy'] WHEN 1 THEN ['crime'] WHEN 2 THEN ['sf'] WHEN 3 THEN [] WHEN 4 THEN ['historical'] ELSE ['legal'] END,
 CASE p_partkey % 4 WHEN 0 THEN ['mystery'] WHEN 1 THEN ['family'] WHEN 2 THEN ['comedy'] ELSE ['crime'] END))), ',') AS codes FROM part""")
def c08_genre_codes(t):
    p = _part()
    labels = F.array(_choice(p, "로맨틱 코미디", "범죄물", "Science Fiction", "news", "시대극", "Legal drama"), _choice(p, "Mystery film", "가족 드라마", "시트콤", "Crime"))
    return t.part.select("p_partkey", F.array_join(rules.genre_codes(labels), ",").alias("codes"))


def _candidates(t):
    p = _part()
    countries = F.when(p % 4 > 0, _choice(p, _texts(), _texts(), _texts("Q884"), _texts("Q17", "Q30")))
    found_by = _choice(p, _texts("kowiki"), _texts("sparql"), _texts("kowiki", "sparql"))
    kind = F.when(p % 7 == 0, "NOT_DRAMA").when(p % 7 == 1, "UNKNOWN").otherwise("DRAMA")
    return t.part.select(F.concat(F.lit("Q"), p.cast("string")).alias("external_id"), kind.alias("kind"), countries.alias("countries"), found_by.alias("found_by"), (p % 5 == 0).alias("has_category"), F.when(p % 2 == 0, _texts("x")).alias("categories"))


FOREIGN_SQL = "CASE p_partkey % 4 WHEN 2 THEN false WHEN 3 THEN true ELSE p_partkey % 3 = 0 AND p_partkey % 5 <> 0 END"


@query(f"SELECT 'Q' || p_partkey AS external_id, {FOREIGN_SQL} AS is_foreign FROM part")
def k02_foreign(t):
    return _candidates(t).select("external_id", rules.is_foreign(F.col("countries"), F.col("found_by"), F.col("has_category")).alias("is_foreign"))


@query(f"SELECT 'Q' || p_partkey AS external_id, CASE WHEN p_partkey % 7 = 0 THEN 'not_drama' WHEN {FOREIGN_SQL} THEN 'foreign' END AS reason FROM part")
def k03_decided(t):
    keep, out = rules.decided(_candidates(t))
    return keep.withColumn("reason", F.lit(None).cast("string")).unionByName(out).select("external_id", "reason")


@query("SELECT 'Q' || p_partkey AS external_id, p_partkey % 7 = 1 AND p_partkey % 2 = 1 AS lookup FROM part")
def k04_needs_lookup(t):
    return _candidates(t).select("external_id", rules.needs_lookup(F.col("kind"), F.col("categories")).alias("lookup"))


@query("SELECT count(*) FILTER (WHERE value > 50) < 0.6 * count(*) AND count(*) > 0 AS collapsed FROM events")
def k07_collapse_guard(t):
    """All events as the discovery before, those of a value above 50 as the new one."""
    new, previous = t.events.agg(F.count_if(F.col("value") > 50), F.count("*")).first()
    return t.spark.createDataFrame([(rules.collapsed(new, previous),)], "collapsed boolean")


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'old' WHEN length(trim(text)) >= 40 THEN text END) AS text_md5,
 CASE WHEN doc_id % 3 = 0 THEN 'seed' WHEN length(trim(text)) >= 40 THEN 'kowiki' ELSE 'kowiki:none' END AS source FROM documents""")
def k08_enrichment(t):
    current = F.when(F.col("doc_id") % 3 == 0, "old")
    text, source = rules.enriched_text(current, F.col("text"), "kowiki")
    return t.documents.select("doc_id", F.md5(text).alias("text_md5"), F.coalesce(source, F.lit("seed")).alias("source"))


WORDS = ("도깨비", "공유")


@query("""SELECT page_id, CASE page_id % 2 WHEN 0 THEN '도깨비' ELSE '공유' END AS text, 1990 + page_id % 30 - CAST(page_id % 5 = 0 AS INT) AS year_from, 1990 + page_id % 30 + CAST(page_id % 5 = 0 AS INT) AS year_to,
 CASE page_id % 3 WHEN 0 THEN 'tvn' WHEN 1 THEN 'kbs' END AS broadcaster FROM pages""")
def r01_query_analysis(t):
    """A table of queries: a year, about a year where the page's id is divisible by five, a channel, a word."""
    k = F.col("page_id")
    said = F.concat((1990 + k % 30).cast("string"), F.when(k % 5 == 0, "년쯤 ").otherwise("년 "), _choice(k, "tvN ", "KBS ", ""), _choice(k, *WORDS), F.lit(" 드라마"))
    plan = V.analyzed(said)
    rows = t.pages.select("page_id", plan.alias("plan"))
    return rows.select("page_id", "plan.text", F.col("plan.year_from").cast("long").alias("year_from"), F.col("plan.year_to").cast("long").alias("year_to"), "plan.broadcaster")


@query(f"SELECT other, strength FROM (SELECT other, count(DISTINCT work) AS strength FROM (SELECT b.person AS other, b.work FROM {EDGE_SQL} a JOIN {EDGE_SQL} b ON a.work = b.work AND a.person <> b.person WHERE a.person = 8 AND a.type = 'ACTED_IN' AND b.type = 'ACTED_IN') GROUP BY 1) ORDER BY strength DESC, other LIMIT 50")
def t08_clamped_limit(t):
    """A limit of 99 is one of 50."""
    own = edges(t)
    return Graph(own, own, own).collaborators(8, 99).select("other", "strength")


def _matches(t):
    k = F.col("o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("record_id"), F.concat(F.lit("o"), k.cast("string")).alias("mention"), _choice(k, "REVIEW", "AUTO_MERGE", "CREATE_NEW").alias("decision"), F.lit("SCORED").alias("method"), F.lit(0.5).alias("confidence"), F.when(k % 3 < 2, k + 1).alias("canonical_id"))


def _staging(t):
    rows = E.record_resolution(_matches(t))
    return rows.select(F.col("record_id").alias("id"), F.when(F.col("needs_review"), "REVIEW").otherwise("RESOLVED").alias("status"), "resolution")


def _flat(resolution: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(resolution)), lambda e: F.concat_ws(":", e["key"], e["value"]["decision"], e["value"]["method"])), ",")


DECISION_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'REVIEW' WHEN 1 THEN 'AUTO_MERGE' ELSE 'CREATE_NEW' END"


@query(f"SELECT o_custkey AS record_id, bool_or(o_orderkey % 3 = 0) AS needs_review, string_agg('o' || o_orderkey || ':' || {DECISION_SQL} || ':SCORED', ',' ORDER BY 'o' || o_orderkey) AS resolution FROM orders GROUP BY 1")
def e09_record_resolution(t):
    return E.record_resolution(_matches(t)).select("record_id", "needs_review", _flat("resolution").alias("resolution"))


@query("""SELECT n.o_custkey AS id, string_agg('o' || o_orderkey || ':' || CASE WHEN o_orderkey % 4 = 0 THEN 'REJECTED:MANUAL' ELSE 'AUTO_MERGE:SCORED' END, ',' ORDER BY 'o' || o_orderkey) AS resolution
FROM (SELECT * FROM orders WHERE o_orderkey % 5 > 0) n SEMI JOIN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) m ON n.o_custkey = m.o_custkey GROUP BY 1""")
def e10_keep_manual(t):
    """Of a record's earlier verdicts (even orders) those of a person (every fourth order) stay, where the new ones (no multiples of five) have the mention."""
    k = F.col("o_orderkey")
    mention = F.concat(F.lit("o"), k.cast("string")).alias("mention")

    def verdicts(rows, name: str, decision, method):
        matches = rows.select(F.col("o_custkey").alias("record_id"), mention, decision.alias("decision"), method.alias("method"), F.lit(1.0).alias("confidence"), k.alias("canonical_id"))
        return E.record_resolution(matches).select(F.col("record_id").alias("id"), F.col("resolution").alias(name))

    by_hand = k % 4 == 0
    old = verdicts(t.orders.where(k % 2 == 0), "old", F.when(by_hand, "REJECTED").otherwise("CREATE_NEW"), F.when(by_hand, "MANUAL").otherwise("NEW"))
    new = verdicts(t.orders.where(k % 5 > 0), "new", F.lit("AUTO_MERGE"), F.lit("SCORED"))
    return old.join(new, "id").select("id", E.keep_manual(F.col("old"), F.col("new")).alias("resolution")).select("id", _flat("resolution").alias("resolution"))


@query("SELECT o_custkey AS id, 'o' || o_orderkey AS mention, o_orderkey + 1 AS canonical_id, 'SCORED' AS method FROM orders WHERE o_orderkey % 3 = 0")
def e11_pending_reviews(t):
    return ReviewQueue(_staging(t)).pending().select("id", "mention", "canonical_id", "method")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'PARSE_FAILED' ELSE 'REJECTED' END AS status FROM orders WHERE o_orderkey % 4 < 2 ORDER BY o_orderkey LIMIT 200")
def e11_problems(t):
    """The list of problems, whose limit of 200 is a feature."""
    k = F.col("o_orderkey")
    return ReviewQueue(t.orders.select(k.alias("id"), _choice(k, "PARSE_FAILED", "REJECTED", "NEW", "RESOLVED").alias("status"))).problems().select("id", "status")


MADE_SQL = "o_orderkey % 3 = 0 AND o_orderkey % 9 > 0 AND o_custkey % 2 = 0"


def _decided(t):
    """Even customers' mentions in review are decided, but for every third."""
    made = t.orders.where("o_orderkey % 3 = 0 AND o_orderkey % 9 > 0 AND o_custkey % 2 = 0").select(F.col("o_custkey").alias("id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("mention"), F.lit("CREATE_NEW").alias("decision"), F.lit(None).cast("long").alias("canonical_id"))
    return ReviewQueue(_staging(t)).decide(made)


@query(f"""SELECT o_custkey AS id, CASE WHEN bool_or(o_orderkey % 3 = 0 AND NOT ({MADE_SQL})) THEN 'REVIEW' ELSE 'RESOLVED' END AS status,
 string_agg('o' || o_orderkey || ':' || CASE WHEN {MADE_SQL} THEN 'CREATE_NEW:MANUAL' ELSE {DECISION_SQL} || ':SCORED' END, ',' ORDER BY 'o' || o_orderkey) AS resolution FROM orders GROUP BY 1""")
def e12_decide(t):
    return _decided(t).select("id", "status", _flat("resolution").alias("resolution"))


@query(f"SELECT o_custkey AS id, 'o' || o_orderkey AS mention FROM orders WHERE o_orderkey % 3 = 0 AND NOT ({MADE_SQL})")
def h05_review_routes(t):
    """What is still pending after decisions were made."""
    return ReviewQueue(_decided(t)).pending().select("id", "mention")


@query("""WITH r AS (SELECT o_orderkey AS id, lower(o_orderpriority) AS base, year(o_orderdate) AS y FROM orders),
a AS (SELECT min(id) AS id, base AS slug FROM r WHERE base <> '1-urgent' GROUP BY base), r2 AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM a)),
b AS (SELECT min(id) AS id, base || '-' || y AS slug FROM r2 GROUP BY base, y), r3 AS (SELECT *, row_number() OVER (PARTITION BY base, y ORDER BY id) AS n FROM r2 WHERE id NOT IN (SELECT id FROM b))
SELECT id, slug FROM a UNION ALL SELECT id, slug FROM b UNION ALL SELECT id, base || '-' || y || '-' || (n + CASE WHEN base = '5-low' AND y = 1995 AND n >= 2 THEN 2 ELSE 1 END) FROM r3""")
def e13_unique_slugs(t):
    """Orders by priority and year, beside two names that are taken."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lower("o_orderpriority").alias("base"), F.year("o_orderdate").alias("year"))
    return E.unique_slugs(rows, t.spark.createDataFrame([("1-urgent",), ("5-low-1995-3",)], "slug string")).select("id", "slug")


@query(f"SELECT mention_id, decision, canonical_id FROM ({E07_SQL}) WHERE decision <> 'REVIEW'")
def e15_enriched_songs(t):
    return E.enrich_songs(e07_resolve_songs(t.spark, t.sf_dir)).select("mention_id", "decision", "canonical_id")


@query("SELECT o_orderstatus AS batch, count(*) >= 5 AND avg(CASE WHEN CASE o_orderstatus WHEN 'F' THEN o_orderkey % 3 > 0 ELSE o_orderkey % 3 = 0 END THEN 1.0 ELSE 0.0 END) > 0.5 AS failed FROM orders GROUP BY 1")
def q02_batch_gate(t):
    """Two of three records are broken in one batch, one of three in the others."""
    broken = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3 > 0).otherwise(F.col("o_orderkey") % 3 == 0)
    rows = t.orders.select("o_orderstatus", F.array(F.struct(F.lit("X").alias("code"), F.when(broken, "ERROR").otherwise("WARNING").alias("severity"))).alias("issues"))
    return Q.gates(rows, "o_orderstatus").select("batch", "failed")


def _staged_table(t):
    return t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("source_record_id"), F.lit("REVIEW").alias("status"), F.lit("r").alias("resolution"), F.lit("i").alias("issues"), F.col("o_orderstatus").alias("payload"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'NEW' ELSE 'REVIEW' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN 'r' END AS resolution, CASE WHEN o_orderkey % 3 > 0 THEN 'i' END AS issues,
 CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE o_orderstatus END AS payload FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def m13_staged(t):
    fresh = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("source_record_id"), F.lit("again").alias("payload"))
    return M.staged(_staged_table(t), fresh).select("id", "status", "resolution", "issues", "payload")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (2, 4, 6) THEN 'RESOLVED' ELSE 'REVIEW' END AS status, CASE WHEN o_orderkey IN (2, 4, 6) THEN 'n' ELSE 'r' END AS resolution, 'i' AS issues FROM orders WHERE o_orderkey % 2 = 0")
def m13_transition(t):
    return M.transition(_staged_table(t), [2, 4, 6], "RESOLVED", resolution=F.lit("n")).select("id", "status", "resolution", "issues")


@query("""SELECT 'login' AS kind, c_mktsegment AS a, CAST(c_custkey AS VARCHAR) AS b, c_name AS c FROM customer UNION ALL SELECT 'login', 'kakao', '1', 'new' UNION ALL SELECT 'consent', c_name, 'terms', '1' FROM customer
UNION ALL SELECT 'consent', 'new', 'terms', '1' UNION ALL SELECT 'consent', 'new', 'privacy', '1'""")
def m18_identity(t):
    logins = t.customer.select(F.col("c_mktsegment").alias("provider"), F.col("c_custkey").cast("string").alias("subject"), F.col("c_name").alias("user_id"))
    consents = t.customer.select(F.col("c_name").alias("user_id"), F.lit("terms").alias("type"), F.lit("1").alias("version"))
    logins, consents = M.link_identity(logins, consents, "new", "kakao", "1", [("terms", "1"), ("privacy", "1")])
    return logins.select(F.lit("login").alias("kind"), F.col("provider").alias("a"), F.col("subject").alias("b"), F.col("user_id").alias("c")).unionByName(consents.select(F.lit("consent").alias("kind"), F.col("user_id").alias("a"), F.col("type").alias("b"), F.col("version").alias("c")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 7 = 0 THEN 'now' ELSE 'before' END AS updated_at FROM orders""")
def d01_updated_at(t):
    """The time of change is renewed in rows that changed (even orders) and in new ones (multiples of seven)."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit("before").alias("updated_at"))
    after = rows.withColumn("status", F.when(F.col("id") % 2 == 0, "X").otherwise(F.col("status")))
    return M.stamped(rows.where("id % 7 > 0"), after, ["id"], F.lit("now"))
