"""Queries of writes: each returns the table as it is after the write."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenfold.operators import merge as M
from lumenfold.operators import versions as V
from lumenfold.plans.registry import long, query, shared_dir

NATION_SQL = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"


def nation(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))


def incoming(t):
    """Half known keys, half new ones; some values null."""
    return t.nation.where("n_nationkey % 2 = 0").select((F.col("n_nationkey") + 13).cast("long").alias("id"), F.when(F.col("n_nationkey") % 3 > 0, F.lower("n_name")).alias("name"), F.lit(9).cast("long").alias("region"))


IN_SQL = "SELECT n_nationkey + 13 AS id, CASE WHEN n_nationkey % 3 > 0 THEN lower(n_name) END AS name, 9 AS region FROM nation WHERE n_nationkey % 2 = 0"


@query(f"{NATION_SQL} UNION ALL SELECT * FROM ({IN_SQL}) WHERE id >= 25")
def m01_insert_ignore(t):
    return M.insert_ignore(nation(t), incoming(t), ["id"])


@query(f"SELECT * FROM ({NATION_SQL}) WHERE id NOT IN (SELECT id FROM ({IN_SQL})) UNION ALL {IN_SQL}")
def m02_overwrite(t):
    return M.overwrite(nation(t), incoming(t), ["id"])


@query(f"SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.name ELSE a.name END AS name, coalesce(b.region, a.region) AS region, CASE WHEN a.id IS NULL THEN 1 WHEN b.id IS NULL THEN 4 ELSE 5 END AS version FROM ({NATION_SQL}) a FULL JOIN ({IN_SQL}) b ON a.id = b.id")
def m03_coalesce_merge(t):
    return M.fill_merge(nation(t).withColumn("version", F.lit(4).cast("long")), incoming(t), ["id"], always=["name"])


@query(f"{NATION_SQL} UNION ALL SELECT * FROM ({IN_SQL}) WHERE id >= 25")
def m04_keep_old(t):
    return M.keep_old(nation(t), incoming(t), ["id"])


@query("SELECT d.doc_id AS id, CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id % 5 ELSE 0 END AS content_hash, CASE WHEN d.doc_id % 2 = 1 THEN 1 WHEN d.doc_id % 3 = 0 AND d.doc_id % 5 <> 0 THEN 8 ELSE 7 END AS document_version FROM documents d")
def m05_replace_if_changed(t):
    old = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("content_hash"), F.lit(7).cast("long").alias("document_version"))
    new = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5).otherwise(0).alias("content_hash"))
    return M.replace_if_changed(old, new, ["id"])


STATE_SQL = "(SELECT user_id, event_type AS item, max(event_id) AS updated_at FROM events GROUP BY 1, 2)"


def states(t):
    return t.events.groupBy("user_id", F.col("event_type").alias("item")).agg(F.max("event_id").alias("updated_at"))


@query(f"SELECT CASE user_id WHEN 4 THEN 3 ELSE user_id END AS user_id, item, max(updated_at) AS updated_at FROM {STATE_SQL} GROUP BY 1, 2")
def m06_newest_wins(t):
    return M.newest_wins(states(t), 4, 3).select("user_id", "item", "updated_at")


@query("SELECT * FROM (SELECT DISTINCT l_orderkey AS work, l_returnflag AS genre FROM lineitem) WHERE work % 5 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 'X' FROM lineitem WHERE l_orderkey % 5 = 0")
def m07_replace_children(t):
    own = t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_returnflag").alias("genre")).distinct()
    rows = t.lineitem.where("l_orderkey % 5 = 0").select(F.col("l_orderkey").alias("work"), F.lit("X").alias("genre"))
    return M.replace_children(own, rows, "work")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def m08_delete_stale(t):
    return M.delete_where_in(t.documents.select("doc_id"), t.labels.where("quality = 0").select("doc_id"), ["doc_id"])


@query("""SELECT 'users' AS part, count(*) AS n FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 0) UNION ALL SELECT 'states', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0)""")
def m09_retention(t):
    gone = t.customer.where("c_mktsegment = 'BUILDING' AND c_acctbal < 0").select("c_custkey")
    users = M.delete_where_in(t.customer, gone, ["c_custkey"]).agg(F.count("*").alias("n")).select(F.lit("users").alias("part"), "n")
    rest = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return users.unionByName(M.delete_where_in(rest, gone, ["c_custkey"]).agg(F.count("*").alias("n")).select(F.lit("states").alias("part"), "n"))


WORK_SQL = "(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'HIDDEN' ELSE 'MERGED' END AS status, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'upcoming' ELSE 'scope' END END AS reason, 1 AS version, o_orderdate AS day, o_orderpriority AS channel FROM orders)"


def works(t):
    reason = F.when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "upcoming").otherwise("scope"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").when(F.col("o_orderstatus") == "O", "HIDDEN").otherwise("MERGED").alias("status"), reason.alias("reason"), F.lit(1).cast("long").alias("version"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("channel"))


SHOW = ["id", "status", "reason", "version"]


@query(f"""SELECT id, CASE WHEN status = 'PUBLISHED' AND id % 3 = 0 THEN 'HIDDEN' ELSE status END AS status, CASE WHEN status = 'PUBLISHED' AND id % 3 = 0 THEN 'excluded' ELSE reason END AS reason, version + CASE WHEN status = 'PUBLISHED' AND id % 3 = 0 THEN 1 ELSE 0 END AS version FROM {WORK_SQL}""")
def m10_hide_by_reference(t):
    refs = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("excluded").alias("reason"))
    return M.set_status(works(t), refs, "HIDDEN").select(*SHOW)


@query(f"""SELECT id, CASE WHEN hit THEN 'PUBLISHED' ELSE status END AS status, CASE WHEN hit THEN NULL ELSE reason END AS reason, version + CAST(hit AS INT) AS version FROM (SELECT *, status = 'HIDDEN' AND id % 3 = 0 AND reason = 'scope' AS hit FROM (SELECT id, status, coalesce(reason, '') AS reason0, reason, version FROM {WORK_SQL}))""".replace("AND reason = 'scope'", "AND reason0 = 'scope'"))
def m10_restore_by_reference(t):
    refs = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("excluded").alias("reason"))
    return M.set_status(works(t), refs, "PUBLISHED", only_reasons=["scope"]).select(*SHOW)


def _toggle_sql(cond: str, reason: str) -> str:
    return f"SELECT id, CASE WHEN gone THEN 'HIDDEN' WHEN back THEN 'PUBLISHED' ELSE status END AS status, CASE WHEN gone THEN '{reason}' WHEN back THEN NULL ELSE reason END AS reason, version + CAST(gone OR back AS INT) AS version FROM (SELECT *, status = 'PUBLISHED' AND {cond} AS gone, status = 'HIDDEN' AND coalesce(reason, '') = '{reason}' AND NOT {cond} AS back FROM {WORK_SQL})"


@query(_toggle_sql("(day >= DATE '1999-01-01')", "upcoming"))
def m11_upcoming(t):
    return M.toggled(works(t), F.col("day") >= F.lit("1999-01-01").cast("date"), "upcoming").select(*SHOW)


@query(_toggle_sql("(channel NOT IN ('1-URGENT', '2-HIGH') OR day < DATE '1996-01-01')", "scope"))
def m12_scope(t):
    return M.toggled(works(t), F.expr("channel NOT IN ('1-URGENT', '2-HIGH') OR day < DATE '1996-01-01'"), "scope").select(*SHOW)


@query("SELECT event_id AS id, CASE WHEN user_id % 4 <> 2 AND event_type = 'view' THEN 'NEW' ELSE event_type END AS status FROM events")
def m14_mark_reparse(t):
    rows = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("event_type").alias("source"), (F.col("user_id") % 4).cast("string").alias("parser_version"))
    return M.mark_reparse(rows, "stale", source="view", version="2").select("id", "status")


@query(f"""SELECT id AS aggregate_id, 'DRAMA_HIDDEN' AS event_type, '{{"id":' || id || ',"was":"PUBLISHED","status":"HIDDEN","reason":"upcoming"}}' AS payload FROM {WORK_SQL} WHERE status = 'PUBLISHED' AND day >= DATE '1999-01-01'
UNION ALL SELECT id, 'DRAMA_PUBLISHED', '{{"id":' || id || ',"was":"HIDDEN","status":"PUBLISHED"}}' FROM {WORK_SQL} WHERE status = 'HIDDEN' AND reason = 'upcoming' AND day < DATE '1999-01-01'""")
def m16_status_events(t):
    after = M.toggled(works(t), F.col("day") >= F.lit("1999-01-01").cast("date"), "upcoming")
    return M.status_events(works(t), after).select("aggregate_id", "event_type", "payload")


@query("SELECT user_id, CASE WHEN seen IS NULL OR seen < TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 60 MINUTE THEN '2024-01-29 12:00:00' ELSE strftime(seen, '%Y-%m-%d %H:%M:%S') END AS last_seen FROM (SELECT user_id, CASE WHEN user_id % 6 > 0 THEN max(ts) END AS seen FROM events GROUP BY 1)")
def m17_touch(t):
    users = t.events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("m")).select("user_id", F.when(F.col("user_id") % 6 > 0, F.col("m")).alias("last_seen"))
    return M.touched(users, F.lit("2024-01-29 12:00:00").cast("timestamp")).select("user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN n IS NOT NULL THEN n END AS channel, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN n IS NOT NULL THEN 'kowiki' ELSE 'kowiki:none' END AS channel_source, 1 + CAST(c_custkey % 3 > 0 AND n IS NOT NULL AS INT) AS version
FROM customer LEFT JOIN (SELECT n_nationkey, n_name AS n FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey""")
def m19_fill_null(t):
    works = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("channel"), F.lit(None).cast("string").alias("channel_source"), F.lit(1).cast("long").alias("version"), F.col("c_nationkey").alias("ref"))
    lookup = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("ref"), F.col("n_name").alias("channel"))
    return M.fill_null(works, lookup, "ref", "channel", "channel_source", "kowiki").select("id", "channel", "channel_source", "version")


@query("SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'NOT_FOUND' ELSE 'UNKNOWN' END AS state, CASE WHEN page_id % 4 = 0 THEN 404 ELSE 0 END AS http FROM pages")
def m20_stamp_links(t):
    links = t.pages.select(F.col("page_id").alias("id"), F.lit("UNKNOWN").alias("state"), F.lit(0).cast("long").alias("http"))
    verdicts = t.pages.where("page_id % 4 = 0").select(F.col("page_id").alias("id"), F.lit("NOT_FOUND").alias("state"), F.lit(404).cast("long").alias("http"))
    return M.update_from(links, verdicts, ["id"], ["state", "http"])


def versioned(t, rows, keys):
    return V.VersionedTable(t.spark, f"{shared_dir(t.spark)}/table-{uuid.uuid4().hex}").create(rows, keys, 16)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 16 = 0 AND o_custkey < 100 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def m02_overwrite_partitions(t):
    """Rows overwritten in a stored table; only the partitions that hold their keys are written."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    table = versioned(t, rows, ["id"])
    table.merge(t.orders.where("o_orderkey % 16 = 0 AND o_custkey < 100").select(F.col("o_orderkey").alias("id"), F.lit("X").alias("status")), lambda old, new: M.overwrite(old, new, ["id"]))
    return table.read()


@query("SELECT d.doc_id AS id, CASE WHEN d.doc_id % 9 = 0 THEN d.doc_id % 5 ELSE 0 END AS content_hash, CASE WHEN d.doc_id % 9 = 0 AND d.doc_id % 5 <> 0 THEN 8 ELSE 7 END AS document_version FROM documents d")
def m05_replace_partitions(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("content_hash"), F.lit(7).cast("long").alias("document_version"))
    table = versioned(t, rows, ["id"])
    table.merge(t.documents.where("doc_id % 9 = 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("content_hash")), lambda old, new: M.replace_if_changed(old, new, ["id"]))
    return table.read()


@query("SELECT * FROM (SELECT DISTINCT l_orderkey AS work, l_returnflag AS genre FROM lineitem) WHERE work % 50 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 'X' FROM lineitem WHERE l_orderkey % 50 = 0")
def m07_children_partitions(t):
    """Children are stored by their parent, so that one partition has all of a parent's."""
    table = versioned(t, t.lineitem.select(F.col("l_orderkey").alias("work"), F.col("l_returnflag").alias("genre")).distinct(), ["work"])
    table.merge(t.lineitem.where("l_orderkey % 50 = 0").select(F.col("l_orderkey").alias("work"), F.lit("X").alias("genre")), lambda old, new: M.replace_children(old, new, "work"))
    return table.read()


@query("SELECT n_nationkey, n_name FROM nation")
def m15_snapshot_swap(t):
    """A table written twice through the store; readers see the second snapshot."""
    store = M.Store(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    rows = t.nation.select(long("n_nationkey"), "n_name")
    store.swap("nation", rows.where("n_nationkey < 3"))
    return store.swap("nation", M.overwrite(store.read("nation"), rows, ["n_nationkey"]))
