"""Queries of sources and sinks; pages stand for raw snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import rules
from lumenfold.functions.text import host
from lumenfold.plans.registry import query
from lumenfold.sources import snapshots as S


@query("SELECT entity_type, external_id, min(pos) AS pos FROM (SELECT event_type AS entity_type, CAST(user_id AS VARCHAR) AS external_id, event_id AS pos FROM events) GROUP BY 1, 2")
def s02_dedupe_items(t):
    return S.dedupe(t.events.select(F.col("event_type").alias("entity_type"), F.col("user_id").cast("string").alias("external_id"), F.col("event_id").alias("pos")))


@query("SELECT page_id FROM pages WHERE (page_id % 2 = 0 AND starts_with(url, 'https://')) OR (page_id % 2 = 1 AND starts_with(url, 'http://seed:8000/'))")
def s03_address_guard(t):
    items = t.pages.select("page_id", "url", F.when(F.col("page_id") % 2 == 0, "manual").otherwise("local_seed").alias("source_code"))
    return S.guarded(items, S.sources(t.spark)).select("page_id")


@query("SELECT page_id, sha256(html) AS content_hash FROM pages")
def s04_content_hash(t):
    return t.pages.select("page_id", S.content_hash(F.col("html").cast("binary")).alias("content_hash"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'html' WHEN 2 THEN 'bin' ELSE 'json' END AS ext FROM pages")
def s05_extension(t):
    kinds = F.array(*map(F.lit, ["Application/JSON; charset=utf-8", "text/html ;q=1", "image/png", "application/sparql-results+json"]))
    return t.pages.select("page_id", S.extension(F.get(kinds, (F.col("page_id") % 4).cast("int"))).alias("ext"))


@query("SELECT o_orderkey, 'source=manual/entity=drama/dt=' || strftime(o_orderdate, '%Y-%m-%d') || '/' || sha256(CAST(o_orderkey AS VARCHAR)) || '.json' AS k FROM orders")
def s06_object_key(t):
    digest = S.content_hash(F.col("o_orderkey").cast("string").cast("binary"))
    return t.orders.select("o_orderkey", S.object_key(F.lit("manual"), F.lit("DRAMA"), F.col("o_orderdate"), digest, F.lit("json")).alias("k"))


@query("""SELECT f.page_id, CASE WHEN f.page_id % 2 = 0 THEN 'unchanged' ELSE 'new' END AS outcome FROM pages f""")
def s08_store_records(t):
    fetched = t.pages.select("page_id", F.when(F.col("page_id") % 3 != 0, F.lit(1)).alias("source_id"), F.lit("DRAMA").alias("entity_type"), F.col("page_id").cast("string").alias("external_id"), F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))
    known = fetched.where("page_id % 2 = 0")
    return S.store_records(known, fetched)[1].select("page_id", "outcome")


@query("SELECT doc_id, CAST(ceil(row_number() OVER (ORDER BY doc_id) / 64.0) AS BIGINT) AS chunk FROM documents")
def s09_chunks(t):
    return S.chunks(t.documents.select("doc_id"), 64, F.col("doc_id"))


@query("""SELECT '[' || string_agg('{"id":' || n_nationkey || ',"title":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS dump FROM nation""")
def s16_catalogue_dump(t):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))))
    return t.nation.agg(F.to_json(rows).alias("dump"))


@query("""SELECT d.doc_id, d.source || '|' || d.lang AS title, substr(d.text, 1, 400) AS synopsis, coalesce(l.marks, '') AS marks FROM documents d LEFT JOIN (SELECT doc_id, string_agg(quality || '/' || toxic, ',' ORDER BY quality || '/' || toxic) AS marks FROM labels GROUP BY 1) l USING (doc_id)""")
def s17_static_index(t):
    marks = t.labels.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")))).alias("m"))
    return t.documents.join(marks, "doc_id", "left").select("doc_id", F.concat_ws("|", "source", "lang").alias("title"), F.substring("text", 1, 400).alias("synopsis"), F.coalesce(F.array_join("m", ","), F.lit("")).alias("marks"))


@query("""SELECT '/' AS loc UNION ALL SELECT DISTINCT '/years/' || year(o_orderdate) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT '/dramas/' || o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def s19_sitemap(t):
    shown = t.orders.where("o_orderstatus = 'F'")
    years = shown.select(F.concat(F.lit("/years/"), F.year("o_orderdate").cast("string")).alias("loc")).distinct()
    works = shown.select(F.concat(F.lit("/dramas/"), F.col("o_orderkey").cast("string")).alias("loc"))
    return t.spark.range(1).select(F.lit("/").alias("loc")).unionByName(years).unionByName(works)


@query("""SELECT y AS year, y || '년 드라마' AS title, (SELECT count(*) FROM orders WHERE year(o_orderdate) = y) AS works
FROM (SELECT unnest(generate_series((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders))) AS y)""")
def s20_year_titles(t):
    """The category titles of all years from the first to the last work's, with the number of works."""
    year = F.year("o_orderdate").cast("long")
    ends = t.orders.agg(F.min(year).alias("a"), F.max(year).alias("z")).first()
    works = t.orders.groupBy(year.alias("year")).agg(F.count("*").alias("works"))
    return S.year_titles(t.spark, ends.a, ends.z).join(works, "year", "left").select("year", "title", F.coalesce("works", F.lit(0)).alias("works"))


LINK_SQL = r"""(SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 451 WHEN 3 THEN 503 WHEN 4 THEN 301 WHEN 5 THEN 200 WHEN 6 THEN 200 ELSE 200 END AS http, CASE page_id % 3 WHEN 0 THEN 'netflix' WHEN 1 THEN 'kbs' ELSE 'other' END AS provider,
 CASE page_id % 5 WHEN 0 THEN 'https://www.netflix.com/browse' WHEN 1 THEN 'https://x.kbs.co.kr/region/1' WHEN 2 THEN url ELSE 'https://example.org/a' END AS final, CASE WHEN page_id % 11 = 0 THEN 'timeout' END AS error FROM pages)"""


@query(f"""SELECT page_id, CASE WHEN error IS NOT NULL THEN 'TEMPORARY_ERROR' WHEN http = 404 THEN 'NOT_FOUND' WHEN http = 451 OR (http = 403 AND walled) THEN 'REGION_RESTRICTED' WHEN http = 403 THEN 'ACCESS_DENIED' WHEN http >= 500 THEN 'TEMPORARY_ERROR'
 WHEN http = 301 THEN 'REDIRECTED' WHEN NOT there THEN 'REDIRECTED' WHEN provider = 'netflix' AND final <> url AND final = 'https://www.netflix.com/browse' THEN 'REDIRECTED' WHEN walled THEN 'REGION_RESTRICTED' ELSE 'AVAILABLE' END AS state
FROM (SELECT *, final LIKE '%region%' OR final LIKE '%unavailable%' OR final LIKE '%not-available%' OR final LIKE '%/geo%' AS walled,
 CASE provider WHEN 'netflix' THEN regexp_extract(final, '^[a-z]+://([^/]+)', 1) LIKE '%netflix.com' WHEN 'kbs' THEN regexp_extract(final, '^[a-z]+://([^/]+)', 1) LIKE '%kbs.co.kr' ELSE true END AS there FROM {LINK_SQL})""")
def k06_link_verdict(t):
    p = F.col("page_id")
    rows = t.pages.select("page_id", "url", F.get(F.array(*map(F.lit, [404, 403, 451, 503, 301, 200, 200, 200])), (p % 8).cast("int")).alias("http"), F.when(p % 3 == 0, "netflix").when(p % 3 == 1, "kbs").otherwise("other").alias("provider"), F.when(p % 5 == 0, "https://www.netflix.com/browse").when(p % 5 == 1, "https://x.kbs.co.kr/region/1").when(p % 5 == 2, F.col("url")).otherwise("https://example.org/a").alias("final"), F.when(p % 11 == 0, "timeout").alias("error"))
    return rows.select("page_id", rules.link_verdict(F.col("provider"), F.col("url"), F.col("http"), F.col("final"), F.col("error")).alias("state"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'DRAMA' WHEN 2 THEN 'DRAMA' ELSE 'NOT_DRAMA' END AS kind FROM pages")
def k01_program_kinds(t):
    """Kinds by classes, genres and categories; the rule table is tested on fixtures."""
    labels = F.array(F.get(F.array(*map(F.lit, ["drama", "quiz", "thriller", "news"])), (F.col("page_id") % 4).cast("int")))
    none = F.lit(None).cast("array<string>")
    return t.pages.select("page_id", rules.program_kind(none, labels, none)["kind"].alias("kind"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'sbs' WHEN 1 THEN 'tvn' WHEN 3 THEN 'netflix' END AS code, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages")
def k05_channels(t):
    titles = F.array(F.get(F.array(*map(F.lit, ["SBS 금토드라마", "TvN의 텔레비전 드라마", "KBS MBC", "Netflix"])), (F.col("page_id") % 4).cast("int")))
    return t.pages.select("page_id", rules.infer_channel(titles)["code"].alias("code"), host(F.col("url")).alias("host"))


@query("""SELECT code, pool, prefixes, discovered, (SELECT count(*) FROM pages WHERE starts_with(url, prefixes)) AS pages FROM (VALUES ('manual', 'source_manual_pool', 'https://', false), ('local_seed', 'source_manual_pool', 'http://seed:8000/', false), ('wikidata', 'source_wikidata_pool', 'https://query.wikidata.org/', true),
('kowiki', 'source_kowiki_pool', 'https://ko.wikipedia.org/', false), ('tvn_official', 'source_tvn_pool', 'https://tvn.cjenm.com/', false)) s(code, pool, prefixes, discovered)""")
def s15_sources(t):
    """The registry, with the number of pages whose address each source's allow-list lets through."""
    sources = S.sources(t.spark)
    each = F.broadcast(sources.select("code", F.explode("prefixes").alias("prefix")))
    allowed = t.pages.select("page_id", "url").join(each, F.startswith(F.col("url"), F.col("prefix"))).groupBy("code").agg(F.countDistinct("page_id").alias("pages"))
    return sources.join(allowed, "code", "left").select("code", "pool", F.array_join("prefixes", " ").alias("prefixes"), "discovered", F.coalesce("pages", F.lit(0)).alias("pages"))
