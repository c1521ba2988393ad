"""Raw snapshots: manifests, the guard on addresses, content addressing, and idempotent records of what was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenfold.operators.merge import new_rows
from lumenfold.operators.relational import numbered

ENTITY_TYPES = ["DRAMA", "PERSON", "SONG", "LINK"]
MANIFEST = "source_code string, items array<struct<external_id: string, entity_type: string, url: string, kind: string>>"
# The sources, the prefixes of addresses each may be read from, its pool and its pause between requests.
SOURCES = [
    ("manual", ["https://"], "source_manual_pool", 20.0, 0.0, False),
    ("local_seed", ["http://seed:8000/"], "source_manual_pool", 20.0, 0.0, False),
    ("wikidata", ["https://query.wikidata.org/"], "source_wikidata_pool", 120.0, 1.0, True),
    ("kowiki", ["https://ko.wikipedia.org/"], "source_kowiki_pool", 30.0, 0.25, False),
    ("tvn_official", ["https://tvn.cjenm.com/"], "source_tvn_pool", 20.0, 0.0, False),
]
EXTENSIONS = {"application/json": "json", "application/sparql-results+json": "json", "text/html": "html", "text/plain": "txt", "application/xml": "xml", "text/xml": "xml"}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "code string, prefixes array<string>, pool string, timeout double, pause double, discovered boolean")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source_code, pos, external_id, entity_type, url, kind, error): items in order, with what is wrong with them."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    rows = raw.select("source_code", F.posexplode("items").alias("pos", "i")).select("source_code", "pos", "i.*")
    return rows.withColumn("error", manifest_error(F.col("external_id"), F.col("entity_type"), F.col("url")))


def manifest_error(external_id: Column, entity_type: Column, url: Column) -> Column:
    n = F.length(F.coalesce(external_id, F.lit("")))
    return F.when((n < 1) | (n > 255), "external_id").when(~F.coalesce(entity_type.isin(ENTITY_TYPES), F.lit(False)), "entity_type").when(~F.coalesce(url.rlike(r"^https?://[^/\s]+"), F.lit(False)), "url")


def dedupe(items: DataFrame, order: str = "pos") -> DataFrame:
    """The first item of each (entity_type, external_id)."""
    place = F.row_number().over(Window.partitionBy("entity_type", "external_id").orderBy(order))
    return items.withColumn("n", place).where("n = 1").drop("n")


def allowed(url: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: url.startswith(p))


def guarded(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Items whose address their source may be read from; an unknown source may read nothing."""
    return items.join(F.broadcast(registry.select(F.col("code").alias("source_code"), "prefixes")), "source_code").where(allowed(F.col("url"), F.col("prefixes"))).drop("prefixes")


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def extension(content_type: Column) -> Column:
    kind = F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), kind), F.lit("bin"))


def object_key(source: Column, entity: Column, at: Column, digest: Column, ext: Column) -> Column:
    return F.concat(F.lit("source="), source, F.lit("/entity="), F.lower(entity), F.lit("/dt="), F.date_format(at, "yyyy-MM-dd"), F.lit("/"), digest, F.lit("."), ext)


def read_snapshots(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, fetched_at, body, content_hash) of stored files, with the folders' source, entity and dt."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", False).load(path)
    keep = [c for c in ("source", "entity", "dt") if c in raw.columns]
    return raw.select("path", F.col("modificationTime").alias("fetched_at"), F.col("content").alias("body"), content_hash(F.col("content")).alias("content_hash"), *keep)


def write_once(fetched: DataFrame, root: str) -> int:
    """Store bodies (source, entity, dt, content_hash, body) that are not there yet, under source/entity/dt; gives how many."""
    spark = fetched.sparkSession
    keys = ["source", "entity", "dt", "content_hash"]
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fresh = fetched.dropDuplicates(keys)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.parquet(root).select(*[F.col(k).cast("string").alias(k) for k in keys])
        fresh = fresh.join(old, keys, "left_anti")
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy("source", "entity", "dt").parquet(root)
    fresh.unpersist()
    return n


RECORD_KEY = ["source_id", "entity_type", "external_id", "content_hash"]


def store_records(records: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the new ones, outcome of each fetch: new or unchanged); null keys are equal."""
    fresh = new_rows(records, fetched, RECORD_KEY).select(*records.columns)
    known = fresh.select(*RECORD_KEY).withColumn("outcome", F.lit("new"))
    cond = F.lit(True)
    for k in RECORD_KEY:
        cond = cond & F.col(f"f.{k}").eqNullSafe(F.col(f"k.{k}"))
    outcome = fetched.alias("f").join(known.alias("k"), cond, "left").select("f.*", F.coalesce("outcome", F.lit("unchanged")).alias("outcome"))
    return records.unionByName(fresh), outcome


def chunks(items: DataFrame, size: int, *order: Column) -> DataFrame:
    """Items with the number of their batch of ``size``. (Reading needs none: partitions are Spark's batches.)"""
    return numbered(items, "chunk", *order).withColumn("chunk", F.ceil(F.col("chunk") / size).cast("long"))


def year_titles(spark: SparkSession, first: int, last: int, form: str = "%d년 드라마") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")).select(F.col("year").cast("long").alias("year"), F.format_string(form, "year").alias("title"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries from lines of JSON; blank lines and comments are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    return lines.select(F.from_json("value", "id string, class string, query string, expected array<string>").alias("g")).select("g.*")
