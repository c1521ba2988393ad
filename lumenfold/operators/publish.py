"""Publishing a batch of resolved records into the canonical tables, as one set-based pipeline.

Records are (staging_id, source_id, external_ref, record, resolution): ``record`` as the parsers give it, ``resolution`` a map from
mention keys to verdicts. Steps follow the order that rows depend on each other: works, their children, people, credits, songs,
references, one event a record. The state is a dict of tables, and so is the result; nothing is written here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenfold.operators import merge as M, relational as R
from lumenfold.operators.resolve import cluster_batch, mention_key

SCHEMAS = {
    "works": "id long, title string, title_normalized string, channel string, start_date date, episode_count int, version long",
    "aliases": "id long, alias string, alias_normalized string",
    "genres": "id long, genre string",
    "people": "id long, name string, name_normalized string, birth_date date",
    "credits": "work long, person long, credit_type string, character_name string, billing_order int, is_main_cast boolean",
    "songs": "id long, title string, title_normalized string",
    "work_songs": "work long, song long, part_no int, track_no int",
    "mappings": "source_id long, canonical_type string, external_ref string, canonical_id long, decision string, staging_id long",
    "outbox": "aggregate_id long, event_type string, payload string",
}


def empty_state(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def numbered(table: DataFrame, rows: DataFrame, *order: Column) -> DataFrame:
    """New rows with ids after the table's greatest, dense and in order."""
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    return R.numbered(rows, "__place", *order).crossJoin(F.broadcast(last)).withColumn("id", F.col("__last") + F.col("__place")).drop("__last", "__place")


def _settled(rows: DataFrame, key: Column) -> DataFrame:
    match = F.element_at("resolution", key)
    return rows.withColumn("merged", F.when(match["decision"] == "AUTO_MERGE", match["canonical_id"])).withColumn("decision", F.coalesce(match["decision"], F.lit("CREATE_NEW")))


def publish(state: dict[str, DataFrame], records: DataFrame) -> dict[str, DataFrame]:
    """The tables after the batch. Works that are new get an id each (two records of one new work are two works, and a
    quality metric); people of one batch are told apart by ``cluster_batch``; verdicts for review create nothing for songs."""
    out = dict(state)
    r = F.col("record")
    rows = _settled(records, mention_key(F.col("external_ref"), "title", r["title_normalized"])).withColumn("was_new", F.col("merged").isNull())
    fresh = numbered(state["works"], rows.where("was_new").select("staging_id"), F.col("staging_id"))
    rows = rows.join(fresh.select("staging_id", F.col("id").alias("made")), "staging_id", "left").withColumn("work", F.coalesce("merged", "made"))
    facts = rows.select(F.col("work").alias("id"), r["title_ko"].alias("title"), r["title_normalized"].alias("title_normalized"), r["broadcaster_code"].alias("channel"), r["start_date"].alias("start_date"), r["episode_count"].alias("episode_count"), "staging_id")
    latest = M.one_each(facts, ["id"], F.desc("staging_id")).drop("staging_id")
    out["works"] = M.fill_merge(state["works"], latest, ["id"], always=["title", "title_normalized"])

    aliases = rows.select(F.col("work").alias("id"), F.explode(r["aliases"]).alias("a")).select("id", "a.alias", "a.alias_normalized")
    out["aliases"] = M.insert_ignore(state["aliases"], aliases, ["id", "alias_normalized"], F.col("alias"))
    genres = rows.select(F.col("work").alias("id"), F.explode(r["genres"]).alias("genre"))
    out["genres"] = M.replace_children(state["genres"], genres, "id")

    credits = rows.select("staging_id", "source_id", "resolution", "work", F.posexplode(r["credits"]).alias("pos", "c"))
    credits = _settled(credits, mention_key(F.col("c.person.external_id"), "name", F.col("c.person.name_normalized")))
    credits = credits.withColumn("mention_id", F.xxhash64("staging_id", "pos"))
    new = credits.where("merged IS NULL").select("mention_id", "staging_id", "source_id", F.col("c.person.external_id").alias("external_ref"), F.col("c.person.name_normalized").alias("name_normalized"), F.col("c.person.birth_date").alias("birth_date"), "work", F.col("c.person.name_ko").alias("name"))
    entity = cluster_batch(new.drop("name"))
    first = new.join(entity, "mention_id").groupBy("entity").agg(F.min(F.struct("staging_id", "mention_id", "name", "name_normalized")).alias("f"), F.max("birth_date").alias("birth_date"))
    made = numbered(state["people"], first, F.col("f.staging_id"), F.col("f.mention_id"))
    out["people"] = state["people"].unionByName(made.select("id", "f.name", "f.name_normalized", F.col("birth_date").cast("date").alias("birth_date")))
    ids = entity.join(made.select("entity", F.col("id").alias("person_made")), "entity").select("mention_id", "person_made")
    credits = credits.join(ids, "mention_id", "left").withColumn("person", F.coalesce("merged", "person_made"))
    lines = credits.select("work", "person", F.col("c.credit_type").alias("credit_type"), F.col("c.character_name").alias("character_name"), F.col("c.billing_order").alias("billing_order"), F.col("c.is_main_cast").alias("is_main_cast"), "staging_id", "pos")
    key = ["work", "person", "credit_type", "character_name"]
    out["credits"] = M.overwrite(state["credits"], M.one_each(lines, key, F.desc("staging_id"), F.desc("pos")).select(*state["credits"].columns), key)

    songs = rows.select("staging_id", "source_id", "resolution", "work", F.posexplode(r["osts"]).alias("pos", "s"))
    songs = _settled(songs, mention_key(F.col("s.external_id"), "song", F.col("s.title_normalized"))).where("decision <> 'REVIEW'")
    fresh = numbered(state["songs"], songs.where("merged IS NULL").select("staging_id", "pos", F.col("s.title").alias("title"), F.col("s.title_normalized").alias("title_normalized")), F.col("staging_id"), F.col("pos"))
    out["songs"] = state["songs"].unionByName(fresh.select("id", "title", "title_normalized"))
    songs = songs.join(fresh.select("staging_id", "pos", F.col("id").alias("song_made")), ["staging_id", "pos"], "left")
    parts = songs.select("work", F.coalesce("merged", "song_made").alias("song"), F.col("s.part_no").alias("part_no"), F.col("s.track_no").alias("track_no"))
    out["work_songs"] = M.overwrite(state["work_songs"], M.one_each(parts, ["work", "song"], F.col("part_no"), F.col("track_no")), ["work", "song"])

    def mapped(df: DataFrame, kind: str, ref: Column, target: str) -> DataFrame:
        return df.where(ref.isNotNull()).select("source_id", F.lit(kind).alias("canonical_type"), ref.alias("external_ref"), F.col(target).alias("canonical_id"), "decision", "staging_id")

    refs = mapped(rows, "DRAMA", F.col("external_ref"), "work").unionByName(mapped(credits, "PERSON", F.col("c.person.external_id"), "person"))
    out["mappings"] = state["mappings"].unionByName(refs.distinct())
    event = F.when(F.col("was_new"), "DRAMA_CREATED").otherwise("DRAMA_UPDATED")
    out["outbox"] = state["outbox"].unionByName(rows.select(F.col("work").alias("aggregate_id"), event.alias("event_type"), F.to_json(F.struct("work", "staging_id", "source_id")).alias("payload")))
    return out
