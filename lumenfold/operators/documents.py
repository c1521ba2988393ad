"""Search documents: labelled lines of text, facets, and a digest that tells whether readers would see a difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenfold.functions.rules import GENRE_LABELS, labelled

VERSION = 2
#: Labels of crew lines.
CREW = {"DIRECTOR": "연출", "WRITER": "극본", "PRODUCER": "제작"}


def rendered(lines: Sequence[tuple[str, Column]]) -> Column:
    """``label: value`` lines; empty values have none."""
    return F.concat_ws("\n", *(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value)) for label, value in lines))


def render(works: DataFrame) -> DataFrame:
    """Works (id, slug, title_ko, title_en, aliases, broadcaster_code, broadcaster_name, start_date, end_date, episode_count, synopsis, genres,
    cast (name, character), crew (name, type), osts (title, artists), canonical_version) as search documents."""
    c = F.col
    cast = F.array_join(F.transform("cast", lambda x: F.when(F.coalesce(x["character"], F.lit("")) != "", F.concat(x["name"], F.lit(" ("), x["character"], F.lit(" 역)"))).otherwise(x["name"])), ", ")
    crew = F.array_join(F.transform("crew", lambda x: F.concat(labelled(x["type"], CREW), F.lit(": "), x["name"])), "\n")
    songs = F.array_join(F.transform("osts", lambda x: F.when(F.size(x["artists"]) > 0, F.concat(x["title"], F.lit(" - "), F.array_join(x["artists"], ", "))).otherwise(x["title"])), ", ")
    year = F.year("start_date")
    head = rendered([("방송사", c("broadcaster_name")), ("연도", F.concat(year.cast("string"), F.lit("년"))), ("장르", F.array_join(F.transform("genres", lambda g: labelled(g, GENRE_LABELS)), ", ")), ("출연", cast)])
    body = F.concat_ws("\n", *(F.nullif(x, F.lit("")) for x in (head, crew, rendered([("OST", songs)]))))
    metadata = F.struct("slug", "title_en", "broadcaster_code", "broadcaster_name", year.alias("year"), c("start_date").cast("string").alias("start_date"), c("end_date").cast("string").alias("end_date"), "episode_count", "genres", F.transform("cast", lambda x: x["name"]).alias("cast"))
    aliases = F.array_join(F.concat(F.array_compact(F.array("title_en")), c("aliases")), "\n")
    out = works.select("id", c("title_ko").alias("title"), aliases.alias("aliases"), body.alias("body"), F.trim(F.coalesce("synopsis", F.lit(""))).alias("synopsis"), metadata.alias("metadata"), "canonical_version", F.lit(VERSION).alias("document_version"))
    # The canonical version is bookkeeping: the digest leaves it out.
    return out.withColumn("content_hash", F.sha2(F.to_json(F.struct("title", "aliases", "body", "synopsis", "metadata", "document_version")), 256))
