"""Golden queries generated from the catalogue: five classes of questions whose answers the catalogue itself knows.

Every choice, of what is asked and in which words, is a digest of the seed and of what is asked about, so that the same catalogue
gives the same queries on any cluster, and any engine with MD5 can repeat them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenfold.operators.evaluate import pairs_sharing_one
from lumenfold.operators.relational import top_k

# The order of the classes.
CLASSES = ["entity_lookup", "person", "multi_hop", "character", "temporal"]


def digest(seed: int, kind: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(kind), *(k.cast("string") for k in keys)))


def chosen(variants: Column, d: Column) -> Column:
    """One of an array's values by six hex digits of a digest."""
    return F.get(variants, (F.conv(F.substring(d, 1, 6), 16, 10).cast("long") % F.size(variants)).cast("int"))


def _asked(rows: DataFrame, kind: str, n: int, keys: Sequence[str], query: Column, expected: Column) -> DataFrame:
    """(class, place, query, expected) of the n rows with the least digests; ``d`` is each row's digest."""
    few = top_k(rows, n, F.col("d"), *(F.col(k) for k in keys))
    place = F.row_number().over(Window.orderBy("d", *keys))  # of n rows at most
    return few.select(F.lit(kind).alias("class"), place.alias("place"), query.alias("query"), expected.alias("expected"))


def entity_lookup(works: DataFrame, seed: int, n: int) -> DataFrame:
    """Works whose title no other has, by their title, one of their aliases or their English title."""
    single = works.groupBy("title").agg(F.count("*").alias("c"), F.min("slug").alias("slug")).where("c = 1").select("slug")
    aliases = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a != "")
    english = F.filter(F.array("title_en"), lambda a: a.isNotNull() & (a != ""))
    rows = works.join(single, "slug", "left_semi").withColumn("d", digest(seed, "entity_lookup", F.col("slug")))
    return _asked(rows, "entity_lookup", n, ["slug"], chosen(F.concat(F.array("title"), aliases, english), F.col("d")), F.array("slug"))


def person(credits: DataFrame, seed: int, n: int) -> DataFrame:
    """People with one to three credits, by what they do: writers and directors who do not act are asked for as such."""
    by = credits.groupBy("name").agg(F.count("*").alias("c"), F.array_sort(F.collect_set("slug")).alias("slugs"), F.max((F.col("type") == "ACTOR").cast("int")).alias("acts"), F.max((F.col("type") == "WRITER").cast("int")).alias("writes"), F.max((F.col("type") == "DIRECTOR").cast("int")).alias("directs"))
    rows = by.where("name IS NOT NULL AND c BETWEEN 1 AND 3").withColumn("d", digest(seed, "person", F.col("name")))
    name = F.col("name")
    acting = chosen(F.array(F.concat(name, F.lit(" 나온 드라마")), F.concat(name, F.lit(" 출연작")), F.concat(F.lit("배우 "), name)), F.col("d"))
    said = F.when((F.col("writes") == 1) & (F.col("acts") == 0), F.concat(name, F.lit(" 작가 드라마"))).when((F.col("directs") == 1) & (F.col("acts") == 0), F.concat(name, F.lit(" 연출 작품"))).otherwise(acting)
    return _asked(rows, "person", n, ["name"], said, F.col("slugs"))


def multi_hop(credits: DataFrame, seed: int, n: int) -> DataFrame:
    """Two actors who have exactly one work in common and two credits or more each."""
    busy = credits.groupBy("name").agg(F.count("*").alias("c")).where("c >= 2").select("name")
    acts = credits.where("type = 'ACTOR'").join(busy, "name", "left_semi").select(F.col("name").alias("person"), F.col("slug").alias("work"))
    rows = pairs_sharing_one(acts, least=1).withColumn("d", digest(seed, "multi_hop", F.col("a"), F.col("b")))
    a, b = F.col("a"), F.col("b")
    said = F.array(F.concat(a, F.lit("랑 "), b, F.lit(" 같이 나온 드라마")), F.concat(a, F.lit(" "), b, F.lit(" 공동 출연작")), F.concat(a, F.lit("이랑 "), b, F.lit(" 나온 작품")))
    return _asked(rows, "multi_hop", n, ["a", "b"], chosen(said, F.col("d")), F.array("work"))


def character(credits: DataFrame, seed: int, n: int) -> DataFrame:
    """Characters that one credit of the whole catalogue has."""
    by = credits.where("character <> ''").groupBy("character").agg(F.count("*").alias("c"), F.first("name").alias("name"), F.first("slug").alias("slug")).where("c = 1")
    rows = by.withColumn("d", digest(seed, "character", F.col("character")))
    who, name = F.col("character"), F.col("name")
    said = F.array(F.concat(who, F.lit(" 역 "), name), F.concat(who, F.lit(" 나오는 드라마")), F.concat(name, F.lit(" "), who))
    return _asked(rows, "character", n, ["character"], chosen(said, F.col("d")), F.array("slug"))


def temporal(works: DataFrame, channels: dict[str, str], genres: dict[str, str], seed: int, n: int) -> DataFrame:
    """Years, channels and genres that one to four works share; a work without genres counts with none. ``channels`` and ``genres``:
    spoken names; channels without one are not asked for, genres are called as they are."""
    spoken = lambda names: F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,string>")
    none = F.array(F.lit(None).cast("string"))
    cells = works.where("year IS NOT NULL AND channel IS NOT NULL").select("slug", "year", "channel", F.explode(F.when(F.size("genres") > 0, F.col("genres")).otherwise(none)).alias("genre"))
    by = cells.groupBy("year", "channel", "genre").agg(F.count("*").alias("c"), F.array_sort(F.collect_list("slug")).alias("slugs")).where(F.col("c").between(1, 4))
    rows = by.where(F.col("channel").isin(list(channels))).withColumn("d", digest(seed, "temporal", F.col("year"), F.col("channel"), F.coalesce("genre", F.lit(""))))
    year, on = F.col("year").cast("string"), F.try_element_at(spoken(channels), F.col("channel"))
    kind = F.when(F.col("genre").isNotNull(), F.concat(F.lit(" "), F.coalesce(F.try_element_at(spoken(genres), F.col("genre")), F.col("genre")))).otherwise("")
    said = F.array(F.concat(year, F.lit("년 "), on, kind, F.lit(" 드라마")), F.concat(year, F.lit("년에 "), on, F.lit("에서 한"), kind, F.lit(" 드라마")))
    return _asked(rows, "temporal", n, ["year", "channel", "genre"], chosen(said, F.col("d")), F.col("slugs"))


def generate(works: DataFrame, credits: DataFrame, channels: dict[str, str], genres: dict[str, str], seed: int = 7, per_class: int = 60) -> DataFrame:
    """(id, class, query, expected): up to ``per_class`` queries of each class, numbered class by class.

    ``works``: (slug, title, title_en, aliases, year, channel, genres); ``credits``: (slug, name, type, character), a row for each
    credit. Slugs are unique.
    """
    parts = [entity_lookup(works, seed, per_class), person(credits, seed, per_class), multi_hop(credits, seed, per_class), character(credits, seed, per_class), temporal(works, channels, genres, seed, per_class)]
    every = reduce(DataFrame.unionByName, parts)
    order = Window.orderBy(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")), "place")  # five times per_class rows at most
    return every.select(F.format_string("g%04d", F.row_number().over(order)).alias("id"), "class", "query", "expected")
