"""The archive's, the user's, the graph's and the reviewers' routes as Python classes: one method for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenfold.operators import graph as G
from lumenfold.operators import relational as R


def resolution(status: Column, target: Column) -> tuple[Column, Column]:
    """(code, target): shown, moved to the work it was merged into, or not there for readers."""
    code = F.when(status == "PUBLISHED", 200).when((status == "MERGED") & target.isNotNull(), 301).otherwise(404)
    return code.cast("long").alias("code"), F.when(status == "MERGED", target).alias("target")


class Catalog:
    """Reads of the archive over works (id, slug, title, channel, start_date, status, merged_into, popularity), channels and credits."""

    def __init__(self, works: DataFrame, channels: DataFrame, credits: DataFrame, channel_key: str = "channel") -> None:
        self.works, self.channels, self.credits, self.key = works, channels, credits, channel_key
        self.shown = R.published(works)

    @classmethod
    def of(cls, t) -> Catalog:
        works = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("slug"), F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderdate").cast("date").alias("start_date"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("HIDDEN").alias("status"), F.lit(None).cast("long").alias("merged_into"), F.col("o_totalprice").alias("popularity"))
        credits = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("person"), F.col("l_returnflag").alias("type"))
        return cls(works, t.nation, credits, "n_nationkey")

    def broadcasters(self) -> DataFrame:
        return self.channels.join(self.shown.select(self.key).distinct(), self.key, "left_semi")

    def years(self) -> DataFrame:
        return self.shown.groupBy(F.year("start_date").alias("year")).count().orderBy(F.desc("year"))

    def year(self, year: int, channel=None, page: int = 0, size: int = 20) -> DataFrame:
        rows = R.where_set(self.shown.where(R.in_year(F.col("start_date"), year)), **{self.key: channel})
        return R.page(rows, page, size, F.col("start_date"), F.col("id"))

    def popular(self, limit: int = 12) -> DataFrame:
        return R.top_k(self.shown.where("popularity > 0"), limit, F.desc("popularity"), F.asc("id"))

    def drama(self, slug: str) -> DataFrame:
        return self._detail(self.works.where(F.col("slug") == slug))

    def drama_by_id(self, work: int) -> DataFrame:
        return self._detail(self.works.where(F.col("id") == work))

    def _detail(self, rows: DataFrame) -> DataFrame:
        people = self.credits.groupBy("id").agg(F.collect_set(F.struct("person", "type")).alias("credits"))
        found = R.with_children(rows, people, "id", "credits")
        return found.withColumns(dict(zip(("code", "target"), resolution(F.col("status"), F.col("merged_into")), strict=True)))

    def person(self, person: int) -> DataFrame:
        """A person's published works, newest first, works without a date last."""
        mine = self.credits.where(F.col("person") == person)
        return self.shown.join(mine, "id").select("id", "type", "start_date").distinct().orderBy(F.desc_nulls_last("start_date"), F.desc("id"))


class Timeline:
    """A user's archive: five aggregates over states (user_id, event_type) and watched works (user_id, o_orderdate)."""

    def __init__(self, states: DataFrame, watched: DataFrame) -> None:
        self._states, self._watched = states, watched

    def states(self, user: int) -> DataFrame:
        return self._states.where(F.col("user_id") == user).groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"))

    def years(self, user: int) -> DataFrame:
        return self._watched.where(F.col("user_id") == user).groupBy(F.year("o_orderdate").cast("string").alias("k")).agg(F.count("*").alias("n"))

    def build(self, user: int) -> DataFrame:
        return self.states(user).select(F.lit("status").alias("part"), "k", "n").unionByName(self.years(user).select(F.lit("year").alias("part"), "k", "n"))

    def note(self, notes: DataFrame, user: int, work: int) -> DataFrame:
        return notes.where((F.col("user_id") == user) & (F.col("drama_id") == work))


class Graph:
    """Reads of the graph with limits within 1 and 50."""

    def __init__(self, edges: DataFrame, features: DataFrame, songs: DataFrame) -> None:
        self.edges, self.features, self.songs = edges, features, songs

    @staticmethod
    def limit(n: int | None) -> int:
        return max(1, min(n or 20, 50))

    def collaborators(self, person, limit: int | None = None) -> DataFrame:
        return G.collaborators(self.edges, person).orderBy(F.desc("strength"), "other").limit(self.limit(limit))

    def related(self, work, limit: int | None = None) -> dict[str, DataFrame]:
        n = self.limit(limit)
        return {"by_people": G.related_by_people(self.edges, work).orderBy(F.desc("strength"), "related").limit(n), "by_ost_artists": G.related_by_artists(self.features, self.songs, work).orderBy(F.desc("artists"), "related").limit(n)}


class ReviewQueue:
    """Staging rows (id, status, resolution map of (decision, canonical_id, method, confidence)) that people decide on."""

    def __init__(self, staging: DataFrame) -> None:
        self.staging = staging

    def pending(self) -> DataFrame:
        rows = self.staging.where("status = 'REVIEW'").select("id", F.explode("resolution").alias("mention", "match"))
        return rows.where("match.decision = 'REVIEW'").select("id", "mention", "match.canonical_id", "match.method", "match.confidence")

    def problems(self, limit: int = 200) -> DataFrame:
        return self.staging.where(F.col("status").isin("PARSE_FAILED", "REJECTED")).orderBy("id").limit(limit)

    def decide(self, decisions: DataFrame) -> DataFrame:
        """Apply (id, mention, decision, canonical_id); a record with nothing left to review becomes RESOLVED."""
        by_record = decisions.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("mention", F.struct("decision", "canonical_id")))).alias("made"))
        rows = self.staging.join(by_record, "id", "left")
        new = F.transform_values("resolution", lambda k, m: F.coalesce(F.when(F.element_at("made", k).isNotNull(), F.struct(F.element_at("made", k)["decision"].alias("decision"), F.element_at("made", k)["canonical_id"].alias("canonical_id"), F.lit("MANUAL").alias("method"), F.lit(1.0).alias("confidence"))), m))
        rows = rows.withColumn("resolution", F.when(F.col("made").isNotNull(), new).otherwise(F.col("resolution")))
        left = F.exists(F.map_values("resolution"), lambda m: m["decision"] == "REVIEW")
        return rows.withColumn("status", F.when((F.col("status") == "REVIEW") & ~left, "RESOLVED").otherwise(F.col("status"))).drop("made")
