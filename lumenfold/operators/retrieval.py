"""Retrieval: query analysis, lexical, trigram and vector lists, rank fusion, reranking and the hybrid search."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenfold.functions import text as T
from lumenfold.operators import graph as G
from lumenfold.operators.fulltext import BUCKETS, TextIndex, TrigramIndex, bucket_of, matches, put, websearch
from lumenfold.operators.relational import ranked, ship, top_k
from lumenfold.operators.vectors import VectorIndex

# Spoken names of channels.
CHANNEL_NAMES = {"kbs": "kbs", "케이비에스": "kbs", "kbs2": "kbs", "kbs1": "kbs", "mbc": "mbc", "엠비씨": "mbc", "sbs": "sbs", "에스비에스": "sbs", "jtbc": "jtbc", "제이티비씨": "jtbc", "tvn": "tvn", "티비엔": "tvn"}
# Patterns of years and decades, filler words, particles.
YEAR = r"(?<!\d)((?:19|20)\d{2})\s*년?\s*(대|쯤|경|초|중반|말|초반|후반)?"
SHORT_YEAR = r"(?<![\d])(\d{2})\s*년\s*(대|쯤|경)?(?![\d])"
DECADE = r"(?<!\d)((?:19|20)?\d)0\s*년대\s*(초반?|중반|후반|말)?"
FILLER = "(에서|했던|하던|나온|나왔던|나오는|출연한|출연하는|드라마|작품|뭐였지|뭐지|뭐더라|기억|찾아줘|알려줘|있었는데|같은|느낌|배경|였던|였는데|인데|이었는데)"
PARTICLE = r"(?:(?<=\s)|^)(에서|에|의|은|는|이|가|을|를|도|로|와|과)(?=\s|$)"
#: Years from the start of a decade by the part that is meant.
PARTS = {"초": (0, 3), "초반": (0, 3), "중반": (3, 6), "후반": (6, 9), "말": (6, 9)}
K = 60
DEPTH = 50
#: The least word similarity of a title that is a candidate.
SIMILAR = 0.35


@dataclass(frozen=True)
class Plan:
    """What a query asks for: words to look for, and constraints on years and channel."""

    raw: str
    text: str
    year_from: int | None = None
    year_to: int | None = None
    broadcaster: str | None = None
    signals: dict[str, str] = field(default_factory=dict)

    @property
    def constrained(self) -> bool:
        return self.year_from is not None or self.broadcaster is not None


def _years(said: str) -> tuple[str, str, tuple[int, int]] | None:
    """(kind of signal, what was said, first and last year) of the strongest mention of time."""
    around = lambda y, word: (y - 1, y + 1) if word in ("쯤", "경") else (y, y)
    if m := re.search(DECADE, said):
        head = int(m[1])
        base = 10 * head if len(m[1]) == 3 else 10 * head + (1900 if head > 4 else 2000)
        low, high = PARTS.get(m[2] or "", (0, 9))
        return "decade", m[0], (base + low, base + high)
    if m := re.search(YEAR, said):
        return "year", m[0], around(int(m[1]), m[2])
    if m := re.search(SHORT_YEAR, said):
        n = int(m[1])
        return "year", m[0], around(n + (2000 if n < 50 else 1900), m[2])
    return None


def analyze(raw: str, constraints: bool = True) -> Plan:
    """A query's plan; without ``constraints`` only fillers and particles go, and years stay words."""
    said, signals, years, channel = raw.strip(), {}, (None, None), None
    if constraints:
        if found := _years(said):
            kind, words, years = found
            signals[kind] = words
            said = said.replace(words, " ")
        names = "|".join(sorted(map(re.escape, CHANNEL_NAMES), key=len, reverse=True))
        if m := re.search(names, said, re.IGNORECASE):
            channel = CHANNEL_NAMES[m[0].lower()]
            signals["broadcaster"] = m[0]
            said = f"{said[: m.start()]} {said[m.end() :]}"
    for pattern in (FILLER, PARTICLE, r"[\s,.?!]+"):
        said = re.sub(pattern, " ", said)
    return Plan(raw, said.strip(), *years, channel, signals)


def analyzed(queries: Column) -> Column:
    """Plans of a column of queries, as structs; a table's queries go through Arrow batches."""

    @F.pandas_udf("text string, year_from int, year_to int, broadcaster string")
    def run(s: pd.Series) -> pd.DataFrame:
        plans = [analyze(q) if isinstance(q, str) else Plan("", "") for q in s]
        out = pd.DataFrame([(p.text, p.year_from, p.year_to, p.broadcaster) for p in plans], columns=["text", "year_from", "year_to", "broadcaster"])
        return out.astype({"year_from": "Int32", "year_to": "Int32"})

    return run(queries)


def overridden(plan: Plan, year_from: int | None = None, year_to: int | None = None, broadcaster: str | None = None) -> Plan:
    """Explicit parameters win; one end of the years stands for both."""
    if year_from is not None or year_to is not None:
        plan = replace(plan, year_from=year_to if year_from is None else year_from, year_to=year_from if year_to is None else year_to)
    return plan if broadcaster is None else replace(plan, broadcaster=broadcaster)


def parse_weights(spec: str | None) -> dict[str, float] | None:
    """``a:0.5,b:2``; ValueError for anything else and for negative weights."""
    if not spec:
        return None
    out = {}
    for item in spec.split(","):
        name, colon, value = item.partition(":")
        if not colon or not name.strip() or float(value) < 0:
            raise ValueError(f"no weight: {item!r}")
        out[name.strip()] = float(value)
    return out


# Documents: (doc_id, title, aliases, body, synopsis, channel, year, embedding), and start_date where it is known

def query_tokens(words: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[0-9a-z가-힣]+", words.lower())))


#: The lists of full text and what each is ordered by.
LEXICAL = {"fts": "cover", "fts_any": "mass"}


def lexical(found: DataFrame, names: Sequence[str] = ("fts", "fts_any"), k: int = DEPTH) -> DataFrame:
    """Lexical candidate lists (list_name, doc_id, rank, score) from (doc_id, every, cover, mass): documents that are what the search
    asks for by the density of their covers, and those with any of its words by the weight of these."""
    out = None
    for name in names:
        rows = found.where("every") if LEXICAL[name] == "cover" else found
        part = listed(name, rows.select("doc_id", F.col(LEXICAL[name]).alias("score")), k)
        out = part if out is None else out.unionByName(part)
    return out


def graph_list(people: DataFrame, credits: DataFrame, works: DataFrame, said: str, k: int = DEPTH) -> DataFrame:
    """(work, rank) for the people a query names; ``people``: (id, name), ``credits``: (person, work), ``works``: (work, start_date).

    One name: the works of its first person. Several names: the works that all of the people share, newest first, or, where
    there is none, each one's works, person by person. A name is a word of the query, as it is said or without its particle.
    """
    spark = people.sparkSession
    named = spark.createDataFrame([(said,)], "said string").select(F.explode(T.name_candidates(F.col("said"))).alias("name"))
    found = people.join(F.broadcast(named), "name", "left_semi").select("id", "name").orderBy("id").limit(k).collect()
    ids = [r.id for r in found]
    if not ids:
        return spark.createDataFrame([], "work long, rank long")
    dated = credits.where(F.col("person").isin(ids)).select("person", "work").distinct().join(works.select("work", "start_date"), "work")
    newest = [F.desc_nulls_first("start_date"), F.asc("work")]
    if len({r.name for r in found}) > 1:
        shared = ranked(G.works_shared(credits.select("person", "work"), ids).join(works.select("work", "start_date"), "work"), k, *newest).select("work", F.col("rank").cast("long").alias("rank"))
        if not shared.isEmpty():
            return shared
    else:
        ids = ids[:1]
    order = F.array_position(F.array(*map(F.lit, ids)), F.col("person"))
    mine = dated.where(F.col("person").isin(ids)).withColumn("n", F.row_number().over(Window.partitionBy("person").orderBy(*newest))).where(F.col("n") <= k)
    first = mine.groupBy("work").agg(F.min(F.struct(order.alias("person"), "n")).alias("at"))
    return ranked(first, k * len(ids), F.asc("at")).select("work", F.col("rank").cast("long").alias("rank"))


def allowed(plan: Plan) -> Column | None:
    """Within a plan's years and channel; what has no year meets no years."""
    years = F.col("year").between(plan.year_from, plan.year_to) if plan.year_from is not None else None
    channel = F.col("channel") == plan.broadcaster if plan.broadcaster is not None else None
    return years & channel if years is not None and channel is not None else years if years is not None else channel


def filtered(docs: DataFrame, plan: Plan) -> DataFrame:
    """Documents within a plan's years and channel."""
    where = allowed(plan)
    return docs if where is None else docs.where(where)


def listed(name: str, rows: DataFrame, k: int = DEPTH) -> DataFrame:
    """The best k as a candidate list (list_name, doc_id, rank, score)."""
    best = ranked(rows.select("doc_id", "score"), k, F.desc("score"), F.asc("doc_id"))
    return best.select(F.lit(name).alias("list_name"), "doc_id", "rank", F.col("score").cast("double").alias("score"))


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = K) -> DataFrame:
    """(doc_id, score, ranks, scores): weighted reciprocal ranks summed over lists; ranks and scores stay as evidence."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("list_name") == name, float(w)).otherwise(weight)
    part = weight / (F.lit(k) + F.col("rank"))
    evidence = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("list_name", c))))
    first = lists.groupBy("doc_id", "list_name").agg(F.sum(part).alias("part"), F.min("rank").alias("rank"), F.max("score").alias("score"))
    return first.groupBy("doc_id").agg(F.sum("part").alias("score"), evidence("rank").alias("ranks"), evidence("score").alias("scores"))


def match_reasons(ranks: Column) -> Column:
    """``list#rank`` of each list that has the document, by name."""
    return F.transform(F.array_sort(F.map_entries(ranks)), lambda e: F.concat(e["key"], F.lit("#"), e["value"].cast("string")))


def overlap(query: Column, document: Column) -> Column:
    """Share of a query's distinct words that a document has."""
    q = F.array_distinct(T.words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.words(document))) / F.size(q)).otherwise(0.0)


def rerank_text() -> Column:
    """What a reranker reads of a document: title, aliases, body and the first 600 characters of the plot, where they are there."""
    some = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    parts = [F.col("title")] + [F.when(some(F.col(c)), F.col(c)) for c in ("aliases", "body")]
    plot = F.when(some(F.col("synopsis")), F.concat(F.lit("줄거리: "), F.substring("synopsis", 1, 600)))
    return F.concat_ws("\n", *parts, plot)


def reranked(fused: DataFrame, docs: DataFrame, query: str, n: int = 30, scorer: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """The best n of a fusion, which are all that stay, in the order of a scorer of pairs (equal ones by id). Fusion's evidence
    stays, with the new score and rank beside it, and the score becomes the scorer's."""
    head = ranked(fused, n, F.desc("score"), F.asc("doc_id"), name="fused_rank")
    scored = head.join(docs.select("doc_id", rerank_text().alias("whole")), "doc_id").withColumn("rerank_score", scorer(F.lit(query), F.col("whole"))).drop("whole")
    placed = ranked(scored, n, F.desc("rerank_score"), F.asc("doc_id"))
    more = lambda c, v: F.map_concat(c, F.map_from_arrays(F.array(F.lit("rerank")), F.array(v)))
    return placed.withColumns({"ranks": more(F.col("ranks"), F.col("rank").cast("long")), "scores": more(F.col("scores"), F.col("rerank_score").cast("double")), "score": F.col("rerank_score").cast("double")})


def strategy(lists: Sequence[str]) -> str:
    """The label of a search by the lists that found something."""
    kinds = ["LEXICAL"] * any(x in lists for x in ("fts", "fts_any", "trigram")) + ["VECTOR"] * ("vector" in lists) + ["GRAPH"] * ("graph" in lists)
    return "_".join(kinds) if kinds else "FILTER" if "filter" in lists else "NONE"


def strategy_of(lists: Column) -> Column:
    """The same of an array of names."""
    any_of = lambda *names: F.arrays_overlap(lists, F.array(*map(F.lit, names)))
    kinds = F.array_compact(F.array(F.when(any_of("fts", "fts_any", "trigram"), "LEXICAL"), F.when(any_of("vector"), "VECTOR"), F.when(any_of("graph"), "GRAPH")))
    return F.when(F.size(kinds) > 0, F.array_join(kinds, "_")).when(any_of("filter"), "FILTER").otherwise("NONE")


class HashEmbedder:
    """Vectors of unit length seeded by the text's digest: for tests, near texts are not near."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(self.dim)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    def column(self):
        """As a pandas UDF, built once a worker."""
        ship(SparkSession.active())

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: self.embed([t])[0], na_action="ignore")

        return run


class WordEmbedder(HashEmbedder):
    """Vectors by random indexing: each word has a direction of its own, seeded by its digest, and a text is the sum of its words',
    each by one and the logarithm of its count, of unit length. Texts that share words are near, and the more so the more they
    share; a query and a document are embedded alike. A text without words has a vector of zeros, which is near to nothing."""

    def __init__(self, dim: int = 64) -> None:
        super().__init__(dim)
        self._number: dict[str, int] = {}
        self._directions = np.zeros((0, dim), np.int8)

    def _direction(self, word: str) -> np.ndarray:
        bits = hashlib.shake_256(word.encode()).digest(self.dim // 8 + 1)
        return np.unpackbits(np.frombuffer(bits, np.uint8))[: self.dim].astype(np.int8) * 2 - 1

    def _of(self, words: Sequence[str]) -> np.ndarray:
        """A row for each word. A worker remembers 100,000 words, or those of one text with more, and begins anew beyond."""
        if len(self._number) + len(words) > max(100_000, len(words)):
            self._number.clear()
        if len(self._number) + len(words) > len(self._directions):
            wider = np.zeros((2 * (len(self._number) + len(words)), self.dim), np.int8)
            wider[: len(self._directions)] = self._directions
            self._directions = wider
        for word in words:
            if word not in self._number:
                self._directions[len(self._number)] = self._direction(word)
                self._number[word] = len(self._number)
        return self._directions[[self._number[w] for w in words]]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            counts = Counter(re.findall("[0-9a-z가-힣]+", t.lower()))
            weights = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
            v = (weights[:, None] * self._of(list(counts))).sum(0)
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out


def embedding_text(title: Column, synopsis: Column) -> Column:
    """What is embedded: title and plot; nothing without a plot."""
    return F.when(F.length(F.trim(synopsis)) > 0, F.concat_ws("\n", title, F.trim(synopsis)))


def refresh_embeddings(docs: DataFrame, embedder: HashEmbedder, model: str) -> DataFrame:
    """New vectors and times for the stale rows of (doc_id, title, synopsis, embedding, embedding_model, embedded_at, updated_at);
    a row without a plot is marked as done and keeps no vector."""
    stale = ~F.col("embedding_model").eqNullSafe(model) | F.col("embedded_at").isNull() | (F.col("embedded_at") < F.col("updated_at"))
    fresh = embedder.column()(F.when(stale, embedding_text(F.col("title"), F.col("synopsis"))))
    return docs.withColumns({"embedding": F.when(stale, fresh).otherwise(F.col("embedding")), "embedding_model": F.when(stale, F.lit(model)).otherwise(F.col("embedding_model")), "embedded_at": F.when(stale, F.col("updated_at")).otherwise(F.col("embedded_at"))})


class Retriever:
    """Hybrid search: the lists a query's plan calls for, fused by reciprocal rank, optionally reranked.

    ``index``, ``vectors`` and ``names`` (of title and aliases): stored indexes of the documents that carry their year and channel;
    without them texts, vectors and names are scanned. ``graph``: a function from the query's words to a (work, rank) table (see ``graph_list``), or None; if it fails, the search
    fails where the graph is ``required``, and else goes on without it and ``failed`` tells why. A list of weight 0 is not built.
    """

    def __init__(self, docs: DataFrame, embedder: HashEmbedder | None = None, graph: Callable[[str], DataFrame] | None = None, index: TextIndex | None = None, vectors: VectorIndex | None = None, names: TrigramIndex | None = None, required: bool = False) -> None:
        self.docs, self.embedder, self.graph, self.index, self.vectors, self.names, self.required = docs, embedder, graph, index, vectors, names, required
        self.failed: str | None = None

    def lists(self, plan: Plan, weights: dict[str, float]) -> dict[str, DataFrame]:
        docs = filtered(self.docs, plan)
        on = lambda name: weights.get(name, 1.0) > 0
        out: dict[str, DataFrame] = {}
        if not plan.text:
            if plan.constrained:
                day = F.col("start_date") if "start_date" in docs.columns else F.col("year")
                rows = ranked(docs.select("doc_id", day.alias("day")), DEPTH, F.asc_nulls_last("day"), F.asc("doc_id"))
                out["filter"] = rows.select(F.lit("filter").alias("list_name"), "doc_id", F.col("rank").cast("long").alias("rank"), F.lit(0.0).alias("score"))
            return out
        if on("fts") or on("fts_any"):
            found = self.index.matches(websearch(plan.text), allowed(plan)) if self.index else matches(docs, websearch(plan.text))
            out |= {name: lexical(found, [name]) for name in LEXICAL if on(name)}
        if on("trigram") and self.names:
            out["trigram"] = listed("trigram", self.names.similar(plan.text, SIMILAR, allowed(plan)).withColumnRenamed("id", "doc_id"))
        elif on("trigram"):
            names = F.greatest(*(T.similar(F.lit(plan.text), F.coalesce(F.col(c), F.lit("")), SIMILAR) for c in ("title", "aliases")))
            out["trigram"] = listed("trigram", docs.select("doc_id", names.alias("score")).where(F.col("score") >= SIMILAR))
        if self.embedder and self.vectors and on("vector"):
            near = self.vectors.nearest(self.embedder.embed([plan.text])[0], DEPTH, allowed(plan))
            out["vector"] = near.select(F.lit("vector").alias("list_name"), F.col("id").alias("doc_id"), "rank", "score")
        elif self.embedder and on("vector"):
            q = F.array(*map(F.lit, self.embedder.embed([plan.text])[0]))
            out["vector"] = listed("vector", docs.where("embedding IS NOT NULL").select("doc_id", F.round(T.cosine(F.col("embedding"), q), 6).alias("score")).where("score IS NOT NULL"))
        if self.graph and on("graph"):
            try:
                rows = self.graph(plan.text).orderBy("rank").limit(DEPTH).select(F.col("work").cast("long").alias("doc_id"), "rank").collect()
            except Exception as e:
                if self.required:
                    raise
                self.failed, rows = type(e).__name__, []
            found = self.docs.sparkSession.createDataFrame([(r.doc_id, r.rank) for r in rows], "doc_id long, rank long")
            known = docs.select("doc_id").join(F.broadcast(found), "doc_id")
            out["graph"] = ranked(known, DEPTH, F.asc("rank"), name="place").select(F.lit("graph").alias("list_name"), "doc_id", F.col("place").cast("long").alias("rank"), F.lit(1.0).alias("score"))
        return out

    def search(self, query: str, limit: int = 10, weights: dict[str, float] | None = None, rerank: bool = False, **overrides) -> DataFrame:
        """(doc_id, score, ranks, scores) and with ``rerank`` its score and rank. A query whose constraints leave nothing is asked
        again without them. The candidates, DEPTH a list, are computed once and come to the driver."""
        weights, spark = weights or {}, self.docs.sparkSession
        rows: list = []
        for constraints in (True, False):
            plan = overridden(analyze(query, constraints), **overrides)
            parts = [x.select("list_name", "doc_id", "rank", "score") for x in self.lists(plan, weights).values()]
            rows = [tuple(r) for r in reduce(DataFrame.unionByName, parts).collect()] if parts else []
            if rows or not (constraints and plan.constrained and plan.text):
                break
        found = spark.createDataFrame(rows, "list_name string, doc_id long, rank long, score double")
        fused = rrf(found, weights)
        if rerank:
            return reranked(fused, self.docs, query).orderBy("rank").limit(limit)
        return fused.orderBy(F.desc("score"), "doc_id").limit(limit)


def browser_index(docs: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """(token, doc_id, field, boost, tf, size, average): postings of a static index with what BM25 needs."""
    parts = []
    for name, boost in boosts.items():
        tokens = docs.select("doc_id", T.search_tokens(F.coalesce(F.col(name), F.lit(""))).alias("t")).withColumn("size", F.size("t"))
        mean = tokens.agg(F.avg("size").alias("average"))
        rows = tokens.select("doc_id", "size", F.explode("t").alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("tf"), F.first("size").alias("size")).crossJoin(F.broadcast(mean))
        parts.append(rows.select("token", "doc_id", F.lit(name).alias("field"), F.lit(boost).alias("boost"), "tf", "size", "average"))
    return reduce(DataFrame.unionByName, parts)


class StaticIndex:
    """A static search index, written once: ``terms`` (token, field, df), sorted by token over ranges, ``postings`` in a folder for
    each bucket of tokens, and ``size``, the number of documents.

    The beginning of a word is a range of the sorted terms; the terms in it name the buckets and tokens whose postings are read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.buckets = spark, buckets
        self.terms, self.postings = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/postings")
        self.documents = spark.read.parquet(f"{path}/size").first().n

    @classmethod
    def write(cls, docs: DataFrame, path: str, boosts: dict[str, float], buckets: int = BUCKETS) -> StaticIndex:
        spark = docs.sparkSession
        own = f"{path}.{uuid.uuid4().hex}"
        rows = browser_index(docs, boosts).withColumn("bucket", bucket_of(F.col("token"), buckets))
        rows.repartitionByRange("bucket", "token", "doc_id").sortWithinPartitions("bucket", "token", "field", "doc_id").write.partitionBy("bucket").parquet(f"{own}/postings")
        stored = spark.read.parquet(f"{own}/postings")
        terms = stored.groupBy("token", "field", "bucket").agg(F.count("*").alias("df"))
        terms.repartitionByRange("token", "field").sortWithinPartitions("token", "field").write.parquet(f"{own}/terms")
        docs.agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{own}/size")
        put(spark, own, path)
        return cls(spark, path, buckets)

    def range(self, word: str) -> DataFrame:
        """The terms that begin with a word, as a range of the sorted table: from the word up to the next text after all of them."""
        after = word[:-1] + chr(ord(word[-1]) + 1)
        return self.terms.where((F.col("token") >= word) & (F.col("token") < after))

    def search(self, query: str, limit: int = 30, k1: float = 1.2, b: float = 0.7, d: float = 0.5) -> DataFrame:
        """(doc_id, score): BM25+ with prefix matches weighing less, all words first and any word where that finds nothing."""
        words = query_tokens(query)
        if not words:
            return self.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        parts = [self.range(w).select("*", F.lit(w).alias("word"), F.when(F.col("token") == w, 1.0).otherwise(0.375 * len(w) / F.length("token")).alias("close")) for w in words]
        terms = reduce(DataFrame.unionByName, parts)
        # The rarity of a term counts all documents that have it by any of the query's words, each once.
        matched = self.postings.join(terms, ["bucket", "token", "field"])
        idf = F.log(1 + (self.documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.col("boost") * F.col("close") * idf * (d + F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("average"))))
        scored = matched.groupBy("doc_id").agg(F.sum(part).alias("score"), F.countDistinct("word").alias("words"))
        best = scored.agg(F.max("words").alias("most"))
        kept = scored.crossJoin(F.broadcast(best)).where((F.col("words") == len(words)) | (F.col("most") < len(words)))
        return top_k(kept.select("doc_id", F.round("score", 5).alias("score")), limit, F.desc("score"), F.asc("doc_id"))
