"""Full text: words with places and weights, the syntax of web searches, cover density, and a stored index.

A search is judged over the places of its words in a document, wherever these come from: the document's own texts (``matches``)
or the index (``TextIndex.matches``), which reads the buckets of the words that are asked for and nothing else.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenfold.functions import text as T

FIELD_WEIGHTS = {"title": 1.0, "aliases": 1.0, "body": 0.4, "synopsis": 0.2}
#: Folders of an index; a word's is its CRC modulo their number.
BUCKETS = 64


def postings(docs: DataFrame, fields: dict[str, float] = FIELD_WEIGHTS, carried: Sequence[str] = ()) -> DataFrame:
    """(token, doc_id, weight, pos, carried): a row for each word of each field; positions run on over the fields."""

    def of(name: str, weight: float) -> Column:
        return F.transform(T.words(F.coalesce(F.col(name), F.lit(""))), lambda w: F.struct(w.alias("token"), F.lit(weight).alias("weight")))

    weighted = F.flatten(F.array(*(of(c, v) for c, v in fields.items())))
    return docs.select("doc_id", *carried, F.posexplode(weighted).alias("pos", "p")).select("p.token", "doc_id", "p.weight", "pos", *carried)


#: What a search asks for: alternatives, each a list of (wanted, words): words in a row that have to be there, or must not be.
Search = list[list[tuple[bool, list[str]]]]


def websearch(said: str) -> Search:
    """The syntax of web searches: words all have to be there, ``"..."`` stands for words in a row, a minus in front excludes,
    and ``or`` between parts gives alternatives (it binds weaker than the rest)."""
    out: Search = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', said):
        if plain.lower() == "or" and not minus:
            out.append([])
            continue
        if row := re.findall("[0-9a-z가-힣]+", (quoted or plain).lower()):
            out[-1].append((not minus, row))
    return [part for part in out if part]


def wanted_tokens(search: Search) -> list[str]:
    return list(dict.fromkeys(w for part in search for wanted, row in part if wanted for w in row))


def asked_tokens(search: Search) -> list[str]:
    """Also the words that must not be there."""
    return list(dict.fromkeys(w for part in search for _, row in part for w in row))


def cover_density(m: Column, words: Sequence[str]) -> Column:
    """Cover density (Clarke, Cormack, Tudhope) of places (token, weight, pos) in order: the sum over all minimal covers, extents
    that have every word and hold no shorter such extent, of the harmonic mean of the weights of the words' occurrences in it,
    divided by one more than the number of other words in it. 0 where a word is missing.

    One fold over the places: for each word its last place and what was counted before it; an occurrence ends a minimal cover
    if the earliest of those last places has moved on since the last one.
    """
    words = list(dict.fromkeys(words))
    place = "struct<pos:int,n:int,mass:double>"
    last = [f"w{k}" for k in range(len(words))]

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["pos"].cast("int").alias("pos"), s["n"].alias("n"), s["mass"].alias("mass")).cast(place)
        moved = [F.when(x["token"] == w, here).otherwise(s[c]) for c, w in zip(last, words, strict=True)]
        every = F.lit(True)
        for p in moved:
            every = every & p.isNotNull()
        first = F.when(every, F.array_min(F.array(*moved)))

        def ended(t: Column) -> Column:
            n, mass, p = s["n"] + 1, s["mass"] + 1 / x["weight"], t["first"]
            others = x["pos"] - p["pos"] + 1 - (n - p["n"])
            fresh = p.isNotNull() & (p["pos"] > s["begun"])
            found = F.when(fresh, (n - p["n"]) / (mass - p["mass"]) / (1 + others)).otherwise(0.0)
            return F.struct(*(t[c].alias(c) for c in last), n.cast("int").alias("n"), mass.cast("double").alias("mass"), F.when(fresh, p["pos"]).otherwise(s["begun"]).cast("int").alias("begun"), (s["density"] + found).cast("double").alias("density"))

        return T.let(F.struct(*(p.alias(c) for p, c in zip(moved, last, strict=True)), first.alias("first")), ended)

    start = F.struct(*(F.lit(None).cast(place).alias(c) for c in last), F.lit(0).alias("n"), F.lit(0.0).alias("mass"), F.lit(-1).alias("begun"), F.lit(0.0).alias("density"))
    return F.aggregate(F.filter(m, lambda x: x["token"].isin(words)), start, step, lambda s: s["density"])


def has(m: Column, row: list[str]) -> Column:
    """Whether the words stand in a row somewhere."""

    def follows(x: Column, k: int) -> Column:
        return F.exists(m, lambda y: (y["token"] == row[k]) & (y["pos"] == x["pos"] + k))

    def starts(x: Column) -> Column:
        found = x["token"] == row[0]
        for k in range(1, len(row)):
            found = found & follows(x, k)
        return found

    return F.exists(m, starts)


def judged(m: Column, search: Search) -> Column:
    """struct(every, cover, mass) of the places of the asked words, in order: whether the document is what the search asks for, the
    sum of the cover densities of the alternatives that it meets, and the sum of the weights of all occurrences of wanted words,
    which is the cover density of asking for any of them. Null where there is no wanted word."""
    every, cover = F.lit(False), F.lit(0.0)
    for part in search:
        met = F.lit(True)
        for wanted, row in part:
            met = met & (has(m, row) if wanted else ~has(m, row))
        every = every | met
        words = [w for wanted, row in part if wanted for w in row]
        if words:
            cover = cover + F.when(met, cover_density(m, words)).otherwise(0.0)
    mass = F.aggregate(F.filter(m, lambda x: x["token"].isin(wanted_tokens(search))), F.lit(0.0), lambda s, x: s + x["weight"])
    return F.when(mass > 0, F.struct(every.alias("every"), F.round(cover, 6).alias("cover"), F.round(mass, 6).alias("mass")))


def nothing(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit(False).alias("every"), F.lit(0.0).alias("cover"), F.lit(0.0).alias("mass")).limit(0)


def matches(docs: DataFrame, search: Search, fields: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """(doc_id, every, cover, mass) of documents with any word of a search (see ``judged``), without an index. Everything is decided
    within a row: texts that have none of the strings are not even cut into words, and nothing is shuffled."""
    wanted, asked = wanted_tokens(search), asked_tokens(search)
    if not wanted:
        return nothing(docs)
    there = F.lit(False)
    for name in fields:
        for w in wanted:
            there = there | F.lower(F.coalesce(F.col(name), F.lit(""))).contains(w)

    def placed(own: Column) -> Column:
        """The words asked for, with their places and weights; ``own``: each field's words."""
        weight, end = F.lit(list(fields.values())[-1]), F.lit(0)
        ends = []
        for name in list(fields)[:-1]:
            end = end + F.size(own[name])
            ends.append(end)
        every = F.concat(*(own[name] for name in fields))

        def of(x: Column, i: Column) -> Column:
            heavy = weight
            for k in reversed(range(len(ends))):
                heavy = F.when(i < ends[k], list(fields.values())[k]).otherwise(heavy)
            return F.when(x.isin(asked), F.struct(x.alias("token"), heavy.alias("weight"), i.alias("pos")))

        return T.let(F.filter(F.transform(every, of), lambda x: x.isNotNull()), lambda m: judged(m, search))

    own = F.struct(*(T.words(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields))
    found = spread(docs.where(there)).select("doc_id", F.explode(F.array(T.let(own, placed))).alias("f"))
    return found.where("f IS NOT NULL").select("doc_id", "f.every", "f.cover", "f.mass")


def spread(df: DataFrame) -> DataFrame:
    """A small table, of fewer partitions than there are cores, dealt to all of them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bucket_of(c: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(buckets)).cast("int")


def buckets_of(values: Sequence[str], buckets: int) -> list[int]:
    return sorted({zlib.crc32(str(v).encode()) % buckets for v in values})


def put(spark: SparkSession, own: str, path: str) -> None:
    """Give a folder that is complete its name, unless that is taken; then it goes."""
    target, temporary = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, own))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target) or not files.rename(temporary, target):
        files.delete(temporary, True)


class TextIndex:
    """Postings stored by word: a folder for each bucket of words, in it files sorted by word, document and place.

    A search reads the buckets of its words, and of these the row groups that hold the words. A large bucket, that of a
    frequent word say, is dealt to several tasks by its size and has several files. ``carried``: columns of the documents that are stored with each posting, so that filters on them
    need no join. An index is written once and not changed; a changed table has a new one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.rows = spark.read.parquet(path)

    @classmethod
    def write(cls, docs: DataFrame, path: str, fields: dict[str, float] = FIELD_WEIGHTS, carried: Sequence[str] = (), buckets: int = BUCKETS) -> TextIndex:
        """Write to a name of its own and then rename, so that no reader meets half an index; one that is there stays."""
        spark = docs.sparkSession
        own = f"{path}.{uuid.uuid4().hex}"
        rows = postings(spread(docs), fields, carried).withColumn("bucket", bucket_of(F.col("token"), buckets))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "doc_id", "pos").write.partitionBy("bucket").parquet(own)
        put(spark, own, path)
        return cls(spark, path, buckets)

    def places(self, tokens: Sequence[str]) -> DataFrame:
        """(token, doc_id, weight, pos, ...) of the words, from their buckets only."""
        return self.rows.where(F.col("bucket").isin(buckets_of(tokens, self.buckets)) & F.col("token").isin(list(tokens)))

    def matches(self, search: Search, where: Column | None = None) -> DataFrame:
        """(doc_id, every, cover, mass), as ``matches`` of the documents gives them; ``where``: a predicate on carried columns."""
        if not wanted_tokens(search):
            return nothing(self.rows)
        rows = self.places(asked_tokens(search))
        rows = rows if where is None else rows.where(where)
        by_doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "weight"))).alias("m"))
        found = by_doc.select("doc_id", judged(F.col("m"), search).alias("f"))
        return found.where("f IS NOT NULL").select("doc_id", "f.every", "f.cover", "f.mass")

    def any_of(self, tokens: Sequence[str]) -> DataFrame:
        """(doc_id, mass) of documents with any of the words; sums only, so partial results are merged before the shuffle."""
        return self.places(tokens).groupBy("doc_id").agg(F.round(F.sum("weight"), 6).alias("mass"))


def grams_of(said: str) -> list[str]:
    """The distinct trigrams of a query, as ``text.trigrams`` gives them."""
    out = []
    for w in re.findall("[0-9a-z가-힣]+", said.lower()):
        padded = f"  {w} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return list(dict.fromkeys(out))


class TrigramIndex:
    """Names stored by trigram, for word similarity: ``grams`` (gram, id, field; a folder for each bucket of grams) and ``names``
    (id, field, text; a folder for each bucket of ids).

    A name cannot be more similar to a query than the share of the query's trigrams that it has. So only names with enough of
    them are read, from the folders of their ids, and only these are compared in full.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.grams, self.names = spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/names")

    @classmethod
    def write(cls, docs: DataFrame, path: str, fields: Sequence[str], id_col: str = "doc_id", carried: Sequence[str] = (), buckets: int = BUCKETS) -> TrigramIndex:
        spark = docs.sparkSession
        own = f"{path}.{uuid.uuid4().hex}"
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(fields))))
        names = spread(docs).select(F.col(id_col).alias("id"), *carried, each.alias("n")).select("id", "n.field", "n.text", *carried).where("text IS NOT NULL")
        grams = names.select(F.explode(F.array_distinct(T.trigrams(F.col("text")))).alias("gram"), "id", "field").withColumn("bucket", bucket_of(F.col("gram"), buckets))
        grams.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{own}/grams")
        placed = names.withColumn("bucket", bucket_of(F.col("id"), buckets))
        placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{own}/names")
        put(spark, own, path)
        return cls(spark, path, buckets)

    def candidates(self, said: str, least: float) -> DataFrame:
        """(id, field, bucket) of the names with enough of the query's trigrams."""
        asked = grams_of(said)
        rows = self.grams.where(F.col("bucket").isin(buckets_of(asked, self.buckets)) & F.col("gram").isin(asked))
        enough = rows.groupBy("id", "field").agg(F.count("*").alias("n")).where(F.col("n") >= least * len(asked))
        return enough.select("id", "field", bucket_of(F.col("id"), self.buckets).alias("bucket"))

    def similar(self, said: str, least: float, where: Column | None = None) -> DataFrame:
        """(id, score) of the names with a word similarity of ``least`` or more, the best of their fields; ``least`` is above 0."""
        if least <= 0:
            raise ValueError("every name is similar by nothing")
        names = self.names if where is None else self.names.where(where)
        found = names.join(self.candidates(said, least), ["bucket", "id", "field"], "left_semi")
        scored = found.select("id", T.similar(F.lit(said), F.col("text"), least).alias("score")).where(F.col("score") >= least)
        return scored.groupBy("id").agg(F.max("score").alias("score"))
