"""Writes as functions from tables to tables: every policy gives the table's next snapshot, or that of the
partitions it touches; ``VersionedTable`` and ``Store`` commit it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenfold.operators.versions import VersionedTable


def same(keys: Sequence[str], a: str = "a", b: str = "b") -> Column:
    """Equality of keys in which nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def one_each(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)])))
    return df.withColumn("__n", place).where("__n = 1").drop("__n")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Rows whose key is new are added; of several new ones with one key, the first."""
    return table.unionByName(new_rows(table, rows, keys, *order))


def new_rows(table: DataFrame, rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return one_each(rows, keys, *order).alias("a").join(table.alias("b"), same(keys), "left_anti")


def overwrite(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows take the place of those with their key, others are added. ``rows`` has one row a key."""
    kept = table.alias("a").join(rows.alias("b"), same(keys), "left_anti")
    return kept.unionByName(rows)


def keep_old(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return insert_ignore(table, rows, keys)


def fill_merge(table: DataFrame, rows: DataFrame, keys: Sequence[str], always: Sequence[str] = (), version: str = "version") -> DataFrame:
    """What comes in wins where it is not null; ``always`` columns are replaced; a changed row's version grows by one."""
    both = table.withColumn("__old", F.lit(True)).alias("a").join(rows.withColumn("__new", F.lit(True)).alias("b"), same(keys), "full_outer")
    out = []
    for c in table.columns:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}") if c in rows.columns else F.lit(None)
        if c == version:
            out.append(F.when(F.col("__old").isNull(), 1).when(F.col("__new").isNull(), old).otherwise(old + 1).cast(table.schema[c].dataType).alias(c))
        elif c in always:
            out.append(F.when(F.col("__new").isNull(), old).otherwise(new).alias(c))
        else:
            out.append(F.coalesce(new, old).alias(c))
    return both.select(*out)


def replace_if_changed(table: DataFrame, rows: DataFrame, keys: Sequence[str], digest: str = "content_hash", version: str = "document_version") -> DataFrame:
    """Rows replace others only where their digest differs, and then the version grows."""
    both = table.withColumn("__old", F.lit(True)).alias("a").join(rows.withColumn("__new", F.lit(True)).alias("b"), same(keys), "full_outer")
    fresh = F.col("__old").isNull()
    changed = F.col("__new").isNotNull() & ~F.col(f"a.{digest}").eqNullSafe(F.col(f"b.{digest}"))
    out = []
    for c in table.columns:
        if c == version:
            out.append(F.when(fresh, 1).when(changed, F.col(f"a.{c}") + 1).otherwise(F.col(f"a.{c}")).cast(table.schema[c].dataType).alias(c))
        else:
            out.append(F.when(fresh | changed, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return both.select(*out)


def newest_wins(table: DataFrame, source, target, owner: str = "user_id", key: str = "item", at: str = "updated_at") -> DataFrame:
    """The source owner's rows go to the target; of two for one key, the newer stays (the target's own, if as new)."""
    moved = table.withColumn("__own", F.col(owner) != F.lit(source)).withColumn(owner, F.when(F.col(owner) == F.lit(source), F.lit(target)).otherwise(F.col(owner)))
    return one_each(moved, [owner, key], F.desc_nulls_last(at), F.desc("__own")).drop("__own")


def replace_children(children: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``rows`` are replaced."""
    return children.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows.distinct())


def delete_where_in(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.alias("a").join(gone.alias("b"), same(keys), "left_anti")


def update_from(table: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str], when: Column | None = None) -> DataFrame:
    """Set columns from the one matching row; ``when`` limits it to some of the table's rows."""
    ok = F.lit(True) if when is None else when
    source = one_each(rows, keys, *[F.col(c) for c in columns]).select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__set_{c}") for c in columns], F.lit(True).alias("__hit"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = table.join(source, match, "left")
    hit = F.col("__hit").isNotNull() & ok
    return joined.select(*[F.when(hit, F.col(f"__set_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def set_status(works: DataFrame, refs: DataFrame, status: str, only_reasons: Sequence[str] | None = None) -> DataFrame:
    """Hide or restore the works of ``refs`` (id, reason). Merged and deprecated works stay as they are; a restore may be
    limited to works hidden for certain reasons. Changed rows get a new version."""
    hits = one_each(refs, ["id"], F.col("reason")).select("id", F.col("reason").alias("__reason"))
    hit = F.col("__reason").isNotNull() & ~F.col("status").isin("MERGED", "DEPRECATED") & (F.col("status") != status)
    if only_reasons is not None:
        hit = hit & F.coalesce(F.col("reason").isin(*only_reasons), F.lit(False))
    reason = F.lit(None).cast("string") if status == "PUBLISHED" else F.col("__reason")
    changed = works.join(hits, "id", "left").withColumn("__hit", hit)
    return changed.select(*[{"status": F.when(F.col("__hit"), status).otherwise(F.col("status")), "reason": F.when(F.col("__hit"), reason).otherwise(F.col("reason")), "version": F.col("version") + F.col("__hit").cast("int")}.get(c, F.col(c)).alias(c) for c in works.columns])


def toggled(works: DataFrame, hide: Column, reason: str) -> DataFrame:
    """Published works for which ``hide`` holds are hidden for the reason; those hidden for it for which it does not are restored."""
    hide = F.coalesce(hide, F.lit(False))
    out = (F.col("status") == "PUBLISHED") & hide
    back = (F.col("status") == "HIDDEN") & F.col("reason").eqNullSafe(reason) & ~hide
    return works.withColumns({"status": F.when(out, "HIDDEN").when(back, "PUBLISHED").otherwise(F.col("status")), "reason": F.when(out, F.lit(reason)).when(back, F.lit(None)).otherwise(F.col("reason")), "version": F.col("version") + (out | back).cast("int")})


def status_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """An event for each work whose status changed."""
    b = before.select("id", F.col("status").alias("was"))
    rows = after.join(b, "id").where("status <> was")
    return rows.select(F.lit("DRAMA").alias("aggregate_type"), F.col("id").alias("aggregate_id"), F.concat(F.lit("DRAMA_"), F.col("status")).alias("event_type"), F.to_json(F.struct("id", "was", "status", "reason")).alias("payload"))


def fill_null(works: DataFrame, lookup: DataFrame, key: str, column: str, mark: str, source: str) -> DataFrame:
    """A null column from a lookup, version + 1; where the lookup has nothing the row is marked as checked."""
    found = lookup.select(key, F.col(column).alias("__v"))
    open_, hit = F.col(column).isNull() & F.col(mark).isNull(), F.col("__v").isNotNull()
    joined = works.join(found, key, "left")
    return joined.select(*[{column: F.when(open_, F.col("__v")).otherwise(F.col(column)), mark: F.when(open_, F.when(hit, F.lit(source)).otherwise(F.lit(f"{source}:none"))).otherwise(F.col(mark)), "version": F.col("version") + (open_ & hit).cast("int")}.get(c, F.col(c)).alias(c) for c in works.columns])


def mark_reparse(staging: DataFrame, mode: str, source: str | None = None, version: str | None = None) -> DataFrame:
    """Set records back to NEW: those of another parser version (stale), that failed, or all."""
    which = {"stale": F.col("parser_version") != F.lit(version), "failed": F.col("status") == "PARSE_FAILED", "all": F.lit(True)}[mode]
    if source is not None:
        which = which & (F.col("source") == source)
    return staging.withColumn("status", F.when(which, "NEW").otherwise(F.col("status")))


def touched(users: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Last-seen times are renewed at most once in ``minutes``."""
    old = F.col("last_seen").isNull() | (F.col("last_seen") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return users.withColumn("last_seen", F.when(old, now).otherwise(F.col("last_seen")))


def staged(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Parsed records take the place of earlier ones and begin without resolution and issues."""
    fresh = rows.withColumns({"resolution": F.lit(None).cast(table.schema["resolution"].dataType), "issues": F.lit(None).cast(table.schema["issues"].dataType), "status": F.lit("NEW")})
    return overwrite(table, fresh.select(*table.columns), ["source_record_id"])


def transition(table: DataFrame, ids: Sequence[int], status: str, resolution: Column | None = None, issues: Column | None = None) -> DataFrame:
    """A status for some records; a resolution or issues that are not given stay."""
    hit = F.col("id").isin(list(ids))
    out = table.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    for name, value in (("resolution", resolution), ("issues", issues)):
        if value is not None:
            out = out.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return out


def link_identity(identities: DataFrame, consents: DataFrame, user: str, provider: str, subject: str, given: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Tie a login to a user unless it is tied already, and record the consents given."""
    spark = identities.sparkSession
    row = spark.createDataFrame([(provider, subject, user)], "provider string, subject string, user_id string")
    new = spark.createDataFrame([(user, k, v) for k, v in given], "user_id string, type string, version string")
    return insert_ignore(identities, row, ["provider", "subject"]), insert_ignore(consents, new, ["user_id", "type", "version"])


def stamped(before: DataFrame, after: DataFrame, keys: Sequence[str], now: Column, at: str = "updated_at") -> DataFrame:
    """``after`` with the time of change renewed in rows that are new or differ from ``before`` in any other column."""
    others = [c for c in after.columns if c not in (*keys, at)]
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in others])
    old = before.select(*[F.col(k).alias(f"__{k}") for k in keys], digest.alias("__old"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = after.withColumn("__new", digest).join(old, match, "left")
    return joined.withColumn(at, F.when(F.col("__old").eqNullSafe(F.col("__new")), F.col(at)).otherwise(now)).select(*after.columns)


class Store:
    """Tables by name as versions of whole snapshots; nothing is overwritten while it may be read, and of two writers that start
    from one snapshot the second is refused (see ``versions``)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}")

    def current(self, name: str) -> int | None:
        """The number of the newest snapshot."""
        return (self.table(name).versions() or [None])[-1]

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def swap(self, name: str, df: DataFrame) -> DataFrame:
        """Write the next snapshot and then make it the current one."""
        table = self.table(name)
        if table.versions():
            table.replace(df)
        else:
            table.create(df, df.columns)
        return table.read()
