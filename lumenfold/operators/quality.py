"""Quality gates: issues of a record as an array expression, the gate of a batch, and invariants of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class GateError(RuntimeError):
    """Too large a share of a batch is broken."""


def issue(when: Column, code: str, severity: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message")))


def each(items: Column, when, code: str, severity: str, message) -> Column:
    """An issue for every element of an array for which ``when`` holds."""
    none = F.filter(items, lambda x: F.coalesce(when(x), F.lit(False)))
    return F.transform(none, lambda x: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message(x).alias("message")))


def record_issues(broadcasters: list[str], genres: list[str]) -> Column:
    """All issues of a nested record (external_id, title_ko, start_date, end_date, episode_count, runtime_minutes, broadcaster_code,
    program_kind, genres, credits, osts, links), in the order of the checks."""
    c = F.col
    none = "array<struct<code:string,severity:string,message:string>>"
    listed = lambda name: F.coalesce(c(name), F.array().cast("array<string>"))
    single = F.array_compact(F.array(
        issue(F.trim(F.coalesce(c("title_ko"), F.lit(""))) == "", "MISSING_TITLE", "ERROR", "title_ko is empty"),
        issue(F.trim(F.coalesce(c("external_id"), F.lit(""))) == "", "MISSING_EXTERNAL_ID", "ERROR", "external_id is empty"),
        issue(c("start_date").isNull(), "MISSING_START_DATE", "WARN", "no start_date"),
        issue(F.size(F.coalesce(c("credits"), F.array())) == 0, "NO_CREDITS", "WARN", "no credits"),
        issue(c("program_kind") == "NOT_DRAMA", "NOT_A_DRAMA", "ERROR", "another kind of programme"),
        issue(c("start_date") > c("end_date"), "DATE_ORDER", "ERROR", "start_date after end_date"),
        issue(c("episode_count") <= 0, "EPISODE_COUNT", "ERROR", "episode_count must be above 0"),
        issue(c("runtime_minutes") <= 0, "RUNTIME", "ERROR", "runtime_minutes must be above 0"),
        issue(c("broadcaster_code").isNotNull() & ~c("broadcaster_code").isin(broadcasters), "UNKNOWN_BROADCASTER", "WARN", F.concat(F.lit("unknown channel "), c("broadcaster_code"))),
    ))
    key = F.transform("credits", lambda x: F.to_json(F.struct(x["person"]["name_normalized"], x["credit_type"], x["character_name"])))
    again = F.filter(F.transform(key, lambda x, i: F.when(F.array_contains(F.slice(key, 1, i), x), x)), lambda x: x.isNotNull())
    parts = [
        single,
        each(listed("genres"), lambda g: ~g.isin(genres), "UNKNOWN_GENRE", "WARN", lambda g: F.concat(F.lit("unknown genre "), g)),
        each(c("credits"), lambda x: F.trim(F.coalesce(x["person"]["name_ko"], F.lit(""))) == "", "CREDIT_NO_NAME", "ERROR", lambda x: F.lit("credit without a name")),
        F.transform(again, lambda x: F.struct(F.lit("DUPLICATE_CREDIT").alias("code"), F.lit("WARN").alias("severity"), x.alias("message"))),
        each(c("credits"), lambda x: x["billing_order"] <= 0, "BILLING_ORDER", "ERROR", lambda x: F.lit("billing_order must be above 0")),
        each(c("osts"), lambda x: F.trim(F.coalesce(x["title"], F.lit(""))) == "", "SONG_NO_TITLE", "ERROR", lambda x: F.lit("song without a title")),
        each(c("osts"), lambda x: x["duration_seconds"] <= 0, "SONG_DURATION", "ERROR", lambda x: F.lit("duration must be above 0")),
        each(c("links"), lambda x: ~x["url"].startswith("https://"), "LINK_NOT_HTTPS", "ERROR", lambda x: x["url"]),
    ]
    return F.concat(*(F.coalesce(p, F.array().cast(none)) for p in parts))


def has_errors(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"] == "ERROR")


def gate(records: DataFrame, issues: str = "issues", least: int = 5, most: float = 0.5) -> None:
    """Raise when a batch of ``least`` records or more has a larger share of broken ones than ``most``."""
    n, share = records.agg(F.count("*"), F.avg(has_errors(F.col(issues)).cast("double"))).first()
    if n >= least and share > most:
        raise GateError(f"{share:.0%} of {n} records are broken, more than {most:.0%}")


def gates(records: DataFrame, batch: str, issues: str = "issues", least: int = 5, most: float = 0.5) -> DataFrame:
    """(batch, n, share, failed): the same verdict for all batches of a table at once, by one aggregate."""
    by = records.groupBy(F.col(batch).alias("batch")).agg(F.count("*").alias("n"), F.avg(has_errors(F.col(issues)).cast("double")).alias("share"))
    return by.select("batch", "n", "share", ((F.col("n") >= least) & (F.col("share") > most)).alias("failed"))


def violations(table: DataFrame, name: str, checks: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """(table, rule, n): rows that break each check (null breaks none), and rows beyond the first of each unique key."""
    counts = table.agg(*[F.count_if(~cond).alias(rule) for rule, cond in checks.items()]) if checks else None
    out = None
    if counts is not None:
        stack = f"stack({len(checks)}, " + ", ".join(f"'{r}', `{r}`" for r in checks) + ") AS (rule, n)"
        out = counts.selectExpr(stack)
    for rule, keys in (unique or {}).items():
        more = table.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = more if out is None else out.unionByName(more)
    return out.select(F.lit(name).alias("table"), "rule", F.col("n").cast("long").alias("n"))


def missing_parents(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
