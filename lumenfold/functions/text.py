"""Text, date and address functions as column expressions; Python only where a builtin does not exist (NFKC, case folding)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

HANGUL = "가-힣"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


def clean(c: Column, folded: bool = False) -> Column:
    """NFKC, runs of white space as one space, trimmed; empty becomes null. ``folded``: the input is known to be NFKC."""
    s = c if folded else _nfkc(c)
    s = F.trim(F.regexp_replace(s, r"[\s\x{A0}\x{1C}-\x{1F}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))
    return F.nullif(s, F.lit(""))


def normalize_key(c: Column, folded: bool = False) -> Column:
    """Key for comparisons: lower case, only digits, a-z, Hangul syllables and letters. Null becomes empty."""
    s = F.lower(c) if folded else _nfkc_fold(c)
    return F.coalesce(F.regexp_replace(s, "[^0-9a-z가-힣ㄱ-ㆎ]+", ""), F.lit(""))


def slugify(c: Column, folded: bool = False) -> Column:
    s = F.lower(c) if folded else _nfkc_fold(c)
    s = F.regexp_replace(F.regexp_replace(s, "[^0-9a-z가-힣]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


#: The three accepted forms of a date.
DATE_FORMS = (r"^\s*(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})", r"^\s*(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일?", r"^\s*(\d{4})(\d{2})(\d{2})\s*$")


def soft_date(c: Column) -> Column:
    """The date a text stands for, null where it stands for none."""

    def attempt(form: str) -> Column:
        y, m, d = (F.regexp_extract(c, form, i) for i in (1, 2, 3))
        return F.when(c.rlike(form), F.concat_ws("-", y, m, d))

    return F.try_to_date(F.coalesce(*map(attempt, DATE_FORMS)), "yyyy-M-d")


def parse_date(c: Column) -> Column:
    """struct(value date, error string): blank gives neither, text that is no date an error."""
    blank = c.isNull() | (F.trim(c) == "")
    known = F.lit(False)
    for form in DATE_FORMS:
        known = known | c.rlike(form)
    value = soft_date(c)
    error = F.when(~blank & ~known, F.lit("unrecognized date format")).when(~blank & value.isNull(), F.lit("invalid calendar date"))
    return F.struct(value.alias("value"), error.alias("error"))


def duration(c: Column) -> Column:
    """``m:ss`` as seconds, else null."""
    form = r"^\s*(\d+):(\d{2})"
    return F.when(c.rlike(form), F.regexp_extract(c, form, 1).cast("int") * 60 + F.regexp_extract(c, form, 2).cast("int"))


def without_suffix(c: Column) -> Column:
    """A title without its trailing disambiguation in brackets."""
    return F.regexp_replace(c, r"\s*\((\d{4}년 )?(드라마|텔레비전 드라마|영화|웹 드라마|웹드라마)\)$", "")


def unquoted(c: Column) -> Column:
    """Percent-decoding that leaves plus signs alone, and underscores as spaces."""
    return F.translate(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "_", " ")


def host(c: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("HOST"))), F.lit(""))


def path(c: Column) -> Column:
    """Path without trailing slashes; ``/`` where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.try_parse_url(c, F.lit("PATH")), "/+$", ""), F.lit("")), F.lit("/"))


def on_host(c: Column, suffixes: list[str]) -> Column:
    """Whether an address lies on one of the hosts or below; any does when there are none."""
    found = F.lit(not suffixes)
    for s in suffixes:
        found = found | (host(c) == s) | host(c).endswith("." + s)
    return found


#: Particles that stick to a name in speech.
NAME_PARTICLES = ("이랑", "랑", "하고", "과", "와", "은", "는", "이", "가", "의", "도")


def name_candidates(c: Column) -> Column:
    """Hangul words of two to five syllables and, after each, its forms without a particle; the first of equal ones."""

    def forms(word: Column) -> Column:
        cut = [F.when(word.endswith(p) & (F.length(word) >= len(p) + 2), F.substring(word, 1, F.length(word) - len(p))) for p in NAME_PARTICLES]
        return F.array_compact(F.array(word, *cut))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(c, F.lit("([가-힣]{2,5})"), 1), forms)))


def search_tokens(c: Column) -> Column:
    """Words of letters and digits in lower case; a Hangul word of more than two syllables also gives its pairs."""

    def grams(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
        return F.when((F.length(w) > 2) & w.rlike("^[가-힣]+$"), F.concat(F.array(w), pairs)).otherwise(F.array(w))

    words = F.filter(F.split(F.lower(c), "[^0-9a-z가-힣]+"), lambda w: w != "")
    return F.flatten(F.transform(words, grams))


def words(c: Column) -> Column:
    """Words of the simple text configuration: runs of ASCII letters, digits and Hangul, in lower case."""
    return F.filter(F.split(F.lower(c), "[^0-9a-z가-힣]+"), lambda w: w != "")


def normalized_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def date_label(start: Column, end: Column) -> Column:
    """``2016.12.02 ~ 2017.01.21``; an open end stays open, no start gives null."""
    return F.when(start.isNotNull(), F.concat(F.date_format(start, "yyyy.MM.dd"), F.lit(" ~ "), F.coalesce(F.date_format(end, "yyyy.MM.dd"), F.lit(""))))


def trailing_window(day: Column) -> tuple[Column, Column]:
    """First and last day of the window of page views: the twelve or so whole months before this one."""
    end = F.last_day(F.add_months(day, -1))
    return F.trunc(F.date_sub(F.trunc(end, "MM"), 365), "MM"), end


def cosine(a: Column, b: Column, lost: float | None = None) -> Column:
    """``lost`` where one of the vectors has no direction; null where one is null."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.try_divide(dot(a, b), norms)).when(norms.isNotNull(), F.lit(lost).cast("double"))


def trigrams(c: Column) -> Column:
    """Trigrams of each word, padded with two spaces before and one behind, in order."""

    def of(word: Column) -> Column:
        p = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))

    return F.flatten(F.transform(words(c), of))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable, where a column that is used often would be computed often."""
    return F.get(F.transform(F.array(value), body), 0)


def _best_extent(q: Column, t: Column) -> Column:
    def ratio(part: Column) -> Column:
        def of(d: Column) -> Column:
            both = F.size(F.array_intersect(q, d))
            return both / (F.size(q) + F.size(d) - both)

        return let(F.array_distinct(part), of)

    def over(at: Column) -> Column:
        return F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda k: k >= i), lambda k: ratio(F.slice(t, i, k - i + 1)))))

    numbered = F.transform(t, lambda x, i: F.when(F.array_contains(q, x), i + 1))
    return F.coalesce(F.array_max(let(F.filter(numbered, lambda i: i.isNotNull()), over)), F.lit(0.0))


def word_similarity(query: Column, target: Column) -> Column:
    """Greatest share of trigrams in common over all contiguous extents of the target's trigrams.

    The best extent begins and ends with a trigram of the query, so only those are tried: square in their number, for titles.
    Null or wordless sides give 0.
    """
    return similar(query, target, 0.0)


def similar(query: Column, target: Column, least: float) -> Column:
    """``word_similarity`` where it is ``least`` or more, else 0. Whatever the extent, it has at most the share of the query's
    trigrams that the target has at all, and targets below that are not tried further."""

    def of(x: Column) -> Column:
        bound = F.size(F.array_intersect(x["q"], x["t"])) / F.size(x["q"])
        found = F.when((F.size(x["t"]) > 0) & (F.size(x["q"]) > 0) & (bound > 0) & (bound >= least), _best_extent(x["q"], x["t"])).otherwise(0.0)
        return let(found, lambda v: F.when(v >= least, v).otherwise(0.0))

    return F.coalesce(let(F.struct(F.array_distinct(trigrams(query)).alias("q"), trigrams(target).alias("t")), of), F.lit(0.0))
