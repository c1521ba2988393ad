"""Table-driven tests of text functions, classifiers and query analysis."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import rules, text
from lumenfold.operators import retrieval as R
from lumenfold.plans.q_catalog import clamp


def values(spark, expr, rows, schema):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[1] for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_clean_and_keys(spark):
    raw = ["  또  오해영 ", "ＴＶＮ", "　", None, "Straße", "a\tb c"]
    assert values(spark, text.clean(F.col("v")), raw, "v string") == ["또 오해영", "TVN", None, None, "Straße", "a b c"]
    assert values(spark, text.normalize_key(F.col("v")), raw, "v string") == ["또오해영", "tvn", "", "", "strasse", "abc"]
    assert values(spark, text.slugify(F.col("v")), ["Guardian: The Lonely", "도깨비", "!!", "ＡＢ"], "v string") == ["guardian-the-lonely", "도깨비", "untitled", "ab"]


def test_dates(spark):
    raw = ["2016.12.02", "2016-1-2", "2016년 12월 2일", "20161202", " ", None, "2016-13-01", "soon"]
    got = values(spark, text.parse_date(F.col("v")), raw, "v string")
    day = dt.date(2016, 12, 2)
    assert [g.value for g in got] == [day, dt.date(2016, 1, 2), day, day, None, None, None, None]
    assert [g.error for g in got] == [None] * 6 + ["invalid calendar date", "unrecognized date format"]
    assert values(spark, text.duration(F.col("v")), ["3:41", "x", None], "v string") == [221, None, None]


def test_names_and_tokens(spark):
    said = ["공유랑 이동욱이랑 나온", "김혜수와", "abc", ""]
    got = values(spark, text.name_candidates(F.col("v")), said, "v string")
    assert got[0] == ["공유랑", "공유", "이동욱이랑", "이동욱", "이동욱이", "나온"]
    assert got[1:] == [["김혜수와", "김혜수"], [], []]
    assert values(spark, text.search_tokens(F.col("v")), ["Goblin 도깨비 신"], "v string") == [["goblin", "도깨비", "도깨", "깨비", "신"]]


def test_word_similarity(spark):
    pairs = [("도깨비", "도깨비"), ("word", "two words"), ("x", ""), ("", "x")]
    df = spark.createDataFrame(pairs, "q string, t string").select(text.word_similarity(F.col("q"), F.col("t")).alias("s"))
    got = [r.s for r in df.collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.8) and got[2:] == [0.0, 0.0]


@pytest.mark.parametrize(
    ("classes", "genres", "categories", "kind"),
    [
        (["Q336181", "Q482612"], ["drama"], ["SBS 드라마"], "NOT_DRAMA"),
        ([], [], ["2016년 드라마"], "DRAMA"),
        (["Q15416"], [], ["드라마 목록"], "NOT_DRAMA"),
        (["Q15416"], ["comedy"], ["대한민국의 음악 프로그램"], "NOT_DRAMA"),
        (["Q15416"], [], ["2016년 작품"], "NOT_DRAMA"),
        (["Q482612"], [], None, "DRAMA"),
        ([], ["thriller"], None, "DRAMA"),
        ([], ["reality television"], None, "NOT_DRAMA"),
        ([], ["thriller", "reality television"], None, "UNKNOWN"),
        (["Q5398426"], [], None, "UNKNOWN"),
        (["Q11424"], [], None, "UNKNOWN"),
    ],
)
def test_program_kind(spark, classes, genres, categories, kind):
    df = spark.createDataFrame([(classes, genres, categories)], "c array<string>, g array<string>, k array<string>")
    got = df.select(rules.program_kind(F.col("c"), F.col("g"), F.col("k")).alias("v")).first().v
    assert got.kind == kind
    assert bool(got.reasons) == (kind != "UNKNOWN" or len(genres) == 2)


def test_channels(spark):
    rows = [(["SBS 금토드라마"],), (["TvN의 텔레비전 드라마", "KBS에서 방영한 프로그램"],), (["SBS 드라마", "KBS 드라마", "MBC에서 방영한 프로그램"],), (["KBS와 MBC의 드라마"],), (["MBC 에브리원에서 방영한 프로그램"],), ([],)]
    got = values(spark, rules.infer_channel(F.col("v"))["code"], rows, "v array<string>")
    assert got == ["sbs", "tvn", None, None, "mbc_every1", None]


def test_links(spark):
    kbs = "https://vod.kbs.co.kr/1"
    rows = [("kbs", kbs, 200, kbs, None, "AVAILABLE"), ("kbs", kbs, 404, None, None, "NOT_FOUND"), ("kbs", kbs, 403, None, None, "ACCESS_DENIED"), ("kbs", kbs, 403, kbs + "/region", None, "REGION_RESTRICTED"), ("kbs", kbs, 200, "https://evil.com/", None, "REDIRECTED"),
            ("kbs", kbs, 200, "https://notkbs.co.kr.evil.com/", None, "REDIRECTED"), ("netflix", "https://www.netflix.com/title/1", 200, "https://www.netflix.com/", None, "REDIRECTED"), ("netflix", "https://www.netflix.com/title/1", 200, "https://www.netflix.com/not-available", None, "REGION_RESTRICTED"),
            ("any", kbs, 503, None, None, "TEMPORARY_ERROR"), ("any", kbs, None, None, "timeout", "TEMPORARY_ERROR"), ("any", kbs, 302, None, None, "REDIRECTED"), ("any", kbs, 418, None, None, "UNKNOWN")]
    df = spark.createDataFrame(rows, "p string, o string, h int, f string, e string, want string")
    got = df.select(rules.link_verdict(F.col("p"), F.col("o"), F.col("h"), F.col("f"), F.col("e")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_genres_and_precedence(spark):
    rows = [(["로맨틱 코미디", "범죄물"],), (["Science Fiction", "x"],), ([],)]
    assert values(spark, rules.genre_codes(F.col("v")), rows, "v array<string>") == [["comedy", "crime", "romance"], ["sf"], []]
    assert values(spark, rules.precedence(F.col("v")), ["kbs", "netflix", "?"], "v string") == [0, 13, 21]


def test_foreign_and_enrichment(spark):
    rows = [(["Q884"], ["sparql"], False), (["Q17"], ["sparql"], True), ([], ["kowiki"], False), (None, ["kowiki"], True), ([], ["kowiki", "sparql"], False)]
    df = spark.createDataFrame(rows, "c array<string>, f array<string>, h boolean")
    assert [r[0] for r in df.select(rules.is_foreign(F.col("c"), F.col("f"), F.col("h"))).collect()] == [False, True, True, False, False]
    assert rules.collapsed(50, 100) and not rules.collapsed(60, 100) and not rules.collapsed(0, 0)
    filled, source = rules.enriched_text(F.col("a"), F.col("b"), "kowiki")
    df = spark.createDataFrame([(None, "x" * 40), (None, "short"), ("old", "x" * 50)], "a string, b string").select(filled, source)
    assert [tuple(r) for r in df.collect()] == [("x" * 40, "kowiki"), (None, "kowiki:none"), ("old", None)]
    kinds = spark.createDataFrame([("UNKNOWN", None), ("UNKNOWN", []), ("DRAMA", None)], "k string, c array<string>")
    assert [r[0] for r in kinds.select(rules.needs_lookup(F.col("k"), F.col("c"))).collect()] == [True, False, False]


@pytest.mark.parametrize(
    ("raw", "years", "channel", "words"),
    [
        ("2016년 tvN 도깨비", (2016, 2016), "tvn", "도깨비"),
        ("2016년쯤 공유 나온 드라마", (2015, 2017), None, "공유"),
        ("2010년대 초반 KBS", (2010, 2013), "kbs", ""),
        ("90년대 후반 의사 드라마", (1996, 1999), None, "의사"),
        ("00년대 중반", (2003, 2006), None, ""),
        ("17년쯤 법정", (2016, 2018), None, "법정"),
        ("98년 학교", (1998, 1998), None, "학교"),
        ("공유, 이동욱 나온 드라마?", (None, None), None, "공유 이동욱"),
        ("에스비에스에서 했던 뿌리깊은 나무", (None, None), "sbs", "뿌리깊은 나무"),
    ],
)
def test_query_analysis(raw, years, channel, words):
    plan = R.analyze(raw)
    assert ((plan.year_from, plan.year_to), plan.broadcaster, plan.text) == (years, channel, words)


def test_query_without_constraints_and_overrides():
    plan = R.analyze("응답하라 1988", constraints=False)
    assert plan.text == "응답하라 1988" and not plan.constrained
    plan = R.overridden(R.analyze("도깨비"), year_to=2017, broadcaster="tvn")
    assert (plan.year_from, plan.year_to, plan.broadcaster) == (2017, 2017, "tvn")
    assert R.parse_weights("fts:0.5, vector:2") == {"fts": 0.5, "vector": 2.0} and R.parse_weights("") is None
    for bad in ("fts", "fts:-1", "fts:x"):
        with pytest.raises(ValueError):
            R.parse_weights(bad)
    assert [clamp(n) for n in (None, 0, -3, 7, 99)] == [20, 20, 1, 7, 50]
    assert R.strategy(["fts", "vector"]) == "LEXICAL_VECTOR" and R.strategy(["filter"]) == "FILTER" and R.strategy([]) == "NONE"


def test_candidates_are_decided(spark):
    rows = [("Q10", "DRAMA", ["Q884"], ["sparql"], False), ("Q9", "UNKNOWN", [], ["kowiki"], True), ("Q8", "NOT_DRAMA", [], ["sparql"], False), ("Q7", "DRAMA", ["Q17"], ["sparql"], False)]
    keep, out = rules.decided(spark.createDataFrame(rows, "external_id string, kind string, countries array<string>, found_by array<string>, has_category boolean"))
    assert [r.external_id for r in keep.collect()] == ["Q9", "Q10"]
    assert {r.external_id: r.reason for r in out.collect()} == {"Q8": "not_drama", "Q7": "foreign"}


def test_a_table_of_queries(spark):
    df = spark.createDataFrame([("2016년 tvN 도깨비",), (None,), ("공유",)], "q string").select(R.analyzed(F.col("q")).alias("p")).select("p.*")
    assert [tuple(r) for r in df.collect()] == [("도깨비", 2016, 2016, "tvn"), ("", None, None, None), ("공유", None, None, None)]
