"""Parsers, snapshots and the golden reader on documents made here."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import parsers as P
from lumenfold.sources import snapshots as S

GOOD = {
    "format": "catalog.drama.v1", "external_id": " g-1 ", "title_ko": " 도깨비 ", "aliases": ["Goblin", "도 깨비", " "], "broadcaster": "tvN", "start_date": "2016.12.02", "end_date": "2017년 1월 21일",
    "episode_count": 16, "genres": ["Fantasy", "romance", "fantasy"],
    "credits": [{"person": {"name_ko": "공유", "birth_date": "1979-07-10"}, "character": "김신", "billing_order": 1, "main": True}, {"person": {"name_ko": "김은숙"}, "type": "WRITER"}],
    "ost": [{"title": "Stay With Me", "artists": ["찬열", {"name": "펀치", "role": "FEATURED"}], "duration_seconds": 193}], "links": [{"provider": "TVING", "url": " https://tving.com/1 ", "type": "OTT_DETAIL"}],
}


def test_curated(spark):
    bad = [GOOD | {"title_ko": "  "}, GOOD | {"format": "v9"}, GOOD | {"start_date": "2016-13-40"}, GOOD | {"ost": [{"title": " "}]}, {k: v for k, v in GOOD.items() if k != "external_id"}]
    bodies = [json.dumps(GOOD).encode(), *(json.dumps(b).encode() for b in bad), b"no json", b"\xff\xfe"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "id int, body binary")
    rows = P.parse_curated(df, "catalog.drama.v1").orderBy("id").collect()
    assert [r.error for r in rows] == [None, "title_ko is empty", "unsupported format v9", "start_date: invalid calendar date", "ost title is empty", "schema violation", "not valid JSON", "not valid UTF-8"]
    assert all(r.record is None for r in rows[1:])
    d = rows[0].record
    assert (d.external_id, d.title_ko, d.title_normalized, d.broadcaster_code) == ("g-1", "도깨비", "도깨비", "tvn")
    assert [a.alias for a in d.aliases] == ["Goblin"] and d.genres == ["fantasy", "romance"]
    assert d.start.value == dt.date(2016, 12, 2) and d.end.value == dt.date(2017, 1, 21)
    assert [(c.person.name_ko, c.credit_type, c.is_main_cast) for c in d.credits] == [("공유", "ACTOR", True), ("김은숙", "WRITER", False)]
    assert [(a.name, a.role, a.sort_order) for a in d.osts[0].artists] == [("찬열", "PERFORMER", 1), ("펀치", "FEATURED", 2)]
    assert (d.links[0].provider_code, d.links[0].url, d.links[0].region_code) == ("tving", "https://tving.com/1", "KR")


def triple(p, o, **more):
    v = lambda x: {"type": "literal", "value": x}
    base = "http://www.wikidata.org/entity/"
    known = p in ("label", "alias", "sitelink")
    return {"item": v(base + "Q1"), "p": v(p if known else f"http://www.wikidata.org/prop/direct/{p}"), "o": v(base + o if o[:1] == "Q" and o[1:].isdigit() else o), **{k: v(x) for k, x in more.items()}}


def test_triples(spark):
    rows = [
        triple("label", "도깨비", lang="ko"), triple("label", "Goblin", lang="en"), triple("alias", "쓸쓸하고 찬란하神"), triple("alias", "-x"), triple("alias", "!!"), triple("alias", "도 깨비"),
        triple("sitelink", "도깨비 (2016년 드라마)"), triple("P580", "2016-12-02T00:00:00Z"), triple("P582", "2017-01-21T00:00:00Z"), triple("P1113", "16.0"), triple("P449", "Q907311"), triple("P449", "Q333424"), triple("P449", "Q5"),
        triple("P136", "Q9", oLabel="판타지 드라마"), triple("P31", "Q5398426"), triple("P161", "Q7", oLabel="공유", charLabel="김신", ord="1", birth="1979-07-10"), triple("P161", "Q7", oLabel="공유"),
        triple("P161", "Q8", oLabel="Q8"), triple("P161", "Q10", oLabel="김고은", ord="5", birth="http://unknown", charLabel="Q77"), triple("P58", "Q11", oLabel="김은숙"),
        triple("P856", "https://tvn.com/g"), triple("P856", "http://plain.com"), triple("P856", "https://tvn.com/g"), triple("P1874", "80123"), triple("P1874", "x1"),
    ]
    bodies = [json.dumps({"results": {"bindings": b}}) for b in (rows, [], [triple("P580", "2016-12-02")], [triple("label", "t", lang="ko"), triple("P580", "2016-99-02")])] + ["{}"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = P.parse_triples(df).orderBy("id").collect()
    assert [r.error for r in got] == [None, "empty result", "no usable title", "date", "not a result"]
    d = got[0].record
    assert (d.external_id, d.title_ko, d.title_en, d.broadcaster_code, d.episode_count) == ("Q1", "도깨비", "Goblin", "tvn", 16)
    assert [a.alias for a in d.aliases] == ["쓸쓸하고 찬란하神"] and d.genres == ["fantasy"] and d.program_kind == "DRAMA"
    assert (d.start_date, d.end_date) == (dt.date(2016, 12, 2), dt.date(2017, 1, 21))
    assert [(c.person.external_id, c.credit_type, c.character_name, c.billing_order, c.is_main_cast, c.person.birth_date) for c in d.credits] == [("Q7", "ACTOR", "김신", 1, True, dt.date(1979, 7, 10)), ("Q10", "ACTOR", None, 5, False, None), ("Q11", "WRITER", None, None, False, None)]
    assert [(x.provider_code, x.url) for x in d.links] == [("tvn", "https://tvn.com/g"), ("netflix", "https://www.netflix.com/title/80123")]


WIKI = """== 줄거리 ==
{{음반 정보|음반명=x}}
== 음악 ==
{{음반 정보
| 음반명 = 도깨비 OST Part 1
| 가수명 = [[찬열]], '''[[펀치 (가수)|펀치]]'''
| 발매년월일 = [[2016년]] 12월 3일
}}
{{곡 목록
| 제목1 = Stay With Me | 재생시간1 = 3:13
| 제목2 = Stay With Me (Inst.) | 재생시간2 = 3:13
| 제목3 = {{lang|en|}}[[Beautiful]] | 가수3 = 크러쉬 & Various Artists
}}
=== 그 밖 ===
x
== 각주 ==
{{곡 목록 | 제목1 = 아님 | 가수1 = 아님 }}
"""
TABLE = """== OST ==
{| class="wikitable"
! 제목 !! 가수 !! 길이 !! 파트
|-
| [[노래]] || [[가수1|가수]], 둘 || 4:01 || Part 2
|-
| 연주 MR || 누구 || 1:00 || 1
|}
"""


def test_soundtracks(spark):
    df = spark.createDataFrame([("a", WIKI), ("b", TABLE), ("c", "== 줄거리 ==\nx"), ("d", None)], "id string, wikitext string")
    rows = {}
    for r in P.parse_soundtracks(df).orderBy("id", "track_no").collect():
        rows.setdefault(r.id, []).append((r.title, list(r.artists), r.duration_seconds, r.part_no, r.track_no, r.release_date))
    assert rows == {
        "a": [("Stay With Me", ["찬열", "펀치"], 193, 1, 1, "2016-12-03"), ("Beautiful", ["크러쉬"], None, 1, 2, "2016-12-03")],
        "b": [("노래", ["가수", "둘"], 241, 2, 1, None)],
    }


def test_registry(spark):
    df = spark.createDataFrame([(1, "manual", bytearray(json.dumps(GOOD).encode())), (2, "unknown", bytearray(b"x"))], "id int, source string, body binary")
    parsed, skipped = P.parse_all(df)
    assert [(r.id, r.error, r.parser_version) for r in parsed["manual"].collect()] == [(1, None, "curated/1")]
    assert [r.id for r in skipped.collect()] == [2]


def test_manifest(spark, tmp_path):
    items = [{"external_id": "a", "entity_type": "DRAMA", "url": "https://x.org/a"}, {"external_id": "", "entity_type": "DRAMA", "url": "https://x"}, {"external_id": "b", "entity_type": "FILM", "url": "https://x"}, {"external_id": "c", "entity_type": "SONG", "url": "ftp://x"}, {"external_id": "a", "entity_type": "DRAMA", "url": "https://x.org/b"}]
    (tmp_path / "m.json").write_text(json.dumps({"source_code": "manual", "items": items}, indent=1))
    rows = S.read_manifest(spark, str(tmp_path / "m.json"))
    assert [r.error for r in rows.orderBy("pos").collect()] == [None, "external_id", "entity_type", "url", None]
    assert [r.url for r in S.dedupe(rows.where("error IS NULL")).collect()] == ["https://x.org/a"]
    assert S.guarded(rows.where("error IS NULL"), S.sources(spark)).count() == 2
    assert S.guarded(rows.withColumn("source_code", F.lit("wikidata")), S.sources(spark)).count() == 0


def test_snapshots_are_written_once(spark, tmp_path):
    def fetched(*bodies):
        rows = [("manual", "drama", "2024-01-01", str(i), bytearray(b)) for i, b in enumerate(bodies)]
        df = spark.createDataFrame(rows, "source string, entity string, dt string, name string, body binary")
        return df.withColumn("content_hash", S.content_hash(F.col("body")))

    root = str(tmp_path / "raw")
    assert S.write_once(fetched(b"a", b"b", b"a"), root) == 2
    assert S.write_once(fetched(b"a"), root) == 0
    assert S.write_once(fetched(b"a2"), root) == 1
    assert spark.read.parquet(root).count() == 3
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.json").write_bytes(b"a")
    got = S.read_snapshots(spark, str(tmp_path / "files"), "*.json").first()
    assert got.content_hash == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"


def test_records_are_idempotent(spark):
    schema = "source_id int, entity_type string, external_id string, content_hash string"
    old = spark.createDataFrame([(1, "DRAMA", None, "h1")], schema)
    new = spark.createDataFrame([(1, "DRAMA", None, "h1"), (1, "DRAMA", None, "h2"), (1, "DRAMA", None, "h2")], schema)
    records, outcome = S.store_records(old, new)
    assert records.count() == 2
    assert sorted(r.outcome for r in outcome.collect()) == ["new", "new", "unchanged"]


def test_golden_lines(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# note\n\n{"id": "1", "class": "genre", "query": "q", "expected": ["a"]}\n')
    assert [tuple(r) for r in S.read_golden(spark, str(tmp_path / "g.jsonl")).collect()] == [("1", "genre", "q", ["a"])]


@pytest.mark.parametrize("value", ["Various Artists", "V.A.", "여러 가수"])
def test_nobody(value):
    assert P.artists(value) == []
