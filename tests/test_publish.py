"""A batch of records into the canonical tables."""

import datetime as dt

from lumenfold.operators import publish as P

RECORD = """staging_id long, source_id long, external_ref string, record struct<title_ko: string, title_normalized: string, broadcaster_code: string, start_date: date, episode_count: int, aliases: array<struct<alias: string, alias_normalized: string>>,
genres: array<string>, credits: array<struct<person: struct<external_id: string, name_ko: string, name_normalized: string, birth_date: date>, credit_type: string, character_name: string, billing_order: int, is_main_cast: boolean>>,
osts: array<struct<external_id: string, title: string, title_normalized: string, part_no: int, track_no: int>>>, resolution map<string, struct<decision: string, canonical_id: long>>"""


def credit(ref, name, birth=None, kind="ACTOR", character=None):
    return ((ref, name, name, birth), kind, character, 1, True)


def test_publish(spark):
    day = dt.date(1979, 7, 10)
    state = P.empty_state(spark)
    state["works"] = spark.createDataFrame([(7, "old", "old", "tvn", None, 16, 3)], P.SCHEMAS["works"])
    state["people"] = spark.createDataFrame([(4, "kim", "kim", None)], P.SCHEMAS["people"])
    state["genres"] = spark.createDataFrame([(7, "crime")], P.SCHEMAS["genres"])
    rows = [
        (1, 1, "w1", ("new", "new", None, day, None, [("a", "a"), ("a", "a")], ["romance"], [credit("p4", "kim"), credit("p9", "lee", day)], [(None, "s", "s", 1, 1)]), {"w1": ("AUTO_MERGE", 7), "p4": ("AUTO_MERGE", 4), "p9": ("CREATE_NEW", None)}),
        (2, 1, "w2", ("other", "other", "kbs", None, 8, [], [], [credit(None, "lee", day), credit(None, "lee", None, "WRITER")], [(None, "r", "r", None, None)]), {"w2": ("CREATE_NEW", None), "song:r": ("REVIEW", 5)}),
    ]
    got = {k: [tuple(r) for r in v.collect()] for k, v in P.publish(state, spark.createDataFrame(rows, RECORD)).items()}
    assert sorted(got["works"]) == [(7, "new", "new", "tvn", day, 16, 4), (8, "other", "other", "kbs", None, 8, 1)]
    assert got["aliases"] == [(7, "a", "a")] and got["genres"] == [(7, "romance")]
    assert sorted(got["people"]) == [(4, "kim", "kim", None), (5, "lee", "lee", day)]
    assert sorted((w, p, t) for w, p, t, *_ in got["credits"]) == [(7, 4, "ACTOR"), (7, 5, "ACTOR"), (8, 5, "ACTOR"), (8, 5, "WRITER")]
    assert got["songs"] == [(1, "s", "s")] and got["work_songs"] == [(7, 1, 1, 1)]
    assert sorted((k, ref, i) for _, k, ref, i, *_ in got["mappings"]) == [("DRAMA", "w1", 7), ("DRAMA", "w2", 8), ("PERSON", "p4", 4), ("PERSON", "p9", 5)]
    assert sorted(e[:2] for e in got["outbox"]) == [(7, "DRAMA_UPDATED"), (8, "DRAMA_CREATED")]
