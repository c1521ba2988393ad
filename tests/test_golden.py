"""Generated golden queries against the rules applied row by row; gates of several batches."""

import hashlib
from itertools import combinations

from pyspark.sql import functions as F

from lumenfold.operators import golden as N
from lumenfold.operators import quality as Q

WORKS = "slug string, title string, title_en string, aliases array<string>, year int, channel string, genres array<string>"
CREDITS = "slug string, name string, type string, character string"
ROWS = [("a", "하나", "One", ["", "I"], 2001, "kbs", ["x", "y"]), ("b", "둘", None, None, 2001, "kbs", None), ("c", "둘", "", [], 2001, "zz", ["x"]), ("d", "넷", "", [], None, "kbs", []), *[(f"m{i}", f"t{i}", None, [], 1999, "mbc", ["x"]) for i in range(5)]]
PEOPLE = [("a", "kim", "ACTOR", "hero"), ("a", "lee", "ACTOR", "friend"), ("b", "kim", "ACTOR", "hero"), ("b", "lee", "WRITER", ""), ("c", "han", "WRITER", None), ("d", "seo", "DIRECTOR", ""), ("d", "lee", "ACTOR", "cook"), *[(f"m{i}", "many", "ACTOR", f"x{i}") for i in range(4)], ("m4", "han", "WRITER", ""), ("m1", "han", "ACTOR", "x9")]


def digest(kind, *keys):
    return hashlib.md5("|".join(["3", kind, *keys]).encode()).hexdigest()


def pick(variants, d):
    return variants[int(d[:6], 16) % len(variants)]


def wanted():
    channels, genres = {"kbs": "KBS", "mbc": "MBC"}, {"x": "멜로"}
    out = {"entity_lookup": [], "person": [], "multi_hop": [], "character": [], "temporal": []}
    for slug, title, english, aliases, *_ in ROWS:
        if sum(r[1] == title for r in ROWS) == 1:
            d = digest("entity_lookup", slug)
            out["entity_lookup"].append((d, pick([title, *[a for a in aliases or [] if a], *([english] if english else [])], d), [slug]))
    names = sorted({p[1] for p in PEOPLE})
    for name in names:
        mine = [p for p in PEOPLE if p[1] == name]
        kinds = {p[2] for p in mine}
        if len(mine) <= 3:
            d = digest("person", name)
            said = f"{name} 작가 드라마" if "WRITER" in kinds and "ACTOR" not in kinds else f"{name} 연출 작품" if "DIRECTOR" in kinds and "ACTOR" not in kinds else pick([f"{name} 나온 드라마", f"{name} 출연작", f"배우 {name}"], d)
            out["person"].append((d, said, sorted({p[0] for p in mine})))
    for a, b in combinations(names, 2):
        both = {p[0] for p in PEOPLE if p[1] == a and p[2] == "ACTOR"} & {p[0] for p in PEOPLE if p[1] == b and p[2] == "ACTOR"}
        if len(both) == 1 and all(sum(p[1] == x for p in PEOPLE) >= 2 for x in (a, b)):
            d = digest("multi_hop", a, b)
            out["multi_hop"].append((d, pick([f"{a}랑 {b} 같이 나온 드라마", f"{a} {b} 공동 출연작", f"{a}이랑 {b} 나온 작품"], d), sorted(both)))
    for slug, name, _, who in PEOPLE:
        if who and sum(p[3] == who for p in PEOPLE) == 1:
            d = digest("character", who)
            out["character"].append((d, pick([f"{who} 역 {name}", f"{who} 나오는 드라마", f"{name} {who}"], d), [slug]))
    cells = {}
    for slug, _, _, _, year, channel, kinds in ROWS:
        for g in kinds or [None]:
            if year and channel:
                cells.setdefault((year, channel, g), []).append(slug)
    for (year, channel, g), slugs in cells.items():
        if len(slugs) <= 4 and channel in channels:
            d = digest("temporal", str(year), channel, g or "")
            kind = f" {genres.get(g, g)}" if g else ""
            out["temporal"].append((d, pick([f"{year}년 {channels[channel]}{kind} 드라마", f"{year}년에 {channels[channel]}에서 한{kind} 드라마"], d), sorted(slugs)))
    return {k: sorted(v) for k, v in out.items()}


def test_generated_queries(spark):
    works, credits = spark.createDataFrame(ROWS, WORKS).repartition(3), spark.createDataFrame(PEOPLE, CREDITS).repartition(3)
    for n in (100, 2):
        want = [(kind, query, slugs) for kind, rows in wanted().items() for _, query, slugs in rows[:n]]
        got = N.generate(works, credits, {"kbs": "KBS", "mbc": "MBC"}, {"x": "멜로"}, seed=3, per_class=n).orderBy("id").collect()
        assert [(r["class"], r.query, r.expected) for r in got] == want
        assert [r.id for r in got] == [f"g{i:04d}" for i in range(1, len(want) + 1)]
    assert N.generate(works.where("false"), credits.where("false"), {}, {}).count() == 0


def test_gates_of_all_batches(spark):
    issue = lambda bad: [("X", "ERROR" if bad else "WARNING")]
    rows = [("a", issue(i < 4)) for i in range(6)] + [("b", issue(True)) for _ in range(4)] + [("c", issue(i < 3)) for i in range(6)] + [(None, []) for _ in range(5)]
    df = spark.createDataFrame(rows, "batch string, issues array<struct<code: string, severity: string>>")
    got = {r.batch: (r.n, r.failed) for r in Q.gates(df, "batch").collect()}
    assert got == {"a": (6, True), "b": (4, False), "c": (6, False), None: (5, False)}
    for batch, (_, failed) in got.items():
        try:
            Q.gate(df.where(F.col("batch").eqNullSafe(batch)))
            assert not failed
        except Q.GateError:
            assert failed
