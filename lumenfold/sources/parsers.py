"""Parsers from raw bodies to nested records: errors are a column, never an exception that stops a batch."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumenfold.functions import rules
from lumenfold.functions.text import clean, normalize_key, parse_date, soft_date, without_suffix

CURATED = """format string, external_id string, title_ko string, title_en string, aliases array<string>, broadcaster string, start_date string, end_date string,
episode_count int, runtime_minutes int, synopsis string, official_page_url string, genres array<string>,
credits array<struct<person: struct<external_id: string, name_ko: string, name_en: string, birth_date: string>, type: string, character: string, billing_order: int, main: boolean>>,
ost array<struct<external_id: string, title: string, artists: array<string>, release_date: string, duration_seconds: int, part_no: int, track_no: int>>,
links array<struct<provider: string, url: string, type: string, region: string>>, _corrupt string"""
ARTIST = "external_id string, name string, role string"


def parse_curated(raw: DataFrame, format_name: str, body: str = "body") -> DataFrame:
    """Curated JSON documents (id, body) as (id, record struct, error): forgiving about dates and white space, strict about
    structure. An artist may be a name or an object. The first thing that is wrong is the error, and then there is no record."""
    text = F.when(F.is_valid_utf8(F.col(body)), F.col(body).cast("string"))
    parsed = F.from_json(text, CURATED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.select("id", text.alias("t"), parsed.alias("r"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))

    def person(p: Column) -> Column:
        return F.struct(clean(p["external_id"], True).alias("external_id"), clean(p["name_ko"], True).alias("name_ko"), clean(p["name_en"], True).alias("name_en"), normalize_key(p["name_ko"], True).alias("name_normalized"), parse_date(p["birth_date"]).alias("birth"))

    def artist(a: Column, i: Column) -> Column:
        whole = F.from_json(a, ARTIST)
        name = F.when(a.startswith("{"), whole["name"]).otherwise(a)
        return F.struct(F.when(a.startswith("{"), whole["external_id"]).alias("external_id"), clean(name, True).alias("name"), normalize_key(name, True).alias("name_normalized"), F.coalesce(F.when(a.startswith("{"), whole["role"]), F.lit("PERFORMER")).alias("role"), (i + 1).alias("sort_order"))

    r = F.col("r")
    title_key = normalize_key(r["title_ko"], True)
    aliases = F.filter(F.transform(none(r["aliases"], "array<string>"), lambda a: F.struct(clean(a, True).alias("alias"), normalize_key(a, True).alias("alias_normalized"))), lambda a: a["alias"].isNotNull() & (a["alias_normalized"] != "") & (a["alias_normalized"] != title_key))
    credits = F.transform(r["credits"], lambda c: F.struct(person(c["person"]).alias("person"), F.coalesce(c["type"], F.lit("ACTOR")).alias("credit_type"), clean(c["character"], True).alias("character_name"), c["billing_order"].alias("billing_order"), F.coalesce(c["main"], F.lit(False)).alias("is_main_cast")))
    songs = F.transform(r["ost"], lambda s: F.struct(clean(s["external_id"], True).alias("external_id"), clean(s["title"], True).alias("title"), normalize_key(s["title"], True).alias("title_normalized"), parse_date(s["release_date"]).alias("release"), s["duration_seconds"].alias("duration_seconds"), F.transform(none(s["artists"], "array<string>"), artist).alias("artists"), s["part_no"].alias("part_no"), s["track_no"].alias("track_no")))
    links = F.transform(r["links"], lambda x: F.struct(normalize_key(x["provider"], True).alias("provider_code"), F.trim(x["url"]).alias("url"), x["type"].alias("link_type"), F.upper(F.coalesce(x["region"], F.lit("KR"))).alias("region_code")))
    built = rows.select("id", "t", "r", F.struct(
        F.trim(r["external_id"]).alias("external_id"), clean(r["title_ko"], True).alias("title_ko"), clean(r["title_en"], True).alias("title_en"), title_key.alias("title_normalized"), aliases.alias("aliases"),
        F.nullif(normalize_key(r["broadcaster"], True), F.lit("")).alias("broadcaster_code"), parse_date(r["start_date"]).alias("start"), parse_date(r["end_date"]).alias("end"),
        r["episode_count"].alias("episode_count"), r["runtime_minutes"].alias("runtime_minutes"), clean(r["synopsis"], True).alias("synopsis"), clean(r["official_page_url"], True).alias("official_page_url"),
        F.array_sort(F.array_distinct(F.filter(F.transform(none(r["genres"], "array<string>"), lambda g: normalize_key(g, True)), lambda g: g != ""))).alias("genres"),
        credits.alias("credits"), songs.alias("osts"), links.alias("links"),
    ).alias("record"))
    x = F.col("record")
    nameless = lambda c: F.coalesce(F.exists(c, lambda y: y.isNull()), F.lit(False))
    names = F.transform(x["credits"], lambda c: c["person"]["name_ko"])
    error = (
        F.when(F.col("t").isNull(), "not valid UTF-8")
        .when(r.isNull() | r["_corrupt"].isNotNull() | ~F.coalesce(F.trim("t").startswith("{"), F.lit(False)), "not valid JSON")
        .when(r["external_id"].isNull() | r["title_ko"].isNull() | r["format"].isNull(), "schema violation")
        .when(r["format"] != format_name, F.concat(F.lit("unsupported format "), r["format"]))
        .when(x["title_ko"].isNull(), "title_ko is empty")
        .when(nameless(names), "credit person name_ko is empty")
        .when(nameless(F.transform(x["osts"], lambda s: s["title"])), "ost title is empty")
        .when(F.coalesce(F.exists(x["osts"], lambda s: F.exists(s["artists"], lambda a: a["name"].isNull())), F.lit(False)), "artist name is empty")
        .when(x["start"]["error"].isNotNull(), F.concat(F.lit("start_date: "), x["start"]["error"]))
        .when(x["end"]["error"].isNotNull(), F.concat(F.lit("end_date: "), x["end"]["error"]))
        .when(F.coalesce(F.exists(x["credits"], lambda c: c["person"]["birth"]["error"].isNotNull()), F.lit(False)), "person.birth_date")
    )
    return built.select("id", error.alias("error"), F.when(error.isNull(), x).alias("record"))


TRIPLE = ", ".join(f"{k}: struct<type: string, value: string>" for k in ("item", "p", "o", "oLabel", "charLabel", "birth", "ord"))
BINDINGS = f"results struct<bindings: array<struct<{TRIPLE}, lang: struct<type: string, value: string, `xml:lang`: string>>>>"


def parse_triples(raw: DataFrame, body: str = "body") -> DataFrame:
    """Results of the knowledge base (id, body) as (id, error, record struct): the statements of an item pivoted into one record."""
    rows = raw.select("id", F.from_json(F.col(body).cast("string"), BINDINGS)["results"]["bindings"].alias("b"))
    v = lambda r, k: r[k]["value"]
    item_of = lambda c: F.nullif(F.regexp_extract(c, r"/entity/(Q\d+)$", 1), F.lit(""))
    b = F.coalesce("b", F.array().cast(f"array<struct<{TRIPLE}, lang: struct<type: string, value: string, `xml:lang`: string>>>"))

    def of(kind: str) -> Column:
        return F.filter(b, lambda r: F.regexp_extract(v(r, "p"), "([^/]+)$", 1) == kind)

    values = lambda kind: F.transform(of(kind), lambda r: v(r, "o"))
    text = lambda kind: F.filter(F.transform(values(kind), lambda o: clean(o, True)), lambda o: o.isNotNull())
    label = lambda r: F.when(~clean(v(r, "oLabel"), True).rlike(r"^Q\d+$"), clean(v(r, "oLabel"), True))
    in_language = lambda code: clean(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(of("label"), lambda r: v(r, "lang") == code), lambda r: v(r, "o"))), -1), True)
    site = clean(without_suffix(F.element_at(F.concat(F.array(F.lit(None).cast("string")), values("sitelink")), -1)), True)
    title = F.coalesce(in_language("ko"), F.get(text("P1476"), 0), site, in_language("en"))
    names = F.filter(F.concat(text("P1476"), text("alias"), F.array_compact(F.array(site))), lambda a: ~a.startswith("-") & (normalize_key(a, True) != "") & (normalize_key(a, True) != normalize_key(title, True)))
    keys = F.transform(names, lambda a: normalize_key(a, True))
    aliases = F.filter(F.transform(names, lambda a, i: F.struct(a.alias("alias"), normalize_key(a, True).alias("alias_normalized"), (F.array_position(keys, normalize_key(a, True)) == i + 1).alias("first"))), lambda a: a["first"])
    dates = lambda kind: F.array_sort(F.filter(F.transform(values(kind), soft_date), lambda d: d.isNotNull()))
    bad = lambda kind: F.exists(values(kind), lambda d: parse_date(d)["error"].isNotNull())
    channels = F.array_compact(F.transform(of("P449"), lambda r: F.element_at(F.create_map(*(F.lit(x) for kv in rules.CHANNEL_ITEMS.items() for x in kv)), item_of(v(r, "o")))))
    best = F.get(F.array_sort(F.transform(channels, lambda c: F.struct(rules.precedence(c).alias("at"), c.alias("code")))), 0)["code"]
    genres = F.filter(F.transform(of("P136"), label), lambda g: g.isNotNull())
    classes = F.array_compact(F.transform(of("P31"), lambda r: item_of(v(r, "o"))))

    def credits(kind: str, credit: str) -> Column:
        people = F.filter(of(kind), lambda r: item_of(v(r, "o")).isNotNull() & label(r).isNotNull())
        ids = F.transform(people, lambda r: item_of(v(r, "o")))
        first = F.filter(F.transform(people, lambda r, i: F.when(F.array_position(ids, item_of(v(r, "o"))) == i + 1, r)), lambda r: r.isNotNull())

        def one(r: Column) -> Column:
            place = F.when(v(r, "ord").rlike("^[0-9]+$"), v(r, "ord").cast("int"))
            role = clean(v(r, "charLabel"), True)
            who = F.struct(item_of(v(r, "o")).alias("external_id"), label(r).alias("name_ko"), normalize_key(label(r), True).alias("name_normalized"), soft_date(v(r, "birth")).alias("birth_date"))
            return F.struct(who.alias("person"), F.lit(credit).alias("credit_type"), F.when(~role.rlike(r"^Q\d+$"), role).alias("character_name"), place.alias("billing_order"), F.coalesce(place <= 4, F.lit(False)).alias("is_main_cast"))

        return F.transform(first, one)

    sites = F.array_distinct(F.filter(text("P856"), lambda u: u.startswith("https://")))
    streams = F.array_except(F.transform(F.filter(text("P1874"), lambda n: n.rlike("^[0-9]+$")), lambda n: F.concat(F.lit("https://www.netflix.com/title/"), n)), sites)
    link = lambda provider, kind: lambda u: F.struct(provider.alias("provider_code"), u.alias("url"), F.lit(kind).alias("link_type"))
    links = F.concat(F.transform(sites, link(F.coalesce(best, F.lit("official")), "BROADCASTER_PAGE")), F.transform(streams, link(F.lit("netflix"), "OTT_DETAIL")))
    episodes = F.get(F.filter(F.transform(values("P1113"), lambda e: e.try_cast("double").cast("int")), lambda e: e.isNotNull()), 0)
    english = in_language("en")
    record = F.struct(
        item_of(v(F.get(b, 0), "item")).alias("external_id"), title.alias("title_ko"), F.when(english != title, english).alias("title_en"), normalize_key(title, True).alias("title_normalized"),
        F.transform(aliases, lambda a: F.struct(a["alias"], a["alias_normalized"])).alias("aliases"), best.alias("broadcaster_code"), F.get(dates("P580"), 0).alias("start_date"), F.element_at(F.concat(F.array(F.lit(None).cast("date")), dates("P582")), -1).alias("end_date"),
        episodes.alias("episode_count"), rules.genre_codes(genres).alias("genres"), F.concat(credits("P161", "ACTOR"), credits("P57", "DIRECTOR"), credits("P58", "WRITER")).alias("credits"), links.alias("links"),
        rules.program_kind(classes, genres, F.lit(None).cast("array<string>"))["kind"].alias("program_kind"),
    )
    error = F.when(F.col("b").isNull(), "not a result").when(F.size("b") == 0, "empty result").when(item_of(v(F.get(b, 0), "item")).isNull(), "no item").when(title.isNull(), "no usable title").when(bad("P580") | bad("P582"), "date")
    return rows.select("id", error.alias("error"), F.when(error.isNull(), record).alias("record"))


# Soundtracks from wiki text

_LINK = re.compile(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]")
_SECTION = re.compile(r"^(={2,})\s*(.*?)\s*\1\s*$", re.MULTILINE)
_ABOUT_MUSIC = re.compile(r"OST|O\.S\.T|사운드트랙|사운드 트랙|음악|삽입곡|주제가", re.IGNORECASE)
_NOT_SUNG = re.compile(r"\binst\b|instrumental|\bmr\b|반주", re.IGNORECASE)
_NOBODY = re.compile(r"(?:various(?: artists)?|v\.?a\.?|여러 가수)", re.IGNORECASE)
_PART = re.compile(r"(?:part|파트)\.?\s*(\d+)", re.IGNORECASE)
_DAY = re.compile(r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})")
_TIME = re.compile(r"(\d+):(\d{2})")


def plain(wiki: str) -> str:
    """Wiki text without its marks: links by their label, templates, tags and quotes gone."""
    s = _LINK.sub(r"\1", wiki or "")
    while (t := re.sub(r"\{\{[^{}]*\}\}", "", s)) != s:
        s = t
    s = html.unescape(re.sub(r"<[^>]+>", "", s))
    return " ".join(s.replace("'''", "").replace("''", "").strip(" \t\n'\"“”‘’").split())


def artists(value: str) -> list[str]:
    names = (plain(n) for n in re.split(r",|/|&|·|、|(?:\s+feat\.?\s+)|(?:\s+with\s+)", plain(value), flags=re.IGNORECASE))
    return list(dict.fromkeys(n for n in names if n and not _NOBODY.fullmatch(n)))


def _music_section(wiki: str) -> str:
    marks = list(_SECTION.finditer(wiki))
    for i, m in enumerate(marks):
        if _ABOUT_MUSIC.search(m[2]):
            end = next((n.start() for n in marks[i + 1 :] if len(n[1]) <= len(m[1])), len(wiki))
            return wiki[m.end() : end]
    return ""


def _fields(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(name, parameters) of templates, outermost ones in order; brackets are counted, as they nest."""
    depth, start, cuts, links = 0, 0, [], 0
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\|", text):
        mark = m[0]
        if mark == "{{":
            depth += 1
            if depth == 1:
                start, cuts, links = m.end(), [m.end()], 0
        elif mark == "}}" and depth:
            depth -= 1
            if not depth:
                edges = [*cuts, m.start() + 1]
                parts = [text[a : z - 1] for a, z in zip(edges[:-1], edges[1:], strict=True)]
                pairs = (p.partition("=") for p in parts[1:])
                yield parts[0].strip(), {k.strip(): v.strip() for k, _, v in pairs if k.strip()}
        elif depth == 1:
            links += (mark == "[[") - (mark == "]]")
            if mark == "|" and links <= 0:
                cuts.append(m.end())
    del start


def _seconds(value: str | None) -> int | None:
    m = _TIME.match((value or "").strip())
    return 60 * int(m[1]) + int(m[2]) if m else None


def _rows(section: str) -> Iterator[tuple[str, list[str], int | None, int | None]]:
    for table in re.findall(r"^\{\|.*?^\|\}", section, re.MULTILINE | re.DOTALL):
        head, *rows = re.split(r"^\|-.*$", table, flags=re.MULTILINE)
        names = [plain(c) for c in re.split(r"\n!|!!", head) if c.strip() and not c.startswith("{|")]
        at = lambda *words: next((i for i, n in enumerate(names) if any(w in n for w in words)), None)  # noqa: B023, E731
        title, singer, time, part = at("제목", "곡명", "곡"), at("가수", "아티스트", "노래", "부른"), at("재생", "길이"), at("파트", "Part", "part")
        if title is None or singer is None:
            continue
        for row in rows:
            cells = [plain(c) for c in re.split(r"\n\||\|\|", row.replace("|}", "")) if c.strip()]
            if len(cells) > max(title, singer):
                number = re.search(r"\d+", cells[part]) if part is not None and part < len(cells) else None
                yield cells[title], artists(cells[singer]), _seconds(cells[time]) if time is not None and time < len(cells) else None, int(number[0]) if number else None


def soundtrack(wiki: str) -> list[dict]:
    """Songs of an article's section on music: from its album and track templates, else from its tables. Instrumental ones and
    scores (neither a singer nor a part) are left out, and of equal titles in one part the first stays."""
    section = _music_section(wiki or "")
    found: list[tuple] = []
    part, day, singers = None, None, []
    for name, p in _fields(section):
        if name.startswith("음반 정보"):
            m, d = _PART.search(plain(p.get("음반명") or p.get("앨범명") or "")), _DAY.search(p.get("발매년월일") or p.get("발매일") or "")
            part, day, singers = int(m[1]) if m else None, "-".join(f"{int(x):02d}" for x in d.groups()) if d else None, artists(p.get("가수명") or p.get("가수") or "")
        elif name.startswith("곡 목록"):
            n = 1
            while f"제목{n}" in p:
                found.append((plain(p[f"제목{n}"]), artists(p.get(f"주{n}") or p.get(f"가수{n}") or "") or singers, _seconds(p.get(f"재생시간{n}")), part, day))
                n += 1
    if not any(_sung(t, a, p) for t, a, _, p, _ in found):
        found = [(t, a, s, p, None) for t, a, s, p in _rows(section)]
    out, seen = [], set()
    for title, names, seconds, number, day in found:
        key = (re.sub("[^0-9a-z가-힣ㄱ-ㆎ]+", "", title.casefold()), number)
        if _sung(title, names, number) and key[0] and key not in seen:
            seen.add(key)
            out.append({"title": title, "artists": names, "duration_seconds": seconds, "part_no": number, "track_no": len(out) + 1, "release_date": day})
    return out


def _sung(title: str, names: list[str], part: int | None) -> bool:
    return bool(title) and not _NOT_SUNG.search(title) and bool(names or part is not None)


SONG = "id string, title string, artists array<string>, duration_seconds int, part_no int, track_no int, release_date string"


def parse_soundtracks(raw: DataFrame) -> DataFrame:
    """(id, title, artists, duration_seconds, part_no, track_no, release_date) from (id, wikitext); an article without songs has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SONG.split(", ")]
        for b in batches:
            rows = [{"id": i, **song} for i, text in zip(b["id"], b["wikitext"], strict=True) for song in soundtrack(text)]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("duration_seconds", "part_no", "track_no")})

    return raw.select("id", "wikitext").mapInPandas(run, SONG)


#: Source code -> (version of the parser, parser of (id, body)).
PARSERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {"manual": ("curated/1", lambda df: parse_curated(df, "catalog.drama.v1")), "local_seed": ("curated/1", lambda df: parse_curated(df, "catalog.drama.v1")), "wikidata": ("triples/1", parse_triples)}


def parse_all(raw: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(records by source, records left out): bodies (source, id, body) go to their source's parser; without one they are skipped."""
    out = {code: parse(raw.where(F.col("source") == code)).withColumn("parser_version", F.lit(version)) for code, (version, parse) in PARSERS.items()}
    return out, raw.where(~F.col("source").isin(*PARSERS))
