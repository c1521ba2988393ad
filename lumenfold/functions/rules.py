"""Rules that enrich records: kinds of programmes, channels, genres and the state of links; all as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lumenfold.functions.text import on_host, path

# Class identifiers of the public knowledge base.
SERIES_CLASSES = ["Q5398426", "Q526877", "Q1259759", "Q482612", "Q24855895", "Q15416", "Q3464665", "Q61704031", "Q506240", "Q98701476", "Q12623153", "Q6863157"]
DRAMA_CLASSES = ["Q482612", "Q24855895", "Q12623153", "Q6863157", "Q506240", "Q98701476"]
NEVER_DRAMA_CLASSES = ["Q336181", "Q622812", "Q173799", "Q13406463", "Q18340514", "Q2155186", "Q581714", "Q63952888", "Q1555508", "Q1132548"]
WEAK_CLASSES = ["Q11424", "Q21191270", "Q7725634", "Q21198342", "Q74262765", "Q7978994", "Q213369"]
GENERIC_CLASSES = ["Q15416", *WEAK_CLASSES]
# Words in genre labels and category titles.
DRAMA_GENRE = r"(?i)드라마|drama|시트콤|sitcom|thriller|스릴러|mystery|미스터리|crime|범죄|fantasy|판타지|romance|romantic|로맨|melodrama|멜로|사극|시대극|역사물|historical|action|액션|science fiction|\bsf\b|horror|공포|comedy|코미디|희극|adventure|lgbt|coming-of-age|supernatural|추리|web series|웹 시리즈|superhero|soap|\bwar\b|teen|틴|학원|특촬물|tokusatsu|noir|누아르|omnibus|옴니버스|anthology|musical|뮤지컬|sports drama"
OTHER_GENRE = r"(?i)리얼리티|reality|버라이어티|variety|토크|talk show|게임 쇼|game show|music television|music program|음악 프로그램|travel|여행|다큐|documentary|기행|competition|경연|서바이벌|survival|퀴즈|quiz|cooking|요리|뉴스|news|\bsport\b|스포츠|award|시상|애니메이션|animat|makeover|dating show|연애 프로그램|infotainment|교양"
DRAMA_CATEGORY, LIST_CATEGORY = "드라마|시트콤", "목록"
OTHER_CATEGORY = "예능|리얼리티|버라이어티|토크|음악 (?:텔레비전 )?프로그램|연예 ?오락|오디션|다큐멘터리|시사|교양|뉴스|스포츠|퀴즈|게임|경연|서바이벌|애니메이션|영화|만화|소설|웹툰|목록|음식|요리|시상식|라디오|코미디 텔레비전 프로그램"


def program_kind(classes: Column, genres: Column, categories: Column) -> Column:
    """struct(kind, reasons). Null arrays count as empty. Classes that are never a drama come first, then curated
    categories, then votes of classes and genres; votes on both sides or on none leave it UNKNOWN."""
    none = F.array().cast("array<string>")
    classes, genres, categories = (F.coalesce(c, none) for c in (classes, genres, categories))

    def among(values: list[str]) -> Column:
        return F.array_sort(F.array_intersect(classes, F.array(*map(F.lit, values))))

    never, by_class = among(NEVER_DRAMA_CLASSES), among(DRAMA_CLASSES)
    curated = F.exists(categories, lambda c: c.rlike(DRAMA_CATEGORY) & ~c.rlike(LIST_CATEGORY))
    others = F.filter(categories, lambda c: c.rlike(OTHER_CATEGORY))
    specific = F.size(F.array_except(classes, F.array(*map(F.lit, GENERIC_CLASSES)))) > 0
    dramatic = F.filter(genres, lambda g: g.rlike(DRAMA_GENRE))
    for_drama = F.concat(F.transform(F.slice(by_class, 1, 1), lambda c: F.concat(F.lit("class "), c)), F.transform(dramatic, lambda g: F.concat(F.lit("genre "), g)))
    against = F.transform(F.filter(genres, lambda g: ~g.rlike(DRAMA_GENRE) & g.rlike(OTHER_GENRE)), lambda g: F.concat(F.lit("genre "), g))

    def verdict(kind: str, reasons: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), reasons.alias("reasons"))

    a, b = F.size(for_drama) > 0, F.size(against) > 0
    return (
        F.when(F.size(never) > 0, verdict("NOT_DRAMA", F.array(F.concat(F.lit("class "), F.get(never, 0)))))
        .when(curated, verdict("DRAMA", F.array(F.lit("kowiki category"))))
        .when(F.size(others) > 0, verdict("NOT_DRAMA", F.array(F.concat(F.lit("kowiki category "), F.get(others, 0)))))
        .when((F.size(categories) > 0) & ~specific & (F.size(dramatic) == 0), verdict("NOT_DRAMA", F.array(F.lit("kowiki has no drama category for a generic programme"))))
        .when(a & ~b, verdict("DRAMA", F.slice(for_drama, 1, 2)))
        .when(b & ~a, verdict("NOT_DRAMA", F.slice(against, 1, 2)))
        .when(a & b, verdict("UNKNOWN", F.concat(F.slice(for_drama, 1, 1), F.slice(against, 1, 1))))
        .otherwise(verdict("UNKNOWN", none))
    )


# Patterns of channel names in category titles, and their codes.
CHANNELS = [
    ("한국방송공사|KBS", "kbs"), ("문화방송|MBC(?! ?에브리원)", "mbc"), ("MBC ?에브리원", "mbc_every1"), ("(?<![A-Z])SBS", "sbs"), ("JTBC", "jtbc"),
    ("(?<![A-Za-z])tvN", "tvn"), ("(?<![A-Za-z])OCN", "ocn"), ("채널 ?A(?![A-Za-z])", "channel_a"), ("TV ?조선", "tv_chosun"), ("매일방송|(?<![A-Za-z])MBN", "mbn"),
    ("(?<![A-Za-z])ENA(?![A-Za-z])", "ena"), ("엠넷|(?<![A-Za-z])Mnet", "mnet"), ("한국교육방송공사|(?<![A-Za-z])EBS", "ebs"), ("넷플릭스|Netflix", "netflix"),
    (r"디즈니 ?\+|디즈니플러스|Disney\+", "disney_plus"), ("티빙|TVING", "tving"), ("웨이브|Wavve", "wavve"), ("쿠팡 ?플레이|Coupang Play", "coupang_play"),
    ("지니 ?TV|올레 ?TV|Genie TV", "genie_tv"), ("카카오 ?TV|Kakao TV", "kakao_tv"), ("네이버 ?TV|Naver TV", "naver_tv"),
]
SLOT_CATEGORY = "드라마|시트콤|연속극|미니시리즈"


def channels_in(category: Column) -> Column:
    return F.array_compact(F.array(*(F.when(category.rlike("(?i)" + p), F.lit(code)) for p, code in CHANNELS)))


def infer_channel(categories: Column) -> Column:
    """struct(code, category): the one channel that categories of one tier name; slots come first, disagreement gives null."""
    votes = F.filter(F.transform(categories, lambda c: F.struct(c.alias("category"), channels_in(c).alias("codes"))), lambda v: F.size(v["codes"]) == 1)
    slots, others = F.filter(votes, lambda v: v["category"].rlike(SLOT_CATEGORY)), F.filter(votes, lambda v: ~v["category"].rlike(SLOT_CATEGORY))
    tier = F.when(F.size(slots) > 0, slots).otherwise(others)
    agreed = F.size(F.array_distinct(F.transform(tier, lambda v: F.get(v["codes"], 0)))) == 1
    first = F.get(tier, 0)
    return F.when(agreed, F.struct(F.get(first["codes"], 0).alias("code"), first["category"].alias("category")))


# Keywords of genre labels; the first row that fits a label counts.
GENRES = [
    (["로맨틱 코미디", "romantic comedy"], ["romance", "comedy"]), (["로맨스", "romance", "연애"], ["romance"]), (["코미디", "comedy", "시트콤", "sitcom"], ["comedy"]),
    (["판타지", "fantasy"], ["fantasy"]), (["스릴러", "thriller"], ["thriller"]), (["미스터리", "추리", "mystery"], ["mystery"]), (["범죄", "crime"], ["crime"]),
    (["액션", "action"], ["action"]), (["의학", "medical"], ["medical"]), (["법정", "legal", "법률"], ["legal"]), (["사극", "시대극", "역사", "historical", "period"], ["historical"]),
    (["가족", "family"], ["family"]), (["청춘", "youth", "coming-of-age", "학원"], ["youth"]), (["멜로", "melodrama"], ["melodrama"]), (["공포", "horror"], ["horror"]),
    (["공상과학", "science fiction", "sf"], ["sf"]), (["일일", "daily"], ["daily"]), (["오피스", "office", "workplace", "직장"], ["office"]),
]
GENRE_LABELS = {
    "romance": "로맨스", "comedy": "코미디", "melodrama": "멜로", "fantasy": "판타지", "thriller": "스릴러", "mystery": "미스터리", "crime": "범죄", "action": "액션",
    "medical": "의학", "legal": "법정", "historical": "사극", "family": "가족", "youth": "청춘", "office": "오피스", "sf": "SF", "horror": "공포", "daily": "일일",
}


def genre_codes(labels: Column) -> Column:
    """Sorted distinct codes of genre labels."""

    def of(label: Column) -> Column:
        low, out = F.lower(label), None
        for keys, codes in GENRES:
            fits = reduce(lambda a, b: a | b, (low.contains(k) for k in keys))
            found = F.array(*map(F.lit, codes))
            out = F.when(fits, found) if out is None else out.when(fits, found)
        return out.otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(labels, of))))


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """A code's label, or the code itself."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), code), code)


# Channels by knowledge-base item, and their order of precedence.
CHANNEL_ITEMS = {
    "Q498825": "kbs", "Q624509": "kbs", "Q777278": "kbs", "Q482607": "mbc", "Q10854650": "mbc", "Q928831": "sbs", "Q16172404": "sbs", "Q213097": "jtbc", "Q333424": "tvn",
    "Q626419": "ocn", "Q6729143": "mbn", "Q492438": "channel_a", "Q486605": "tv_chosun", "Q12618747": "ena", "Q490182": "mnet", "Q6714697": "mbc_every1", "Q12580927": "ebs",
    "Q907311": "netflix", "Q54958752": "disney_plus", "Q12621401": "tving", "Q65233413": "wavve", "Q116638614": "coupang_play", "Q7088285": "genie_tv", "Q21825231": "kakao_tv", "Q64822152": "naver_tv",
}
PRECEDENCE = ["kbs", "mbc", "sbs", "tvn", "jtbc", "ocn", "mbn", "channel_a", "tv_chosun", "ena", "mnet", "mbc_every1", "ebs", "netflix", "disney_plus", "tving", "wavve", "coupang_play", "genie_tv", "kakao_tv", "naver_tv"]


def precedence(code: Column, order: list[str] = PRECEDENCE) -> Column:
    """Place in the order of precedence; codes that are not in it come last."""
    place = F.array_position(F.array(*map(F.lit, order)), code)
    return F.when(place > 0, place - 1).otherwise(len(order))


# Each provider's hosts, and paths that a title's address turns into once it is gone.
PROVIDERS: dict[str, tuple[list[str], list[str]]] = {
    "kbs": (["kbs.co.kr"], []), "mbc": (["imbc.com", "mbc.co.kr"], []), "sbs": (["sbs.co.kr"], []), "jtbc": (["jtbc.co.kr"], []),
    "tvn": (["tving.com", "cjenm.com", "tvn.co.kr"], []), "ocn": (["tving.com", "cjenm.com"], []), "netflix": (["netflix.com"], ["/browse", "/login", "/kr", "/"]),
    "tving": (["tving.com"], ["/", "/onboarding", "/login"]), "wavve": (["wavve.com"], ["/", "/login", "/member"]), "disney_plus": (["disneyplus.com"], ["/", "/login", "/home", "/welcome"]),
    "coupang_play": (["coupangplay.com"], ["/", "/login"]), "watcha": (["watcha.com"], ["/", "/sign_in"]),
}
REGION_MARKS = ["/geo", "not-available", "unavailable", "region"]


def link_verdict(provider: Column, original: Column, status: Column, final: Column, error: Column) -> Column:
    """The availability that one answer to a request shows."""
    final = F.coalesce(F.nullif(final, F.lit("")), original)
    walled = reduce(lambda a, b: a | b, (F.lower(final).contains(m) for m in REGION_MARKS))
    there, gone = F.lit(True), F.lit(False)
    for code, (hosts, paths) in PROVIDERS.items():
        there = F.when(provider == code, on_host(final, hosts)).otherwise(there)
        gone = F.when(provider == code, path(final).isin(paths) if paths else F.lit(False)).otherwise(gone)
    ok = (status >= 200) & (status < 300)
    return (
        F.when(error.isNotNull(), "TEMPORARY_ERROR")
        .when(status.isin(404, 410), "NOT_FOUND")
        .when((status == 451) | ((status == 403) & walled), "REGION_RESTRICTED")
        .when(status.isin(401, 403), "ACCESS_DENIED")
        .when((status == 429) | (status >= 500), "TEMPORARY_ERROR")
        .when(ok & ~there, "REDIRECTED")
        .when(ok & (final != original) & gone, "REDIRECTED")
        .when(ok & walled, "REGION_RESTRICTED")
        .when(ok, "AVAILABLE")
        .when((status >= 300) & (status < 400), "REDIRECTED")
        .otherwise("UNKNOWN")
    )


def is_foreign(countries: Column, found_by: Column, has_category: Column, home: str = "Q884") -> Column:
    """Known countries without the home one; where none is known, only what categories alone found needs one that fits."""
    known = F.size(F.coalesce(countries, F.array().cast("array<string>"))) > 0
    only_pages = (F.size(found_by) == 1) & F.array_contains(found_by, "kowiki")
    return F.when(known, ~F.array_contains(countries, home)).otherwise(only_pages & ~has_category)


def needs_lookup(kind: Column, categories: Column) -> Column:
    """Whether categories have to be fetched before the kind can be told."""
    return (kind == "UNKNOWN") & categories.isNull()


def collapsed(new: int, previous: int, least: float = 0.6) -> bool:
    """Whether a discovery found so much less than the one before that it must not be used."""
    return previous > 0 and new < least * previous


def enriched_text(current: Column, extract: Column, source: str, least: int = 40) -> tuple[Column, Column]:
    """(text, source): an extract of enough characters fills an empty text; a shorter one only marks it as checked."""
    good = F.length(F.trim(extract)) >= least
    return F.when(current.isNull() & good, extract).otherwise(current), F.when(current.isNull(), F.when(good, F.lit(source)).otherwise(F.lit(f"{source}:none")))


def decided(candidates, home: str = "Q884"):
    """(to ingest, excluded) from candidates (external_id, kind, countries, found_by, has_category): works of home go on, in
    the order of their numbers; others are excluded with the reason."""
    foreign = is_foreign(F.col("countries"), F.col("found_by"), F.col("has_category"), home)
    reason = F.when(F.col("kind") == "NOT_DRAMA", "not_drama").when(foreign, "foreign")
    rows = candidates.withColumn("reason", reason).withColumn("n", F.regexp_extract("external_id", "([0-9]+)$", 1).cast("long"))
    return rows.where("reason IS NULL").orderBy("n").drop("reason", "n"), rows.where("reason IS NOT NULL").orderBy("n").drop("n")
