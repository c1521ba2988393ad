"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenfold.llm import bpe, chat, components, jaccard, jpeg, packing, quality, queries, repeats, search, sharding, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "\n\n", "  a", "a \n b", "▁a ▁ b▁ c", "a▁", " \t x  ", "<|endoftext|></s><unk>", "日本語 テキスト 😀😀  ¡é", "ab" * 300 + "\n" + "é" * 200, "a　b c", "a\x00b \x1c!\x1c?", "x y", "it's  we'll 123 4\r\n5", "q" * 2000]


@pytest.fixture(scope="session")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()
    return [r.text for r in rows] + ODD + ODD[:4]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Every odd text, repeated ones, and columns whose names operators use themselves."""
    rows = [(i, t, i, "s", b"k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard long, id string, kept binary").repartition(5, "doc_id").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_jpeg_round_trip(docs, texts, empty):
    got = {r.id: r for r in jpeg.read(jpeg.store(docs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert got[i].payload == want and got[i].n_bytes == len(raw)
        assert got[i].width * got[i].height >= len(want)
    assert jpeg.read(jpeg.store(empty)).count() == 0


def test_jpeg_any_bytes():
    draw = np.random.default_rng(1)
    payloads = [draw.integers(0, 256, 64 * n, dtype=np.uint8) for n in (1, 2, 40)] + [np.full(640, v, np.uint8) for v in (0, 128, 255)]
    payloads.append(np.where(np.arange(6400) % 23, 128, 7).astype(np.uint8))
    images = [jpeg.parse(m) for m in jpeg.encode(payloads)]
    for p, image, values in zip(payloads, images, jpeg.decode(images), strict=True):
        assert jpeg.payload(image, values) == p.tobytes()
        thumb = jpeg.thumbnail(image, values)
        assert thumb.shape == (image.height // 8, image.width // 8)
        want = np.clip((p.reshape(-1, 64)[:, 0].astype(int) - 128) // 8 + 128, 0, 255)
        assert (thumb.reshape(-1)[: len(want)] == want).all()


def test_jpeg_colour_image_without_restarts():
    """Two components of different sampling, coded bit by bit here."""
    dc, ac = jpeg.own_tables()
    (_, dcode), (_, acode) = jpeg.canonical(dc), jpeg.canonical(ac)
    draw = np.random.default_rng(2)
    blocks = draw.integers(-3, 4, (2 * 3, 64)) * (draw.random((6, 64)) < 0.2)  # two units of two and one blocks
    bits, last = "", [0, 0]
    for k, b in enumerate(blocks):
        c = 1 if k % 3 == 2 else 0
        run = 0
        for i, v in enumerate(map(int, b)):
            if i == 0:
                v, last[c] = v - last[c], v
                n = abs(v).bit_length()
                code, size = dcode[n]
            elif v == 0:
                run += 1
                continue
            else:
                while run > 15:
                    bits += f"{acode[0xF0][0]:0{acode[0xF0][1]}b}"
                    run -= 16
                n = abs(v).bit_length()
                code, size = acode[run << 4 | n]
                run = 0
            bits += f"{code:0{size}b}" + (f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else "")
        if run:
            bits += f"{acode[0][0]:0{acode[0][1]}b}"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    head = jpeg.header(1, 1, 64)
    tables = head[head.index(b"\xff\xdb") : head.index(b"\xff\xc0")], head[head.index(b"\xff\xc4") : head.index(b"\xff\xdd")]
    frame = jpeg.segment(0xC0, b"\x08\x00\x08\x00\x20\x02" + b"\x01\x21\x00" + b"\x02\x11\x00")
    media = b"\xff\xd8" + tables[0] + frame + tables[1] + jpeg.segment(0xDA, b"\x02\x01\x00\x02\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    image = jpeg.parse(media)
    first, second = jpeg.decode([image])[0]
    assert (first == blocks[[0, 1, 3, 4]]).all() and (second == blocks[[2, 5]]).all()
    assert jpeg.thumbnail(image, [first, second]).shape == (1, 4)
    with pytest.raises(ValueError):
        jpeg.parse(b"no image")


def bm25(docs, asked, k):
    words = {i: search.terms(t) for i, t in docs}
    n, average = len(docs), sum(map(len, words.values())) / max(1, len(docs))
    df = Counter(t for w in words.values() for t in set(w))
    out = []
    for q, text in asked:
        scores = []
        for i, w in words.items():
            tf = Counter(w)
            s = sum(c * np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / average)) for t, c in Counter(search.terms(text)).items() if tf[t])
            if s > 0:
                scores.append((-round(s, 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_search_is_exact(spark, docs, texts, empty, monkeypatch):
    asked = spark.createDataFrame([(1, texts[0][:400]), (2, "the of and"), (3, None), (4, "no_such_word"), (5, texts[40]), (5, "日本語 a")], "item_id long, text string")
    monkeypatch.setattr(search, "SHARD_DOCS", 30)
    found = search.search(search.build_index(docs), asked, 7).select("query_id", "rank", "doc_id", F.round("score", 6)).collect()
    want = bm25(list(enumerate(texts)), [(1, texts[0][:400]), (2, "the of and")], 7)
    assert sorted(tuple(r) for r in found if r[0] < 5) == [(*w[:3], pytest.approx(float(w[3]), abs=2e-6)) for w in sorted(want)]
    assert len([r for r in found if r[0] == 5]) > 7  # each of two queries of one id
    assert search.search(search.build_index(empty), asked, 3).count() == 0


def test_search_asks_every_twentieth_document(spark, sf, monkeypatch):
    """op2's queries are the whole texts of the documents whose id is divisible by 20; blocks of queries change nothing."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    asked = [(i, t) for i, t in rows if i % 20 == 0]
    want = [(*w[:3], pytest.approx(float(w[3]), abs=2e-6)) for w in sorted(bm25(rows, asked, 10))]
    assert {w[0] for w in want} == {i for i, t in asked if search.terms(t)}
    for limit in (1 << 20, 300):
        monkeypatch.setattr(search, "QUERY_TERMS", limit)
        assert sorted(map(tuple, queries.op2_bmw_search(spark, sf).collect())) == want


def test_chat_tree(spark):
    draw = random.Random(3)
    rows = []
    for conv in range(60):
        system = "be good" if conv % 3 else "be <|im_end|>\\n bad\\"
        rows.append((conv, 0, "system", system))
        for turn in range(1, draw.randint(1, 6)):
            rows.append((conv, turn, "assistant" if turn % 2 == 0 else "user", draw.choice(["", None, "hi", queries.HOSTILE, "é\n<\\|", "x" * 50])))
    rows += [(None, 0, None, "n"), (None, None, "assistant", "first"), (70, 1, "user", "b"), (70, 1, "user", "a"), (71, 0, "a\nb", "c")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        made = chat.formatter(f.read(), public_tokenizers.PATTERN)
    for limit in (1 << 18, 300):
        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        nodes, members = chat.layouts(frame, *ranks, limit)
        got = {r.conv_id: r for r in chat.read_back(nodes, members, *ranks).collect()}
        key = lambda v: (v is not None, v or 0 if not isinstance(v, str) else v)
        for conv in {r[0] for r in rows}:
            mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (key(r[0]), r[1] or "", r[2] or ""))
            said = "".join(t or "" for _, role, t in mine if role == "assistant")
            assert got[conv].n_turns == len(mine)
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a or ''}\n{b or ''}\n" for _, a, b in mine).encode()).hexdigest()
            assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
            assert got[conv].formatted_chars == sum(len(chat.render(a or "", b or "")[0]) for _, a, b in mine)
        flat = nodes.collect()
        assert len({r.node for r in flat}) == len(flat)  # a shared turn once, in trees of any size
        place, size = {r.node: r for r in flat}, {r.node: len(r.ids) // 4 for r in flat}
        by = {}
        for r in flat:
            by.setdefault(r.layout, []).append(r)
            turn = made.ids(r.role, "")[0]
            assert bytes(r.ids)[: len(turn) - len(made.after)] == turn[: len(turn) - len(made.after)]
            assert (r.loss_start is not None) == (r.role == "assistant")
        for own in by.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += size[r.node]
                above, p = set(), r.parent
                while p:
                    above |= {(place[p].layout, x) for x in range(place[p].offset, place[p].offset + size[p])}
                    p = place[p].parent
                assert above == {(s.layout, x) for s in r.ancestors for x in range(s.start, s.stop)}
                assert r.position == len(above)
    assert len({r.layout for r in flat}) > 20 and any(len({s.layout for s in r.ancestors}) > 1 for r in flat)
    assert chat.layouts(frame.limit(0), *ranks)[0].count() == 0
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made.own.ranks, special_tokens={})
    ids, start, stop = made.ids("user", "a <|im_end|> b")
    assert np.frombuffer(ids, np.uint32)[start:stop].tolist() == reference.encode_ordinary("a <\\|im_end|> b")
    assert made.text(ids) == chat.render("user", "a <|im_end|> b")[0]


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids, at = b"", 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length * 4 == len(r.ids) > 0
            ids, at = ids + r.ids, at + r.length
        want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert queries.unpacked(ids) == want and {r.doc_tokens for r in by_doc[i]} == {len(want)}
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0 and at <= 1024
    assert sum(sum(r.length for r in own) < 1024 for own in by_sequence.values()) <= 10 * docs.rdd.getNumPartitions()
    assert packing.pack(empty, path).count() == 0


def test_packing_level_is_least_sum_of_squares():
    packer = packing.Packer(64, 0)
    draw = random.Random(9)
    for i in range(400):
        n = draw.randint(1, 63)
        choices = []
        for h in range(64 - n + 1):
            if h == 0 or packer.counts[h]:
                after = packer.counts.copy()
                after[h] -= h > 0
                after[h + n] += h + n < 64
                choices.append((int((after[1:64] ** 2).sum()), -h))
        assert packer.level(n) == -min(choices)[1]
        packer.add(i, np.zeros(n, np.uint32))


def similar_components(texts, size=5):
    sets, least = [], []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    least = list(range(len(sets)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(draw, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"w{draw.randint(0, 99)}"
        out.append(" ".join(w))
    return out


def test_jaccard(spark, docs, texts, empty):
    want = similar_components(texts)
    assert sorted(tuple(r) for r in jaccard.join(docs).select("doc_id", "n_shingles", "component_id").collect()) == want
    assert jaccard.join(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "c"), (2, "A b"), (2, "A b")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd).collect()), key=str)
    assert got == sorted([(None, 1, None), (None, 0, None), (1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 1, 1)], key=str)


@pytest.mark.parametrize("lot", [2048, 5])
def test_jaccard_of_large_groups(spark, monkeypatch, lot):
    """Families of copies, edited until they fall apart; blocks and hot elements at every size."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(4))
    texts = []
    for n, edits in ((60, 3), (50, 9), (40, 14)):
        base = " ".join(word() for _ in range(90))
        texts += near_copies(draw, base, n, edits)
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(draw.choice([5, 15, 40]))) for _ in range(60)]
    draw.shuffle(texts)
    monkeypatch.setattr(jaccard, "HOT", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "LOT", lot)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = similar_components(texts)
    assert len({c for _, _, c in want}) > 20
    assert sorted(tuple(r) for r in jaccard.join(frame).select("doc_id", "n_shingles", "component_id").collect()) == want


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(draw.randint(100, 180), draw.randint(100, 180)) for _ in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_bpe(docs, texts, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.id: r for r in bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert queries.unpacked(got[i].ids) == library.encode_ordinary(t or "")
        assert got[i].raw == (t or "").encode()
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0
    table = bpe.MinimalPerfectHash(ranks)
    assert all(table.find(k) == v for k, v in ranks.items()) and table.find(b"no such entry") == -1
    assert len(table.keys) == len(ranks)


def test_token_counts(docs, texts, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)}
    assert token_counts.token_counts(empty, path).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_bradley_terry_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    right = sum(r.predicted == r.quality for r in got) / len(got)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_quality_learns_from_trigrams():
    """Texts that only differ in the order of letters within words, which no share of byte classes shows."""
    draw = np.random.default_rng(3)
    kinds = [["stone", "water", "light"], ["tsneo", "rtwae", "ghitl"]]
    texts = [(good, " ".join(draw.choice(kinds[0 if good else 1], 40))) for good in draw.random(400) < 0.5]
    x, good = np.array([quality.features(t) for _, t in texts]), np.array([g for g, _ in texts])
    found = quality.fit(x[:300], good[:300]).scores(x[300:])
    assert found[good[300:]].min() > found[~good[300:]].max()
    assert np.isfinite(quality.features("")).all() and np.isfinite(quality.features("a")).all() and np.isfinite(quality.features("é" * 200_000)).all()


def test_quality_odd_input(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 7)], "doc_id long, quality int")
    one = quality.train(docs, labels)
    rows = quality.score(docs, one).collect()
    assert all(r.score >= 0.3 for r in rows) and rows[0].shard is not None
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def covered(texts, length):
    where = Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        where.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if where[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [8000, 2])
def test_repeats(spark, docs, texts, monkeypatch, hot):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abé ") for _ in range(n))
    passages = [text(n) for n in (95, 100, 101, 130, 400)]
    more = [text(draw.randint(0, 80)) + draw.choice(passages) + text(draw.randint(0, 80)) + draw.choice(passages) for _ in range(50)]
    more += [more[0], more[0], "a" * 350, "b" * 99, "b" * 99, "c" * 100, "c" * 100, "ab" * 200 + "ba" * 100, None, ""]
    everything = more + texts
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", 5000)
    frame = spark.createDataFrame([(i, t, 1, i) for i, t in enumerate(everything)], "doc_id long, text string, k1 int, cut long").repartition(3)
    got = repeats.removed(frame, 100).collect()
    want = covered(everything, 100)
    assert len(got) == len(everything)
    for r in got:
        assert (sum(c.stop - c.start for c in r.cut), len(r.cut), repeats.digest(bytes(r.kept))) == want[r.doc_id], everything[r.doc_id]
    assert repeats.removed(frame.limit(0), 100).count() == 0


@pytest.mark.parametrize("hot", [8000, 40, 2])
def test_groups_list_all_occurrences(spark, monkeypatch, hot):
    draw = random.Random(15)
    text = lambda n: "".join(draw.choice("abé ") for _ in range(n))
    line, passages = text(90), [text(n) for n in (130, 300, 700)]
    texts = [text(draw.randint(0, 90)) + line * draw.randint(1, 4) + text(90) + draw.choice(passages) for _ in range(60)] + [None, "", "x" * 99]
    monkeypatch.setattr(repeats, "HOT", hot)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keys = {(r.k1, r.k2): (r.text or "").encode() for r in repeats.keyed(frame, "text").collect()}
    found: dict[bytes, set] = {}
    cover = {k: bytearray(len(raw)) for k, raw in keys.items()}
    for r in repeats.groups(frame, 100).collect():
        k = (r.k1, r.k2)
        assert r.size >= 100
        found.setdefault(keys[k][r.start : r.start + r.size], set()).add((k, r.start))
        cover[k][r.start : r.start + r.size] = b"\1" * r.size
    for string, places in found.items():
        want = {(k, m.start()) for k, raw in keys.items() for m in re.finditer(b"(?=" + re.escape(string) + b")", raw)}
        assert places == want and len(want) > 1
    distinct = list(keys.values())
    assert [sum(c) for c in cover.values()] == [n for n, _, _ in covered([raw.decode() for raw in distinct], 100)]


def test_equal_segments_are_settled_in_their_task(spark):
    draw = random.Random(16)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    line, passage = text(60), text(500)
    texts = [text(150) + line * 12 + text(150) + passage + text(150) for _ in range(80)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    rows = repeats.anchors(repeats.keyed(frame, "text"), 100)
    counts = {r.settled: r["count"] for r in rows.groupBy("settled").count().collect()}
    assert counts[True] > 80 * 8
    heaviest = rows.where("NOT settled").groupBy("h").count().agg(F.max("count")).first()[0]
    assert heaviest <= 2 * 80 + 8  # the line's two ends in each text, and twice a task what lies between
    got = {r.doc_id: r for r in repeats.removed(frame, 100).collect()}
    for i, want in enumerate(covered(texts, 100)):
        assert (sum(c.stop - c.start for c in got[i].cut), len(got[i].cut), repeats.digest(bytes(got[i].kept))) == want


def test_maximal_repeat_groups():
    groups, _ = repeats.maximal_repeats([b"xabcdefgy", b"zabcdefgw", b"qcdefgz", b"bcdefgy"], 4)
    found = {(n, tuple(sorted(o))) for n, o in groups}
    assert (7, ((0, 1), (1, 1))) in found  # abcdefg, with other bytes before and behind
    assert (5, ((0, 3), (1, 3), (2, 1), (3, 1))) in found  # cdefg: all occurrences, not neighbours only
    assert not any(n == 6 and (1, 2) in o for n, o in found if len(o) == 2)


def test_shuffle_behind_a_shuffle(spark):
    """Copies of one row with a wide column, dealt anew by another key: jobs that read different columns cut the input differently."""
    rows = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("one text").alias("text"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("wide"), (F.col("id") % 997).alias("z"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        dealt = sharding.shuffle(rows.repartition(16, "z").repartition("z"), 16, bucket_bytes=20_000)
        found = dealt.select("position", "shard", "slot").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sorted(r.position for r in found) == list(range(4000))
    for shard in range(16):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(250))


def test_sharding_query(spark, sf):
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_two_pass_shuffle(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(rows[r.doc_id]) + 1, zlib.crc32(rows[r.doc_id]), "rows", None) for r in got)
    sizes = []
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
        sizes.append(len(slots))
    assert max(sizes) - min(sizes) <= 1


def test_shards_are_written_in_order(spark, docs, tmp_path):
    sharding.write_shards(sharding.shuffle(docs, 3, bucket_bytes=3000), str(tmp_path / "shards"))
    for s in range(3):
        files = [pq.ParquetFile(f).read(["slot"])["slot"].to_pylist() for f in (tmp_path / "shards" / f"shard={s}").glob("*.parquet")]
        assert len(files) > 3 and [x for f in sorted(files) for x in f] == list(range(sum(map(len, files))))


def test_shuffle(spark, docs, texts, empty):
    for size in (1 << 25, 3000):
        rows = sharding.shuffle(docs, 16, bucket_bytes=size).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        assert all(r.text == texts[r.doc_id] and r.id == "s" for r in rows)
        sizes = Counter(r.shard for r in rows)
        assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        again = {(r.doc_id, r.shard, r.slot) for r in sharding.shuffle(docs.repartition(2), 16, bucket_bytes=size).collect()}
        assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert sharding.shuffle(empty).count() == 0
    odd = spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sharding.shuffle(odd, 2).count() == 4
    hot = spark.createDataFrame([(None, None)] * 3000 + [(5, "x")] * 3000 + [(5, f"t{i}") for i in range(3000)], "doc_id long, bucket string").withColumn("text", F.col("bucket")).withColumn("key", F.lit(1)).repartition(3)
    dealt = sharding.shuffle(hot, 4, bucket_bytes=20_000)
    assert sorted(dealt.columns) == sorted([*hot.columns, "shard", "slot", "position"])
    parts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) > 20 and max(parts) < 3 * 9000 / len(parts)  # no bucket has one id's rows, or copies of one row
    rows = sharding.write_shards(dealt).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in hot.collect())
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(4) for i in range(2250)]
    counts = Counter(tuple(sharding.fisher_yates(3, s, 0)) for s in range(600))
    assert len(counts) == 6 and min(counts.values()) > 60
