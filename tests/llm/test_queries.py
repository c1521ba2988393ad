"""The digest columns of registered queries over whole tables, against values made here from the texts and by the libraries."""

import base64
import hashlib
import struct
import zlib

import public_tokenizers
import pytest

from lumenfold.llm import queries
from tests.llm.test_llm import covered, similar_components


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def words(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_media_query(spark, sf, rows):
    got = {r.doc_id: r for r in queries.op1_jpeg_media(spark, sf).collect()}
    same = {}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert same.setdefault(raw, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature) and r.feature
    assert len(got) == len(rows)


def test_packing_query(spark, sf, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in queries.op4_sum_of_squares_packing(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(words(ids[at : at + r.length])))
            at += r.length
        assert at == len(ids)
    lengths = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        lengths.append(at)
    assert max(lengths) <= 1024 and sum(lengths) > 0.95 * 1024 * len(lengths)


def test_jaccard_query(spark, sf, rows):
    want = [(rows[i][0], n, rows[c][0]) for i, n, c in similar_components([t for _, t in rows])]
    got = queries.op5_ngram_jaccard(spark, sf).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == want


def test_round_trip_query(spark, sf, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe_round_trip(spark, sf).collect()}
    want = {}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(words(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want


def test_token_count_query(spark, sf, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op7_token_counts(spark, sf).collect()}
    assert got == {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows}


def test_repeat_query(spark, sf, rows):
    want = covered([t for _, t in rows], 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_repeat_removal(spark, sf).collect()}
    assert got == {i: (len((t or "").encode()), *w) for (i, t), w in zip(rows, want, strict=True)}
    assert sum(w[0] for w in want) > 0


def test_texts_of_some_megabytes(spark, tmp_path):
    """Each query over a table with one very long text, beside an empty one, a null and a copy."""
    import random

    draw = random.Random(2)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopq") for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    long = " ".join(draw.choice(vocabulary) for _ in range(500_000))  # about 3 MB
    rows = [(0, long), (1, ""), (2, None), (3, long), (4, "a b c. d")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    path = str(tmp_path)
    assert {r.doc_id: r.n_bytes for r in queries.op1_jpeg_media(spark, path).collect()} == {i: len((t or "").encode()) for i, t in rows}
    for query in (queries.op5_ngram_jaccard, queries.op13_minhash_near_duplicates):
        assert {r.doc_id: r.component_id for r in query(spark, path).collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4}
    for query in (queries.op6_bpe_round_trip,):
        assert {r.doc_id: r.decoded_sha256 for r in query(spark, path).collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
    removed = {r.doc_id: r.n_removed for r in queries.op9_repeat_removal(spark, path).collect()}
    assert removed == {0: len(long), 1: 0, 2: 0, 3: len(long), 4: 0}
    assert sorted(r.doc_id for r in queries.op10_two_pass_shuffle(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert sum(1 for r in queries.op11_collocations(spark, path).collect()) >= 0
    checked = {r.doc_id: r.verified for r in queries.op12_merkle_manifest(spark, path).collect()}
    assert checked == dict.fromkeys(range(5), True)
