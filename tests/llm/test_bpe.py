import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, byte_bpe, token_binary
from ledgerloom.llm.queries import op1_token_binary, op4_byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  ", "a", "a b", "a  b", "a \n b", "\n\nx", " \n", "héllo wörld", "日本語 テキスト", "😀 😀😀", "don't we'll", "<|endoftext|>", "a b  c", "x" * 5000, "word " * 3000, "tab\tsep", "12 345\r\n6", "a" + " " * 40 + "b", "\x1c \x85 "]
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


def split(encoder, texts):
    flat, at = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


@pytest.fixture(scope="module")
def whole():
    t = bpe.tokenizer_from_file(JSON)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    return t, bpe.Encoder(t), bpe.Encoder(bpe.tokenizer_from_ranks(RANKS, P.PATTERN)), own


def test_segments_equal_whole_text(whole):
    plain, by_json, by_ranks, own = whole
    for text, a, b in zip(ODD, split(by_json, ODD), split(by_ranks, ODD), strict=True):
        assert a == plain.encode(text or "", add_special_tokens=False).ids, repr(text)
        assert b == own.encode_ordinary(text or ""), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ae.1é日😀 "), st.characters(codec="utf-8", exclude_categories=("Cn", "Co", "Cs")))))
def test_any_text(whole, text):
    plain, by_json, by_ranks, own = whole
    assert split(by_json, [text, "two  of them", text])[2] == plain.encode(text, add_special_tokens=False).ids
    assert split(by_ranks, [text])[0] == own.encode_ordinary(text)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_pack_and_random_access(bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n).astype(np.uint32) for n in (0, 1, 7, 40, 100)]
    shard = token_binary.Shard(token_binary.build_shard([5, None, 7, 8, 9], docs, bits, block=16))
    flat = np.concatenate(docs)
    assert shard.doc_ids == [5, None, 7, 8, 9]
    assert all((shard.document(i) == d).all() for i, d in enumerate(docs))
    assert (shard.whole(step=2) == flat).all() and shard.whole().dtype == np.uint32
    for a in range(0, len(flat), 11):
        for b in range(a, len(flat), 13):
            assert (shard.read(a, b) == flat[a:b]).all()
    with pytest.raises(IndexError):
        shard.read(0, len(flat) + 1)


def test_added_tokens_as_the_untouched_library(monkeypatch):
    plain, own = tokenizers.Tokenizer.from_file(JSON), bpe.encoder_from_file(JSON)
    texts = ["<|endoftext|> hi", "two  <|endoftext|>  sides", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext", "some words  here", ""]
    assert split(own, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert split(own, texts[:1]) == [[50256, 23105]]


@pytest.mark.parametrize("size", [50, 64, 1000])
def test_very_long_texts_in_pieces(monkeypatch, whole, size):
    monkeypatch.setattr(bpe, "LONG", size)
    text = "word  and 12 more,\n\n then é 日本語 " * 60 + "x" * 900 + " \n y"
    plain, by_json, by_ranks, own = whole
    assert split(by_json, ["a b", text]) == [plain.encode(t, add_special_tokens=False).ids for t in ("a b", text)]
    assert split(by_ranks, [text, None]) == [own.encode_ordinary(text), []]


def expected_rows(rows):
    t = tokenizers.Tokenizer.from_file(JSON)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_binary(spark, tmp_path):
    rows = [(3 * i, t, "clash", 1) for i, t in enumerate(ODD)] + [(6, " ", "again", 0), (None, "no id", "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    token_binary.write_shards(df, str(tmp_path / "x"), JSON, 2, shard_ids=300)
    got = [tuple(r) for r in token_binary.read_documents(spark, str(tmp_path / "x")).orderBy("start").collect()]
    want = expected_rows(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")))
    assert got == want
    assert token_binary.token_binary(df.where("doc_id < 0"), JSON, 2).count() == 0


def test_rows_without_doc_id_are_parted(spark, tmp_path):
    rows = [(None, f"{'same start ' * 8}{i:03}" if i < 20 else f"{i:03} text", "", 0) for i in range(300)] + [(5, "last", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    token_binary.write_shards(df, str(tmp_path / "x"), JSON, 2)
    assert spark.read.parquet(str(tmp_path / "x")).select("part").distinct().count() > 4
    got = [tuple(r) for r in token_binary.read_documents(spark, str(tmp_path / "x")).orderBy("start").collect()]
    assert got == expected_rows(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[1])))


def test_op1(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = op1_token_binary(spark, d).orderBy("doc_id").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert [tuple(r) for r in got] == expected_rows([tuple(r) for r in rows])


def test_op4(spark, whole):
    d = "/root/testdata/sf0.001"
    for r in op4_byte_bpe(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").collect():
        ids = whole[3].encode_ordinary(r.text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        starts, ends, at, char_of = [], [], 0, [i for i, c in enumerate(r.text) for _ in c.encode()]
        for i in ids:
            n = len(whole[3].decode_single_token_bytes(i))
            starts.append(char_of[at])
            ends.append(char_of[at + n - 1] + 1)
            at += n
        assert r.offsets_crc32 == zlib.crc32(struct.pack(f"<{2 * len(ids)}i", *starts, *ends))


def test_encode_and_decode(spark, whole):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(ODD)], SCHEMA)
    got = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS)
    assert "n_tokens" in got.columns
    for r in got.collect():
        text = r.text or ""
        assert r.ids == whole[3].encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.decoded_text == text
        raw = [whole[3].decode_single_token_bytes(i) for i in r.ids]
        at = 0
        for a, b, piece in zip(r.char_starts, r.char_ends, raw, strict=True):
            chars = text[a:b].encode()
            assert piece in chars and len(text[:a].encode()) <= at < len(text[:b].encode())
            at += len(piece)
        assert r.split_tokens == sum((x[0] & 0xC0) == 0x80 for x in raw)
    assert byte_bpe.encode(df.where(F.lit(False)), RANKS, P.PATTERN).count() == 0


def test_encode_checked(spark, whole):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(ODD)], SCHEMA)
    for r in byte_bpe.encode_checked(df, RANKS, P.PATTERN).collect():
        assert r.ids == whole[3].encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.encode_checked(df.where(F.lit(False)), RANKS, P.PATTERN).count() == 0


def thue_morse(n, letters="ab"):
    """Words that sums over powers of an odd base modulo 2**64 cannot tell from their complement, from 1,024 letters on."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [8, 15, 16, 1024, 4096])
def test_words_that_weak_hashes_confuse(whole, n):
    plain, by_json, by_ranks, own = whole
    text = f"x {thue_morse(n)} {thue_morse(n, 'ba')} y"
    for texts in ([text], [text[:-2], text]):
        assert split(by_json, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert split(by_ranks, texts) == [own.encode_ordinary(t) for t in texts]


def test_segments_are_told_apart_by_bytes_and_length(whole):
    plain, by_json, _, _ = whole
    texts = ["a \x00 \x00\x00 b", "a b\x00 b c", "a " + "z" * 14 + " " + "z" * 15 + " " + "z" * 14 + "\x00 q"]
    small = bpe.Encoder(plain, keep=4)
    for _ in range(3):
        assert split(by_json, texts) == split(small, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
