import hashlib
import struct
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import media as M
from ledgerloom.llm.queries import op6_media


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04ab12\xff\x0034\xff\xd9"
ZIP = b"PK\x03\x04" + b"x" * 26 + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0, 0, 0, 30, 0)
PDF = b"%PDF-1.4\n...startxref\n9\n%%EOF"


def test_formats_and_broken_ones():
    for kind, data in (("audio/wav", M.to_wav(b"a" * 64)), ("image/bmp", M.to_bmp(b"a" * 64)), ("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("application/zip", ZIP), ("application/pdf", PDF)):
        assert M.sniff(data) == [(0, len(data), kind)]
        assert M.sniff(b"junk" + data + b"tail")[0] == (4, len(data), kind)
        assert M.sniff(data[:-1]) == []
    broken = bytearray(png())
    broken[-8] ^= 1
    assert M.sniff(bytes(broken)) == [] == M.sniff(b"") == M.sniff(b"BM" * 40) == M.sniff(b"RIFFRIFF")


def test_media_inside_media_and_neighbours():
    inner = M.to_wav(M.padded(png()))
    assert M.sniff(inner) == [(0, len(inner), "audio/wav")]
    assert [x[2] for x in M.sniff(png() + b"--" + GIF + JPEG)] == ["image/png", "image/gif", "image/jpeg"]
    for make, kind in ((M.to_wav, "audio/wav"), (M.to_bmp, "image/bmp")):
        assert M.samples(make(M.padded(b"abc")), kind) == b"abc" + bytes(61)


def test_several_documents_in_one_value():
    two = PDF + b"\n3 0 obj\nstartxref\n40\n%%EOF"  # with an incremental update
    whole = two + b"\n" + png() + PDF + PDF
    assert [(whole[a : a + n], kind) for a, n, kind in M.sniff(whole)] == [(two, "application/pdf"), (png(), "image/png"), (PDF, "application/pdf"), (PDF, "application/pdf")]
    attached = b"%PDF-1.7\nstartxref\n0\n%%EOF\nstream\n" + PDF + b"\nendstream\nstartxref\n9\n%%EOF"
    assert M.sniff(attached + PDF) == [(0, len(attached), "application/pdf"), (len(attached), len(PDF), "application/pdf")]


def expected(text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_columns(spark):
    rows = [(1, png(), "x", 7), (2, b"..." + GIF, "x", 7), (3, None, "x", 7), (3, None, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, media binary, media_type string, other int")
    got = {(r.doc_id, r.media_type, r.media_size, tuple(r.carved), r.other) for r in M.sniffed(df).collect()}
    assert got == {(1, "image/png", len(png()), (), 7), (2, M.UNKNOWN, None, ((3, len(GIF), "image/gif"),), 7), (3, M.UNKNOWN, None, (), 7)}
    assert M.sniffed(df.where("doc_id > 9")).count() == 0


def test_digests_of_odd_texts(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "RIFF" * 40, "y" * 500_000, png().decode("latin-1")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    for r in M.digests(df).collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])
    assert M.digests(df.where("doc_id > 99")).count() == 0


def test_op6(spark):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    seen = {}
    for r in op6_media(spark, d).collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(text[r.doc_id])
        assert seen.setdefault(text[r.doc_id], r[5:]) == r[5:]


def naive(data):
    """Every place, every format, without an automaton."""
    found, at = [], 0
    while at < len(data):
        for magic, (kind, length) in M.FORMATS.items():
            if data[at : at + len(magic)] == magic and (n := length(data, at, M.Marks(data))):
                found.append((at, n, kind))
                at += n - 1
                break
        at += 1
    return found


PIECES = [b"", b"junk", b"BM", b"RIFF", b"PK\x03\x04", b"%PDF-1.", b"%%EOF", b"startxref", b"\xff\xd8\xff\xe0\x00\x04ab", b"GIF89a", GIF, JPEG, ZIP, PDF, png(), M.to_wav(b"a" * 64), M.to_bmp(b"b" * 64), GIF[:-1], png()[:-3]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8))
def test_against_a_naive_scan(pieces):
    data = b"".join(pieces)
    assert M.sniff(data) == naive(data)


@pytest.mark.parametrize("unit", [b"%PDF-1", b"PK\x03\x04", b"PK\x03\x04PK\x05\x06", b"%PDF-1startxref", b"\xff\xd8\xff\xe0\x00\x06xx", b"GIF89a\x01\x00\x01\x00\x00\x00\x00!", b"RIFF", b"BM"])
def test_many_magic_bytes_take_time_in_proportion(unit):
    began = time.process_time()
    M.sniff(unit * (400_000 // len(unit)))
    assert time.process_time() - began < 8


def riffs(n):
    """Starts that all jump to one run of empty chunks at the end."""
    unit, run = 48, b"junk\0\0\0\0" * (n // 16)
    half = n // unit // 2
    out = [struct.pack("<4sI4s4sI", b"RIFF", half * unit + len(run) - i * unit - 8 - 8 * (i % 1000), b"WAVE", b"junk", half * unit - i * unit - 20).ljust(unit, b"\0") for i in range(half)]
    return b"".join(out) + run


def pngs(n):
    """Starts whose second chunk claims all that comes after it."""
    head = b"\x89PNG\r\n\x1a\n" + png()[8:33]
    unit = len(head) + 8
    return b"".join(head + struct.pack(">I4s", (n // unit - i - 1) * unit, b"IDAT") for i in range(n // unit)) + bytes(4)


@pytest.mark.parametrize("make", [riffs, pngs])
def test_chains_that_meet_take_time_in_proportion(make):
    began = time.process_time()
    assert M.sniff(make(4_000_000)) == []
    assert time.process_time() - began < 8
    assert M.sniff(make(4000) + png()) == [(len(make(4000)), len(png()), "image/png")]


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(1, 300), st.integers(0, 2**20), st.integers(0, 2**20))
def test_checksums_of_ranges(unit, times, a, b):
    data = unit * times
    a, b = sorted((a % (len(data) + 1), b % (len(data) + 1)))
    assert M.RangeCrc(data)(a, b) == zlib.crc32(data[a:b])


def wav_by_walking(d, at):
    """Length of a RIFF/WAVE file by reading its chunks one after another, or 0: the rules, without anything kept."""
    if d[at : at + 4] != b"RIFF" or d[at + 8 : at + 12] != b"WAVE" or len(d) - at < 44:
        return 0
    end = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    if end - at < 44 or end > len(d):
        return 0
    pos, seen = at + 12, []
    while pos + 8 <= end:
        n = int.from_bytes(d[pos + 4 : pos + 8], "little")
        name = d[pos : pos + 4]
        if name == b"fmt " and n >= 16:
            kind, channels, rate, per_s, align, bits = struct.unpack("<HHIIHH", d[pos + 8 : pos + 24])
            if kind == 0 or channels == 0 or align != channels * -(-bits // 8) or per_s != rate * align:
                return 0
        if name == b"data" and b"fmt " not in seen:
            return 0
        seen.append(name)
        pos += 8 + n + n % 2
    return end - at if pos in (end, end + 1) and b"fmt " in seen and b"data" in seen else 0


FORM = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
CHUNKS = [FORM, FORM[:10] + b"\0\0" + FORM[12:], b"fmt \x02\0\0\0ab", b"data\x04\0\0\0abcd", b"data\x03\0\0\0abc\0", b"junk\0\0\0\0", b"LIST\x05\0\0\0hello\0", b"junk\x40\0\0\0", b"x", b"RIFF"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(CHUNKS), max_size=6), st.integers(-9, 12)), min_size=1, max_size=4))
def test_wav_against_reading_chunk_after_chunk(files):
    data = b""
    for chunks, off in files:
        body = b"WAVE" + b"".join(chunks)
        data += b"RIFF" + struct.pack("<I", max(0, len(body) + off)) + body
    data += bytes(30)
    known = M.Marks(data)
    for at in range(len(data)):
        if data[at : at + 4] == b"RIFF":
            assert M._wav(data, at, known) == wav_by_walking(data, at)


def test_stored_values_have_media_around_the_payload(spark):
    texts = [f"%%EOF startxref %PDF-1.7 PK\x05\x06 number {i}" for i in range(64)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = M.digests(df).collect()
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == expected(texts[r.doc_id])
        stored = M.wrapped(texts[r.doc_id].encode())
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        parts = "+".join(f"{k}@{a}:{n}" for a, n, k in naive(stored))
        assert f";parts={parts};" in r.feature and sum(n for _, n, _ in naive(stored)) in (len(stored), len(stored) - 2)
    assert {p.split("@")[0] for r in rows for p in r.feature.split("parts=")[1].split(";")[0].split("+")} == {k for k, _ in M.FORMATS.values()}
