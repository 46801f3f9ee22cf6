"""Media columns: what a binary value is, told by its bytes.

An Aho-Corasick automaton over the magic bytes of all formats finds every place where a medium may start. A validator of
the format then reads its structure and lengths from there: only what it confirms counts. A value whose confirmed
medium starts at its first byte has that type, whatever was declared. Confirmed media that start later, and are not part of
another, are carved: their place, length and type are told.

Marks and chains of chunks that validators need are found once for a value, and checksums of ranges come from those of what is before them, so
a value of many magic bytes takes time in proportion to its length, times its logarithm. Very long values need memory for themselves.

Null values are empty. A value without confirmed medium has type `application/octet-stream`. Equal values give equal
results; repeated rows stay. All other columns are kept; columns named as an added one are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import io
import math
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ledgerloom.llm import common

UNKNOWN = "application/octet-stream"
#: Alignment of a stored payload, and the side of a stored image's rows.
ALIGN = 64


def _wav(d: bytes, at: int, known: Marks) -> int:
    """Length of a RIFF/WAVE file with a format chunk before its data, or 0."""
    if len(d) - at < 44 or d[at + 8 : at + 12] != b"WAVE":
        return 0
    size = struct.unpack_from("<I", d, at + 4)[0] + 8
    end = at + size
    if size < 44 or end > len(d):
        return 0
    bad, form, data = known.chunks.first(at + 12)
    last = known.chunks.after(at + 12, end - 8)  # where the chunks that lie in the file end
    return size if last in (end, end + 1) and bad >= last and form < data < last else 0


def _bmp(d: bytes, at: int, known: Marks) -> int:
    """Length of a bitmap with 8, 24 or 32 bits a pixel, uncompressed, or 0."""
    if len(d) - at < 54:
        return 0
    size, _, start, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", d, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    good = header == 40 and planes == 1 and bits in (8, 24, 32) and not packed and width > 0 and height and start >= 54
    return size if good and size == start + row * abs(height) and at + size <= len(d) else 0


def _png(d: bytes, at: int, known: Marks) -> int:
    """Length of a PNG file whose chunks all have right checksums, or 0."""

    def chunk(pos: int) -> tuple[bytes, int]:
        """Name and end of a whole chunk with a right checksum; no name for another."""
        if pos + 12 > len(d):
            return b"", 0
        n, name = struct.unpack_from(">I4s", d, pos)
        end = pos + 12 + n
        return (name, end) if end <= len(d) and known.crc(pos + 4, end - 4) == struct.unpack_from(">I", d, end - 4)[0] else (b"", 0)

    name, pos = chunk(at + 8)
    if name != b"IHDR" or pos != at + 33:
        return 0
    tried, end = [], 0
    while pos not in known.png_ends:
        tried.append(pos)
        name, after = chunk(pos)
        if name in (b"", b"IHDR", b"IEND"):
            end = after if name == b"IEND" and after == pos + 12 else 0
            break
        pos = after
    else:
        end = known.png_ends[pos]
    known.png_ends.update(dict.fromkeys(tried, end))
    return end - at if end else 0


def _gif(d: bytes, at: int, known: Marks) -> int:
    """Length of a GIF file by its blocks, or 0."""
    if len(d) - at < 14:
        return 0
    flags = d[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        met = []
        while p < len(d) and d[p] and p not in known.block_ends:
            met.append(p)
            p += d[p] + 1
        end = known.block_ends.get(p, p + 1)
        known.block_ends.update(dict.fromkeys(met, end))
        return end

    tried = []
    while pos < len(d) and pos not in known.no_gif:
        tried.append(pos)
        if d[pos] == 0x3B:
            return pos + 1 - at
        if d[pos] == 0x21:
            pos = blocks(pos + 2)
        elif d[pos] == 0x2C and pos + 10 < len(d):
            own = d[pos + 9]
            pos = blocks(pos + 11 + (3 << ((own & 7) + 1) if own & 0x80 else 0))
        else:
            break
    known.no_gif.update(tried)
    return 0


def _jpeg(d: bytes, at: int, known: Marks) -> int:
    """Length of a JPEG file by its segments, or 0."""
    pos, scanned, tried = at + 2, False, []
    while pos + 2 <= len(d) and d[pos] == 0xFF and (pos, scanned) not in known.no_jpeg:
        tried.append((pos, scanned))
        mark = d[pos + 1]
        if mark == 0xD9 and scanned:
            return pos + 2 - at
        if mark in (0, 0x01, 0xD9, 0xFF) or 0xD0 <= mark <= 0xD8 or pos + 4 > len(d):
            break
        pos += 2 + struct.unpack_from(">H", d, pos + 2)[0]
        if mark == 0xDA:
            scanned = True
            while (pos := d.find(b"\xff", pos)) >= 0 and pos + 1 < len(d) and (d[pos + 1] == 0 or 0xD0 <= d[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0 or pos + 1 >= len(d):
                break
    known.no_jpeg.update(tried)
    return 0


def _zip(d: bytes, at: int, known: Marks) -> int:
    """Length of an archive to the first end record that points back to this start, or 0."""
    return known.archives.get(at, at) - at


def _pdf(d: bytes, at: int, known: Marks) -> int:
    """Length of a document to its last end mark, after a cross-reference pointer and before the next document, or 0."""
    heads, ends, pointers = known.heads, known.ends, known.pointers
    after = lambda places, x: places[i] if (i := bisect.bisect_left(places, x)) < len(places) else -1
    before = lambda places, x: places[i] if (i := bisect.bisect_left(places, x) - 1) >= 0 else -1
    if not d[at + 5 : at + 6].isdigit() or not ends or ends[-1] < at:
        return 0
    pointer = before(pointers, ends[-1])
    first = after(ends, after(pointers, at))
    if pointer <= at or first < 0:
        return 0
    i = bisect.bisect_left(heads, first)
    while i < len(heads) and heads[i] < pointer:
        opened = before(known.streams, heads[i])
        attached = opened >= first and d[opened - 3 : opened] != b"end"  # in a stream of this document
        if d[heads[i] + 5 : heads[i] + 6].isdigit() and not attached:
            return before(ends, heads[i]) + 5 - at
        i += 1
    return ends[-1] + 5 - at


class Chunks:
    """Chains of RIFF chunks: where each leads depends on its place alone, so chains are trees that grow together. Every place is read once.

    Each place keeps the next one and a place farther on, chosen so that any place of its chain is found in steps as the logarithm of its length.
    """

    def __init__(self, data: bytes):
        self.data = data
        self.next: dict[int, int] = {}
        self.far: dict[int, int] = {}
        self.depth: dict[int, int] = {}
        self.firsts: dict[int, tuple[float, float, float]] = {}

    def _follow(self, pos: int) -> None:
        d, new = self.data, []
        while pos not in self.depth and pos + 8 <= len(d):
            new.append(pos)
            n = struct.unpack_from("<I", d, pos + 4)[0]
            pos += 8 + n + (n & 1)
        if pos not in self.depth:  # behind the last whole head of a chunk
            self.next[pos] = self.far[pos] = pos
            self.depth[pos], self.firsts[pos] = 0, (math.inf,) * 3
        for place in reversed(new):
            far = self.far[pos]
            even = self.depth[pos] - self.depth[far] == self.depth[far] - self.depth[self.far[far]]
            self.next[place], self.far[place], self.depth[place] = pos, self.far[far] if even else pos, self.depth[pos] + 1
            bad, form, data = self.firsts[pos]
            name = d[place : place + 4]
            if name == b"fmt ":
                form, bad = place, bad if self._good_format(place) else place
            self.firsts[place] = bad, form, place if name == b"data" else data
            pos = place

    def _good_format(self, place: int) -> bool:
        if struct.unpack_from("<I", self.data, place + 4)[0] < 16:
            return True  # too short to be read; not an error by itself
        if place + 24 > len(self.data):
            return False
        kind, channels, rate, per_s, align, bits = struct.unpack_from("<HHIIHH", self.data, place + 8)
        return bool(kind and channels and per_s == rate * align and align == channels * ((bits + 7) // 8))

    def first(self, pos: int) -> tuple[float, float, float]:
        """The first bad format chunk, format chunk and data chunk of the chain from pos."""
        if pos not in self.depth:
            self._follow(pos)
        return self.firsts[pos]

    def after(self, pos: int, limit: int) -> int:
        """The first place of the chain from pos that is greater than limit, or its last."""
        while pos <= limit and self.next[pos] != pos:
            pos = self.far[pos] if self.far[pos] <= limit else self.next[pos]
        return pos


class RangeCrc:
    """CRC-32 of any range of a value, in a time that does not grow with the range: from checksums of all that comes before its ends."""

    STEP = 1 << 12
    POLY = 0xEDB88320

    def __init__(self, data: bytes):
        self.data, self.view, self.before = data, memoryview(data), [0]

    def _until(self, at: int) -> int:
        """Checksum of the first at bytes."""
        while len(self.before) <= at // self.STEP:
            n = len(self.before)
            self.before.append(zlib.crc32(self.view[(n - 1) * self.STEP : n * self.STEP], self.before[-1]))
        whole = at // self.STEP
        return zlib.crc32(self.view[whole * self.STEP : at], self.before[whole])

    @classmethod
    def _times(cls, a: int, b: int) -> int:
        """The product of two polynomials over bits modulo the checksum's; the highest power is the lowest bit."""
        out = 0
        for i in range(31, -1, -1):
            if a >> i & 1:
                out ^= b
            b = b >> 1 ^ (cls.POLY if b & 1 else 0)
        return out

    @classmethod
    @functools.lru_cache(maxsize=2048)
    def _zeros(cls, i: int, digit: int) -> int:
        """What digit * 256 ** i bytes of 0 multiply a checksum by."""
        if digit == 0:
            return 1 << 31
        one = 1 << 23 if i == 0 else cls._times(cls._zeros(i - 1, 255), cls._zeros(i - 1, 1))
        return one if digit == 1 else cls._times(one, cls._zeros(i, digit - 1))

    def __call__(self, a: int, b: int) -> int:
        if b - a <= 2 * self.STEP:
            return zlib.crc32(self.view[a:b])
        start, n, i = self._until(a), b - a, 0
        while n:
            if n & 255:
                start = self._times(self._zeros(i, n & 255), start)
            n, i = n >> 8, i + 1
        return self._until(b) ^ start


class Marks:
    """What the validators look up in a value, found once: places of marks, the archives' ends by their starts, chains of RIFF chunks, places from which a chain of blocks fails, and where chains of PNG chunks and of a GIF's sub-blocks end."""

    def __init__(self, data: bytes):
        self.data, self.no_gif, self.no_jpeg = data, set(), set()
        self.block_ends: dict[int, int] = {}
        self.png_ends: dict[int, int] = {}
        self.chunks, self.crc = Chunks(data), RangeCrc(data)

    def _all(self, mark: bytes) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(mark), self.data)]

    @functools.cached_property
    def heads(self) -> list[int]:
        return self._all(b"%PDF-")

    @functools.cached_property
    def ends(self) -> list[int]:
        return self._all(b"%%EOF")

    @functools.cached_property
    def pointers(self) -> list[int]:
        return self._all(b"startxref")

    @functools.cached_property
    def streams(self) -> list[int]:
        return self._all(b"stream")

    @functools.cached_property
    def archives(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for p in self._all(b"PK\x05\x06"):
            if p + 22 <= len(self.data):
                size, where, note = struct.unpack_from("<IIH", self.data, p + 12)
                if p + 22 + note <= len(self.data):
                    out.setdefault(p - size - where, p + 22 + note)
        return out


#: Magic bytes, media type and validator of each format. The magic bytes are fixed values.
FORMATS: dict[bytes, tuple[str, Callable[[bytes, int, Marks], int]]] = {
    b"RIFF": ("audio/wav", _wav),
    b"BM": ("image/bmp", _bmp),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"PK\x03\x04": ("application/zip", _zip),
    b"%PDF-": ("application/pdf", _pdf),
}


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in FORMATS:
        a.add_word(magic.decode("latin-1"), (len(magic), magic))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """Start, length and type of the outermost confirmed media, in order."""
    known, found, reached = Marks(data), [], 0
    for last, (n, magic) in _automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        if at < reached:
            continue
        kind, length = FORMATS[magic]
        if size := length(data, at, known):
            found.append((at, size, kind))
            reached = at + size
    return found


def padded(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of ALIGN."""
    return raw + bytes(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def to_bmp(payload: bytes) -> bytes:
    """A grey image of 8 bits a pixel and rows of ALIGN pixels, the first row on top."""
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(palette)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(payload), 0, start, 40, ALIGN, -(len(payload) // ALIGN), 1, 8, 0, len(payload), 2835, 2835, 256, 0) + palette + payload


def samples(data: bytes, kind: str) -> bytes:
    """The 8-bit samples of a stored medium, from its own headers."""
    if kind == "audio/wav":
        pos = 12
        while data[pos : pos + 4] != b"data":
            n = struct.unpack_from("<I", data, pos + 4)[0]
            pos += 8 + n + (n & 1)
        n = struct.unpack_from("<I", data, pos + 4)[0]
        return data[pos + 8 : pos + 8 + n]
    if kind == "image/bmp":
        start, _, width, height = struct.unpack_from("<IIii", data, 10)
        rows = [data[start + i * width : start + (i + 1) * width] for i in range(abs(height))] if height > 0 else None
        return data[start : start + width * -height] if rows is None else b"".join(reversed(rows))
    raise ValueError(f"no 8-bit samples in {kind}")


@functools.lru_cache(maxsize=1)
def companions() -> tuple[list[bytes], list[bytes]]:
    """Small media to stand before and behind another: what each has before it ends by itself."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\x80")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes((0, 0, 0, 255, 255, 255)) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    segment = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    table = lambda kind: segment(0xC4, bytes([kind, 1, *[0] * 15, 0]))  # noqa: E731  one code, for symbol 0
    jpeg = b"\xff\xd8" + segment(0xDB, bytes([0, *[1] * 64])) + segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 8, 1, 1, 0x11, 0)) + table(0) + table(0x10) + segment(0xDA, bytes((1, 1, 0, 0, 63, 0))) + b"\x3f\xff\xd9"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr(zipfile.ZipInfo("note.txt"), b"note")
    pdf, places = b"%PDF-1.4\n", []
    for no, body in enumerate((b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/Count 0>>"), 1):
        places.append(len(pdf))
        pdf += b"%d 0 obj%sendobj\n" % (no, body)
    pdf += b"xref\n0 3\n0000000000 65535 f \n%s" % b"".join(b"%010d 00000 n \n" % x for x in places) + b"trailer<</Size 3/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % pdf.rindex(b"endobj")
    return [b"", png, gif, jpeg], [b"", held.getvalue(), pdf, png + b"--" + jpeg]


def wrapped(raw: bytes) -> bytes:
    """A stored value of raw: its padded bytes as a sound or an image, by its checksum alone between other media or none."""
    code = zlib.crc32(raw)
    before, behind = companions()
    return before[code >> 1 & 3] + (to_bmp if code & 1 else to_wav)(padded(raw)) + behind[code >> 3 & 3]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared_type and media: each text's bytes, padded and stored losslessly as 8-bit samples, in a value with other media around them.

    The declared type is always that of sound, as from a careless source.
    """
    common.ship(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for at in range(0, len(raw), 256):
                part = raw[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), pa.array([len(x) for x in part], pa.int64()), pa.array(["audio/wav"] * len(part)), pa.array(list(map(wrapped, part)), pa.binary())],
                    names=["doc_id", "n_bytes", "declared_type", "media"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, declared_type string, media binary")


def sniffed(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds media_type, media_size (of the medium at the first byte, else null) and carved, the media further on."""
    common.ship(media.sparkSession)
    names = ["media_type", "media_size", "carved"]
    kept = media.drop(*names)
    item = pa.struct([("start", pa.int64()), ("size", pa.int64()), ("media_type", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [sniff(x or b"") for x in batch.column(column).to_pylist()]
            own = [x[0] if x and x[0][0] == 0 else None for x in found]
            carved = [[dict(zip(("start", "size", "media_type"), y, strict=True)) for y in x if y[0]] for x in found]
            new = [pa.array([x[2] if x else UNKNOWN for x in own]), pa.array([x and x[1] for x in own], pa.int64()), pa.array(carved, pa.list_(item))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    added = "media_type string, media_size long, carved array<struct<start:long,size:long,media_type:string>>"
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(added).fields]))


SAMPLED = ("audio/wav", "image/bmp")


def digests(docs: DataFrame) -> DataFrame:
    """Stores each text, sniffs the stored bytes and reads the payload back from the one medium with 8-bit samples that was found, at the first byte or carved."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in rows:
            out = []
            for data, kind, declared, size, carved in zip(*(batch.column(c).to_pylist() for c in ("media", "media_type", "declared_type", "media_size", "carved")), strict=True):
                found = [(0, size, kind), *((x["start"], x["size"], x["media_type"]) for x in carved)]
                at, n, own = next(x for x in found if x[2] in SAMPLED)
                payload = samples(data[at : at + n], own)
                parts = "+".join(f"{k}@{a}:{m}" for a, m, k in found)
                feature = f"{kind};declared={declared};corrected={str(kind != declared).lower()};payload={own};parts={parts};mean={sum(payload) / len(payload):.3f}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return sniffed(store(docs)).mapInArrow(run, schema)
