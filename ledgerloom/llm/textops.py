"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than ASCII white space, A-Z lower-cased. Its hash takes eight bytes after the other, each
mixed nonlinearly with what came before, so that no pattern of letters cancels out; a long word is hashed by BLAKE2.
Two different words, or shingles, share a hash with probability about 2**-64.

Null texts have no words. Very long texts are taken in blocks that end at white space. Columns and rows are the callers' matter.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
#: Bytes that are hashed in one go, and the longest word that is hashed together with others.
BLOCK, LONG_WORD = 1 << 20, 64
_KEPT = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of at most BLOCK bytes."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(IS_SPACE[raw].astype(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    lower = np.concatenate((_LOWER[raw], np.zeros(8, np.uint8)))
    eights = np.ndarray((len(raw) + 1,), "<u8", lower, strides=(1,))  # the eight bytes from each byte on
    size = ends - starts
    h = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(1))
    left = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(left):
        h[left] = mix((h[left] ^ (eights[starts[left] + at] & _KEPT[np.minimum(size[left] - at, 8)])) * U(0x9FB21C651E98DF25) + U(0xD6E8FEB86659FD93))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = _long_word(lower[starts[i] : ends[i]].tobytes())
    return h, starts, ends


def _long_word(lower: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(lower, digest_size=8).digest(), "little")


def _cuts(data: bytes) -> list[tuple[int, int, bool]]:
    """Spans of at most BLOCK bytes that end at white space, and longer words alone."""
    out, at = [], 0
    while len(data) - at > BLOCK:
        end = max(data.rfind(bytes([c]), at, at + BLOCK) for c in SPACES)
        if end > at:
            out.append((at, end, False))
            at = end
        elif end == at:
            at += 1
        else:
            ends = [e for c in SPACES if (e := data.find(bytes([c]), at + BLOCK)) >= 0]
            end = min(ends, default=len(data))
            out.append((at, end, True))
            at = end
    out.append((at, len(data), len(data) - at > BLOCK))
    return out


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts, in order: hash, number of the text, and first and last-plus-one byte in its UTF-8."""
    hashes, owner, first, last = [], [], [], []
    group: list[bytes] = []
    offsets: list[int] = []
    size = start_no = 0

    def flush(next_no: int) -> None:
        nonlocal group, offsets, size, start_no
        if group:
            h, s, e = _block(b" ".join(group))
            at = np.asarray(offsets)
            no = np.searchsorted(at, s, "right") - 1
            hashes.append(h)
            owner.append(no + start_no)
            first.append(s - at[no])
            last.append(e - at[no])
        group, offsets, size, start_no = [], [], 0, next_no

    for no, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if len(data) >= BLOCK:
            flush(no)
            for a, b, is_word in _cuts(data):
                if is_word:
                    h, s, e = np.array([_long_word(data[a:b].translate(_LOWER.tobytes()))], np.uint64), np.array([0]), np.array([b - a])
                else:
                    h, s, e = _block(data[a:b])
                hashes.append(h)
                owner.append(np.full(len(h), no))
                first.append(s + a)
                last.append(e + a)
            start_no = no + 1
            continue
        if size + len(data) + 1 > BLOCK:
            flush(no)
        offsets.append(size)
        group.append(data)
        size += len(data) + 1
    flush(len(texts))
    if not hashes:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(hashes), np.concatenate(owner), np.concatenate(first), np.concatenate(last)


def fold(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbours; k - 1 fewer than h has."""
    n = len(h) - k + 1
    out = h[:n] if n > 0 else h[:0]
    for j in range(1, k if n > 0 else 1):
        out = mix(out * U(0x9FB21C651E98DF25) + h[j : j + n] + U(j))
    return out


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: the number of the text and the hash, sorted by both.

    A text of 1 to k - 1 words has one shingle, its whole sequence; a text without words has none.
    """
    h, owner, _, _ = words(texts)
    counts = np.bincount(owner, minlength=len(texts))
    at = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    s = fold(h, k)
    whole = owner[: len(s)] == owner[k - 1 :] if len(s) else np.zeros(0, bool)
    nos, out = [owner[: len(s)][whole]], [s[whole]]
    for c in range(1, k):
        few = np.flatnonzero(counts == c)
        if len(few):
            x = h[at[few]]
            for j in range(1, c):
                x = mix(x * U(0x9FB21C651E98DF25) + h[at[few] + j] + U(j))
            nos.append(few)
            out.append(mix(x ^ U(c * 0x51ED2701)))
    no, x = np.concatenate(nos), np.concatenate(out)
    order = np.lexsort((x, no))
    no, x = no[order], x[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (no[1:] != no[:-1]) | (x[1:] != x[:-1])
    return no[keep], x[keep]
