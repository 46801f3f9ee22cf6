"""Byte-level BPE of many texts with the tokenizers library, word by word.

A cut before a single space that a non-space follows is always a cut between two matches of the tokenizer's pattern,
so a text can be encoded as its segments between such cuts. Segments repeat, so each worker keeps the ids of those
that it has seen, up to a limit, and asks the library for new ones only, many at a time. A segment is found again by its
own bytes, never by a hash alone. A text that holds the string of
one of the tokenizer's added tokens is encoded whole: the library parts such a text at those first.

Null and empty texts have no ids. Very long texts are encoded in pieces that end at cuts. Repeated texts and empty
batches are ordinary; rows and columns are the callers' matter.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

from ledgerloom.llm import common

_CUT = re.compile(r" (?=\S)")
#: Bytes before which a space is cut off: not white space, nor the first byte of white space outside ASCII.
_CUT_BEFORE = np.ones(256, bool)
_CUT_BEFORE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Bytes of a segment that fit into the two numbers of its key, beside its length.
SHORT = 15
#: Segments kept by a worker.
KEEP = 1_000_000
#: Characters in a piece of a very long text.
LONG = 1 << 20


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the library's byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        out[i] = t
    return out


def _quiet() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def tokenizer_from_file(path: str):
    _quiet()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_from_ranks(path: str, pattern: str):
    """The library's BPE over a file of ranks.

    Ranks rule by the merged bytes alone, so each split of a token into two others is a merge, in order of the
    token's rank; a match that is itself a token stays whole.
    """
    _quiet()
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    t = Tokenizer(models.BPE(vocab={name[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return t


def _keys(raw: np.ndarray, a: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the length of segments of at most SHORT bytes as two numbers each: equal for equal segments only."""
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    eights = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    kept = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
    first = eights[a] & kept[np.minimum(size, 8)]
    second = eights[a + 8] & kept[np.clip(size - 8, 0, 8)]
    return first, second | size.astype(np.uint64) << np.uint64(56)


class Encoder:
    """Ids of texts. Keeps the ids of the segments that it has seen: short ones in a table by their bytes as numbers, longer ones in a dictionary."""

    def __init__(self, tokenizer, keep: int = KEEP):
        self.tokenizer, self.keep = tokenizer, keep
        vocabulary = tokenizer.get_vocab()
        self.vocabulary = tokenizer.get_vocab_size()
        self.added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a character for each byte
        self._forget()

    def _forget(self, coming: int = 0) -> None:
        """Empties the tables; they have room for so many segments at once, even if those are more than are kept."""
        slots = 1 << (max(3 * self.keep, 2 * coming) - 1).bit_length()
        self.slot_place = np.full(slots, -1, np.int32)
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # the key of each segment, zeros for a longer one
        self.longer: dict[bytes, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Encodes new segments, each with its leading space, one behind another as one text, and parts the ids where their bytes end."""
        step = 20_000
        pools, sizes = [self.pool], [self.sizes]
        for at in range(0, len(a), step):
            x, n = a[at : at + step], (b - a)[at : at + step]
            ends = np.cumsum(n)
            joined = raw[np.repeat(x - (ends - n), n) + np.arange(ends[-1])].tobytes().decode()
            ids = self._ids([joined])[0]
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            pools.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        self.pool, self.sizes = np.concatenate(pools), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _places(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each segment among those that are kept; new ones are encoded first."""
        size = b - a
        place = np.empty(len(a), np.int64)
        short = np.flatnonzero(size <= SHORT)
        first, second = _keys(raw, a[short], size[short])
        found = self._find(first, second)
        known, at_a, at_b = len(self.sizes), [], []
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((second[new], first[new]))]
            other = np.ones(len(order), bool)
            other[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            found[order] = known + np.cumsum(other) - 1
            one = order[other]
            at_a.append(a[short[one]])
            at_b.append(b[short[one]])
            self.first, self.second = np.concatenate((self.first, first[one])), np.concatenate((self.second, second[one]))
            self._insert(np.arange(known, known + len(one)))
        place[short] = found
        data, tail_a, tail_b = raw.tobytes() if len(short) < len(a) else b"", [], []
        for i in np.flatnonzero(size > SHORT):
            segment = data[a[i] : b[i]]
            at = self.longer.get(segment)
            if at is None:
                at = self.longer[segment] = len(self.first) + len(tail_a)
                tail_a.append(a[i])
                tail_b.append(b[i])
            place[i] = at
        if tail_a:
            self.first, self.second = (np.concatenate((x, np.zeros(len(tail_a), np.uint64))) for x in (self.first, self.second))
            at_a.append(np.array(tail_a, np.int64))
            at_b.append(np.array(tail_b, np.int64))
        if at_a:
            self._learn(raw, np.concatenate(at_a), np.concatenate(at_b))
        return place

    def _long(self, text: str) -> np.ndarray:
        """A very long text, encoded in pieces."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + LONG)
            end = cut.start() if cut else len(text)
            out += self._ids([text[at:end]])
            at = end
        return np.concatenate(out)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin, and the end."""
        own = {i: self._ids([t])[0] for i, t in enumerate(texts) if t and any(x in t for x in self.added)}
        own |= {i: self._long(t) for i, t in enumerate(texts) if t and len(t) > 4 * LONG and i not in own}
        data = [t.encode() if t and i not in own else b"" for i, t in enumerate(texts)]
        lengths = np.array([len(x) for x in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        text_at = np.cumsum(lengths) - lengths
        full = lengths > 0
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 1:
            cut[:-2] = (raw[:-1] == 32) & _CUT_BEFORE[raw[1:]]
        cut[(text_at + lengths)[full] - 1] = False  # a space that ends a text: the next byte is another text's
        cut[text_at[full]] = True
        is_head = np.zeros(len(raw) + 1, bool)
        is_head[text_at[full]] = True
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(raw))[: len(a)]
        head = is_head[a]
        if max(len(self.sizes) + len(a), len(self.pool) // 8) > 2 * self.keep:
            self._forget(len(a))
        ra, rb = a[~head], b[~head]
        place = self._places(raw, ra, rb)
        heads = self._ids([raw[x:y].tobytes().decode() for x, y in zip(a[head], b[head], strict=True)])
        pool = np.concatenate([self.pool, *heads])  # heads lie behind the pool, for this call only
        starts, sizes = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        starts[~head], sizes[~head] = self.starts[place], self.sizes[place]
        sizes[head] = [len(x) for x in heads]
        starts[head] = len(self.pool) + np.cumsum(sizes[head]) - sizes[head]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = pool[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[np.append(np.searchsorted(a, text_at), len(a))]
        if own:
            parts = [own.get(i, flat[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return flat, bounds

    def _slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first * np.uint64(0xD6E8FEB86659FD93) ^ second) * np.uint64(0x94D049BB133111EB)
        return ((mixed ^ mixed >> np.uint64(29)) & np.uint64(len(self.slot_place) - 1)).astype(np.int64)

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places of short segments in the open-addressed table, -1 for new ones."""
        out, left, mask = np.full(len(first), -1, np.int64), np.arange(len(first)), len(self.slot_place) - 1
        slot = self._slots(first, second)
        while len(left):
            place = self.slot_place[slot]
            there = place >= 0
            slot, left, place = slot[there], left[there], place[there]
            same = (self.first[place] == first[left]) & (self.second[place] == second[left])
            out[left[same]] = place[same]
            left, slot = left[~same], (slot[~same] + 1) & mask
        return out

    def _insert(self, place: np.ndarray) -> None:
        mask = len(self.slot_place) - 1
        slot = self._slots(self.first[place], self.second[place])
        while len(place):
            free = self.slot_place[slot] < 0
            self.slot_place[slot[free]] = place[free]
            mine = self.slot_place[slot] == place
            place, slot = place[~mine], (slot[~mine] + 1) & mask


@common.kept_by_worker
def encoder_from_file(path: str) -> Encoder:
    """One for each worker process: tasks of the same operator that follow find the segments it has seen."""
    return Encoder(tokenizer_from_file(path))


@common.kept_by_worker
def encoder_from_ranks(path: str, pattern: str, keep: int = KEEP) -> Encoder:
    return Encoder(tokenizer_from_ranks(path, pattern), keep)


def batches(texts: list[str | None], size: int = 4 << 20):
    """Slices of texts of about so many characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield start, texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
