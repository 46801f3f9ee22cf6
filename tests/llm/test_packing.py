import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tokenizers

from ledgerloom.llm import common, packing
from ledgerloom.llm.queries import op11_packing

JSON = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, length int, part string"


def documents(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "naïve", "日本", "x9", "\n\n", "supercalifragilistic"]
    texts = [None, "", " ", "a", "word " * 40_000, "<|endoftext|> b"] + [" ".join(rng.choices(words, k=int(2 ** rng.uniform(0, 11)))) for _ in range(n)]
    rows = [(i, t, "clash", -1, "p") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, texts[8], "", 0, ""), (None, None, "", 0, "")]


def ids_of(texts):
    t = tokenizers.Tokenizer.from_file(JSON)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


@pytest.mark.parametrize("capacity,smallest", [(1024, 32), (1024, 1), (64, 8), (16, 4)])
def test_pieces_are_reciprocal_shares_and_tails(capacity, smallest):
    lengths = np.array([0, 1, 2, 31, 32, 33, 1023, 1024, 1025, 5000, *range(100, 140)])
    pieces, counts = packing.cut_lengths(lengths, capacity, smallest)
    at = 0
    for n, k in zip(lengths, counts, strict=True):
        own = pieces[at : at + k].tolist()
        at += k
        whole = n // capacity
        assert sum(own) == n and own == sorted(own, reverse=True) and own[:whole] == [capacity] * whole
        assert len(set(own[whole:])) == len(own[whole:]) and all(x & (x - 1) == 0 for x in own[:-1]) and all(x >= smallest or x == own[-1] for x in own)
    assert at == len(pieces)


def check(rows, got, capacity=1024, most_padding=0.03):
    """Every id once, in pieces that lie gapless in gapless sequences."""
    want = sorted(map(tuple, ids_of([r[1] for r in rows])))
    by_doc: dict = {}
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        assert r.length * 4 == len(r.ids) > 0
        by_doc.setdefault(r.doc_id, []).append(r)
    own: dict = {}
    for r, ids in zip(rows, ids_of([r[1] for r in rows]), strict=True):
        own.setdefault(r[0], []).append(ids)
    for doc_id, pieces in by_doc.items():
        total = sorted(i for ids in own[doc_id] for i in ids)
        assert sorted(np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist()) == total
        if len(own[doc_id]) == 1:
            assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == own[doc_id][0]
            assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()] and {p.doc_tokens for p in pieces} == {len(total)}
    assert by_doc.keys() == own.keys() and len(want) == len(rows)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= most_padding * sum(map(len, want))


@pytest.mark.parametrize("capacity,smallest,partitions", [(1024, 32, 7), (1024, 1, 3), (64, 8, 5)])
def test_packed(spark, capacity, smallest, partitions):
    rows = documents(1, 150)
    got = packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(partitions), JSON, 0, capacity, smallest).collect()
    check(rows, got, capacity, {32: 0.03, 8: 0.13, 1: 0}[smallest])


def test_classes_hold_a_fixed_count(spark):
    rows = [(i, "a", "", 0, "") for i in range(2000)]  # two ids each: 512 in a sequence
    got = packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(9), JSON, 0).collect()
    check(rows, got, most_padding=0)
    counts = np.bincount([r.sequence_id for r in got])
    assert (counts[:3] == 512).all() and sorted(counts[3:].tolist(), reverse=True) == [256, 128, 64, 16]


def test_sequences_hold_the_ids_of_their_pieces(spark):
    rows = documents(2, 60)
    pieces = common.written(packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(4), JSON, 0), "test-pieces")
    whole = {r.sequence_id: r for r in packing.sequences(pieces, pad_id=7).collect()}
    got = pieces.collect()
    for p in got:
        assert bytes(whole[p.sequence_id].ids)[p.offset * 4 : (p.offset + p.length) * 4] == bytes(p.ids)
    for r in whole.values():
        power = r.n_tokens & (r.n_tokens - 1) == 0
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == (r.n_tokens if power else 1024) and (ids[r.n_tokens :] == 7).all()
        assert [(x.doc_id, x.start, x.offset) for x in r.pieces] == sorted(((p.doc_id, p.start, p.offset) for p in got if p.sequence_id == r.sequence_id), key=lambda x: x[2])


def test_empty_table_and_wrong_parameters(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.packed(docs, JSON, 0).count() == 0 and packing.sequences(packing.packed(docs, JSON, 0)).count() == 0
    for capacity, smallest in ((1000, 32), (1024, 64), (1024, 3)):
        with pytest.raises(ValueError):
            packing.packed(docs, JSON, 0, capacity, smallest)


def test_op11(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = op11_packing(spark, d).orderBy("doc_id", "start").collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for r, ids in zip(rows, ids_of([r.text for r in rows]), strict=True):
        at = 0
        for p in by_doc[r.doc_id]:
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
