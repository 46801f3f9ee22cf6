import itertools
from types import SimpleNamespace

import public_tokenizers

from ledgerloom.llm import bpe, byte_bpe, common, language_id, ngram_join, substring_dedup
from tests.llm.test_pipeline import SF

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_an_encoder_goes_when_another_operator_begins(spark, monkeypatch):
    docs, tasks = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20"), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a: tasks.append(run) or plain(self, run, *a))
    language_id.identified(docs)
    ngram_join.representatives(docs, k=5, per_cent=80)
    substring_dedup.deduplicated(docs)
    others = tasks[:]
    tasks.clear()
    byte_bpe.encode_checked(docs, RANKS, public_tokenizers.PATTERN)
    assert len(others) >= 8 and len(tasks) == 1
    for task in others:
        list(tasks[0](iter([])))
        list(tasks[0](iter([])))  # the next task of the same operator finds it
        assert bpe.encoder_from_ranks.cache_info()[:2] >= (1, 1) and bpe.encoder_from_ranks.cache_info().currsize == 1
        list(task(iter([])))
        assert bpe.encoder_from_ranks.cache_info().currsize == 0


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 >> 20


def test_a_task_returns_free_memory():
    held = []

    def run(rows):
        yield from rows
        parts = [bytearray(100_000) for _ in range(3000)]
        held.append(parts[-1])  # above the 300 MB that become free

    before = resident()
    task = common.mapped(SimpleNamespace(mapInArrow=lambda f, schema: f), run, None)
    assert list(task(iter([1, 2]))) == [1, 2]
    assert resident() < before + 150


def test_few_kept_segments_give_the_same_ids():
    tokenizer = bpe.tokenizer_from_ranks(RANKS, public_tokenizers.PATTERN)
    small, large = bpe.Encoder(tokenizer, keep=4), bpe.Encoder(tokenizer)
    # More different segments in one call than a table for 4 of them has slots.
    texts = [" ".join(map("".join, itertools.product("abcde", repeat=n))) for n in (2, 3, 4)] + [None, "", "a b a b", "an even longer segment-than-short-ones"]
    for part in (texts, texts[:1], texts[::-1]):
        (a, at), (b, bt) = small.encode(part), large.encode(part)
        assert a.tolist() == b.tolist() and at.tolist() == bt.tolist()
        assert a.tolist() == [i for t in part for i in tokenizer.encode(t or "", add_special_tokens=False).ids]


def test_checked_encoding_with_few_kept_segments(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few, many = (byte_bpe.encode_checked(docs, RANKS, public_tokenizers.PATTERN, **x) for x in ({"keep": 100}, {}))
    assert few.exceptAll(many).count() == many.exceptAll(few).count() == 0
