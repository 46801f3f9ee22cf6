import base64
import hashlib
import re

import public_tokenizers
import pytest

import corpus_pipeline as P
from ledgerloom.llm import language_id, mixing
from tests.llm.test_ngram_join import sets_of, union_find
from tests.llm.test_substring_dedup import brute as repeated_lines
from tests.llm.test_substring_dedup import words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, every stage fed with what the one before has written."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.collect()}
    columns = docs.columns
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        out[name] = docs.collect()
    return out


def names():
    return ["documents", *(n for n, _ in P.STAGES)]


def test_language_stage(spark, stages):
    before, after = (stages[n] for n in names()[:2])
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    want = [r.doc_id for r, p in zip(before, language_id.mixtures([r.text for r in before], model), strict=True) if p.any() and p.max() >= P.LEAST_SHARE]
    assert sorted(r.doc_id for r in after) == sorted(want)
    assert len(after) >= 0.9 * len(before)


def test_near_copies_stage(stages):
    before, after = (stages[n] for n in names()[1:3])
    sets = [sets_of(r.text, P.SHINGLE) for r in before]
    pairs = [(x, y) for x in range(len(sets)) for y in range(x) if sets[x] and 100 * len(sets[x] & sets[y]) >= P.NEAR * len(sets[x] | sets[y])]
    lead = {}
    for n, c in union_find(pairs, range(len(sets))).items():
        lead[c] = min(lead.get(c, before[n].doc_id), before[n].doc_id)
    assert sorted(r.doc_id for r in after) == sorted(lead.values())
    texts = {r.doc_id: r for r in before}
    assert all(texts[r.doc_id] == r for r in after)


def test_repeated_passages_stage(stages):
    before, after = (stages[n] for n in names()[2:4])
    gone = repeated_lines([(r.doc_id, r.text) for r in before])
    left = {r.doc_id: r for r in after}
    for r in before:
        n = sum(d == r.doc_id for d, _ in gone)
        kept = left.get(r.doc_id)
        assert len(words_of(kept and kept.text)) <= len(words_of(r.text)) - n
        assert kept is None or kept.n_chars == len(kept.text)
    assert sum(left[r.doc_id].text == r.text for r in before if r.doc_id in left) >= 0.7 * len(before)


def test_mixing_stage(spark, stages):
    before, after = (stages[n] for n in names()[3:5])
    size = {r.doc_id: len(re.findall(mixing.WORD, r.text)) for r in before}
    taken = {}
    for r in after:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= P.MOST and set(taken) <= set(size)
    plan = {r.source: r.target for r in mixing.mix(spark.createDataFrame(before), P.WEIGHTS, P.MOST).select("source", "target").distinct().collect()}
    for source, target in plan.items():
        words = sum(size[r.doc_id] for r in after if r.source == source)
        own = [size[r.doc_id] for r in before if r.source == source]
        assert abs(words - target) <= max(own)


def test_token_stage(stages):
    before, after = (stages[n] for n in names()[4:])
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    decoded = sorted((r.doc_id, hashlib.sha256(b"".join(table[i] for i in r.ids)).hexdigest()) for r in after)
    assert decoded == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "12 34", None, None, 5), (None, "the and of that with", "en", None, 20), (3, "the and of that with", "en", "a", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    full = docs
    for docs in (full, full.where("false")):
        df = docs
        for _, stage in P.STAGES:
            df = spark.createDataFrame(stage(spark, df, SF).collect(), stage(spark, df, SF).schema)
        # Of the texts with letters one stays, that with a doc_id; as the only one of the only source it is taken once.
        assert [(r.doc_id, r.lang, r.source, r.round_trip) for r in df.collect()] == ([(3, "en", "a", True)] if docs is full else [])


def test_columns_named_as_the_operators_own(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    clash = ("score", "held_out", "lang_pred", "languages", "component_id", "group", "sig", "size", "copies", "taken", "no", "lines", "start", "end", "node")
    first = docs.selectExpr("*", *(f"concat('mine ', doc_id) AS `{c}`" for c in clash))
    rows = first
    for name, stage in P.STAGES[:-1]:
        rows = P.common.written(stage(spark, rows, SF), "test-stage")
        assert rows.schema[len(docs.columns) :] == first.schema[len(docs.columns) :], name
        assert rows.columns == first.columns
    got = rows.collect()
    assert len(got) > 20 and all(r[c] == f"mine {r.doc_id}" for r in got for c in clash)
