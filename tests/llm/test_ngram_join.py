import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import ngram_join as N
from ledgerloom.llm import textops
from ledgerloom.llm.components import components
from ledgerloom.llm.queries import op10_ngram_join


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sets_of(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, k=4, per_cent=85):
    """rows: (doc_id, text) with doc_id not null. All pairs by themselves."""
    sets = [(i, sets_of(t, k)) for i, t in rows]
    pairs = [(x, y) for x, (_, a) in enumerate(sets) for y, (_, b) in enumerate(sets[:x]) if 100 * len(a & b) >= per_cent * len(a | b) and a and b]
    comp = union_find(pairs, range(len(rows)))
    low = {}
    for n, c in comp.items():
        low[c] = min(low.get(c, rows[n][0]), rows[n][0])
    return sorted((rows[n][0], len(sets[n][1]), low[comp[n]]) for n in range(len(rows)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x1c 日", max_size=60)), max_size=8), st.integers(1, 5))
def test_shingles_of_any_text(texts, k):
    no, x = textops.shingle_sets(texts, k)
    assert np.bincount(no, minlength=len(texts)).tolist() == [len(sets_of(t, k)) for t in texts]
    assert len(set(x.tolist())) == len(set().union(*(sets_of(t, k) for t in texts)))


def test_long_texts_and_words(monkeypatch):
    monkeypatch.setattr(textops, "BLOCK", 64)
    texts = ["ab cd " * 50 + "x" * 500 + " ab cd", "x" * 500, "x" * 499 + "y", "", "Ab", " " * 200 + "ab"]
    h, no, a, b = textops.words(texts)
    got = [(int(n), texts[n].encode()[i:j].lower()) for n, i, j in zip(no, a, b, strict=True)]
    assert got == [(n, w.encode()) for n, t in enumerate(texts) for w in words_of(t)]
    by = {}
    for (_, w), x in zip(got, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice("pqrstuv") * rng.randint(1, 4)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows, vocabulary = [], [a + b for a in "abcdefghij" for b in "xyzw"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 120))]
        rows += [" ".join(edited(base, rng.randint(0, 4), rng)) for _ in range(rng.randint(1, 12))]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows += [" ".join(common + [rng.choice(vocabulary) for _ in range(rng.randint(2, 30))]) for _ in range(30)]
    rows += [rows[0]] * 9 + [rows[0].upper(), "", "   ", "one", "ONE", "one two", "one two three", "a b c d", "a b c d"]
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(2, rows[2])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, node string, n_shingles int").repartition(5)
    got = sorted(tuple(r) for r in N.linked(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a b c d e"), (None, "a b c d e"), (None, "alone in the world"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in N.linked(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 2, 2), (None, 2, 2), (None, 1, None), (None, 0, None)], key=str)
    assert N.linked(df.where("doc_id > 5")).count() == 0
    kept = N.representatives(df.union(df.where("doc_id = 2")), 4, 85).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(1, None), (2, "a b c d e"), (None, "alone in the world"), (None, None)], key=str)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2001 + i) for i in range(300)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union_find(pairs, nodes)


def test_op10(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op10_ngram_join(spark, d).select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_weak_hashes_confuse(spark, n):
    a, b = ("".join(letters[i.bit_count() & 1] for i in range(n)) for letters in ("ab", "ba"))
    df = spark.createDataFrame([(1, f"x {a} y z"), (2, f"x {b} y z"), (3, f"x {a} y z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.linked(df, k=4, per_cent=85).collect()) == [(1, 1), (2, 2), (3, 1)]
    h = textops.words([f"{a} {b} {a.upper()}"])[0]
    assert h[0] == h[2] != h[1]
