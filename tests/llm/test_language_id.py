import itertools
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import language_id as L
from ledgerloom.llm.queries import op5_language_id

SOUNDS = {"aa": ["ka", "to", "mi", "ra"], "bb": ["ßen", "sch", "über", "ein"], "cc": ["日", "本", "語", "文"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, prose(lang, 40, rng), lang, "s", 0.5) for i, lang in enumerate(list(SOUNDS) * 40)]
    odd = [None, "", "123 !? ²½", "́", "ka", "KA TO " * 20_000, prose("aa", 60, rng) + " " + prose("bb", 30, rng)]
    rows += [(900 + i, t, None, "s", 0.5) for i, t in enumerate(odd)] + [(None, "ka to mi", "cc", "s", 0.5), (1, rows[1][1], "bb", "s", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, languages string, score double").repartition(4)


def test_folds_and_predictions(docs):
    got = L.identified(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred == L.UNKNOWN) == (r.score == 0)
        if r.lang is not None and r.doc_id is not None:
            assert r.lang_pred == r.lang
    by = {r.doc_id: r for r in got}
    assert [by[900 + i].lang_pred for i in range(7)] == ["und"] * 4 + ["aa"] * 3
    assert by[906].languages.keys() == {"aa", "bb"} and abs(by[906].score - 2 / 3) < 0.08


def test_nothing_to_learn_from(docs):
    got = L.identified(docs.where("lang is null")).collect()
    assert len(got) == 7 and all(r.lang_pred == "und" and r.score == 0 for r in got)
    assert L.identified(docs.where("doc_id < 0")).count() == 0


def test_mixture_against_plain_em(docs):
    """One document by itself, word after word, as the batch does it."""
    model = L.fit(docs)
    rng = random.Random(9)
    text = prose("aa", 30, rng) + prose("bb", 12, rng)
    words = [w for w in L._WORD.findall(text.lower())]
    logs = np.array([model.log_likelihoods([w])[0] for w in words], float)
    pair = [0, 1]
    pi = np.full(2, 0.5)
    for _ in range(L.STEPS):
        r = np.exp(logs[:, pair] - logs.max(1)[:, None]) * pi
        pi = (r / r.sum(1)[:, None]).mean(0)
    got = L.mixtures(["ka", text, None, "語"], model)
    assert np.allclose(got[1][pair], pi, atol=1e-4) and got[1][2] == 0
    assert got[2].sum() == 0 and got[3].argmax() == 2


def test_selection_against_all_sets(docs):
    """The set of languages with the best penalised likelihood, by EM over every set of them, one word after another."""
    model = L.fit(docs)
    rng = random.Random(12)
    texts = [" ".join(prose(x, rng.choice([1, 2, 5, 40]), rng) for x in rng.choices(list(SOUNDS), k=rng.randint(1, 3))) for _ in range(25)]
    for text, pi in zip(texts, L.mixtures(texts, model)):
        words = L._WORD.findall(text.lower())
        logs = np.array([model.log_likelihoods([w])[0] for w in words], float)

        def score(own):
            share = np.full(len(own), 1 / len(own))
            for _ in range(L.STEPS if len(own) > 1 else 0):
                r = np.exp(logs[:, own] - logs.max(1)[:, None]) * share
                share = (r / np.maximum(r.sum(1), 1e-30)[:, None]).mean(0)
            fit = (np.log(np.maximum((np.exp(logs[:, own] - logs.max(1)[:, None]) * share).sum(1), 1e-30)) + logs.max(1)).sum()
            return fit - L.PENALTY * (len(own) - 1) * np.log(len(words) + 1)

        sets = [list(c) for n in (1, 2, 3) for c in itertools.combinations(range(3), n)]
        best = max(map(score, sets))
        assert score(list(np.flatnonzero(pi > 0))) == pytest.approx(best, abs=0.05), text


def test_more_than_three_languages(spark):
    sounds = SOUNDS | {"dd": ["жи", "ло", "ств", "ый"], "ee": ["θα", "νο", "ρει", "ξυ"], "ff": ["عل", "مي", "نا", "دو"]}
    rng = random.Random(21)

    def words(lang, n):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(i, words(lang, 40), lang) for i, lang in enumerate(list(sounds) * 30)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sets = [["aa"], ["aa", "cc", "dd", "ee"], list(sounds), ["bb", "ff"], ["aa", "bb", "cc"]]
    got = L.mixtures([" ".join(words(x, 40) for x in s) for s in sets] + [None], model)
    for s, pi in zip(sets, got):
        assert {model.languages[i] for i in np.flatnonzero(pi > 0.01)} == set(s)
        assert abs(pi.max() - 1 / len(s)) < 0.02
    assert got[-1].sum() == 0


def test_op5_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = op5_language_id(spark, d)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 100
