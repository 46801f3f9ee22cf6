import hashlib
import math
import random

import numpy as np
import pytest

from ledgerloom.llm import vector_codes as V
from ledgerloom.llm.queries import op12_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Lloyd in Python's own integers, every part compared with every entry. rows: vec_id, vector, label."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [r for r in kept if r[1] and len(r[1]) % parts == 0 and max(map(abs, r[1])) <= V.LARGEST]
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    width = len(usable[0][1]) // parts if usable else 0
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in usable[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds if usable else 0):
        for p in range(parts):
            of = [nearest(cut(r[1], p), books[p])[1] for r in usable]
            for e in range(len(books[p])):
                own = [cut(r[1], p) for r, i in zip(usable, of, strict=True) if i == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, errors = [], {}
    for r in kept:
        if r not in usable:
            out.append((r[0], r[2], None, None))
            continue
        found = [nearest(cut(r[1], p), books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    for _, label, _, e in out:
        errors[label] = errors.get(label) if e is None else (errors.get(label) or 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    key = lambda r: tuple((x is None, x or 0) for x in r[:1]) + (repr(r),)
    return sorted(((i, c, e, errors[label], sha) for i, label, c, e in out), key=key)


def result(df):
    key = lambda r: tuple((x is None, x or 0) for x in r[:1]) + (repr(r),)
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=key)


def table(spark, rows, partitions=4):
    return spark.createDataFrame([(i, v, label, "clash", 0) for i, v, label in rows], SCHEMA).repartition(partitions)


def vectors(seed, n, dim=16, coarse=False):
    rng = random.Random(seed)
    value = (lambda: rng.randint(-2, 2) / 4096) if coarse else (lambda: float(np.float32(rng.gauss(0, 0.2))))
    centers = [[value() for _ in range(dim)] for _ in range(24)]
    return [(i, [float(np.float32(c + (0 if coarse and rng.random() < 0.5 else value() * 0.3 if not coarse else value()))) for c in rng.choice(centers)], rng.choice([0, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("coarse", [False, True])
def test_codes_are_those_of_plain_lloyd(spark, coarse):
    rows = vectors(5, 400, coarse=coarse)
    assert result(V.codes(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(6, 60)
    nan, inf = float("nan"), float("inf")
    rows += [(60, None, 0), (61, [None] * 16, 0), (62, [nan] + [0.0] * 15, 1), (63, [-inf] + [0.0] * 15, 1), (64, [0.5] * 8, 2), (65, [0.5] * 15, 9), (66, [], 0), (67, [1e30] + [0.0] * 15, None)]
    rows += [rows[3], rows[3], (None, [0.25] * 16, None), (None, [-0.25] * 16, 7), (5, [0.1] * 16, 1)]
    assert result(V.codes(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("n", [1, 5, 16, 17])
def test_few_and_equal_vectors(spark, n):
    rows = [(i, [0.5 if i % 3 else -0.5] * 8, i % 2) for i in range(n)]
    assert result(V.codes(table(spark, rows))) == brute(rows)


def test_without_vectors(spark):
    assert V.codes(table(spark, [(1, [1.0] * 8, 1)]).where("vec_id < 0")).count() == 0
    assert V.codes(table(spark, [(1, None, 1)])).count() == 0
    assert [tuple(r)[:4] for r in V.codes(table(spark, [(1, [1.0] * 3, 1)])).select("vec_id", "code", "error", "label_error").collect()] == [(1, None, None, None)]
    with pytest.raises(ValueError):
        V.codes(table(spark, [(1, [1.0] * 8, 1)]), entries=257)


@pytest.mark.parametrize("spread", [3, 4000])
def test_bounds_hold_and_save_work(spread):
    """Codes of every round as by comparing with all entries; bounds are true; far fewer distances than that are computed."""
    rng = np.random.default_rng(spread)
    centers = rng.integers(-20 * spread, 20 * spread, (16, 8))
    x = (centers[rng.integers(0, 16, 3000)] + rng.integers(-spread, spread + 1, (3000, 8))).astype(np.int64)
    book = V.Books(x[None, :16].copy(), V.grouped(x[None, :16]), np.zeros((1, 16)))
    code, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf, np.float32), np.zeros((3000, book.n_groups), np.float32)
    looked = []
    for round_ in range(8):
        a = V.Assigner(book.entries[0], book.groups[0], book.drift[0], book.n_groups)
        if round_:
            upper, lower = a.adjusted(code, upper, lower)
        a.assign(x, code, upper, lower)
        looked.append(a.looked)
        d = ((x[:, None] - book.entries[0]) ** 2).sum(2)
        assert (code == d.argmin(1)).all()
        assert (upper.astype(float) >= np.sqrt(d.min(1))).all()
        other = np.where(np.arange(16) == code[:, None], np.inf, np.sqrt(d))
        for g in range(book.n_groups):
            own = other[:, book.groups[0] == g]
            if own.shape[1]:
                assert (lower[:, g].astype(float) <= own.min(1)).all()
        book = book.moved({(0, e): (x[code == e].sum(0).tolist(), int((code == e).sum())) for e in np.unique(code).tolist()})
    assert looked[-1] < 0.2 * x.shape[0] * 16


def test_op12(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(op12_vector_codes(spark, d)) == brute(rows)
