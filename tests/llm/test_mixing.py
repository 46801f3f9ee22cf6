import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import mixing as M
from ledgerloom.llm.queries import op9_mixing


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 6), max_size=12), st.integers(0, 600))
def test_fit_is_near_and_exact_where_it_can_be(sizes, budget):
    lengths, counts = np.array(list(sizes), np.int64), np.array(list(sizes.values()), np.int64)
    took = M.fit(lengths, counts, budget)
    assert ((took >= 0) & (took <= counts)).all()
    got = int((lengths * took).sum())
    reach = {0}
    for n, c in sizes.items():
        for _ in range(c):
            reach |= {x + n for x in reach}
    below = max(x for x in reach if x <= budget)
    assert got == below or abs(got - budget) < budget - below


@pytest.mark.parametrize(
    "lengths, counts, budget, near",
    [
        ([10, 1_000_000], [100_000, 1], 1_000_000, 1_000_000),
        ([512, 300_000], [10_000, 1], 512_000, 512_000),
        ([512, 300_000], [1_000, 1], 300_000, 300_000),
        ([512, 300_000], [3_000, 9], 300_000 * 7 + 512 * 11, 300_000 * 7 + 512 * 11),
        ([7, 11, 400_000, 400_001], [3, 2, 5, 5], 1_600_003, 1_600_003),
        ([4, 6, 700_000], [90_000, 50_000, 3], 1_000_001, 1_000_000),
        ([5, 9], [200_000, 300_000], 3_699_999, 3_700_000),
    ],
)
def test_fit_with_long_documents_and_few_lengths(lengths, counts, budget, near):
    took = M.fit(np.array(lengths, np.int64), np.array(counts, np.int64), budget)
    assert (took >= 0).all() and (took <= counts).all() and int((took * lengths).sum()) == near


@pytest.mark.parametrize("lengths", [[300_000, 310_007, 400_003, 555_555], [999_983, 524_287, 65_537, 131_071, 7]])
@pytest.mark.parametrize("part", [0.1, 0.2, 0.29, 0.5, 0.77])
def test_fit_of_long_documents_against_all_subsets(lengths, part):
    counts = [3] * len(lengths)
    sums = {0}
    for n in lengths:
        sums = {x + k * n for x in sums for k in range(4)}
    for budget in (int(part * 3 * sum(lengths)), 855_555, 1_210_013):
        took = M.fit(np.array(lengths, np.int64), np.array(counts, np.int64), budget)
        assert abs(int((took * lengths).sum()) - budget) == min(abs(x - budget) for x in sums)


def test_memory_of_a_fit_that_cannot_be_exact():
    """114 documents of 1 to 2 million words, all but one multiples of 1,000: nothing hits the budget, all sums are tried."""
    rng = np.random.default_rng(5)
    lengths, counts = np.unique([*(rng.integers(1000, 2000, 113) * 1000), 1_234_567], return_counts=True)
    budget = int((lengths * counts).sum()) // 2_000 * 1_000 + 500
    tracemalloc.start()
    took = M.fit(lengths, counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(int((took * lengths).sum()) - budget) == 67 and peak < 120 << 20


def test_fractional_limit_and_rows_without_doc_id(spark):
    rows = [(i, " ".join(["w"] * 10), "a") for i in range(10)] + [(None, "v%d " % i * 10, "b") for i in range(200)] + [(7, "u%d " % i * 10, "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [r for r in M.mix(df, most=2.5).collect() if r.source == "a"]
    assert got[0].target == 250 and sum(r.taken for r in got) == 250 and max(r.copies for r in got) == 3
    again = [sorted(map(str, M.mixed(x, (1, 3), 1.5).collect())) for x in (df, df.repartition(7))]
    assert again[0] == again[1]


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held, left = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(held.values())
        total = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / total >= most * sizes[s]} if total and rest > 0 else set()
        if not over:
            return held | {s: (rest * weight[s] / total if total else 0.0) for s in left}
        held |= {s: most * sizes[s] for s in over}
        left -= over


def check(rows, texts):
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in texts.items()}
    by_source, took, count, longest = Counter(), Counter(), Counter(), Counter()
    for r in rows:
        assert r.size == sizes[r.doc_id]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        by_source[r.source] += r.size
        took[r.source] += r.taken
        count[r.source] += 1
        longest[r.source] = max(longest[r.source], r.size)
    want = brute_targets(dict(by_source))
    for r in rows:
        assert r.source_size == by_source[r.source] and r.target == pytest.approx(want[r.source])
    return {s: (took[s], want[s], longest[s]) for s in by_source}


def test_odd_rows(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), s, 1) for i, s in enumerate(["b", "a", None, "c", "d"] * 40)]
    rows += [(900, None, "a", 1), (901, "", "zero", 1), (902, "x\u00a0y \t z", "a", 1), (903, "v " * 50_000, "long", 1), (904, "w w", "b", 1), (904, "w w", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").repartition(6)
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    for took, want, longest in check(got, {r[0]: r[1] for r in rows}).values():
        assert abs(took - want) <= (2 if longest < 10 else longest / 2)
    again = M.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert M.mix(df.where("doc_id < 0")).count() == 0


def test_op9(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert set(op9_mixing(spark, d).columns) == {"doc_id", "size", "source_size", "target", "taken"}
    got = M.mix(spark.read.parquet(f"{d}/documents.parquet")).collect()
    for took, want, _ in check(got, {k: v[0] for k, v in docs.items()}).values():
        assert abs(took - want) <= 0.01 * want + 5
    fresh = defaultdict(set)
    for r in got:
        fresh[r.source].add(r.copies)
    assert all(max(x) - min(x) <= 1 for x in fresh.values())
