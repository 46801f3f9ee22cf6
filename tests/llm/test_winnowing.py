import hashlib
import random

import regex
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import winnowing as W
from ledgerloom.llm.queries import op3_winnowing


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def join(a, b):
    first = xxhash.xxh64_intdigest((a % 2**64).to_bytes(8, "little"), 42)
    return signed(xxhash.xxh64_intdigest((b % 2**64).to_bytes(8, "little"), first))


def brute(text, k=W.K, w=W.W):
    """[(hash, position)] by looking at every window by itself."""
    units = regex.findall(rf"[\p{{L}}\p{{M}}\p{{N}}]{{1,{W.UNIT}}}|[^ \t-\r\p{{Z}}\p{{L}}\p{{M}}\p{{N}}]", text or "")
    if len(units) < k:
        return [(signed(xxhash.xxh64_intdigest(" ".join(units).encode(), 42)), 0)]
    h = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units]
    n = 1
    while n < k:
        h, n = [join(a, b) for a, b in zip(h, h[n:])], 2 * n
    out = []
    for start in range(max(1, len(h) - w + 1)):
        window = range(start, min(start + w, len(h)))
        at = min(window, key=lambda i: (h[i] >> 32, -i))
        if not out or out[-1][1] != at:
            out.append((h[at], at))
    return out


def jaccard(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b)


def check(rows, got):
    """rows: (doc_id, text) in order."""
    want = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), jaccard(brute(text), brute(new)), jaccard(brute(text), brute(after))))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == sorted(want, key=str)


TEXTS = [None, "", "   ", "a", "one two three", "é ü 日本語 テキスト " * 9, "x" * 3000, "same words again " * 80, "!?" * 60, "ab " * 7, "abc def ghi jkl mno pqr stu vwx yz " * 300]


def test_positions_and_ties(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for r in df.withColumn("f", W.fingerprint(F.col("text"))).withColumn("d", W.digest(F.col("f"))).collect():
        assert [(x["hash"], x.position) for x in r.f] == brute(r.text), r.text


def test_match_guarantee(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(60):
        shared = [word() for _ in range(W.K + W.W - 1)]
        around = [[word() for _ in range(rng.randint(0, 60))] for _ in range(4)]
        rows.append((i, " ".join(around[0] + shared + around[1]), " ".join(around[2] + shared + around[3])))
    df = spark.createDataFrame(rows, "id int, a string, b string")
    both = F.size(F.array_intersect(W.hashes(W.fingerprint(F.col("a"))), W.hashes(W.fingerprint(F.col("b")))))
    assert df.where(both == 0).count() == 0


def test_next_row_and_repeats(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(3, "later text of the same id"), (6, "   "), (None, "no id " * 30)]
    df = spark.createDataFrame([(*r, 1.5, "clash") for r in rows], "doc_id long, text string, near_next double, next string").repartition(5)
    check(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), W.compared(df).collect())
    assert W.compared(df.where("doc_id < 0")).count() == 0
    check([(1, "alone " * 50)], W.compared(spark.createDataFrame([(1, "alone " * 50)], "doc_id long, text string")).collect())


def test_op3(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = op3_winnowing(spark, d)
    check([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()], got.collect())
    same = got.join(docs, "doc_id").groupBy("text").agg(F.countDistinct("fingerprint").alias("n"))
    assert same.where("n > 1").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
