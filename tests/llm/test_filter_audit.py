import random
import re
from itertools import permutations

import pytest

from ledgerloom.llm import filter_audit as A
from ledgerloom.llm.queries import FILTER_AUDIT_SQL, op13_filter_audit
from tests.oracle import compare, connection

DOCS = "doc_id long, text string, source string, mask string, n int, good int, part string"
LABELS = "doc_id long, quality int, toxic int, part string"


def failures(rows):
    """The letters that each row fails, by plain reading of the rules."""
    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [d for d, x, *_ in rows if (x or "") == t and d is not None]
        copy = bool(same) and (doc_id is None or min(same) < doc_id)
        tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)
        out.append({f for f, x in zip("ABCDE", tests, strict=True) if x})
    return out


def brute(rows, labels):
    """Every order is run filter by filter over the documents that are still there."""
    fails, out, shapley = failures(rows), {}, {}
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    parts = {r[2] or "" for r in rows}
    for part in parts:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                again = [i for i in own if i not in left and f in fails[i]]
                left = [i for i in left if f not in fails[i]]
                lost = [sum(rows[i][0] in s for i in gone) for s in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(gone), len(again), sum(fails[i] == {f} for i in own), *lost]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def result(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def fixture(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "DELTA", "x#y", "a|b", "é", "\x1c", "　", "日本"] + [f"w{i}" for i in range(60)]
    texts = [None, "", " \t\n", " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), "ABC " * 80, ("w1 w2 w3\x0b") * 900]
    for _ in range(30):
        texts.append(rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.choice([3, 49, 50, 51, 70, 200]))))
    rows = [(i, rng.choice(texts), rng.choice(["s", "s", "s", "t", None, ""]), "clash", 1, 2, "p") for i in range(60)]
    rows += [rows[3], rows[3], (None, texts[9], "s", "", 0, 0, ""), (None, texts[9], "s", "", 0, 0, ""), (None, "only without id", "t", "", 0, 0, ""), (99, texts[9], None, "", 0, 0, "")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "l") for i in range(0, 60, 2)] + [(4, 1, 0, "l"), (4, 0, 1, "l"), (None, 1, 1, "l"), (1000, 1, 1, "l")]
    return rows, labels


@pytest.mark.parametrize("seed", range(2))
def test_audit_is_as_running_every_order(spark, seed):
    rows, labels = fixture(seed)
    got = A.audited(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    assert result(got) == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.audited(docs, labels).count() == 0
    one = spark.createDataFrame([(5, None, None, "", 0, 0, "")], DOCS)
    assert result(A.audited(one, labels)) == brute([(5, None, None)], [])


def test_other_filters_and_steps(spark):
    counted = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 2, 1), ("q", 2, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in A.audit(counted, ["x", "y"]).collect()}
    assert len(got) == 8
    assert got["p", "xy", 1] == (5, 2, 0, 0, 2, 1, 2) and got["p", "xy", 2] == (5, 0, 2, 0, 0, 0, 2)
    assert got["q", "yx", 1] == (0, 4, 0, 4, 0, 0, 8) and got["q", "xy", 1] == (4, 0, 0, 0, 0, 0, 0)


def test_op13(spark):
    d = "/root/testdata/sf0.001"
    assert compare(op13_filter_audit(spark, d), connection(d), FILTER_AUDIT_SQL) == ""
