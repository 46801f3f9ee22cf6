import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import missing, numbers, text
from ledgerloom.operators import content, dedupe, joins, nested, periods, ranges, screening
from ledgerloom.sources import sinks
from ledgerloom.streaming import incremental


def grown(rng, depth):
    """A random JSON value without ties of type."""
    kind = rng.choice("sbndl" if depth else "snb")
    if kind == "s":
        return rng.choice(["", " a  b ", "The rate: 5%", "x.y", "€ 1,200.50 on 1-2-2020"])
    if kind == "n":
        return rng.choice([1, 2.5, 2.5000001, 3.04, 3.05, None])
    if kind == "b":
        return rng.random() < 0.5
    if kind == "d":
        return {k: grown(rng, depth - 1) for k in rng.sample("abcd", rng.randint(0, 3))}
    return [grown(rng, depth - 1) for _ in range(rng.randint(0, 3))]


def changed(value, rng):
    if isinstance(value, dict):
        return {k: changed(v, rng) for k, v in value.items() if rng.random() < 0.9}
    if isinstance(value, list):
        out = [changed(v, rng) for v in value]
        return out[::-1] if rng.random() < 0.2 else out[:-1] if rng.random() < 0.1 else out
    return grown(rng, 0) if rng.random() < 0.15 else value


def walk(value, path="$"):
    yield path, value
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        yield from walk(v, f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]")


def kind(v):
    return "OBJECT" if isinstance(v, dict) else "ARRAY" if isinstance(v, list) else "NULL" if v is None else "BOOLEAN" if isinstance(v, bool) else "STRING" if isinstance(v, str) else "NUMBER"


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(4)
    rows = [(i, {"top": grown(rng, 3), "list": [grown(rng, 2) for _ in range(3)]}) for i in range(40)]
    pairs = [(i, a, changed(a, rng) if i % 4 else a) for i, a in rows]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs] + [(90, None, "{}"), (91, "no json", "[]")], "id long, a string, b string")
    return pairs, df


def test_nodes(documents):
    pairs, df = documents
    got = sorted((r.id, r.path, r.kind) for r in nested.nodes(df.where("id < 90"), ["id"], "a").rows.collect())
    assert got == sorted((i, p, kind(v)) for i, a, _ in pairs for p, v in walk(a))
    assert nested.nodes(df.where("id = 91"), ["id"], "a").rows.count() == 0


def sorted_all(v):
    if isinstance(v, dict):
        return {k: sorted_all(v[k]) for k in v}
    if isinstance(v, list):
        return sorted((sorted_all(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True))
    return v.strip() if isinstance(v, str) else round(v, 6) if isinstance(v, float) else v


def test_matches(documents):
    pairs, df = documents
    rows = df.where("id < 90")
    found = {r.id: r for r in nested.matches(nested.nodes(rows, ["id"], "a"), nested.nodes(rows, ["id"], "b")).collect()}
    dump = lambda v: json.dumps(v, sort_keys=True)
    for i, a, b in pairs:
        r = found[i]
        assert r.strict_match == (dump(a) == dump(b)) and r.flexible_match == (dump(sorted_all(a)) == dump(sorted_all(b)))
        assert not r.strict_match or (r.flexible_match and r.very_flexible_match and r.fuzzy_match and r.meaning_match and r.data_match)
    assert 10 < sum(r.strict_match for r in found.values()) < 40


def test_tolerance(spark):
    cases = {1: ('{"a": [1.00004, "x"], "b": ""}', '{"a": ["x", 1.00003]}', 3), 2: ('["The A.", "b"]', '["b", "a!"]', 4), 3: ('[2.04]', '[2.01]', 5), 4: ('["now grow"]', '["grow"]', 5), 5: ('{"a": 1}', '{"a": 2}', 9), 6: ("[[], 1]", "[1]", 3)}
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in cases.items()], "id long, a string, b string")
    for r in nested.matches(nested.nodes(df, ["id"], "a"), nested.nodes(df, ["id"], "b")).collect():
        flags = [r[f"{x}_match"] for x in ("strict", "flexible", "very_flexible", "fuzzy", "meaning")]
        assert flags == [n + 1 >= cases[r.id][2] for n in range(5)], r


def brute_differences(a, b, path="$"):
    if kind(a) != kind(b):
        return [(path, "type")]
    if isinstance(a, dict):
        out = [(f"{path}.{k}", "missing") for k in a if k not in b] + [(f"{path}.{k}", "extra") for k in b if k not in a]
        return out + [x for k in a if k in b for x in brute_differences(a[k], b[k], f"{path}.{k}")]
    if isinstance(a, list):
        return [(path, "length")] if len(a) != len(b) else [x for i, (v, w) in enumerate(zip(a, b)) for x in brute_differences(v, w, f"{path}[{i}]")]
    return [(path, {"STRING": "text", "NUMBER": "number", "BOOLEAN": "boolean"}[kind(a)])] if a != b else []


def test_differences(documents):
    pairs, df = documents
    rows = df.where("id < 90")
    got = sorted((r.id, r.no, r.path, r.difference.split(":")[0]) for r in nested.differences(nested.nodes(rows, ["id"], "a"), nested.nodes(rows, ["id"], "b"), most=3).collect())
    assert got == [(i, n + 1, *x) for i, a, b in pairs for n, x in enumerate(sorted(brute_differences(a, b))[:3])] and len(got) > 20


def test_lists(documents):
    pairs, df = documents
    want = {}
    for i, a, _ in pairs:
        for p, v in walk(a):
            if isinstance(v, list) and "[" not in p:
                kinds = sorted({k: sum(kind(x) == k for x in v) for k in map(kind, v)}.items())
                want[i, p] = (len(v), len({json.dumps(x, sort_keys=True) for x in v}), dict(kinds))
    got = {(r.id, r.path): (r.total, r.distinct, r.kinds) for r in nested.lists(nested.nodes(df.where("id < 90"), ["id"], "a")).collect()}
    assert got == want


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_sanitized_strings(spark):
    cases = {'["a\nb\r t"h \\q \\n"]': '["a\\nb\\r t\\"h \\\\q \\n"]', '["x"]': '["x"]', "['it\"s']": "['it\\\"s']", '["open': '["open', '["q\\"r"]': '["q\\"r"]'}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r[0]: r[1] for r in df.select("t", text.sanitized_strings(F.col("t"))).collect()} == cases | {None: None}


def test_picked_text(spark):
    lit, none = F.lit, F.lit(None).cast("string")
    parts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    got = one(spark, *(text.picked_text(*c) for c in ((lit("SAFETY"), lit("{}"), lit("t"), parts("p")), (none, lit("{}"), lit("t"), parts("p")), (lit("MAX_TOKENS"), lit(""), lit("t"), parts("p")), (none, none, lit(""), parts('{"a": "\x01', None, '"}')), (none, none, none, parts()))))
    assert [tuple(x) for x in got] == [("", "SAFETY"), ("{}", "STOP"), ("t", "MAX_TOKENS"), ('{"a": ""}', "STOP"), (None, "STOP")]


def test_small_rules(spark):
    assert one(spark, missing.missing_keys(F.lit('{"b": 1}'), ("a", "b", "c")), missing.has_keys(F.lit("[]"), ("a",)), missing.has_keys(F.lit("x"), ()))[:2] == (["a", "c"], False)
    assert one(spark, *(numbers.time_limit(F.lit(x)) for x in (5.0, 5.1, 8.0, 8.1))) == (600, 900, 900, 1200)
    pdf = lambda n, name, head: screening.pdf_validity(F.lit(n).cast("long"), F.lit(name), F.lit(head).cast("binary"))
    assert one(spark, pdf(5000, "a.PDF", b"%PDF-1.4"), pdf(5000, "a.pdf", b"<html>"), pdf(5000, "a.txt", b"%PDF"), pdf(None, "a.pdf", None), pdf(10, "a.pdf", b"%PDF")) == ("valid", "no PDF header", "wrong suffix", "missing", "too small")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 3), ("b", 9.0, 1), ("c", 9.0, 2), ("d", None, 4)], "name string, share double, at int")
    assert [r.name for r in content.most_present(df, "name", "share").collect()] == ["b", "c", "a"]
    assert [tuple(r) for r in content.last_known(df, "at", "share").collect()] == [("a", 1.0, 3)] and content.last_known(df.where("at > 3"), "at", "share").count() == 0
    for n in (1, 2):
        sinks.write_summary(df.where(F.col("at") == n), str(tmp_path / "s"))
    assert [(r.name, r["at"]) for r in spark.read.json(str(tmp_path / "s")).collect()] == [("c", 2)]
    assert [r.name for r in joins.unmatched(df, df.where("at < 4"), ["name"]).collect()] == ["d"]
    rows, seen = incremental.watched(df.withColumn("ok", F.col("at") != 2), "ok", "share")
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"files": 4, "failures": 1, "seconds": 19.0}


def test_places_and_sums(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SAMPLE", 2)
    rng = random.Random(2)
    values = [rng.choice([None, rng.randint(0, 30), rng.randint(0, 10**6)]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(5)
    got = {r.id: r.no for r in ranges.placed(df, ["v", "id"], "no").collect()}
    order = sorted(range(3000), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: n for n, i in enumerate(order)}
    known = sorted(v for v in values if v is not None)
    places = {}
    for n, v in enumerate(known, 1):
        places.setdefault(v, []).append(n)
    ranks = {r.v: r.rank for r in periods.average_rank(df, "v", "rank").where("v is not null").collect()}
    assert ranks == {v: sum(n) / len(n) for v, n in places.items()}
    assert ranges.placed(df.where("id < 0"), ["v", "id"], "no").count() == 0
    assert sorted(r.worker for r in dedupe.assigned(df, ["v", "id"], 4).collect()) == sorted(n % 4 for n in range(3000))
    assert dedupe.shuffled(df, "id", 5).collect() == dedupe.shuffled(df.repartition(2), "id", 5).collect()


def test_names_that_look_like_paths_and_null_keys(spark):
    a, b = '{"a.b":[1],"a":{"b":[2]}}', '{"a.b":[2],"a":{"b":[1]}}'
    c = '{"x[0]":["p","q","p"],"y":["r"],"x":[["s"]],"":{"":[]}}'
    df = spark.createDataFrame([(1, "k", a, a), (2, "k", a, b), (None, "k", c, c), (None, None, a, c), (3, None, c, '{"x[0]":["p","z","p"],"y":["r"],"x":[["s"]],"":{"":0}}')], "id long, key string, a string, b string")
    one, two = (nested.nodes(df, ["id", "key"], x) for x in "ab")
    by = lambda rows: {(r.id, r.key): r for r in rows}
    assert {k: r.strict for k, r in by(nested.canonical(one, ["strict"]).collect()).items()}.keys() == {(1, "k"), (2, "k"), (None, "k"), (None, None), (3, None)}
    assert by(nested.canonical(one, ["strict"]).collect())[None, "k"].strict == '{"":{"":[]},"x":[["s"]],"x[0]":["p","q","p"],"y":["r"]}'
    flags = by(nested.matches(one, two).collect())
    assert {k: (r.strict_match, r.meaning_match) for k, r in flags.items()} == {(1, "k"): (True, True), (2, "k"): (False, False), (None, "k"): (True, True), (None, None): (False, False), (3, None): (False, False)}
    got = [(r.id, r.key, r.no, r.path, r.difference) for r in nested.differences(one, two).collect()]
    assert sorted(x for x in got if x[0] == 2) == [(2, "k", 1, "$.a.b[0]", "number: 2 / 1"), (2, "k", 2, "$.a.b[0]", "number: 1 / 2")]
    assert not [x for x in got if x[0] == 1 or x[:2] == (None, "k")]
    assert sorted(x[3:] for x in got if x[:2] == (None, None)) == [("$.", "extra"), ("$.a", "missing"), ("$.a.b", "missing"), ("$.x", "extra"), ("$.x[0]", "extra")]
    assert sorted(x[2:] for x in got if x[0] == 3) == [(1, "$..", "type: ARRAY / NUMBER"), (2, "$.x[0][1]", "text: q / z")]
    lists = sorted((r.path, r.total, r.distinct, r.repeats, r.kinds) for r in nested.lists(one).where("id is null and key = 'k'").collect())
    assert lists == [("$..", 0, 0, 0, {}), ("$.x", 1, 1, 0, {"ARRAY": 1}), ("$.x[0]", 3, 2, 1, {"STRING": 3}), ("$.y", 1, 1, 0, {"STRING": 1})]
    assert nested.lists(one).where("id = 1").count() == 2 and nested.nodes(df, ["id", "key"], "a").rows.where("key is null and id is null").count() == 6
