import json

import pyarrow as pa

from ledgerloom.operators import nested


def test_a_worker_holds_few_nodes():
    sizes = [3, 0, nested.HELD, nested.HELD + 5, 1, 1, 0]
    nodes = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), nodes], names=["id", "nodes"])
    for own, ids in ((batch, range(7)), (batch.slice(2), range(2, 7)), (batch.slice(7), [])):
        parts = [p.to_pydict() for p in nested._parts(own)]
        assert [i for p in parts for i in p["id"]] == list(ids)
        assert all(len(p["id"]) == 1 or sum(map(len, p["nodes"])) <= nested.HELD for p in parts)
    assert len(list(nested._parts(batch))) >= 3


def test_documents_beyond_what_is_held_at_once(spark):
    docs = {i: [{"b": i, "a": [i, str(i)]}] * (1 + i % 3) for i in range(2500)} | {2500: list(range(nested.HELD + 7)), 2501: [], 2502: {}}
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in docs.items()], "id long, a string").coalesce(1)
    found = nested.nodes(df, ["id"], "a")
    sizes = {r.id: [n.no for n in r.nodes] for r in found.documents.collect()}
    count = lambda v: 1 + sum(map(count, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else 1
    assert sizes == {i: list(range(count(v))) for i, v in docs.items()}
    assert {r.id: json.loads(r.strict) for r in nested.canonical(found, ["strict"]).collect()} == json.loads(json.dumps(docs), object_pairs_hook=lambda p: {int(k) if k.isdigit() else k: v for k, v in p})
    lists = {(r.id, r.path): (r.total, r.distinct) for r in nested.lists(found).collect()}
    assert lists[2500, "$"] == (nested.HELD + 7,) * 2 and lists[2, "$"] == (3, 1) and lists[2501, "$"] == (0, 0)
