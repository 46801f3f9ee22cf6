"""Comparing nested JSON documents: a document becomes its nodes, found in one pass, and comparisons are joins and aggregates of these.

A node is known by its steps from the root as an array, ".name" for a member and "[0]" for an item, so no name can look like
another path. Keys that are null are keys like others; keys identify a document. A value of a document is put together from its last node to
its first, so a document is as deep as it likes. A text that is no JSON has no nodes.
"""

from __future__ import annotations

import json as json_
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions import dates
from ledgerloom.functions import text as T
from ledgerloom.operators.compare import MONEY, NUMBER, PERCENT

NODES = "nodes array<struct<no:int,parent:int,steps:array<string>,kind:string,said:string,size:int>>"
KINDS = ("numbers", "percentages", "amounts", "dates")
#: Nodes that a worker holds as Python values at once; a document that has more is held alone.
HELD = 1 << 13


@dataclass
class Nodes:
    """documents: a row each, with the keys and the array of its nodes: no, parent's no (-1: none), steps, kind, what a scalar says and how many are in a container."""

    documents: DataFrame
    keys: list[str]

    @property
    def rows(self) -> DataFrame:
        """A row for each node, with path, which shows the steps as in $.member[0]; other nodes' paths may look the same."""
        out = self.documents.select(*self.keys, F.inline("nodes"))
        return out.withColumn("path", F.concat(F.lit("$"), F.array_join("steps", "")))


class _Number(str):
    """A number as it is written."""


def _walk(text: str) -> Iterator[tuple]:
    """The nodes of a document: parent, steps, kind, what is said and size, each before its own."""
    left, no = [(json_.loads(text, parse_int=_Number, parse_float=_Number), -1, ())], 0
    while left:
        value, parent, steps = left.pop()
        if isinstance(value, dict):
            yield parent, steps, "OBJECT", None, len(value)
            left += [(v, no, (*steps, f".{k}")) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            yield parent, steps, "ARRAY", None, len(value)
            left += [(value[i], no, (*steps, f"[{i}]")) for i in reversed(range(len(value)))]
        elif isinstance(value, str):
            yield parent, steps, "NUMBER" if isinstance(value, _Number) else "STRING", str(value), None
        else:
            yield parent, steps, "NULL" if value is None else "BOOLEAN", None if value is None else str(value).lower(), None
        no += 1


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def nodes(documents: DataFrame, keys: Sequence[str], json: str) -> Nodes:
    """The nodes of each document's JSON text."""

    def made(rows: pa.RecordBatch, sizes: list[int], out: list[tuple]) -> pa.RecordBatch:
        parent, steps, kind, said, size = zip(*out, strict=True) if out else ((),) * 5
        flat = _lists([len(s) for s in steps], pa.array([x for s in steps for x in s], pa.string()))
        no = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        fields = [pa.array(no, pa.int32()), pa.array(parent, pa.int32()), flat, pa.array(kind, pa.string()), pa.array(said, pa.string()), pa.array(size, pa.int32())]
        struct = pa.StructArray.from_arrays(fields, ["no", "parent", "steps", "kind", "said", "size"])
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), _lists(sizes, struct)], names=[*keys, "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sizes, out = 0, [], []
            for text in batch.column("_json"):
                before = len(out)
                out += _walk(text.as_py())
                sizes.append(len(out) - before)
                if len(out) >= HELD:
                    yield made(batch.slice(start, len(sizes)), sizes, out)
                    start, sizes, out = start + len(sizes), [], []
            if sizes:
                yield made(batch.slice(start), sizes, out)

    # Written anew by Spark, a text is plain JSON, numbers in one form; what it cannot read is left out.
    rows = documents.select(*keys, F.to_json(F.try_parse_json(json)).alias("_json")).where("_json is not null")
    return Nodes(rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *StructType.fromDDL(NODES).fields])), list(keys))


def _number(said: Column, digits: int | None) -> Column:
    value = said.cast("double")
    return (F.bround(value, digits) if digits is not None else value).cast("string")


#: Levels of tolerance: what becomes of a text, digits that a number with a fraction keeps, and whether empty values go and lists are sorted.
LEVELS = {
    "strict": (lambda t: t, None, False, False),
    "flexible": (T.strip, 6, False, True),
    "very_flexible": (T.collapse, 4, True, True),
    "fuzzy": (T.fuzzy, 2, True, True),
    "meaning": (T.meaning, 1, True, True),
    "data": (T.data_only, None, True, True),
}


def _leaf(level: str, kind: Column, said: Column) -> Column:
    plain, digits, _, _ = LEVELS[level]
    number = F.when(said.rlike("[.eE]"), _number(said, digits)).otherwise(_number(said, None))
    quoted = F.regexp_extract(F.to_json(F.array(plain(said))), r"(?s)^\[(.*)\]$", 1)
    return F.when(kind == "STRING", quoted).when(kind == "NUMBER", number).when(kind == "NULL", "null").otherwise(said)


def _together(level: str, nodes_: list[dict], leaves: list[str | None]) -> list[str]:
    """The text of each node of a document, from the last to the first. Members are in order of their names."""
    _, _, filled, ordered = LEVELS[level]
    out: list[str] = [""] * len(nodes_)
    below: list[list] = [[] for _ in nodes_]
    for no in range(len(nodes_) - 1, -1, -1):
        node = nodes_[no]
        kind = node["kind"]
        if kind == "ARRAY":
            out[no] = "[" + ",".join(sorted(below[no]) if ordered else reversed(below[no])) + "]"
        elif kind == "OBJECT":
            out[no] = "{" + ",".join(f"{json_.dumps(name)}:{text}" for name, text in sorted(below[no])) + "}"
        else:
            out[no] = leaves[no] or ""
        if node["parent"] < 0 or filled and (kind == "NULL" or node["said"] == ""):
            continue
        step = node["steps"][-1]
        if step[0] == ".":
            below[node["parent"]].append((step[1:], out[no]))
        elif not (filled and out[no] == "[]"):  # an empty list in a list goes too, an empty list as a member stays
            below[node["parent"]].append(out[no])
    return out


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many at a time that they have HELD nodes, or one row with more."""
    ends = np.asarray(batch.column("nodes").offsets)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + HELD, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def texts(found: Nodes, levels: Sequence[str]) -> DataFrame:
    """keys, nodes and, for each level, the array of all nodes' texts: the same for values that are the same at that level."""
    keys = found.keys
    leaves = lambda x: F.transform("nodes", lambda n: _leaf(x, n["kind"], n["said"])).alias(x)
    rows = found.documents.select(*keys, "nodes", *map(leaves, levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                own = batch.column("nodes").to_pylist()
                made = [[_together(x, n, leaves) for n, leaves in zip(own, batch.column(x).to_pylist(), strict=True)] for x in levels]
                new = [pa.array(w, pa.list_(pa.string())) for w in made]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("nodes"), *new], names=[*keys, "nodes", *levels])

    return rows.mapInArrow(run, rows.schema)


def canonical(found: Nodes, levels: Sequence[str] = tuple(LEVELS)) -> DataFrame:
    """keys and, for each level, one text of the document: the same for documents that are the same at that level."""
    return texts(found, levels).select(*found.keys, *(F.get(x, F.lit(0)).alias(x) for x in levels))


def _data(nodes_: Column) -> dict[str, Column]:
    """The different data of each kind in a document's numbers and texts, as sorted arrays."""
    plain = lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double").cast("string")
    said = F.transform(F.filter(nodes_, lambda n: n["kind"] == "STRING"), lambda n: n["said"])
    numbers = F.transform(F.filter(nodes_, lambda n: n["kind"] == "NUMBER"), lambda n: n["said"].cast("double").cast("string"))
    in_text = lambda pattern: F.flatten(F.transform(said, lambda t: F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), plain)))
    each = (F.concat(numbers, in_text(NUMBER)), in_text(PERCENT), in_text(MONEY), F.flatten(F.transform(said, lambda t: dates.all_in(t))))
    return {k: F.array_sort(F.array_distinct(F.array_compact(values))) for k, values in zip(KINDS, each, strict=True)}


def data_in(found: Nodes) -> DataFrame:
    """keys, kind (numbers, percentages, amounts, dates) and value of the different data in a document's numbers and texts."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), values.alias("values")) for k, values in _data(F.col("nodes")).items()))
    return found.documents.select(*found.keys, F.inline(each)).select(*found.keys, "kind", F.explode("values").alias("value"))


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str, also: Sequence[str] = ()) -> DataFrame:
    """a and b joined where keys are the same, null with null, and the columns in also; these once, then a's others and b's, which end in _b."""
    named = b.withColumnsRenamed({c: f"{c}_b" for c in b.columns})
    on = [*keys, *also]
    same = [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in on]
    out = a.join(named, same, how)
    # A key may be null in both, so the side that is there says whose keys these are.
    once = [F.when(F.col("_there").isNotNull(), F.col(k)).otherwise(F.col(f"{k}_b")).alias(k) if how == "full" else F.col(k) for k in on]
    return out.select(*once, *(c for c in out.columns if c not in on and c not in {f"{k}_b" for k in on}))


def matches(a: Nodes, b: Nodes) -> DataFrame:
    """keys and whether both documents are the same at each level. data: some kind of data is the same in both, or what is left of their texts."""
    keys = a.keys
    firsts = lambda n: texts(n, tuple(LEVELS)).select(*n.keys, *(F.get(x, F.lit(0)).alias(x) for x in LEVELS), *(v.alias(k) for k, v in _data(F.col("nodes")).items()))
    both = _joined(firsts(a), firsts(b), keys, "inner")
    same = F.lit(False)
    for k in KINDS:
        same = same | (F.col(k) == F.col(f"{k}_b"))
    flags = {x: F.col(x) == F.col(f"{x}_b") for x in LEVELS}
    flags["data"] = flags["data"] | same
    return both.select(*keys, *(flag.alias(f"{x}_match") for x, flag in flags.items()))


def differences(a: Nodes, b: Nodes, most: int = 5) -> DataFrame:
    """keys, no, path and difference: the first few differences of two documents in order of their paths (a report's feature).

    Below a list of another length, and below values of another type, nothing is compared.
    """
    keys = a.keys
    side = lambda n: n.rows.select(*keys, "steps", "path", "kind", "said", "size", F.lit(True).alias("_there"))
    both = _joined(side(a), side(b), keys, "full", ["steps"])
    shorten = lambda c: F.when(F.length(c) > 50, F.concat(F.left(c, F.lit(50)), F.lit("..."))).otherwise(F.col(c))
    told = lambda name: F.concat(F.lit(f"{name}: "), shorten("said"), F.lit(" / "), shorten("said_b"))
    difference = (
        F.when(F.col("kind_b").isNull(), "missing")
        .when(F.col("kind").isNull(), "extra")
        .when(F.col("kind") != F.col("kind_b"), F.concat(F.lit("type: "), "kind", F.lit(" / "), "kind_b"))
        .when((F.col("kind") == "ARRAY") & (F.col("size") != F.col("size_b")), F.concat(F.lit("length: "), "size", F.lit(" / "), "size_b"))
        .when((F.col("kind") == "NUMBER") & (F.col("said").cast("double") != F.col("said_b").cast("double")), told("number"))
        .when((F.col("kind") == "STRING") & (F.col("said") != F.col("said_b")), told("text"))
        .when((F.col("kind") == "BOOLEAN") & (F.col("said") != F.col("said_b")), told("boolean"))
    )
    found = both.select(*keys, "steps", F.coalesce("path", "path_b").alias("path"), difference.alias("difference")).where("difference is not null")
    # Only the topmost of what differs: nothing below what is missing, extra, of another type or length.
    stops = found.where(~F.col("difference").rlike("^(number|text|boolean): ")).select(*keys, F.col("steps").alias("above"))
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.slice("steps", 1, i - 1))).alias("above")
    hidden = _joined(found.where(F.size("steps") > 0).select(*keys, "steps", above), stops, keys, "inner", ["above"]).select(*keys, "steps").distinct()
    top = _joined(found, hidden.withColumn("hidden", F.lit(True)), keys, "left", ["steps"]).where("hidden_b is null")
    no = F.row_number().over(Window.partitionBy(*keys).orderBy("path", "steps")).cast("int")
    return top.select(*keys, "path", "difference", no.alias("no")).where(F.col("no") <= most)


def lists(found: Nodes) -> DataFrame:
    """keys, path, total, distinct, repeats and number of items of each kind of the lists that are in no other list. Items are compared as JSON in order of names."""
    keys = found.keys
    rows = texts(found, ["strict"]).select(*keys, F.inline(F.arrays_zip("nodes", "strict"))).select(*keys, "nodes.*", "strict")
    inside = F.size(F.filter("steps", lambda x: x.startswith("[")))
    item = (inside == 1) & F.element_at("steps", -1).startswith("[")
    rows = rows.select(*keys, F.when(item, F.col("parent")).when((inside == 0) & (F.col("kind") == "ARRAY"), F.col("no")).alias("list"), item.alias("item"), F.concat(F.lit("$"), F.array_join("steps", "")).alias("path"), "kind", "strict")
    every = ("ARRAY", "BOOLEAN", "NULL", "NUMBER", "OBJECT", "STRING")
    counts = [F.count_if(F.col("item") & (F.col("kind") == k)).alias(k) for k in every]
    counted = rows.where("list is not null").groupBy(*keys, "list").agg(F.max(F.when(~F.col("item"), F.col("path"))).alias("path"), F.count_if("item").alias("total"), F.count_distinct(F.when(F.col("item"), F.col("strict"))).alias("distinct"), *counts)
    kinds = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in every)), lambda e: e["n"] > 0))
    return counted.select(*keys, "path", "total", "distinct", (F.col("total") - F.col("distinct")).alias("repeats"), kinds.alias("kinds"))
