"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

A document is the set of its distinct k-word shingles (64-bit hashes, see textops). Documents with the same set are one
class; classes are joined.

Prefixes. All shingles have one order: estimated number of documents that hold it, then hash. Two sets of Jaccard
similarity t or more share at least m = ceil(t * n) shingles, n the size of the larger; so the first n - m + l
shingles of each share at least l, for any l. Each document picks its own l by estimated cost: a longer prefix meets more
documents, but they have to share l shingles before they are compared. Two documents must share the smaller of
their two numbers. Places in the prefixes, and bits of what is in them, bound what two sets can share besides. The estimate is a table of CELLS counts, of shingles that repeat within a batch of a task; it steers cost
only, any order gives the same links.

Components. In a group of near copies every pair would be a candidate. So first each class is compared with one leader,
of the classes that it shares a shingle with: one with few shingles of its own; the components of these links are contracted, and all candidates
between different components are compared after that. Links within a component cannot change it, so components are exact.

A text with fewer than k words is one shingle, its whole sequence. A null text, or one without words, has no shingle,
links with nothing and is its own component. A row without doc_id links like others and has the smallest doc_id of its
component, or null. Repeated rows stay. Very long texts are hashed block by
block, as one sequence of words. Of several documents with one set, and of several leaders, the tie goes to the smallest doc_id or the largest hash. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, common, textops
from ledgerloom.llm.components import components

CELLS = 1 << 20
#: MB of a table's files up to which it is broadcast here: what it is joined to are narrow rows, cheap to shuffle.
LOOKUP_MB = 1
#: Largest number of shared shingles that a document may ask for, and the cost of a comparison in posting entries.
MOST, COMPARE = 4, 8.0
U = np.uint64


def lookup(df: DataFrame, tag: str) -> DataFrame:
    return common.lookup(df, tag, LOOKUP_MB)


def _signature(no: np.ndarray, x: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's set: sums of differently mixed members."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textops.mix(x ^ U(salt)), dtype=np.uint64)))
        at = np.searchsorted(no, np.arange(docs + 1))
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _texts(rows: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of about size characters."""
    for batch in rows:
        for start, texts in bpe.batches(batch.column("text").to_pylist(), size):
            yield batch.slice(start, len(texts)), texts


def read_sets(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, sig, n_shingles, s1 and s2 of each document, written; and the table of estimated counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names = ["is_doc", "doc_id", "sig", "n", "s1", "s2"]
        for batch, texts in _texts(rows, 4 << 20):  # counts need many texts together
            no, x = textops.shingle_sets(texts, k)
            s1, s2 = _signature(no, x, len(texts))
            n = np.bincount(no, minlength=len(texts))
            # A set counts once a batch, so exact copies do not make their shingles look frequent.
            fresh = np.zeros(len(texts), bool)
            fresh[np.unique(s1, return_index=True)[1]] = True
            each, count = np.unique(x[fresh[no]], return_counts=True)
            more = count > 1
            np.add.at(cells, (each[more] % U(CELLS)).astype(np.int64), count[more])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(texts), bool)), batch.column("doc_id"), batch.column("sig"), pa.array(n), pa.array(s1), pa.array(s2)], names=names)
        cell = np.flatnonzero(cells)
        none = pa.nulls(len(cell), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(cell), bool)), none, none, pa.array(cells[cell]), pa.array(cell), none], names=names)

    found = common.written(common.mapped(docs, run, "is_doc boolean, doc_id long, sig long, n long, s1 long, s2 long"), "join-sets", ["is_doc"])
    counts = found.where("not is_doc").groupBy("s1").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    table = np.ones(CELLS, np.float32)
    table[counts.column("s1").to_numpy()] += counts.column("n").to_numpy()
    rows = found.where("is_doc").select("doc_id", "sig", F.col("n").alias("n_shingles"), "s1", "s2")
    rows._written_at = found._written_at
    return rows, table


def choose_prefixes(no: np.ndarray, x: np.ndarray, docs: int, table: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set size and number to share of each document, and its prefix: owners and shingles."""
    cost = table[(x % U(CELLS)).astype(np.int64)]
    order = np.lexsort((x, cost, no))
    x, cost = x[order], cost[order].astype(np.float64)
    n = np.bincount(no, minlength=docs)
    start = np.cumsum(n) - n
    total = np.concatenate(([0.0], np.cumsum(cost)))
    need = -(-per_cent * n // 100)
    best, ell = np.full(docs, np.inf), np.ones(docs, np.int64)
    for m in range(1, MOST + 1):
        length = n - need + m
        met = total[start + np.minimum(length, n)] - total[start]
        price = np.where((length <= n) & (n > 0), met + COMPARE * met / m, np.inf)
        ell = np.where(price < best, m, ell)
        best = np.minimum(best, price)
    length = np.where(n > 0, n - need + ell, 0)
    taken = np.arange(len(x)) - start[no] < length[no]
    return n, ell, no[taken], x[taken]


def prefixes(docs: DataFrame, k: int, table: np.ndarray, per_cent: int) -> DataFrame:
    """doc_id, s1, s2, n, ell and prefix of each document that has shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(rows):
            no, x = textops.shingle_sets(texts, k)
            s1, s2 = _signature(no, x, len(texts))
            n, ell, owner, prefix = choose_prefixes(no, x, len(texts), sent.value, per_cent)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(prefix.view(np.int64)))
            whole = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s1), pa.array(s2), pa.array(n.astype(np.int32)), pa.array(ell.astype(np.int32)), lists], names=["doc_id", "s1", "s2", "n", "ell", "prefix"]
            )
            yield whole.filter(pa.array(n > 0))

    return common.mapped(docs, run, "doc_id long, s1 long, s2 long, n int, ell int, prefix array<long>")


def shingles_of(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """node and shingles of the given classes (node, first_doc, s1, s2), written. A repeated row may give a class twice."""
    ids = lookup(classes.select(F.coalesce("first_doc", F.lit(0)).alias("key")).distinct(), "join-ids")
    named = docs.withColumn("key", F.coalesce("doc_id", F.lit(0))).join(ids, "key", "left_semi").drop("key")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(rows):
            no, x = textops.shingle_sets(texts, k)
            s1, s2 = _signature(no, x, len(texts))
            bounds = np.searchsorted(no, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.view(np.int64)))], names=["first_doc", "s1", "s2", "shingles"])

    sets = common.mapped(named, run, "first_doc long, s1 long, s2 long, shingles array<long>")
    keys = classes.select(F.col("first_doc").alias("d"), F.col("s1").alias("x1"), F.col("s2").alias("x2"), "node")
    same = F.col("first_doc").eqNullSafe(F.col("d")) & (F.col("s1") == F.col("x1")) & (F.col("s2") == F.col("x2"))
    out = common.written(sets.join(keys, same).select("node", "shingles"), "join-shingles")
    common.dropped(ids)
    return out


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, written."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = lookup(classes.join(nodes, "node", "left_semi"), "join-wanted")
    sets = shingles_of(docs, wanted, k)
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("all"))
    out = common.written(joined.where(100 * F.col("both") >= per_cent * (F.col("all") - F.col("both"))).select("a", "b").distinct(), "join-links")
    common.dropped(wanted, sets)
    return out


def _posting(c: str) -> list:
    """Set size, number to share and place in the prefix, packed in meta, as columns of side c."""
    return [F.shiftrightunsigned(f"m{c}", 31).alias(f"n{c}"), F.col(f"m{c}").bitwiseAND(F.lit(7)).alias(f"l{c}"), F.shiftrightunsigned(F.col(f"m{c}").bitwiseAND(F.lit((1 << 31) - 1)), 3).alias(f"p{c}")]


def _overlap(before, per_cent: int):
    """Whether the sets can share enough: what they share before places pa and pb, that one, and all that is behind either."""
    most = before + 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return (100 + per_cent) * most >= per_cent * (F.col("na") + F.col("nb"))


def _enough(met: DataFrame, per_cent: int) -> DataFrame:
    """Rows (a, b, ma, mb) of shared shingles as pairs that share enough in their prefixes and whose sizes and places allow the similarity."""
    sized = met.select("a", "b", *_posting("a"), *_posting("b"))
    counted = sized.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("la", "lb")).alias("least"), *(F.max(c).alias(c) for c in ("na", "nb", "pa", "pb")))
    return counted.where((F.col("shared") >= F.col("least")) & _overlap(F.col("shared") - 1, per_cent)).select("a", "b", "shared")


#: Columns of a posting that a join of two needs, and their letters there.
SIDE = {"meta": "m", "before": "r", "own": "o", "low": "x", "high": "y"}


def _may_link(per_cent: int):
    """Of one shared shingle, with places in both prefixes: whether sizes, places and bits allow the similarity.

    ra and rb: the shingles before it that any other prefix has; only those can be shared too. Of all oa such shingles in a prefix, those
    whose bit the other one lacks are not shared; behind the prefix that ends first lie as many shingles as that set needs, less what it asks for.
    """
    n, p, ell, behind, lacks = {}, {}, {}, {}, {}
    for c, d in ("ab", "ba"):
        n[c] = F.shiftrightunsigned(f"m{c}", 31)
        ell[c] = F.col(f"m{c}").bitwiseAND(F.lit(7))
        p[c] = F.shiftrightunsigned(F.col(f"m{c}").bitwiseAND(F.lit((1 << 31) - 1)), 3)
        behind[c] = F.ceil(n[c] * per_cent / 100) - ell[c]
        lacks[c] = sum(F.bit_count(F.col(f"{x}{c}").bitwiseAND(F.bitwise_not(f"{x}{d}"))) for x in "xy")
    most = F.least("ra", "rb") + F.least(n["a"] - p["a"], n["b"] - p["b"])
    shared = F.least(F.col("oa") - lacks["a"], F.col("ob") - lacks["b"])
    needed = per_cent * (n["a"] + n["b"])
    sizes = 100 * F.least(n["a"], n["b"]) >= per_cent * F.greatest(n["a"], n["b"])
    bits = ((100 + per_cent) * (shared + F.greatest(behind["a"], behind["b"])) >= needed) & (shared >= F.least(ell["a"], ell["b"]))
    return sizes & ((100 + per_cent) * most >= needed) & bits


def _slim(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("sig"))


def grouped(docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """doc_id, sig (hash of the text), n_shingles, group (null without shingles) and component_id of each document, written."""
    common.ship(docs.sparkSession)
    docs = _slim(docs)
    rows, table = read_sets(docs, k)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"]
    classes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(first.alias("first_doc"))
    classes = common.written(classes.withColumn("node", F.monotonically_increasing_id()), "join-classes")
    postings = read_postings(docs, classes, k, per_cent, table)
    leader_pairs = common.written(nearest_leaders(postings, per_cent), "join-pairs")
    links = verified(docs, leader_pairs, classes, k, per_cent)
    groups = components(links)
    pairs = common.written(apart_pairs(postings, groups, per_cent), "join-pairs")
    common.dropped(postings, leader_pairs)
    if not pairs.isEmpty():
        more = verified(docs, pairs, classes, k, per_cent)
        common.dropped(groups)
        groups = components(links.union(more))
        common.dropped(more)
    common.dropped(pairs, links)

    named = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = lookup(named.groupBy("component").agg(F.min("first_doc").alias("component_id")), "join-smallest")
    named = lookup(named.join(smallest, "component").select("s1", "s2", F.col("component").alias("group"), "component_id"), "join-named")
    found = rows.join(named, ["s1", "s2"], "left")
    lonely = F.col("n_shingles") == 0
    group = F.when(~lonely, F.col("group")).alias("group")
    out = found.select("doc_id", "sig", "n_shingles", group, F.when(lonely, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = common.written(out, "join-found")
    common.dropped(rows, classes, groups, smallest, named)
    return out


def read_postings(docs: DataFrame, classes: DataFrame, k: int, per_cent: int, table: np.ndarray) -> DataFrame:
    """shingle, node, meta, before, own, low, high and typical of each shingle in the prefix of a class that another prefix has too, written.

    before: how many such shingles come before it in its prefix; own: how many there are; low and high: a bit for each, of 128 by its hash;
    typical: the share of a prefix that others have too.
    """
    keys = classes.select(F.col("s1").alias("x1"), F.col("s2").alias("x2"), "first_doc", "node")
    own = (F.col("s1") == F.col("x1")) & (F.col("s2") == F.col("x2")) & F.col("doc_id").eqNullSafe(F.col("first_doc"))
    chosen = common.written(prefixes(docs, k, table, per_cent).join(keys, own).select("node", "n", "ell", "prefix"), "join-prefixes")
    place = F.posexplode("prefix").alias("place", "shingle")
    meta = F.shiftleft(F.col("n").cast("long"), 31).bitwiseOR(F.shiftleft(F.col("place").cast("long"), 3)).bitwiseOR(F.col("ell").cast("long"))
    postings = chosen.select("node", "n", "ell", place).select("shingle", "node", meta.alias("meta"))
    repeated = lookup(postings.groupBy("shingle").count().where("count > 1").select("shingle"), "join-repeated")
    shared = common.written(postings.join(repeated, "shingle"), "join-postings")
    common.dropped(chosen, repeated)
    rows, ordered = Window.partitionBy("node"), Window.partitionBy("node").orderBy("meta")
    place = F.col("shingle").bitwiseAND(F.lit(127)).cast("int")
    bit = lambda least: F.bit_or(F.when((place >= least) & (place < least + 64), F.call_function("shiftleft", F.lit(1).cast("long"), place - least)).otherwise(0)).over(rows)
    ranked = shared.withColumn("before", F.row_number().over(ordered) - 1).withColumn("own", F.count("*").over(rows).cast("int"))
    ranked = ranked.withColumns({"low": bit(0), "high": bit(64), "typical": F.col("own") / (F.shiftrightunsigned("meta", 31) * (100 - per_cent))})
    ranked = common.written(ranked, "join-ranked")
    common.dropped(shared)
    return ranked


def nearest_leaders(postings: DataFrame, per_cent: int) -> DataFrame:
    """a and b: each class with the leader that it shares most with.

    Each shingle has one leader, the class most of whose prefix others have too: in a group of near copies, one with few edits of its own.
    """
    ranked = F.struct("typical", F.xxhash64("node").alias("at"), "node", *(F.col(c) for c in SIDE))
    leaders = lookup(postings.groupBy("shingle").agg(F.max(ranked).alias("lead")), "join-leaders")
    met = postings.join(leaders, "shingle").where("node <> lead.node")
    met = met.select(F.col("node").alias("a"), F.col("lead.node").alias("b"), *(F.col(c).alias(f"{x}a") for c, x in SIDE.items()), *(F.col(f"lead.{c}").alias(f"{x}b") for c, x in SIDE.items())).where(_may_link(per_cent))
    return _enough(met, per_cent).groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b"))


def apart_pairs(postings: DataFrame, groups: DataFrame, per_cent: int) -> DataFrame:
    """a and b: all candidates between different components."""
    rows = postings.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle")
    rows = common.written(rows.join(lookup(several, "join-several"), "shingle"), "join-apart")
    ours, theirs = (rows.select("shingle", F.col("node").alias(c), F.col("component").alias(f"c{c}"), *(F.col(x).alias(f"{y}{c}") for x, y in SIDE.items())) for c in "ab")
    theirs = theirs.withColumnRenamed("shingle", "same")
    met = ours.join(theirs, (F.col("shingle") == F.col("same")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _may_link(per_cent))
    return _enough(met, per_cent)


def linked(docs: DataFrame, k: int = 4, per_cent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each document; documents link where 100 * intersection >= per_cent * union."""
    return grouped(docs, k, per_cent).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """The rows of docs that stay when one document of each component does, once: the smallest doc_id, null last, then the smallest hash of the text."""
    whole = grouped(docs, k, per_cent)
    found = whole.where("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")
    lead = lookup(found.groupBy("group").agg(F.min(rank).alias("lead")), "join-lead")
    gone = found.join(lead, "group").where((F.col("sig") != F.col("lead.sig")) | ~F.col("doc_id").eqNullSafe(F.col("lead.doc_id")))
    gone = common.written(gone.select(F.col("doc_id").alias("_join_doc"), F.col("sig").alias("_join_sig")).distinct(), "join-gone")
    twice = found.groupBy("doc_id", "sig").count().where("count > 1").select(F.col("doc_id").alias("_join_doc"), F.col("sig").alias("_join_sig"))
    twice = common.written(twice, "join-twice")
    common.dropped(whole, lead)
    own = F.xxhash64(F.col("text").cast("string"))

    def semi(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if common.small_enough(keys) else keys
        return rows.join(keys, (own == F.col("_join_sig")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_join_doc")), how)

    kept = semi(docs, gone, "left_anti")
    if twice.isEmpty():
        return kept
    again = Window.partitionBy("doc_id", own).orderBy(F.to_json(F.struct(*docs.columns)))
    once = semi(kept, twice, "left_semi").withColumn("_join_no", F.row_number().over(again)).where("_join_no = 1").drop("_join_no")
    return semi(kept, twice, "left_anti").unionByName(once)
