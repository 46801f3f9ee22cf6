"""Substring dedup: passages that repeat across documents, found by paragraphs and removed from all documents but one.

Paragraphs. Lines of at least LINE_WORDS words and, in texts with blank lines, what stands between those, are compared as sets of 5-word shingles. MinHash bands, as many as the
wanted recall needs, give candidates; exact Jaccard similarity decides. Passages that do not fill a line are found by
floating paragraphs: WINDOW words from each anchor, a place whose hash is the rightmost smallest of SPREAD neighbours.
A floating paragraph has one band, all of its words: one other word in it takes 5 of its 20 shingles away, below
the threshold. Two texts that share WINDOW + SPREAD + 1 words in a row share an anchor and what follows it; the shared
run, verified by a hash of all its words, is then followed word by word in both directions to where it ends. What lines and blocks
have removed is never what a run is kept for, and a run goes only for the sake of a document before its own: so what goes
is always still there elsewhere, a line or block as one that is similar, a run word by word.

Clusters. Equal lines are one class. In each bucket of a band every class is compared with the class that has most
copies, and the components of these links are contracted; in buckets that still hold several, classes of different components
are compared if they share one of their rarest shingles, as any two similar enough must. Of each component the
first paragraph by (doc_id, text's hash, place) is kept, null doc_id last, with all others of its document; those of other documents go.

Ties are decided by (doc_id, text's hash, place), so reruns agree. Very long texts are hashed block by block. A document is a distinct (doc_id, text); repeated rows of it are treated alike. Null texts and texts without words
lose nothing. A removed passage leaves one line break where one was beside it, else one space. Texts that lose
nothing stay as they are, byte for byte. An empty table gives an empty table. Other columns are kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm import bpe, common, textops
from ledgerloom.llm.components import components

K, PER_CENT = 5, 80
LINE_WORDS, WINDOW, SPREAD = 24, 24, 24
#: Words of an anchor's hash; recall at the threshold that the bands are tuned for, and bands that may be spent on it.
ANCHOR, RECALL, MOST_BANDS = 3, 0.99, 8
#: Words before and after a run of floating paragraphs among which its end lies.
REACH = SPREAD + ANCHOR
#: Characters that a worker hashes at once.
BATCH_CHARS = 1 << 20
U = np.uint64


def tuned(threshold: float, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """Bands and rows in each: the most selective bands that find a pair at the threshold with the wanted probability."""
    best = (most, 1)
    for rows in range(1, 17):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands <= most:
            best = (bands, rows)
    return best


BANDS, ROWS = tuned(PER_CENT / 100)
_random = np.random.default_rng(20250311).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_XOR, _TIMES = _random[0], _random[1] | U(1)


def anchors(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of anchors with WINDOW words of the same text from there. owner: the text of each word, in order."""
    span = SPREAD + ANCHOR - 1
    if len(h) < span:
        return np.zeros(0, np.int64)
    low = U((1 << 22) - 1)
    g = textops.fold(h, ANCHOR)
    at = np.arange(len(g), dtype=np.uint64)
    m = (g & ~low) | (low - (at & low))  # the smallest hash; of equal ones the rightmost
    key, step = m, 1
    while 2 * step <= SPREAD:
        m, step = np.minimum(m[:-step], m[step:]), 2 * step
    if rest := SPREAD - step:
        m = np.minimum(m[:-rest], m[rest:])
    m = m[owner[: len(m)] == owner[span - 1 : span - 1 + len(m)]]
    chosen = np.unique(low - (m & low)).astype(np.int64)
    places = []  # the low bits of a place; batches of over 4 million words have several of the same
    for base in range(0, len(key), 1 << 22):
        x = chosen + base
        places.append(x[x < len(key)])
    at = np.concatenate(places)
    if len(places) > 1:
        at = at[np.isin(key[at], m)]
    at = at[at + WINDOW <= len(h)]
    return at[owner[at] == owner[at + WINDOW - 1]]


def run_keys(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place."""
    out = np.full(len(at), n, np.uint64)
    for j in range(n):
        out = textops.mix(out * U(0x9FB21C651E98DF25) + h[at + j] + U(j))
    return out


def lines_of(texts: list[str | None], owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for the line of each word, ascending; no two texts have a line in common."""
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out, base = np.zeros(len(owner), np.int64), 0
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        if a < b:
            breaks = np.flatnonzero(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) == 10)
            out[a:b] = base + np.searchsorted(breaks, first[a:b])
            base += len(breaks) + 1
    return out


class Lines:
    """The lines of at least LINE_WORDS words, and the blocks of several lines between blank ones: text, first word, words, and their shingles one behind another."""

    def __init__(self, texts: list[str | None], h: np.ndarray, owner: np.ndarray, first: np.ndarray):
        line = lines_of(texts, owner, first)
        step = np.diff(line, prepend=-1)
        start = np.flatnonzero(step)
        words = np.diff(np.append(start, len(line)))
        block = np.flatnonzero((step > 1) | (np.diff(owner, prepend=-1) != 0))  # a line without words has no number here
        inside = np.diff(np.append(block, len(line)))
        wrapped = (line[block] != line[block + inside - 1]) & (np.bincount(owner[block], minlength=1)[owner[block]] > 1)
        of = np.searchsorted(block, start, "right") - 1
        around = np.where(wrapped[of], block[of], -1) if len(start) else start
        start, words, around = np.append(start, block[wrapped]), np.append(words, inside[wrapped]), np.append(around, np.full(wrapped.sum(), -1))
        order = np.lexsort((words, start))
        order = order[words[order] >= LINE_WORDS]
        start, self.words, around = start[order], words[order], around[order]
        self.owner = owner[start]
        text_at = np.searchsorted(owner, self.owner)
        self.at = start - text_at  # counted from the text's first word
        self.block = np.where(around >= 0, around - text_at, -1)  # where the block of a line starts, -1 for what is in none
        size = self.words - K + 1
        self.bounds = np.concatenate(([0], np.cumsum(size)))
        s = textops.fold(h, K)
        self.shingles = s[np.repeat(start - self.bounds[:-1], size) + np.arange(self.bounds[-1])]

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textops.mix(self.shingles ^ U(salt)), dtype=np.uint64)))
            out.append((total[self.bounds[1:]] - total[self.bounds[:-1]]).view(np.int64))
        return out[0], out[1]

    def bands(self) -> np.ndarray:
        """BANDS keys of each line."""
        out = np.zeros((len(self.at), BANDS), np.uint64)
        if len(self.at):
            for i in range(BANDS * ROWS):
                low = np.minimum.reduceat((self.shingles ^ _XOR[i]) * _TIMES[i], self.bounds[:-1])
                out[:, i // ROWS] = textops.mix(out[:, i // ROWS] * U(0x9FB21C651E98DF25) + low + U(i // ROWS))
        return out.view(np.int64)


def _texts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in rows:
        for start, texts in bpe.batches(batch.column("text").to_pylist(), BATCH_CHARS):
            yield batch.slice(start, len(texts)), texts


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


LINE = "struct<at:int,words:int,block:int,s1:long,s2:long,bands:array<long>>"


def read_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, sig, the floating paragraphs (key and place) and the lines of each document, written."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(rows):
            h, owner, first, _ = textops.words(texts)
            at = anchors(h, owner)
            starts = np.searchsorted(owner, np.arange(len(texts)))
            keys = run_keys(h, at, WINDOW)
            windows = pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array((at - starts[owner[at]]).astype(np.int32))], ["key", "at"])
            lines = Lines(texts, h, owner, first)
            s1, s2 = lines.signatures()
            n = len(lines.at)
            bands = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * BANDS).astype(np.int32)), pa.array(lines.bands().ravel()))
            ints = (pa.array(x.astype(np.int32)) for x in (lines.at, lines.words, lines.block))
            found = pa.StructArray.from_arrays([*ints, pa.array(s1), pa.array(s2), bands], ["at", "words", "block", "s1", "s2", "bands"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sig"), _lists(windows, owner[at], len(texts)), _lists(found, lines.owner, len(texts))], names=["doc_id", "sig", "windows", "lines"]
            )

    return common.written(common.mapped(docs, run, f"doc_id long, sig long, windows array<struct<key:long,at:int>>, lines array<{LINE}>"), "dedup-paragraphs")


def _place(*more: str) -> Column:
    """A document's place in the order that decides which paragraph is kept."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig", *more)


def _other(kept: str) -> Column:
    return (F.col("sig") != F.col(f"{kept}.sig")) | ~F.col("doc_id").eqNullSafe(F.col(f"{kept}.doc_id"))


def marked_windows(paragraphs: DataFrame, cuts: DataFrame) -> DataFrame:
    """doc_id, sig, key, at and free of the floating paragraphs, written. free: none of its words is removed already.

    Those so deep inside what is removed that following them to their ends would not lead out of it are left out.
    """
    rows = _beside(paragraphs.select("doc_id", "sig", "windows"), cuts, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, cuts_ = batch.column("windows"), batch.column("cuts")
            flat, cut = windows.flatten(), cuts_.flatten()
            owner = windows.value_parent_indices()
            row, start, end = (x.to_numpy().astype(np.int64) for x in (cuts_.value_parent_indices(), cut.field("start"), cut.field("end")))
            # One axis for all documents of the batch. Cuts of one document do not touch, so the first that ends behind a place is the one to look at.
            far = np.int64(1) << 32
            place = owner.to_numpy() * far + flat.field("at").to_numpy()
            at = np.searchsorted(row * far + end, place, "right")
            opens, closes = (np.append(row * far + x, np.iinfo(np.int64).max)[at] for x in (start, end))
            stays = pa.array((opens > place - REACH) | (closes < place + WINDOW + REACH))
            names = ["doc_id", "sig", "key", "at", "free"]
            columns = [batch.column("doc_id").take(owner), batch.column("sig").take(owner), flat.field("key"), flat.field("at"), pa.array(opens >= place + WINDOW)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(stays)

    return common.written(common.mapped(rows, run, "doc_id long, sig long, key long, at int, free boolean"), "dedup-marked")


def shared_runs(docs: DataFrame, windows: DataFrame, cuts: DataFrame) -> DataFrame:
    """doc_id, sig, start, end (words) and kept_doc_id of each run of words that another document before this one keeps, written.

    windows: marked floating paragraphs; cuts: what is removed already. Only free ones are kept, and a run goes for the sake of a
    document before it alone, so all of its words are there in the end.
    """
    repeated = windows.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.max("free").alias("free")).where("lo <> hi and free").select("key")
    repeated = common.lookup(repeated, "dedup-keys")
    found = common.written(windows.join(repeated, "key"), "dedup-windows")
    common.dropped(repeated)
    kept = common.lookup(found.where("free").groupBy("key").agg(F.min(_place("at")).alias("kept")), "dedup-keepers")
    gone = found.join(kept, "key").where(_place() > F.struct("kept.none", "kept.doc_id", "kept.sig"))
    # Floating paragraphs that follow one another in both documents are one run.
    pair = Window.partitionBy("doc_id", "sig", "kept.doc_id", "kept.sig", F.col("at") - F.col("kept.at")).orderBy("at")
    begins = F.coalesce((F.col("at") > F.lag("at").over(pair) + WINDOW).cast("int"), F.lit(1))
    runs = gone.withColumn("begins", begins).withColumn("run", F.sum("begins").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("shift", F.col("at") - F.col("kept.at")).groupBy("doc_id", "sig", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.sig").alias("kept_sig"), "shift", "run")
    runs = runs.agg(F.min("at").alias("start"), (F.max("at") + WINDOW).alias("end"))
    runs = common.written(runs.withColumns({"kept_start": F.col("start") - F.col("shift"), "kept_end": F.col("end") - F.col("shift")}).drop("run", "shift"), "dedup-runs")
    common.dropped(found, kept)

    ends = runs.select("doc_id", "sig", "start", "end").union(runs.select("kept_doc_id", "kept_sig", "kept_start", "kept_end")).distinct()
    around = neighbours(docs, ends, cuts)
    same = lambda x: (F.col("doc_id").eqNullSafe(F.col(f"{x}doc")) & (F.col("sig") == F.col(f"{x}sig")) & (F.col("start") == F.col(f"{x}start")) & (F.col("end") == F.col(f"{x}end")))
    named = lambda x: around.toDF(*(f"{x}{c}" for c in ("doc", "sig", "start", "end", "run", "before", "after")))
    own = runs.join(named("o_"), same("o_")).select(*runs.columns, "o_run", "o_before", "o_after")
    other = F.col("kept_doc_id").eqNullSafe(F.col("k_doc")) & (F.col("kept_sig") == F.col("k_sig")) & (F.col("kept_start") == F.col("k_start")) & (F.col("kept_end") == F.col("k_end"))
    both = own.join(named("k_"), other).where("o_run = k_run")  # the words between the ends, verified: no edit at all

    def alike(x: str) -> Column:
        """Leading neighbours that both documents have."""
        n = F.least(F.size(f"o_{x}"), F.size(f"k_{x}"))
        first = F.array_position(F.zip_with(F.slice(f"o_{x}", 1, n), F.slice(f"k_{x}", 1, n), lambda a, b: a == b), False)
        return F.when(first > 0, first - 1).otherwise(n).cast("int")

    out = common.written(both.select("doc_id", "sig", (F.col("start") - alike("before")).alias("start"), (F.col("end") + alike("after")).alias("end"), "kept_doc_id"), "dedup-shared")
    common.dropped(runs, around)
    return out


def _beside(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """rows joined to other (d, s, ...) on the document: doc_id = d, null too, and sig = s."""
    return rows.join(other, rows["doc_id"].eqNullSafe(other["d"]) & (rows["sig"] == other["s"]), how).drop("d", "s")


def neighbours(docs: DataFrame, ends: DataFrame, cuts: DataFrame) -> DataFrame:
    """ends (doc_id, sig, start, end) with a hash of the words between them, and hashes of up to REACH words before start, nearest first, and after end, written.

    Words that are removed already (cuts), and what lies behind those, are no neighbours.
    """
    wanted = common.lookup(ends.groupBy(F.col("doc_id").alias("d"), F.col("sig").alias("s")).agg(F.collect_list(F.struct("start", "end")).alias("ends")), "dedup-ends")
    found = _beside(_beside(docs, wanted, "inner"), cuts, "left").select("doc_id", "sig", "text", "ends", "cuts")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(rows):
            h, owner, _, _ = textops.words(texts)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            short = (h >> U(32)).astype(np.uint32).view(np.int32)
            out: list[tuple] = []
            for i, (doc, sig, own, gone) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sig", "ends", "cuts")), strict=True)):
                words, whole = short[bounds[i] : bounds[i + 1]], h[bounds[i] : bounds[i + 1]]
                opens, closes = ([x[k] for x in gone or []] for k in ("start", "end"))
                for x in own:
                    a, b = x["start"], x["end"]
                    low, high = bisect.bisect_right(closes, a), bisect.bisect_left(opens, b)
                    low = max(0, a - REACH, closes[low - 1] if low else 0)
                    high = min(b + REACH, opens[high] if high < len(opens) else b + REACH)
                    told = textops.mix(whole[a:b] + np.arange(b - a, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                    out.append((doc, sig, a, b, int(told.view(np.int64)), words[low:a][::-1], words[b:high]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "sig", "start", "end", "run", "before", "after"])

    out = common.mapped(found, run, "doc_id long, sig long, start int, end int, run long, before array<int>, after array<int>")
    out = common.written(out.dropDuplicates(["doc_id", "sig", "start", "end"]), "dedup-neighbours")  # a repeated row gives its own again
    common.dropped(wanted)
    return out


def line_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """node and the distinct shingles of each class (node, place: its first line), written."""
    own = F.collect_list(F.struct(F.col("place.at").alias("at"), F.col("place.words").alias("words"), "node")).alias("own")
    wanted = common.lookup(places.groupBy(F.col("place.doc_id").alias("d"), F.col("place.sig").alias("s")).agg(own), "dedup-wanted")
    found = _beside(docs, wanted, "inner").select("text", "own")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(rows):
            h, owner, first, _ = textops.words(texts)
            lines = Lines(texts, h, owner, first)
            of = {(int(o), int(a), int(w)): i for i, (o, a, w) in enumerate(zip(lines.owner, lines.at, lines.words, strict=True))}
            nodes, sets = [], []
            for i, own in enumerate(batch.column("own").to_pylist()):
                for x in own:
                    no = of[i, x["at"], x["words"]]
                    nodes.append(x["node"])
                    sets.append(np.unique(lines.shingles[lines.bounds[no] : lines.bounds[no + 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = common.written(common.mapped(found, run, "node long, shingles array<long>"), "dedup-sets")
    common.dropped(wanted)
    if sets.count() > places.count():  # repeated rows of a document
        once = common.written(sets.dropDuplicates(["node"]), "dedup-sets")
        common.dropped(sets)
        sets = once
    return sets


def similar(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches per_cent, written."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("all"))
    return common.written(joined.where(100 * F.col("both") >= per_cent * (F.col("all") - F.col("both"))).select("a", "b").distinct(), "dedup-links")


def near_groups(docs: DataFrame, lines: DataFrame, per_cent: int) -> DataFrame:
    """s1, s2 and component of each class of equal lines that is similar to another one, written. A class is called by its s1."""
    banded = lines.select("s1", "s2", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("band")
    buckets = common.lookup(buckets, "dedup-buckets")
    met = common.written(banded.join(buckets, "band").groupBy(F.col("s1").alias("node"), "s2", "band").agg(F.count("*").alias("copies")), "dedup-met")
    common.dropped(buckets)
    classes = common.lookup(met.groupBy("node").agg(F.min("s2").alias("s2")), "dedup-classes")
    first = F.min(_place("at", "words")).alias("place")
    places = common.written(lines.join(classes.withColumnRenamed("node", "s1"), ["s1", "s2"]).groupBy(F.col("s1").alias("node")).agg(first), "dedup-places")
    sets = line_sets(docs, places)
    common.dropped(places)

    leads = common.lookup(met.groupBy("band").agg(F.max(F.struct("copies", F.xxhash64("node").alias("at"), "node"))["node"].alias("lead")), "dedup-leads")
    pairs = met.join(leads, "band").where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    links = similar(pairs, sets, per_cent)
    groups = components(links, "dedup-components")
    more = apart_pairs(met, sets, groups, per_cent)
    if not more.isEmpty():
        again = similar(more, sets, per_cent)
        common.dropped(groups)
        groups = components(links.union(again), "dedup-components")
        common.dropped(again)
    near = common.written(classes.join(groups, "node").select(F.col("node").alias("s1"), "s2", "component"), "dedup-near")
    common.dropped(met, classes, sets, leads, links, more, groups)
    return near


def apart_pairs(met: DataFrame, sets: DataFrame, groups: DataFrame, per_cent: int) -> DataFrame:
    """a and b: classes of different components that may be similar enough, of those in buckets that hold several components, written."""
    apart = met.select("node", "band").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = common.lookup(apart.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band"), "dedup-several")
    of = apart.join(several, "band").select("node", "component").distinct().join(sets, "node")
    of = common.written(of.select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "dedup-shingles")
    # Two sets of similarity t share one of the n - ceil(t * n) + 1 shingles that come first in any common order: here the rarest.
    counts = common.lookup(of.groupBy("shingle").count().where("count > 1"), "dedup-counts")
    ranked = of.join(counts, "shingle").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("all"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("all"))  # shingles of this class alone come first and are shared with nothing
    length = F.greatest(F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1 - F.col("alone"), F.lit(0)).cast("int")
    first = ranked.withColumn("first", F.transform(F.slice("all", F.lit(1), length), lambda x: x["shingle"]))
    bit = lambda least: F.aggregate("first", F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.when(F.pmod(x, F.lit(128)).between(least, least + 63), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(128)).cast("int") - least)).otherwise(0)))
    rare = first.select("node", "component", "n", "alone", F.size("first").alias("own"), bit(0).alias("low"), bit(64).alias("high"), F.posexplode("first").alias("before", "shingle"))
    rare = common.written(rare, "dedup-rare")
    mixed = common.lookup(rare.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle"), "dedup-mixed")
    keyed = rare.join(mixed, "shingle")
    columns = {"node": "", "component": "c", "n": "n", "alone": "u", "own": "o", "low": "x", "high": "y", "before": "r"}
    ours, theirs = (keyed.select("shingle", *(F.col(x).alias(f"{y}{c}") for x, y in columns.items())) for c in "ab")
    theirs = theirs.withColumnRenamed("shingle", "same")
    # What two sets share lies before a shared shingle in both prefixes, or behind it. Of all that is in a prefix, what has a bit that the
    # other one lacks is not shared, and behind the prefix that ends first lie as many shingles as that set needs, less one.
    lacks = {c: sum(F.bit_count(F.col(f"{x}{c}").bitwiseAND(F.bitwise_not(f"{x}{d}"))) for x in "xy") for c, d in ("ab", "ba")}
    left = {c: F.col(f"n{c}") - F.col(f"u{c}") - F.col(f"r{c}") for c in "ab"}
    most = F.least(F.least("ra", "rb") + F.least(left["a"], left["b"]), F.least(F.col("oa") - lacks["a"], F.col("ob") - lacks["b"]) + F.greatest(*(F.ceil(F.col(f"n{c}") * per_cent / 100) - 1 for c in "ab")))
    needed = per_cent * (F.col("na") + F.col("nb"))
    meet = ours.join(theirs, (F.col("shingle") == F.col("same")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ((100 + per_cent) * most >= needed))
    shared = meet.groupBy("a", "b").agg(F.count("*").alias("both"), *(F.max(c).alias(c) for c in ("na", "nb", "ua", "ub", "ra", "rb")))
    behind = F.least(F.col("na") - F.col("ua") - F.col("ra"), F.col("nb") - F.col("ub") - F.col("rb")) - 1
    more = common.written(shared.where((100 + per_cent) * (F.col("both") + behind) >= needed).select("a", "b"), "dedup-pairs")
    common.dropped(several, of, counts, rare, mixed)
    return more


def removed_lines(docs: DataFrame, paragraphs: DataFrame, per_cent: int) -> DataFrame:
    """doc_id, sig, start, end (words) and kept_doc_id of each line and block that goes, written.

    Of a component that has blocks, or lines outside of blocks, the first of these is kept: nothing else can remove it.
    Where there are only lines of blocks, the first of those whose block stays is kept.
    """
    lines = paragraphs.select("doc_id", "sig", F.inline("lines"))
    near = near_groups(docs, lines, per_cent)
    exact = lines.groupBy("s1", "s2").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("s1", "s2")
    exact = exact.join(near.select("s1", "s2"), ["s1", "s2"], "left_anti").select("s1", "s2", F.col("s1").alias("g1"), F.col("s2").alias("g2"))
    groups = common.lookup(near.select("s1", "s2", F.col("component").alias("g1"), F.lit(0).cast("long").alias("g2")).unionByName(exact), "dedup-groups")
    hit = common.written(lines.select("doc_id", "sig", "at", "words", "block", "s1", "s2").join(groups, ["s1", "s2"]).drop("s1", "s2"), "dedup-hit")
    common.dropped(near, groups)

    keep = F.min(_place("at")).alias("kept")
    outer = common.lookup(hit.where("block < 0").groupBy("g1", "g2").agg(keep), "dedup-kept")
    gone, used = hit.join(outer, ["g1", "g2"]).where(_other("kept")), [hit, outer]
    inner = hit.where("block >= 0").join(outer, ["g1", "g2"], "left_anti")
    if not inner.isEmpty():
        blocks = gone.where("block < 0").select(F.col("doc_id").alias("d"), F.col("sig").alias("s"), F.col("at").alias("cut_at")).distinct()
        own = inner["doc_id"].eqNullSafe(F.col("d")) & (inner["sig"] == F.col("s")) & (inner["block"] == F.col("cut_at"))
        blocks = common.lookup(blocks, "dedup-blocks")
        stay = common.written(inner.join(blocks, own, "left_anti"), "dedup-inner")
        first = common.lookup(stay.groupBy("g1", "g2").agg(keep), "dedup-kept")
        gone, used = gone.unionByName(stay.join(first, ["g1", "g2"]).where(_other("kept"))), [*used, blocks, stay, first]
    out = common.written(gone.select("doc_id", "sig", F.col("at").alias("start"), (F.col("at") + F.col("words")).alias("end"), F.col("kept.doc_id").alias("kept_doc_id")), "dedup-gone")
    common.dropped(*used)
    return out


def cuts_of(gone: DataFrame) -> DataFrame:
    """d, s (document) and cuts, its removed spans in order, joined where they touch, to be looked up."""
    doc = Window.partitionBy("doc_id", "sig").orderBy("start", "end")
    opens = (F.col("start") > F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    joined = gone.select("doc_id", "sig", "start", "end").withColumn("opens", F.coalesce(opens, F.lit(1))).withColumn("no", F.sum("opens").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("doc_id", "sig", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = joined.groupBy(F.col("doc_id").alias("d"), F.col("sig").alias("s")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    return common.lookup(cuts, "dedup-cuts")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and sig, the hash of both."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.withColumn("sig", F.xxhash64("doc_id", "text"))


def spans(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, sig and spans (start, end in words, kept_doc_id) of each document that loses text, written.

    Lines and blocks go first. What they leave is then searched for shared runs, so no run is removed for the sake of one that goes itself.
    """
    common.ship(docs.sparkSession)
    slim = _keyed(docs)
    paragraphs = read_paragraphs(slim)
    gone = removed_lines(slim, paragraphs, per_cent)
    cuts = cuts_of(gone)
    windows = marked_windows(paragraphs, cuts)
    common.dropped(paragraphs)
    runs = shared_runs(slim, windows, cuts)
    both = gone.unionByName(runs)
    out = common.written(both.groupBy("doc_id", "sig").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kept_doc_id"))).alias("spans")), "dedup-spans")
    common.dropped(gone, cuts, windows, runs)
    return out


def merged(found: list[dict]) -> list[tuple[int, int, int | None]]:
    """Spans in order, joined where they touch; of their kept documents the smallest."""
    out: list[list] = []
    for x in found:
        if out and x["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["end"])
            out[-1][2] = min((d for d in (out[-1][2], x["kept_doc_id"]) if d is not None), default=None)
        else:
            out.append([x["start"], x["end"], x["kept_doc_id"]])
    return [tuple(x) for x in out]


def cut(text: str, holes: list[tuple[int, int]]) -> str:
    """text without the byte ranges, and one line break or space for the white space around each."""
    data, parts, at, space = text.encode("utf-8", "surrogatepass"), [], 0, b""
    white = bytes(textops.SPACES)
    for a, b in [*holes, (len(data), len(data))]:
        part = data[at:a]
        if at:
            left = part.lstrip(white)
            space += part[: len(part) - len(left)]
            part = left
        if a < len(data):
            right = part.rstrip(white)
            space_after, part = part[len(right) :], right
        else:
            space_after = b""
        if part:
            parts += [b"\n" if b"\n" in space else b" ", part] if parts else [part]
            space = b""
        space += space_after
        at = b
    return b"".join(parts).decode("utf-8", "surrogatepass")


def _holes(texts: list[str | None], found: list[list[dict]]) -> Iterator[list[tuple[int, int, int, int | None]]]:
    """First and last-plus-one byte, words and kept document of each merged span, for each text."""
    _, owner, first, last = textops.words(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, own in enumerate(found):
        base = bounds[i]
        yield [(int(first[base + a]), int(last[base + b - 1]), b - a, kept) for a, b, kept in merged(own or [])]


def _with_spans(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    sig = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = found.select(F.col("doc_id").alias("_dedup_doc"), F.col("sig").alias("_dedup_sig"), F.col("spans").alias("_dedup_spans"))
    if common.small_enough(found):
        own = F.broadcast(own)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_dedup_doc")) & (sig == F.col("_dedup_sig"))
    return docs.join(own, same, how).drop("_dedup_doc", "_dedup_sig")


def passages(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """Each removed passage: doc_id, start_char, end_char (code points), n_words, kept_doc_id, the document that keeps it."""
    rows = _with_spans(docs.select("doc_id", "text"), spans(docs, per_cent), "inner")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "_dedup_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            out: list[tuple] = []
            for doc, text, holes in zip(batch.column("doc_id").to_pylist(), texts, _holes(texts, batch.column("_dedup_spans").to_pylist()), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                char = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                out += [(doc, int(char[a]), int(char[b]), n, kept) for a, b, n, kept in holes]
            columns = list(zip(*out, strict=True)) or [()] * 5
            names = ["doc_id", "start_char", "end_char", "n_words", "kept_doc_id"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    return common.mapped(rows, run, "doc_id long, start_char long, end_char long, n_words long, kept_doc_id long")


def deduplicated(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """docs without the removed passages, and without documents of which nothing is left."""
    rows = _with_spans(docs, spans(docs, per_cent), "left")
    lost = rows.where("_dedup_spans is not null")
    kept = rows.where("_dedup_spans is null").drop("_dedup_spans")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            new = [cut(t, [h[:2] for h in holes]) for t, holes in zip(texts, _holes(texts, batch.column("_dedup_spans").to_pylist()), strict=True)]
            whole = pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)
            yield whole.filter(pa.array([bool(t) for t in new]))

    return kept.unionByName(common.mapped(lost.withColumn("text", F.col("text").cast("string")), run, StructType([f for f in lost.schema.fields if f.name != "_dedup_spans"])))
