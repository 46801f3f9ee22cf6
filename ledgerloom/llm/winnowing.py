"""Document fingerprints by winnowing, in DataFrame functions only.

A text is read as units: runs of at most UNIT letters, digits and marks, and other non-space characters one by one, so
that a text without spaces has many units too. Each k neighbouring units have a hash, built by doubling: the hash of
2m units comes from two hashes of m units. In every window of w such hashes the smallest is chosen, of equal ones the
rightmost. Chosen hashes are kept once each, with their positions (in units, from 0).

Guarantee: two texts that share w + k - 1 neighbouring units share a whole window, so its hash is in both fingerprints.

A text with fewer than k units has one hash, of all its units; with fewer than w hashes, one window. A text without
units (null, empty or white space) has the hash of nothing. Equal texts have equal fingerprints, and of equal hashes in a window
the rightmost is kept. A very long text is one array of units in its task. Repeated rows stay;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common

UNIT = 6
UNITS = rf"[\p{{L}}\p{{M}}\p{{N}}]{{1,{UNIT}}}|[^ \t-\r\p{{Z}}\p{{L}}\p{{M}}\p{{N}}]"
#: Units in a hash and hashes in a window; both powers of two, as doubling needs.
K, W = 8, 16
_LOW = 0xFFFFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def pairs(values: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """join(x[i], x[i + step]) for each i where both are there."""
    return let(values, lambda a: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))), F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))), join))


def doubled(values: Column, n: int, join: Callable[[Column, Column], Column]) -> Column:
    """What join makes of each n neighbours, n a power of two."""
    step = 1
    while step < n:
        values = pairs(values, step, join)
        step *= 2
    return values


def minima(hashes: Column, w: int) -> Column:
    """The rightmost smallest of each window, as structs of hash and position from 0, in order of position, once each.

    Hashes are ordered by their upper 32 bits. With the position below them, negated, a window's choice is the
    smallest of plain numbers, and the whole hash is looked up again at the end.
    """

    def chosen(h: Column) -> Column:
        keys = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.lit(_LOW) - i))
        smallest = let(keys, lambda a: F.when(F.size(a) < w, F.array(F.array_min(a))).otherwise(doubled(a, w, lambda x, y: F.least(x, y))))
        places = F.transform(F.array_distinct(smallest), lambda x: (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("int"))
        return F.transform(places, lambda i: F.struct(F.get(h, i).alias("hash"), i.alias("position")))

    return let(hashes, chosen)


def kgrams(text: Column, k: int) -> Column:
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNITS), 0)
    few = lambda u: F.array(F.xxhash64(F.concat_ws(" ", u)))
    many = lambda u: doubled(F.transform(u, lambda x: F.xxhash64(x)), k, lambda a, b: F.xxhash64(a, b))
    return let(units, lambda u: F.when(F.size(u) < k, few(u)).otherwise(many(u)))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen hashes with their positions: array<struct<hash: bigint, position: int>>."""
    return minima(kgrams(text, k), w)


def hashes(chosen: Column) -> Column:
    """The distinct hashes of a fingerprint, sorted."""
    return F.sort_array(F.array_distinct(F.transform(chosen, lambda x: x["hash"])))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def digest(chosen: Column) -> Column:
    """A fingerprint as one string: equal for equal fingerprints, positions included."""
    return F.sha2(F.to_json(chosen), 256)


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame], per_bucket: int = 4) -> DataFrame:
    """derive(docs) with next, a struct of its columns but doc_id of the next row by (doc_id, text), null doc_id first; after the last comes the first.

    Rows are dealt to ranges of doc_id, whose bounds are quantiles. Each range also gets the first row of the one
    after it, so that a window within ranges finds every next row: one exchange of the texts.
    """
    rows = docs.select("doc_id", "text")
    n = per_bucket * common.partitions(docs.sparkSession)
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    bounds = sorted(set(found))
    # The number of bounds that are not above doc_id; null is below all.
    bucket = F.lit(0)
    if bounds:
        array = F.array(*map(F.lit, bounds))
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.array_size(F.filter(array, lambda b: b <= F.col("doc_id"))))
    rows = rows.withColumn("bucket", bucket)
    order = [F.asc_nulls_first("doc_id"), F.asc("text")]
    # The first doc_id of each range, and the range before it: a row a range.
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("first_id"))
    around = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy())
    firsts = firsts.select("bucket", "first_id", F.coalesce(F.lag("bucket").over(around), last).alias("before"))
    heads = rows.join(F.broadcast(firsts.withColumnRenamed("bucket", "own")), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = heads.groupBy("before").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("bucket"), F.lit(True).alias("stands_in"))
    both = derive(rows.withColumn("stands_in", F.lit(False))).unionByName(derive(heads))
    names = [c for c in both.columns if c not in ("doc_id", "bucket", "stands_in")]
    in_range = Window.partitionBy("bucket").orderBy("stands_in", *order)
    return both.withColumn("next", F.lead(F.struct(*names)).over(in_range)).where("not stands_in").drop("stands_in", "bucket")


def edited(text: Column, following: Column) -> Column:
    """text with its last half (rounded down) replaced by as many characters of the following text, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def compared(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like they and the next text's are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def derive(df: DataFrame) -> DataFrame:
        df = df.withColumn("chosen", fingerprint(F.col("text"), k, w))
        return df.withColumn("fingerprint", digest(F.col("chosen"))).withColumn("a", hashes(F.col("chosen"))).drop("chosen")

    rows = with_next(rows, derive)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next.text")))
    rows = rows.select("doc_id", "fingerprint", "a", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), k, w).alias("chosen"), F.col("next.a").alias("c"))
    rows = rows.withColumn("edited_fingerprint", digest(F.col("chosen"))).withColumn("b", hashes(F.col("chosen")))
    near = [likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next")]
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near, F.size("a").alias("n_hashes"))
