"""Product codes of vectors: each part of a vector becomes the number of its codebook's nearest entry, codebooks by Yinyang Lloyd in integers.

Components become whole numbers, floor(scale * x). The codebook of each part position starts as that part of the first vectors by
vec_id; every round assigns all parts and replaces entries by their parts' mean, rounded down. An assignment keeps, for
each part, an upper bound of the distance to its entry and one lower bound for each group of entries: of all entries of the
group but its own. When entries move, bounds are adjusted by how far. Only where a group's lower bound does not exceed
the upper bound are the group's entries looked at, in whole numbers, so that of entries at the same distance the lower number
wins; bounds are rounded to the safe side. The result is that of comparing with every entry.

A round reads and writes one table of rows with codes and bounds, sums parts by entry in each worker, and sends the sums, as many as
codebooks have components, to the driver. Nothing else leaves the workers.

Rows whose vector is null or holds null or non-finite components are dropped. A vector whose length is no positive multiple of the
parts or not that of the others (that of the first by vec_id), or that holds a component beyond LARGEST, has a null code and error
and no part in training. Rows without vec_id come last in order; repeated rows each count, rows of one vec_id in order of their vectors. With
fewer vectors than entries a codebook has fewer entries. Rows without label have one label together. Without vectors there are no entries. An empty
table gives an empty table. Columns other than the ones that are named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a group, about.
GROUP = 4
#: Whole numbers up to which squared distances of 64 components fit into 63 bits.
LARGEST = 1 << 27


@dataclass
class Books:
    """entries: parts x entries x components; groups: the group of each entry; drift: how far it moved in the last update."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.groups.max()) + 1

    def moved(self, sums: dict[tuple[int, int], tuple[list[int], int]]) -> Books:
        """The books after an update; entries without parts stay."""
        new = self.entries.copy()
        for (part, entry), (total, n) in sums.items():
            new[part, entry] = [x // n for x in total]
        return Books(new, self.groups, np.sqrt(((new - self.entries) ** 2).sum(2).astype(np.float64)))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def grouped(entries: np.ndarray, size: int = GROUP) -> np.ndarray:
    """Groups of near entries of each part's book, by a few rounds of k-means among them. Which groups decides the work, not the result."""
    parts, n, _ = entries.shape
    out = np.zeros((parts, n), np.int64)
    for p in range(parts):
        points = entries[p].astype(np.float64)
        centers = points[:: max(1, size)][: max(1, n // size)].copy()
        for _ in range(5):
            out[p] = ((points[:, None] - centers) ** 2).sum(2).argmin(1)
            for g in range(len(centers)):
                if (own := out[p] == g).any():
                    centers[g] = points[own].mean(0)
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(-1)


class Assigner:
    """Assigns the parts at one position to the entries of their book. looked: distances computed so far."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray, drift: np.ndarray, n_groups: int):
        self.entries, self.groups, self.drift = entries, groups, drift
        self.members = [np.flatnonzero(groups == g) for g in range(n_groups)]
        self.far = np.array([drift[m].max(initial=0) for m in self.members])
        self.empty = np.array([len(m) == 0 for m in self.members])
        self.looked = 0

    def adjusted(self, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds after the entries moved."""
        return _up(upper + self.drift[code]), _down(lower - self.far)

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Renews code, upper and lower in place. x: parts x components, whole numbers; lower: parts x groups."""
        lower[:, self.empty] = np.inf
        at = np.flatnonzero(lower.min(1) <= upper)
        if not len(at):
            return
        x, old, bounds = x[at], code[at], lower[at]
        best = own = _distances(x, self.entries[old])
        self.looked += len(at)
        now, seen = old.copy(), np.zeros(bounds.shape, bool)
        nearest, second, who = (np.zeros(bounds.shape, t) for t in (np.int64, np.float64, np.int64))
        for g, members in enumerate(self.members):
            r = np.flatnonzero(bounds[:, g] <= _up(np.sqrt(best.astype(np.float64))))
            if not len(r):
                continue
            d = _distances(x[r][:, None], self.entries[members])
            self.looked += d.size
            first = d.argmin(1)  # of the same distance the lower number: members ascend
            low = d[np.arange(len(r)), first]
            seen[r, g], nearest[r, g], who[r, g] = True, low, members[first]
            if len(members) > 1:
                d[np.arange(len(r)), first] = np.iinfo(np.int64).max
                second[r, g] = np.sqrt(d.min(1).astype(np.float64))
            else:
                second[r, g] = np.inf
            better = (low < best[r]) | ((low == best[r]) & (members[first] < now[r]))
            best = best.copy()
            best[r[better]], now[r[better]] = low[better], members[first][better]
        others = np.where(who == now[:, None], second, np.sqrt(nearest.astype(np.float64)))
        bounds = np.where(seen, _down(others), bounds)
        changed = np.flatnonzero(now != old)
        home = self.groups[old[changed]]
        left = changed[~seen[changed, home]], home[~seen[changed, home]]
        bounds[left] = np.minimum(bounds[left], _down(np.sqrt(own[left[0]].astype(np.float64))))
        code[at], upper[at], lower[at] = now, _up(np.sqrt(best.astype(np.float64))), bounds


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def whole_numbers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE, vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and x (whole numbers, null where they cannot be used) of the rows that are kept."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            kept, out = [], []
            for i, v in enumerate(batch.column("v")):
                if not v.is_valid:
                    continue
                values = v.values
                if values.null_count or not np.isfinite(x := values.to_numpy(zero_copy_only=False).astype(np.float64)).all():
                    continue
                kept.append(i)
                x = np.floor(x * scale)
                good = len(x) and len(x) % parts == 0 and np.abs(x).max() <= LARGEST
                out.append(x.astype(np.int32) if good else None)
            index = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(index), batch.column("label").take(index), pa.array(out, pa.list_(pa.int32()))], names=["vec_id", "label", "x"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return own.mapInArrow(run, StructType([*own.schema.fields[:2], *StructType.fromDDL("x array<int>").fields]))


def assigned(state: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, x, code, upper and lower. state: the same with the bounds of the books before, or without codes and bounds at first."""
    parts, _, width = books.entries.shape
    n_groups, begun = books.n_groups, "code" in state.columns
    fields = [state.schema[c] for c in ("vec_id", "label", "x")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigners = [Assigner(books.entries[p], books.groups[p], books.drift[p], n_groups) for p in range(parts)]
        for batch in rows:
            n = batch.num_rows
            x = _matrix(batch.column("x"), parts * width).astype(np.int64).reshape(n, parts, width)
            if begun:
                code, upper = _matrix(batch.column("code"), parts).astype(np.int64), _matrix(batch.column("upper"), parts).copy()
                lower = _matrix(batch.column("lower"), parts * n_groups).reshape(n, parts, n_groups).copy()
            else:  # nothing is known: every group is looked at
                code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, n_groups), np.float32)
            for p, a in enumerate(assigners):
                c, u, b = code[:, p].copy(), upper[:, p], lower[:, p]
                if begun:
                    u, b = a.adjusted(c, u, b)
                a.assign(x[:, p], c, u, b)
                code[:, p], upper[:, p], lower[:, p] = c, u, b
            new = [_lists(code.astype(np.int16), pa.int16()), _lists(upper, pa.float32()), _lists(lower.reshape(n, -1), pa.float32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *new], names=[*(f.name for f in fields), "code", "upper", "lower"])

    return state.mapInArrow(run, StructType([*fields, *StructType.fromDDL("code array<smallint>, upper array<float>, lower array<float>").fields]))


def sums(state: DataFrame, books: Books) -> dict[tuple[int, int], tuple[list[int], int]]:
    """Componentwise sum and number of the parts of each entry that has any, by part and entry."""
    parts, entries, width = books.entries.shape

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in rows:
            x = _matrix(batch.column("x"), parts * width).astype(np.int64).reshape(-1, parts, width)
            code = _matrix(batch.column("code"), parts)
            for p in range(parts):
                for i in range(width):  # a batch's sums stay below 2 ** 53, so they are whole
                    total[p, :, i] += np.bincount(code[:, p], x[:, p, i], entries).astype(np.int64)
                n[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(n)
        if len(p):
            places = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), total[p, e].ravel(), np.repeat(n[p, e], width)]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in places], names=["part", "entry", "place", "total", "n"])

    rows = state.select("x", "code").mapInArrow(run, "part long, entry long, place long, total long, n long")
    rows = rows.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    out: dict[tuple[int, int], tuple[list[int], int]] = {}
    for r in rows.collect():  # as many as the codebooks have components
        out.setdefault((r.part, r.entry), ([0] * width, r.n))[0][r.place] = int(r.total)
    return out


def _digests(state: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code as hexadecimal digits and error, the squared distances of all parts."""
    parts, _, width = books.entries.shape

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = _matrix(batch.column("x"), parts * width).astype(np.int64).reshape(-1, parts, width)
            code = _matrix(batch.column("code"), parts)
            error = sum(_distances(x[:, p], books.entries[p][code[:, p]]) for p in range(parts))
            shown = [bytes(c).hex() for c in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(shown, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    fields = [state.schema[c] for c in ("vec_id", "label")]
    return state.mapInArrow(run, StructType([*fields, *StructType.fromDDL("code string, error long").fields]))


def trained(usable: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books] | None:
    """The rows (vec_id, label, x) with their last codes, written, and the last books; None where there is no row."""
    first = usable.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    if not first:
        return None
    start = np.array([r.x for r in first], np.int64)
    start = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    books = Books(start, grouped(start), np.zeros(start.shape[:2]))
    state = common.written(assigned(usable, books), "codes-state")
    for _ in range(rounds):
        books = books.moved(sums(state, books))
        found = common.written(assigned(state, books), "codes-state")
        common.dropped(state)
        state = found
    return state, books


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error (of all rows of the same label) and codebooks_sha256."""
    common.ship(vectors.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256: a code has a byte for each part")
    kept = common.written(whole_numbers(vectors, parts, scale, vector, label), "codes-vectors")
    first = kept.where("x is not null").select(F.min_by("x", F.struct(F.col("vec_id").isNull(), "vec_id", "x")).alias("x")).first().x
    fits = F.coalesce(F.size("x") == F.lit(len(first) if first is not None else 0), F.lit(False)) & F.col("x").isNotNull()
    found = trained(kept.where(fits), parts, entries, rounds)
    none = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    digests = none if found is None else _digests(*found).unionByName(none)
    digests = common.written(digests, "codes-digests")
    common.dropped(kept, *([] if found is None else [found[0]]))
    totals = common.lookup(digests.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error")), "codes-labels")
    sha = hashlib.sha256(b"").hexdigest() if found is None else found[1].sha256()
    out = digests.join(totals, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
