"""Language identification by mixtures: which languages a document is made of, and how much of each.

Each language has an n-gram model: the probability of a byte of a word given up to three bytes before it, counts of
longer contexts backed off to shorter ones, n-grams hashed to a fixed number of cells. A document's words are drawn
from a mixture of languages. Expectation-maximisation estimates the proportions from the words' n-gram likelihoods:
for the best single language, then with one language more at a time, for as long as a perfect fit of all words would still
improve the penalised likelihood; the set with the best one stays.

The models are fitted on a bounded sample of labelled documents: about FIT_DOCS of each language, drawn by a hash of
doc_id. Everything else runs over all documents and whole texts.

Letters alone count. A text that is null or has no letter is `und` with score 0; so is any text if no labelled document
can be learned from. Of languages with equal proportions the first in code order is predicted. Very long texts are
read whole, as the words that they have. Rows without doc_id are predicted and never learned from. Repeated rows stay; an empty table gives
an empty table. Other columns are kept, replaced if named as an added one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm import bpe, common

UNKNOWN = "und"
#: Labelled documents of a language in the sample, about.
FIT_DOCS = 2000
#: Cells of the hashed trigrams and of the 4-grams of one language.
CELLS = 1 << 17
#: Weight of the shorter context, steps of expectation-maximisation, penalty of each language more in a mixture.
BACK_OFF, STEPS, PENALTY = 2.0, 12, 3.0
_WORD = re.compile(r"[^\W\d_]+")


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """First place of each word, and at each place (a byte of a word, or its end) the cells of the n-grams that end there, and of their contexts."""
    data = [w.encode() for w in words]
    raw = np.frombuffer(b"   " + b"   ".join(data) + b"   ", np.uint8).astype(np.uint64)
    size = np.array([len(x) + 1 for x in data], np.int64)
    first = np.cumsum(size) - size
    skip = 3 + 2 * np.arange(len(words))
    at = np.arange(int(size.sum())) + np.repeat(skip, size)

    def cell(*bytes_: np.ndarray) -> np.ndarray:
        h = bytes_[0]
        for b in bytes_[1:]:
            h = h << np.uint64(8) | b
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)).astype(np.int64)

    b0, b1, b2, b3 = (raw[at - i] for i in range(4))
    exact = lambda *x: sum(v.astype(np.int64) << 8 * i for i, v in enumerate(reversed(x)))
    return first, [exact(b0), exact(b1, b0), cell(b2, b1, b0), cell(b3, b2, b1, b0)], [exact(b1), exact(b2, b1), cell(b3, b2, b1)]


SIZES = (256, 1 << 16, CELLS, CELLS)


class Model:
    """Counts of n-grams of 1 to 4 bytes by language, as arrays of languages by cells."""

    def __init__(self, languages: list[str], counts: list[np.ndarray]):
        self.languages, self.counts = languages, [c.astype(np.float32) for c in counts]

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """Of each word under each language."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        first, grams, contexts = _grams(words)
        out = []
        for i in range(len(self.languages)):
            one, *more = (c[i] for c in self.counts)
            p = (one[grams[0]] + 1) / (one.sum() + 256)
            for c, before, gram, context in zip(more, self.counts, grams[1:], contexts):
                p = (c[gram] + BACK_OFF * p) / (before[i][context] + BACK_OFF)
            out.append(np.add.reduceat(np.log(p), first))
        return np.stack(out, 1).astype(np.float32)


def bag(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and rows of (text, word, count) of the words of all texts, in order of text."""
    found = [_WORD.findall(t.lower()) if t else [] for t in texts]
    coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
    plain = [_letters(w) for w in coded.dictionary.to_pylist()]
    words = sorted(set(plain) - {""})
    place = {w: i for i, w in enumerate(words)}
    code = np.array([place.get(w, -1) for w in plain], np.int64)
    code = code[coded.indices.to_numpy()] if len(plain) else code
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    key, count = np.unique((owner * len(words) + code)[code >= 0], return_counts=True)
    return words, key // max(1, len(words)), key % max(1, len(words)), count


def mixtures(texts: list[str | None], model: Model) -> np.ndarray:
    """Proportions of the languages in each text, 0 for those not selected; a row of zeros for a text without letters."""
    languages = len(model.languages)
    words, owner, word, n = bag(texts)
    out = np.zeros((len(texts), languages))
    if not len(owner) or not languages:
        return out
    docs, start = np.unique(owner, return_index=True)
    row_doc = np.repeat(np.arange(len(docs)), np.diff(np.append(start, len(owner))))
    n = n.astype(np.float32)
    total = np.add.reduceat(n, start)
    logs = model.log_likelihoods(words)[word]
    alone = np.add.reduceat(logs * n[:, None], start)
    top = logs.max(1)
    rel = np.exp(logs - top[:, None])
    base = np.add.reduceat(n * top, start)
    some = np.arange(len(docs))
    first = alone.argmax(1)
    chosen = np.zeros((len(docs), languages), bool)
    chosen[some, first] = True
    share = chosen.astype(np.float32)
    score = alone[some, first]
    selected = chosen.copy()
    out[docs] = share
    for size in range(2, languages + 1):
        # No mixture fits better than base; the penalty only grows, so a document that stops here never goes on.
        open_ = base - PENALTY * (size - 1) * np.log(total + 1) > score
        if not open_.any():
            break
        if not open_.all():
            rows = open_[row_doc]
            rel, n, row_doc = rel[rows], n[rows], (np.cumsum(open_) - 1)[row_doc[rows]]
            docs, base, total, score, share, selected = (x[open_] for x in (docs, base, total, score, share, selected))
            start, some = np.searchsorted(row_doc, np.arange(len(docs))), np.arange(len(docs))
        # One language more: the one that explains best what the mixture so far explains badly.
        held = np.maximum(np.einsum("rl,rl->r", rel, share[row_doc]), 1e-30)
        gain = np.add.reduceat(n[:, None] * np.log((held[:, None] + rel / size)), start)
        gain[selected] = -np.inf
        selected = selected.copy()
        selected[some, gain.argmax(1)] = True
        pi = selected / size
        pi = pi.astype(np.float32)
        for _ in range(STEPS):
            r = rel * pi[row_doc]
            z = np.maximum(r.sum(1), 1e-30)
            pi = np.add.reduceat(r * (n / z)[:, None], start) / total[:, None]
        fit = base + np.add.reduceat(n * np.log(np.maximum((rel * pi[row_doc]).sum(1), 1e-30)), start)
        better = fit - PENALTY * (size - 1) * np.log(total + 1) > score
        score = np.where(better, fit - PENALTY * (size - 1) * np.log(total + 1), score)
        share[better] = pi[better]
        out[docs] = share
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Counts n-grams of the sample, in tasks, and gathers the sums: a bounded number of cells for each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    counts = [np.zeros((len(languages), s)) for s in SIZES]
    if not languages:
        return Model(languages, counts)
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, fit_docs / sizes[lang])))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = known.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(languages), s), np.int64) for s in SIZES]
        number = {lang: i for i, lang in enumerate(languages)}
        for batch in rows:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for start, texts in bpe.batches(batch.column("text").to_pylist()):
                words, owner, word, n = bag(texts)
                if not words:
                    continue
                first, grams, _ = _grams(words)
                places = np.repeat(np.arange(len(words)), np.diff(np.append(first, len(grams[0]))))
                for lang in np.unique(langs[start : start + len(texts)]):
                    mine = langs[start : start + len(texts)][owner] == lang
                    weight = np.bincount(word[mine], n[mine], len(words))[places]
                    for s, g in zip(sums, grams, strict=True):
                        s[lang] += np.bincount(g, weight, s.shape[1]).astype(np.int64)
        for order, s in enumerate(sums):
            lang, cell = np.nonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lang), order, np.int32)), pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(s[lang, cell])], names=["o", "lang", "cell", "n"])

    cells = common.mapped(sample, count, "o int, lang int, cell int, n long").groupBy("o", "lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    o, lang, cell, n = (cells.column(c).to_numpy() for c in ("o", "lang", "cell", "n"))
    for i, table in enumerate(counts):
        table[lang[o == i], cell[o == i]] = n[o == i]
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (its proportion) and languages (each selected language with its proportion)."""
    names = ["lang_pred", "score", "languages"]
    kept = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        kind = pa.map_(pa.string(), pa.float64())
        for batch in rows:
            for start, texts in bpe.batches(batch.column("text").to_pylist(), 1 << 21):
                pi = mixtures(texts, own)
                best = pi.argmax(1) if len(own.languages) else np.zeros(len(texts), int)
                score = [float(x.max()) if len(x) and x.any() else 0.0 for x in pi]
                lang = [own.languages[b] if s else UNKNOWN for b, s in zip(best, score, strict=True)]
                mixed = [[(own.languages[i], float(x[i])) for i in np.flatnonzero(x)] for x in pi]
                new = [pa.array(lang), pa.array([min(1.0, s) for s in score], pa.float64()), pa.array(mixed, kind)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(texts)) for c in batch.columns), *new], names=[*batch.schema.names, *names])

    return common.mapped(kept, run, StructType([*kept.schema.fields, *StructType.fromDDL("lang_pred string, score double, languages map<string,double>").fields]))


def identified(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred, score and languages. doc_id, source and lang play no part in a prediction."""
    common.ship(docs.sparkSession)
    return predict(docs, fit(docs)).withColumn("held_out", held_out(F.col("doc_id")))
