"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Features are byte bigrams and trigrams of the whole text (ASCII lower-cased; every ASCII character that is no letter
counts as a blank), hashed into DIMENSIONS. Document frequencies cover all labelled training rows. Vectors are
log-scaled, weighted by inverse document frequency and normalised. Each language has several centroids, found by
spherical k-means on a sample of its training rows. A text gets the language of the centroid with the largest
cosine, which is the score. It is rejected where the cosine is below `margin` times a low quantile of the cosines that
the language's training texts have at its length: texts of no letters, and texts unlike any language. These cosines
are measured on the sampled texts cut to each of LENGTHS letters, as short texts of any language lie far from every
centroid. A text's length is its number of different n-grams, so that a word said a thousand times is a short text;
between the measured lengths the least cosine is interpolated by their logarithms.

The sample is the training rows with the smallest hash share of doc_id, about `per_language` for a language; that
bound is a parameter. Counts of documents and n-grams cover all rows.

Cases: null texts and texts without a letter are 'und' with score 0 and rejected; training rows without a letter or
language are left out; without any training row every text is 'und'; equal cosines go to the language that sorts
first; repeated rows are judged each; a null doc_id is predicted but not learned from; other columns are kept by
accepted and not read by predicted; an empty table gives no rows; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import frugal, parts, small_batches, text_bytes

DIMENSIONS = 4096
#: Letters (bytes of letters) at which least cosines are measured.
LENGTHS = (4, 16, 64, 256, 1024)
_BLOCK_ROWS, _WINDOW = 128, 500_000
_code = np.arange(256)
_letter = (_code >= 0x80) | ((_code >= 0x61) & (_code <= 0x7A)) | ((_code >= 0x41) & (_code <= 0x5A))
_MAP = np.where(_letter, np.where(_code < 0x80, _code | 0x20, _code), 0x20).astype(np.uint32)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each hashed n-gram stands in each text: one row of DIMENSIONS for each text."""
    n = len(offsets) - 1
    out = np.zeros(n * DIMENSIONS, np.int32)
    for lo in range(0, len(data), _WINDOW):
        m = _MAP[data[lo : lo + _WINDOW + 2]]
        row = (np.searchsorted(offsets, np.arange(lo, lo + len(m)), "right") - 1).astype(np.int32) if n > 1 else np.zeros(len(m), np.int32)
        two = ((m[:-1] * np.uint32(0x9E3779B1)) ^ (m[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0x2C1B3C6D)
        three = ((two[:-1] ^ (m[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F))
        for grams, span in ((two, 1), (three, 2)):
            begins = min(len(grams), _WINDOW)
            same = row[:begins] == row[span : span + begins]
            if same.any():
                # the rows of a window are few where texts are long
                first = int(row[0])
                key = (row[:begins][same] - first) * DIMENSIONS + (grams[:begins][same] >> np.uint32(20)).astype(np.int32)
                found = np.bincount(key)
                out[first * DIMENSIONS : first * DIMENSIONS + len(found)] += found.astype(np.int32)
    return out.reshape(n, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = counts.astype(np.float32)
    np.log1p(v, out=v)
    v *= idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v /= np.where(norm > 0, norm, 1)
    return v


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def beginning(text: bytes, letters: int) -> bytes:
    """The text up to its letter of that number; all of it if it has fewer."""
    at = np.flatnonzero(_letter[np.frombuffer(text, np.uint8)])
    return text[: int(at[letters - 1]) + 1] if len(at) >= letters else text


def least_cosines(texts: list[bytes], c: np.ndarray, idf: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """(length, cosine): for the texts of at least each of LENGTHS letters, cut to it, the logarithm of their median number of n-grams and the quantile of their cosines."""
    out = [(0.0, 0.0)]
    for n in LENGTHS:
        cut = [beginning(t, n) for t in texts if int(_letter[np.frombuffer(t, np.uint8)].sum()) >= n]
        if cut:
            counts = gram_counts(np.frombuffer(b"".join(cut), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in cut])]))
            length = float(np.log(max(1.0, np.median((counts > 0).sum(axis=1)))))
            cosine = float(np.quantile((vectors(counts, idf) @ c.T).max(axis=1), quantile))
            if length > out[-1][0]:
                out.append((length, max(cosine, out[-1][1])))
    return tuple(np.array(out).T)


def centroids(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the first row and then from rows far from all chosen."""
    chosen = [sample[0]]
    for _ in range(min(k, len(sample)) - 1):
        chosen.append(sample[int(np.argmin(np.max(sample @ np.array(chosen).T, axis=1)))])
    c = np.array(chosen)
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = sample[own == j].mean(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-9)
    return c


@dataclass
class LanguageModel:
    languages: list[str]  #: of each centroid
    idf: np.ndarray
    matrix: np.ndarray
    least: list[tuple[np.ndarray, np.ndarray]]  #: of each centroid, lengths and the cosines below which texts of these are rejected


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in parts(whole, "text", _WINDOW):
            for at in range(0, part.num_rows, _BLOCK_ROWS):
                yield part.slice(at, _BLOCK_ROWS)


@frugal
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMENSIONS, np.int64), 0
    for b in _blocks(batches):
        total += (gram_counts(*text_bytes(b.column("text"))) > 0).sum(axis=0)
        n += b.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMENSIONS), -1)), pa.array(np.append(total, n))], names=["gram", "n"])


@frugal
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches):
        counts = gram_counts(*text_bytes(b.column("text"))).clip(max=65535).astype("<u2")
        begin = [beginning(t.encode(), LENGTHS[-1]) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(begin, pa.binary())], names=["doc_id", "lang", "counts", "begin"])


def fitted(training: DataFrame, *, per_language: int = 300, max_languages: int = 400, clusters: int = 4, margin: float = 0.5, quantile: float = 0.05) -> LanguageModel | None:
    """Learn from rows (doc_id, text, lang). About per_language rows of each language come to the driver as counts and beginnings.

    max_languages bounds what a dirty label column can ask for: the labels with the most rows are learned.
    """
    small_batches(training.sparkSession)
    rows = training.filter(F.col("text").cast("string").rlike(r"\p{L}")).filter("lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not found:
        return None
    df = {r["gram"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + df[-1]) / (1 + np.array([df[i] for i in range(DIMENSIONS)]))).astype(np.float32) + np.float32(0.05)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in sorted(found.items())])
    few = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    sample = sorted((r["lang"], r["doc_id"], bytes(r["counts"]), bytes(r["begin"])) for r in few.mapInArrow(_sampled, "doc_id long, lang string, counts binary, begin binary").collect())
    languages, matrix, least = [], [], []
    for lang in sorted({s[0] for s in sample}):
        own = vectors(np.array([np.frombuffer(c, "<u2") for l, _, c, _ in sample if l == lang]), idf)
        c = centroids(own, clusters)
        length, cosine = least_cosines([t for l, _, _, t in sample if l == lang], c, idf, quantile)
        languages += [lang] * len(c)
        matrix.append(c)
        least += [(length, margin * cosine)] * len(c)
    return LanguageModel(languages, idf, np.concatenate(matrix), least)


def judge(model: LanguageModel | None, batch: pa.RecordBatch) -> tuple[list[str], list[float], list[bool]]:
    """Language, cosine and rejection of each row."""
    texts = batch.column("text").to_pylist()
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    counts = gram_counts(*text_bytes(batch.column("text")))
    cos = vectors(counts, model.idf) @ model.matrix.T
    best = np.argmax(cos, axis=1)
    score = np.clip(cos[np.arange(len(best)), best], 0, 1)
    length = np.log(np.maximum((counts > 0).sum(axis=1), 1))
    far = np.zeros(len(best), bool)
    for j in set(best.tolist()):
        far[best == j] = score[best == j] < np.interp(length[best == j], *model.least[j])
    said = [has_letter(t) for t in texts]
    return [model.languages[b] if s else "und" for b, s in zip(best, said)], [float(x) if s else 0.0 for x, s in zip(score, said)], [bool(f) or not s for f, s in zip(far, said)]


def predicted(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            lang, score, rejected = judge(shared.value, b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents, unchanged, whose language is not rejected; in the same pass, without a join."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            yield b.filter(pa.array([not r for r in judge(shared.value, b)[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str) -> Column:
    """Every fifth document by the checksum of its id is never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
