"""Quality classifier by compression: how much better a dictionary of good texts compresses a text than one of bad texts.

Two zstandard dictionaries are built from labelled texts. A text is cut into pieces of PIECE bytes, each compressed with either
dictionary; `(bad size - good size) / (bad size + good size)`, summed over the whole text, is the normalised difference.
A logistic curve fitted on labelled texts that the dictionaries have not seen turns it into a probability of label 1.

Only the fit is bounded: it reads at most `sample` labelled documents per label, chosen by hashes of their id,
and PIECES pieces of each. Half of them make the dictionaries, the other half the curve. Scores read every byte of every
text. Only the text enters a score.

Defined cases: null text is empty; an empty text has difference 0. Labels that are null or neither 0 nor 1 are not learnt from;
repeated rows and labels count once per row. If either label has no text, every text scores the share of label 1 (0.5
without any). Extra columns stay.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

PIECE, PIECES, LEVEL, DICTIONARY = 512, 64, 3, 110 * 1024
ACCEPTED = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    shift: float


@functools.lru_cache(maxsize=4)
def _compressors(model: QualityModel):
    import zstandard

    def one(data: bytes):
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)

    return one(model.good), one(model.bad)


def _cut(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def difference(model: QualityModel, text: str | None) -> float:
    good, bad = _compressors(model)
    g = b = 0
    for piece in _cut(text):
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - g) / (b + g) if b + g else 0.0


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit by Newton steps with a light ridge, which keeps separable samples finite. The bulk of each side counts
    alike whatever the differences' scale."""
    scale = x.std() or 1.0
    design, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    ridge = np.diag([0.05, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _dictionary(texts: list[str | None]) -> bytes:
    import zstandard

    pieces = []
    for text in texts:
        cut = _cut(text)
        # a long text gives pieces from all of its length
        pieces += cut if len(cut) <= PIECES else [cut[k * len(cut) // PIECES] for k in range(PIECES)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces)[-DICTIONARY:] or b"        "


def fit(labelled: DataFrame, sample: int = 3_000) -> QualityModel:
    """A model from rows (doc_id, text, quality); at most `sample` rows per label are read."""
    rows = labelled.where("quality IN (0, 1)").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    # about a third more than is asked for passes by hash, so tasks send little more than the sample to the driver
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = {q: min(1.0, (1.3 * sample + 100) / max(1, shares.get(q, 0))) for q in (0, 1)}
    parts = {q: [r["text"] for r in rows.where((F.col("quality") == q) & (near <= int(share[q] * (1 << 30)))).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample).select("text").collect()] for q in (0, 1)}
    total = sum(shares.values())
    if not (parts[0] and parts[1]):
        prior = shares.get(1, 0) / total if total else 0.5
        prior = min(max(prior, 0.01), 0.99)
        return QualityModel(b" " * 8, b" " * 8, 0.0, math.log(prior / (1 - prior)))
    even = {q: parts[q][::2] for q in parts}
    odd = {q: parts[q][1::2] or parts[q] for q in parts}
    raw = QualityModel(_dictionary(even[1]), _dictionary(even[0]), 1.0, 0.0)
    x = np.array([difference(raw, t) for q in (0, 1) for t in odd[q]])
    y = np.array([float(q) for q in (0, 1) for _ in odd[q]])
    slope, shift = _curve(x, y)
    # the sample holds the labels in other shares than the corpus
    shift += math.log(shares[1] / shares[0]) - math.log(len(odd[1]) / len(odd[0]))
    return QualityModel(raw.good, raw.bad, slope, shift)


def with_score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """`docs` with a column `score` (0 to 1; higher: label 1 is likelier) computed from `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema.fields if f.name != "score"] + [T.StructField("score", T.DoubleType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            z = [m.slope * difference(m, t.as_py()) + m.shift for t in batch.column("text")]
            score = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], names=[*kept, "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, quality) of the rows that may be learnt from."""
    marks = labels.where("quality IN (0, 1)").where(~held_out()).select("doc_id", "quality")
    return docs.select("doc_id", "text").join(marks, "doc_id")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = 3_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs` (doc_id, text)."""
    scored = with_score(docs.select("doc_id", "text"), fit(labelled_texts(docs, labels), sample))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, sample: int = 3_000) -> DataFrame:
    """The documents that the classifier accepts, columns as given."""
    scored = with_score(docs, fit(labelled_texts(docs, labels), sample))
    return scored.where(F.col("score") >= ACCEPTED).select(docs.columns)
