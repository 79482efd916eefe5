"""Operator 6: quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are byte trigrams of the whole text and marks of how often a word follows
itself.  Weighted terms of a bounded labelled sample are reduced by a truncated SVD; the
sample's unit vectors (at most 2 * per_class * 2 rows of `RANK` numbers, a few MB) go to
all tasks.  Each text is projected the same way, its cosines to the whole sample are
computed exactly, block by block, and its nearest neighbours vote, weighted by similarity.

A text without terms (null, empty) gets the share of label 1 among the sample; without
any labels every score is 0.5.  Repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .common import batch_words, slices
from .learn import bounded_sample, collect_vectors, held_out, ngram_index

DIMS = 4096
MARKS = 16
MARK_WEIGHT = 4.0
RANK = 64
NEIGHBOURS = 21
SHARPNESS = 8
BLOCK = 2048
THRESHOLD = 0.3


def vectors(texts: list[str]) -> np.ndarray:
    """Logarithms of term counts, before weighting."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    starts = np.cumsum([0] + [len(p) for p in parts])
    index = ngram_index(data, 3, DIMS)
    out = np.zeros((len(texts), DIMS + MARKS), dtype=np.float32)
    hashes, firsts = batch_words(texts)
    for i, (a, b) in enumerate(zip(starts, starts[1:])):
        part = index[a : max(a, b - 2)]
        if len(part):
            out[i, :DIMS] = np.log1p(np.bincount(part, minlength=DIMS))
        words = hashes[firsts[i] : firsts[i + 1]]
        if len(words) > 1:
            share = float((words[1:] == words[:-1]).mean())
            out[i, DIMS : DIMS + round(share * MARKS)] = MARK_WEIGHT
    return out


class QualityModel:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        seen = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
        x = self._weigh(x)
        rank = min(RANK, *x.shape)
        rng = np.random.default_rng(11)
        start = rng.standard_normal((len(x), min(rank + 16, *x.shape)), dtype=np.float32)
        basis = np.linalg.qr(x.T @ start)[0]
        for _ in range(4):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, turned = np.linalg.svd(x @ basis, full_matrices=False)
        self.project = (basis @ turned.T[:, :rank]).astype(np.float32)
        self.points = self._unit(x @ self.project)
        self.labels = y.astype(np.float32)
        self.prior = float(y.mean())

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        """Rows scaled to length one, in place."""
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        return x

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        terms = vectors(texts)
        points = self._unit(self._weigh(terms) @ self.project)
        k = min(NEIGHBOURS, len(self.points))
        best = np.full((len(points), k), -2.0, dtype=np.float32)
        votes = np.zeros((len(points), k), dtype=np.float32)
        for a in range(0, len(self.points), BLOCK):
            cosines = points @ self.points[a : a + BLOCK].T
            near = np.hstack([best, cosines])
            label = np.hstack([votes, np.broadcast_to(self.labels[a : a + BLOCK], cosines.shape)])
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            best, votes = np.take_along_axis(near, top, 1), np.take_along_axis(label, top, 1)
        weight = np.clip(best, 0, 1).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        share = (weight * votes).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where((terms.any(axis=1)) & (total > 1e-12), np.clip(share, 0, 1), self.prior)


def learn_quality(
    docs: DataFrame, labels: DataFrame, per_class: int = 1000
) -> QualityModel | None:
    """A model from a bounded sample of each label, of rows that are not held out.

    Ids with labels that differ are left out; repeated labels count once.
    """
    ship_package(docs.sparkSession)
    marks = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("_other")
    ).where("label = _other").drop("_other")
    chosen = bounded_sample(marks, "label", per_class, 2)
    known = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    x, y = collect_vectors(known, vectors, "label", 4 * per_class)
    return QualityModel(x, y) if len(x) else None


def score_quality(
    docs: DataFrame, model: QualityModel | None, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """All columns of docs with the score and the prediction; texts stay where they are read.

    `names` are the columns added; docs may have no others of these names.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts):
        for batch in slices(parts):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = np.full(len(texts), 0.5)
            if shared.value is not None:
                scores = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(scores, pa.float64()),
                    pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32()),
                ],
                [*batch.schema.names, *names],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{fields}, `{names[0]}` double, `{names[1]}` int")


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row per document: held_out, score and predicted."""
    scored = score_quality(docs.select("doc_id", "text"), learn_quality(docs, labels, **settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
