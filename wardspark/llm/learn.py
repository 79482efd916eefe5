"""Bounded training samples, byte n-gram features and small trainers, for several operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices



FOLDS = 5
DRAWS = 1 << 40


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 0 modulo 5.

    Rows without an id count as held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def bounded_sample(
    rows: DataFrame, label: str, per_class: int, max_classes: int, key: str = "doc_id"
) -> DataFrame:
    """About `per_class` rows of each of the most frequent classes.

    Classes are counted over all rows; each row is kept by a hash of its id at the rate
    its class needs, so nothing is sorted and the choice does not depend on partitions.
    """
    counts = (
        rows.groupBy(label).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc(label)).limit(max_classes).collect()
    )
    if not counts:
        return rows.limit(0)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(DRAWS))
    keep = F.lit(False)
    for row in counts:
        keep = keep | ((F.col(label) == F.lit(row[0])) & (draw < DRAWS * per_class // row["n"] + 1))
    return rows.where(keep)


def ngram_index(data: np.ndarray, order: int, dims: int) -> np.ndarray:
    """Bucket of the byte n-gram at every position but the last order-1."""
    n = len(data) - order + 1
    code = np.full(max(n, 0), order, dtype=np.uint32)
    for k in range(order):
        code = (code * np.uint32(0x01000193)) ^ data[k : k + n]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code ^= code >> np.uint32(12)
    code *= np.uint32(0x297A2D39)
    code ^= code >> np.uint32(15)
    return code & np.uint32(dims - 1)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, passes: int = 40) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; y is -1 or 1.

    The last weight is the bias, as a constant feature.  Classes weigh alike.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    soft = share / cost
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], dtype=x.dtype)
    norms = np.einsum("ij,ij->i", x, x) + soft
    order = np.random.default_rng(5)
    for _ in range(passes):
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norms[i])
            if new != alpha[i]:
                w += x.dtype.type((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


def logistic_scale(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope a >= 0 that makes sigmoid(a * margin) fit y in {-1, 1}; smoothed targets."""
    slopes = np.geomspace(0.1, 100, 61)
    target = 0.98
    losses = [
        np.mean(target * np.logaddexp(0, -a * y * margin) + (1 - target) * np.logaddexp(0, a * y * margin))
        for a in slopes
    ]
    return float(slopes[int(np.argmin(losses))])


def collect_vectors(
    rows: DataFrame, make, label: str, most: int
) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors of a bounded sample, made where the texts are, and their labels.

    They travel as 16-bit numbers: a row is two bytes per feature on the driver, and at
    most `most` rows are taken there (repeated ids could make a sample larger than meant).
    """

    def vectors(parts):
        for batch in slices(parts):
            made = make([t or "" for t in batch.column("text").to_pylist()]).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(label), pa.array([v.tobytes() for v in made], pa.binary())],
                ["label", "vector"],
            )

    kind = rows.schema[label].dataType.simpleString()
    made = rows.select("text", label).mapInArrow(vectors, f"label {kind}, vector binary")
    found = made.orderBy(F.xxhash64("label", "vector"), "label", "vector").limit(most).collect()
    found.sort(key=lambda r: (str(r.label), r.vector))
    x = np.array([np.frombuffer(r.vector, dtype=np.float16) for r in found], dtype=np.float32)
    return x, np.array([r.label for r in found])


