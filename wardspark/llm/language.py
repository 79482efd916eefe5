"""Operator 10: language of a text, family first, then pairs of languages within it.

Texts are whole; their features are counts of byte n-grams of the letters, by logarithm.
One linear SVM per family tells it from the others; inside a family there is one linear
SVM for each pair of languages and the language with most votes wins.

The model learns every language there is, from a bounded sample of rows that are not held
out: `per_language` documents of each, or fewer of each where more than `budget_languages`
languages share the budget of `per_language * budget_languages`; at least MIN_PER_LANGUAGE
of each, as far as it has them.  A null text and one without
letters is `und` with score 0; so is every text if nothing can be learned.  Repeated rows
are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .common import slices
from .learn import (
    bounded_sample, collect_vectors, held_out, logistic_scale, ngram_index, train_svm,
)

# Families of languages by their codes; a code not listed here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
ORDERS = (2, 3, 4)
DIMS = 2048
MIN_PER_LANGUAGE = 20
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one blank between words; the texts' offsets in them."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    starts = np.cumsum([0] + [len(p) + 1 for p in parts])
    keep[starts] = True  # the blank before each text
    data = np.where(letter, data, np.uint8(32))
    return data[keep], np.cumsum(np.append(0, keep))[starts]


def vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors of logarithms of n-gram counts."""
    data, starts = _letters(texts)
    out = np.zeros((len(texts), DIMS * len(ORDERS)), dtype=np.float32)
    for k, order in enumerate(ORDERS):
        index = ngram_index(data, order, DIMS)
        for i, (a, b) in enumerate(zip(starts, starts[1:])):
            part = index[a : max(a, b - order + 1)]
            if len(part):
                out[i, k * DIMS : (k + 1) * DIMS] = np.log1p(np.bincount(part, minlength=DIMS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class LanguageModel:
    """Weight table (n-gram bucket by decision), biases and slopes of all decisions."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.languages = sorted(set(y.tolist()))
        self.families = sorted({family_of(c) for c in self.languages})
        of = np.array([family_of(c) for c in y])
        tasks = [(np.ones(len(y), bool), of == f) for f in self.families]
        self.members = {f: [c for c in self.languages if family_of(c) == f] for f in self.families}
        self.pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        tasks += [(np.isin(y, p), y == p[0]) for p in self.pairs]
        columns, self.slopes = [], []
        for rows, positive in tasks:
            part, sign = x[rows], np.where(positive[rows], 1.0, -1.0)
            if abs(sign.sum()) == len(sign):  # one family only
                columns.append(np.append(np.zeros(x.shape[1]), sign[0]))
                self.slopes.append(1.0)
                continue
            fit = np.arange(len(part)) % 4 > 0
            trial = train_svm(part[fit], sign[fit]) if len(set(sign[fit])) > 1 else None
            rest = part[~fit] @ trial[:-1] + trial[-1] if trial is not None else sign[~fit]
            self.slopes.append(logistic_scale(rest, sign[~fit]))
            columns.append(train_svm(part, sign))
        table = np.array(columns)
        self.bias = table[:, -1]
        self.weights = table[:, :-1].T.astype(np.float32)

    def margins(self, texts: list[str]) -> np.ndarray:
        return vectors(texts) @ self.weights + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not texts:
            return [], []
        chance = 1 / (1 + np.exp(-np.clip(self.margins(texts) * np.array(self.slopes), -60, 60)))
        family = chance[:, : len(self.families)]
        chosen = family.argmax(axis=1)
        names, scores = [], []
        for i, text in enumerate(texts):
            if not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            members = self.members[self.families[chosen[i]]]
            wins = dict.fromkeys(members, 0.0)
            shares = dict.fromkeys(members, 0.0)
            for j, (a, b) in enumerate(self.pairs):
                if a in wins:
                    p = float(chance[i, len(self.families) + j])
                    wins[a if p >= 0.5 else b] += 1
                    shares[a] += p
                    shares[b] += 1 - p
            best = max(members, key=lambda c: (wins[c], shares[c]))
            inside = shares[best] / (len(members) - 1) if len(members) > 1 else 1.0
            names.append(best)
            scores.append(float(family[i, chosen[i]] * inside))
        return names, scores


def learn_languages(
    docs: DataFrame, per_language: int = 300, budget_languages: int = 16
) -> LanguageModel | None:
    """A model from a bounded sample of rows with text and lang that are not held out."""
    ship_package(docs.sparkSession)
    known = docs.where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select("doc_id", "text", "lang")
    languages = max(known.select("lang").distinct().count(), 1)
    share = min(per_language, max(MIN_PER_LANGUAGE, per_language * budget_languages // languages))
    sample = bounded_sample(known, "lang", share, languages)
    x, y = collect_vectors(sample, vectors, "lang", 2 * share * max(languages, budget_languages))
    return LanguageModel(x, y) if len(x) else None


def predict_languages(
    docs: DataFrame, model: LanguageModel | None, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """All columns of docs with the language and its score; texts stay where they are read.

    `names` are the columns added; docs may have no others of these names.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(parts):
        for batch in slices(parts):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if shared.value is not None:
                found, scores = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, *names],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predict, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def identify(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: held_out, lang_pred and score."""
    predicted = predict_languages(docs.select("doc_id", "text"), learn_languages(docs, **settings))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
