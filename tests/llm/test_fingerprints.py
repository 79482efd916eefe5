import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.llm import fingerprints as P

from .conftest import HARD, word_list

SAMPLE = "/root/testdata/sf0.01"


def shingle_set(text):
    words = word_list(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {text}


def edited_texts(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        out.append((i, text, text[: len(text) - cut] + after[:cut], after))
    return out


def check(docs, got):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = edited_texts(rows)
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(
        ((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want), key=key
    )
    return want


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    got = P.fingerprint_documents(docs).collect()
    want = check(docs, got)
    by_id = {r.doc_id: r for r in got}
    sets = {i: (shingle_set(t), shingle_set(e), shingle_set(n)) for i, t, e, n in want}
    wrong = [abs(by_id[i].near_edited - jaccard(a, e)) for i, (a, e, _) in sets.items()]
    assert np.mean(wrong) < 0.08 and np.quantile(wrong, 0.99) < 0.35
    wrong = [abs(by_id[i].near_next - jaccard(a, n)) for i, (a, _, n) in sets.items()]
    assert np.mean(wrong) < 0.02
    wrong = [abs(by_id[i].edited_holds - len(a & e) / len(a)) for i, (a, e, _) in sets.items()]
    assert np.mean(wrong) < 0.08
    prints = {}
    for i, text, _, _ in want:
        assert prints.setdefault(text, by_id[i].fingerprint) == by_id[i].fingerprint


@pytest.mark.parametrize("range_bytes", [1, 200, 1 << 24])
def test_order_of_hard_texts(make_docs, range_bytes, monkeypatch):
    rows = [(i * 7 % 31 - 3, t, None) for i, t in enumerate(HARD)]
    rows += [(None, "no id", None), (None, "nor this", None), (4, "twice", None), (4, "twice", None)]
    docs = make_docs(rows, extra=True)
    monkeypatch.setattr(P.with_next, "__defaults__", (range_bytes,))
    check(docs, P.fingerprint_documents(docs).collect())


def test_short_texts_are_compared_exactly(make_docs):
    rows = P.fingerprint_documents(make_docs(["a b c d e f g h", "a b c d e f g x", "a b c d e f g x"])).collect()
    got = {r.doc_id: r for r in rows}
    assert got[0].near_next == pytest.approx(3 / 5) and got[1].near_next == 1.0 == got[1].next_holds
    assert got[1].fingerprint == got[2].fingerprint != got[0].fingerprint


def test_single_and_empty(make_docs):
    (one,) = P.fingerprint_documents(make_docs(["alone in here"])).collect()
    assert one.near_next == 1.0
    assert P.fingerprint_documents(make_docs([])).collect() == []


def test_merged_parts_hold_what_the_whole_holds(spark):
    words = [f"w{i}" for i in range(4000)]
    parts = spark.createDataFrame(
        [(" ".join(words[:2004]), " ".join(words[2000:]), " ".join(words))], "a string, b string, c string"
    )
    for name in "abc":
        parts = P.with_sketch(parts, name, f"s_{name}")
    row = parts.select(P.merge(F.col("s_a"), F.col("s_b")).alias("merged"), "s_c").first()
    assert row.merged == row.s_c
    assert 0.08 < len(row.s_c) / 3996 < 0.17
