import random
from collections import Counter

import numpy as np
import pytest

from wardspark.llm import dedup as M

from .conftest import HARD, word_list


def bag(text):
    words = word_list(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute(rows):
    """doc index -> least doc_id of its class, over all pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min([x for x in (least.get(root(i)), doc) if x is not None], default=None)
    return sorted(((doc, least[root(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def classes(docs):
    return sorted(((r.doc_id, r.class_id) for r in M.duplicate_classes(docs).collect()), key=str)


def edit(words, draw, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return words


def planted(draw):
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(30, 200))]
        for _ in range(draw.randint(1, 6)):
            rows.append(" ".join(edit(base, draw, draw.choice([0, 0, 1, 2, 4]))))
    chain = [draw.choice(vocabulary) for _ in range(100)]
    for _ in range(12):  # each like the one before, ends unlike
        rows.append(" ".join(chain))
        chain = edit(chain, draw, 1)
    return list(enumerate(rows))


def test_classes_equal_those_of_all_pairs(make_docs):
    rows = planted(random.Random(4))
    got = classes(make_docs([(i, t, None) for i, t in rows], extra=True))
    assert got == brute(rows)


@pytest.mark.parametrize("stars", [1, 8])
def test_one_large_group_whose_members_differ(make_docs, monkeypatch, stars):
    draw = random.Random(8)
    base = [f"w{draw.randrange(400)}" for _ in range(120)]
    rows = [(i, " ".join(edit(base, draw, draw.randint(0, 5)))) for i in range(150)]
    monkeypatch.setattr(M, "STARS", stars)
    monkeypatch.setattr(M, "SALT_MEMBERS", 7)
    assert classes(make_docs([(i, t, None) for i, t in rows])) == brute(rows)


def test_hard_texts_copies_nulls(make_docs):
    rows = list(enumerate(HARD)) + [(None, "no id here at all"), (None, "no id here at all"), (60, "No ID: here, at all")]
    rows += [(50, "%%%"), (51, "%%%"), (52, "$$$"), (53, None), (53, None)]
    docs = make_docs([(i, t, None) for i, t in rows], extra=True)
    assert classes(docs) == brute(rows)
    kept = M.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, c in brute(rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_copies_alone_and_empty(make_docs):
    docs = make_docs(["a b c d e f", "a b c d e f", "quite another text"])
    assert classes(docs) == [(0, 0), (1, 0), (2, 2)]
    alone = make_docs([(None, "same", None)] * 3)
    assert classes(alone) == [(None, None)] * 3
    assert M.one_of_each(alone).count() == 1
    assert M.duplicate_classes(make_docs([])).collect() == []
    assert M.one_of_each(make_docs([])).collect() == []


def test_signatures_estimate_weighted_similarity():
    draw = random.Random(2)
    off = []
    for _ in range(60):
        x = [draw.choice(["a", "b", "c", f"w{draw.randrange(200)}"]) for _ in range(draw.randint(20, 150))]
        y = edit(x, draw, draw.randint(1, 6))
        rows, wordy = M.signatures([" ".join(x), " ".join(y), ""], 480)
        assert wordy.tolist() == [True, True, False]
        off.append((rows[0] == rows[1]).mean() - jaccard(bag(" ".join(x)), bag(" ".join(y))))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def test_signatures_do_not_depend_on_the_batch():
    texts = ["one two three four five six", "a", "b c " * 500, "x y z w v u t s r q p"]
    together, _ = M.signatures(texts)
    for i, t in enumerate(texts):
        assert (M.signatures([t])[0][0] == together[i]).all()


@pytest.mark.parametrize("n", [2, 9, 40])
def test_components_of_a_path(spark, n):
    links = spark.createDataFrame([(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(n)], "a binary, b binary")
    got = M.components(links, "a", "b").collect()
    assert len(got) == n + 1 and {bytes(r.label) for r in got} == {b"000"}


def test_rare_units_find_all_pairs_that_are_alike(make_docs, spark):
    draw = random.Random(21)
    base = [f"w{draw.randrange(60)}" for _ in range(70)]
    texts = [" ".join(edit(base[draw.choice([0, 0, 3]) :], draw, draw.randint(0, 4))) for _ in range(60)]
    texts += [" ".join(f"w{draw.randrange(60)}" for _ in range(70)) for _ in range(10)]
    docs = make_docs(list(dict.fromkeys(texts)))
    named = docs.select("doc_id", "text", M.node_of().alias("node"))
    members = M.stage(named.select("node", M.F.col("node").alias("label")), "members")
    found = M.rare_meetings(docs, members, members.select("node"), 0.8)
    ids = {bytes(r.node): r.doc_id for r in named.collect()}
    got = {(ids[bytes(r.node)], ids[bytes(r.star)]) for r in found.collect()}
    rows = {r.doc_id: bag(r.text) for r in named.collect()}
    want = {(a, b) for a in rows for b in rows if a != b and jaccard(rows[a], rows[b]) >= 0.8}
    assert want and want <= got
