import random
import re
from itertools import permutations

import numpy as np
import pytest

from wardspark.llm import filters

from .conftest import HARD

WORD = re.compile("[^\x20\x09-\x0d]+")


def failures(rows):
    """Set of failed letters per row."""
    found = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any(
            i is not None and i < doc_id and (t or "") == text for i, t, _ in rows
        ):
            fails.add("E")
        found.append(fails)
    return found


def brute(rows, labels):
    """Every order, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = failures(rows)
    out, by_filter = {}, {}
    parts = {lang or "" for _, _, lang in rows}
    for part in parts:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, name in enumerate(order, 1):
                gone = [k for k in left if name in mine[k][1]]
                left = [k for k in left if name not in mine[k][1]]
                everyone = sum(name in f for _, f in mine)
                out[part, "".join(order), step] = [
                    len(left), len(gone), everyone - len(gone), sum(f == {name} for _, f in mine),
                    sum(mine[k][0] in good for k in gone), sum(mine[k][0] in toxic for k in gone),
                ]
                by_filter[part, name] = by_filter.get((part, name), 0) + len(gone)
    return {
        key: (*values, by_filter[key[0], key[1][key[2] - 1]]) for key, values in out.items()
    }


def prose(draw):
    words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([0, 50, 99, 100, 101, 160]))]
    if draw.random() < 0.3:
        words = [draw.choice(["one", "two"]) if draw.random() < 0.3 else w for w in words]
    if draw.random() < 0.3:
        words = [w.upper() for w in words]
    if draw.random() < 0.3:
        words += ["50%"]
    return draw.choice([" ", "\n", "\x0b", "\x0c \t"]).join(words)


def test_against_every_order(spark, make_docs):
    draw = random.Random(3)
    pool = [prose(draw) for _ in range(25)] + HARD
    rows = [(draw.choice([i, i, i, None]), draw.choice(pool), draw.choice(["en", "de", None, ""])) for i in range(220)]
    rows += rows[:30]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 240, 2)]
    labels += [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filters.audit_filters(make_docs(rows, extra=True), table).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got}
    assert len(got) == len(found) and found == brute(rows, labels)


@pytest.mark.parametrize("seed", range(5))
def test_gray_walk_equals_every_subset(seed):
    draw = random.Random(seed)
    cells = {m: np.array([draw.randrange(9), draw.randrange(9)]) for m in draw.sample(range(32), 1 + 6 * seed)}
    states = filters.gray_walk(cells, 5)
    for subset in range(32):
        want = sum((c for m, c in cells.items() if not m & subset), np.zeros(2, dtype=int))
        assert states[subset].tolist() == want.tolist()


def test_copies_and_empty(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit_filters(make_docs([]), labels).collect() == []
    cells = filters.failure_cells(make_docs([(7, "a", "x"), (3, "a", "y"), (3, "a", "x"), (9, "a", "x"), (None, "a", "x")]), labels)
    assert {(r.part, r.mask): r.n for r in cells.collect()} == {("x", 17): 2, ("x", 1): 2, ("y", 1): 1}
