import random
from collections import Counter

import pytest

from wardspark.llm import decontamination as D

from .conftest import HARD, word_list


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs, items, similarity=0.8):
    """(document, item) -> best weighted similarity over all item-sized windows."""
    found = {}
    for i, text in docs:
        words = word_list(text)
        for j, item in items:
            target = word_list(item)
            if not words or not target or len(target) < 5 and len(words) != len(target):
                continue
            goal = bag(target)
            for s in range(max(1, len(words) - len(target) + 1)):
                window = bag(words[s : s + len(target)])
                shared = sum((window & goal).values())
                sim = shared / (sum(window.values()) + sum(goal.values()) - shared)
                if sim >= similarity - 1e-9:
                    found[i, j] = max(found.get((i, j), 0), sim)
    return found


@pytest.fixture
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_planted_passages_against_brute_force(make_docs, make_items):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(j, " ".join(prose(draw.randint(14, 70)))) for j in range(25)]
    items += [(25, items[0][1]), (26, ""), (27, None), (28, "two words")]
    docs = []
    for i in range(120):
        passage = word_list(draw.choice(items[:25])[1])
        for _ in range(draw.choice([0, 0, 1, 2, 3])):
            k = draw.randrange(len(passage))
            passage[k : k + draw.choice([0, 1])] = draw.choice([[], prose(1), prose(1)])
        passage = passage[draw.choice([0, 0, 2]) :]
        docs.append((i, " ".join(prose(draw.randint(0, 60)) + passage + prose(draw.randint(0, 60))), None))
    docs += [(200 + i, " ".join(prose(80)), None) for i in range(30)] + [(300, "Two, words!", None)]
    want = brute([d[:2] for d in docs], items)
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(make_docs(docs, extra=True), make_items(items)).collect()}
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(r.similarity == pytest.approx(want[k]) and r.distance <= D.RADIUS for k, r in got.items())
    kept = {r.doc_id for r in D.without_passages(make_docs(docs, extra=True), make_items(items)).collect()}
    assert kept == {d[0] for d in docs} - {i for i, _ in want}


def test_reordered_passages_and_short_items(make_docs, make_items):
    """Halves swapped, and sentences of 20 words in another order, against all windows."""
    draw = random.Random(8)
    prose = lambda n: [f"w{draw.randrange(400)}" for _ in range(n)]
    items = [(j, " ".join(prose(n))) for j, n in enumerate([40, 59, 59, 80, 120])]
    docs = []
    for i, (_, text) in enumerate(items):
        w, half = word_list(text), len(word_list(text)) // 2
        docs.append((i, " ".join(prose(30) + w[half:] + w[:half] + prose(30)), None))
        sentences = [w[k : k + 20] for k in range(0, len(w), 20)]
        docs.append((10 + i, " ".join(prose(9) + sum(sentences[::-1], []) + prose(50)), None))
    docs += [(100 + i, " ".join(prose(90)), None) for i in range(20)]
    want = brute([d[:2] for d in docs], items)
    assert {(1, 1), (2, 2), (3, 3), (4, 4)} <= want.keys()
    short = [(90, "zeta"), (91, "alpha beta gamma delta"), (92, "gamma beta")]
    docs += [(200, "x Alpha beta, gamma delta y zeta z", None), (201, "alpha beta gamma", None), (202, "zeta", None)]
    want |= {(200, 90): 1.0, (200, 91): 1.0, (202, 90): 1.0}
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(make_docs(docs), make_items(items + short)).collect()}
    assert got == pytest.approx(want)


def test_hard_texts_copies_and_empty(make_docs, make_items):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [*HARD, f"x {passage.upper()}, y", f"x {passage.upper()}, y", passage, "six seven eight nine ten"]
    items = make_items([(7, passage), (7, passage), (8, None), (None, "no id has this item of words")])
    docs = make_docs(rows)
    got = sorted((r.doc_id, r.item_id, r.similarity) for r in D.contaminated(docs, items).collect())
    n = len(HARD)
    assert got == [(n, 7, 1.0), (n + 1, 7, 1.0), (n + 2, 7, 1.0)]
    kept = D.without_passages(docs, items)
    assert kept.columns == docs.columns and kept.count() == n + 1
    assert D.contaminated(docs, make_items([])).collect() == []
    assert D.contaminated(make_docs([]), items).collect() == []
    assert D.without_passages(docs, make_items([])).count() == len(rows)


def test_repeated_words_are_weighted(make_docs, make_items):
    item = "na na na na na na na na hey hey hey hey good bye now"
    docs = [(0, "la " + item, None), (1, "na " * 300, None), (2, "na na na na na na hey hey hey good bye now", None)]
    want = brute([d[:2] for d in docs], [(0, item)])
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(make_docs(docs), make_items([(0, item)])).collect()}
    assert got == pytest.approx(want)


def test_blocks_find_all_within_the_radius(spark):
    draw = random.Random(5)
    base = [draw.getrandbits(64) - (1 << 63) for _ in range(60)]
    near = []
    for v in base:
        for _ in range(4):
            flips = draw.sample(range(64), draw.randint(0, 24))
            x = (v + (1 << 63)) ^ sum(1 << f for f in flips)
            near.append(x - (1 << 63))
    a = spark.createDataFrame([(i, 1, v) for i, v in enumerate(base)], "i int, words int, fingerprint long")
    b = spark.createDataFrame([(j, 1, v) for j, v in enumerate(near)], "j int, words int, other long")
    got = D.within_radius(a, b, "words").select("i", "j").collect()
    want = {(i, j) for i, v in enumerate(base) for j, u in enumerate(near) if ((v ^ u) & (2**64 - 1)).bit_count() <= D.RADIUS}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_simhash_bits(spark):
    draw = random.Random(9)
    sets = [[draw.getrandbits(64) - (1 << 63) for _ in range(draw.randint(1, 40))] for _ in range(20)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, shingles array<long>")
    for r in D.simhash(df, ["i"]).collect():
        s = [v & (2**64 - 1) for v in sets[r.i]]
        want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in s) > len(s))
        assert r.fingerprint & (2**64 - 1) == want
