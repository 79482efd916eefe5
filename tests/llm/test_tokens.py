import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardspark.llm import packing, tokens

from .conftest import HARD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(make_docs, library):
    rows = {r.doc_id: r for r in tokens.token_counts(make_docs(HARD, extra=True)).collect()}
    assert len(rows) == len(HARD)
    for i, text in enumerate(HARD):
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].over_limit) == (want, want > 512)
        assert rows[i].n_bytes == len((text or "").encode())


def test_prefix_tables_answer_every_prefix(make_docs, library):
    words = tokens.vocabulary(tokens.default_vocabulary())
    for text in [t for t in HARD if t and len(t) < 300] + ["unbelievable antidisestablishment  x"]:
        ends, counts = words.table(text)
        want = [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        assert [words.prefix_count(text, ends, counts, n) for n in range(len(text) + 1)] == want, text
        for budget in range(0, int(counts[-1]) + 1):
            cut = words.fit(text, ends, counts, budget)
            assert want[cut] <= budget
            assert cut == max(n for n, c in enumerate(want) if c <= budget), text
    got = {r.doc_id: r for r in tokens.prefix_tables(make_docs(HARD)).collect()}
    assert got[0].counts == [] and got[14].counts[-1] == got[14].n_tokens


def test_empty_table(make_docs):
    assert tokens.token_counts(make_docs([])).collect() == []
    assert packing.pack_documents(make_docs([])).collect() == []


def check_packed(rows, texts, library, capacity=2048):
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert pieces.keys() == ids.keys()
    for i, found in pieces.items():
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        assert len(found) == -(-len(ids[i]) // capacity)
        assert [r.start for r in found] == list(np.cumsum([0] + [r.length for r in found[:-1]]))
        assert sum(r.length for r in found) == len(ids[i])
        assert all(r.length == capacity for r in found[1:])
    for places in sequences.values():
        places.sort()
        assert [p for p, _ in places] == list(np.cumsum([0] + [n for _, n in places[:-1]]))
        assert sum(n for _, n in places) <= capacity
    return len(sequences), sum(map(len, ids.values()))


def test_packing_keeps_every_id(make_docs, library):
    rows = packing.pack_documents(make_docs(HARD, extra=True)).collect()
    check_packed(rows, dict(enumerate(HARD)), library)


def test_packing_in_rounds_is_nearly_full(make_docs, library):
    texts = [f"word{i} " * (i * 37 % 400 + 1) for i in range(600)]
    docs = make_docs(texts)
    rows = packing.pack_documents(docs, part_items=50, fan_in=2).collect()
    bins, total = check_packed(rows, dict(enumerate(texts)), library)
    assert bins <= 1.04 * total / 2048 + 1


def test_packing_that_cannot_join_ends(spark):
    items = spark.range(100).selectExpr("id item", "1100L length")
    packed = packing.pack_items(items, part_items=10, fan_in=2).collect()
    assert len({r.bin for r in packed}) == 100 and {r.offset for r in packed} == {0}


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 4, 5]), 10)
    assert sorted(fills) == [10, 10] and bins[0] == bins[2] and bins[1] == bins[3]


def test_repeated_ids_are_packed_one_by_one(make_docs):
    rows = packing.pack_documents(make_docs([(None, "a b", None), (None, "a b", None)])).collect()
    assert len(rows) == 2 and {r.offset for r in rows} == {0, 3}


def test_both_libraries_agree_on_every_code_point(library):
    words = tokens.vocabulary(tokens.default_vocabulary())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}. " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for i in range(0, len(texts), 2000):
        part = texts[i : i + 2000]
        for text, want in zip(part, library.encode_batch_fast(part, add_special_tokens=False)):
            assert words.ids(text).tolist() == want.ids
            assert words.total(text) == len(want.ids)
