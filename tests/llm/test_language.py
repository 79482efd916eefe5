import zlib

import numpy as np
import pytest

from wardspark.llm import language

from .conftest import HARD

SAMPLE = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_learns_only_from_the_other_folds(make_docs):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "le chat est dans la maison", "fr") for i in ids]
    rows += [(i, "the cat is in the house", "en") for i in range(200) if i not in ids]
    got = language.identify(make_docs(rows)).collect()
    assert {r.lang_pred for r in got} == {"en"}


def test_hard_texts(make_docs):
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(HARD)]
    rows += [(100 + i, f"the cat number {i}", "en") for i in range(40)]
    rows += [(200 + i, f"le chat numéro {i}", "fr") for i in range(40)]
    rows += [(200, "le chat numéro 0", "fr"), (None, "le chat", "fr")]
    got = {r.doc_id: r for r in language.identify(make_docs(rows, extra=True)).collect()}
    assert len(got) == len(rows) - 1
    for i, text in enumerate(HARD):
        assert (got[i].lang_pred == "und") == (not any(map(str.isalpha, text or "")))
    assert got[None].lang_pred == "fr" and got[None].held_out


def test_nothing_to_learn_from_and_empty(make_docs):
    assert {r.lang_pred for r in language.identify(make_docs(["a text", None])).collect()} == {"und"}
    assert language.identify(make_docs([])).collect() == []


def test_one_language_and_unlisted_languages(make_docs):
    rows = [(i, w, lang) for i, (w, lang) in enumerate([("aaa bbb", "xx"), ("ccc ddd", "yy"), ("eee fff", "zz")] * 30)]
    got = language.identify(make_docs(rows)).collect()
    want = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got)
    one = language.identify(make_docs([(i, "aaa bbb", "xx") for i in range(20)])).collect()
    assert {r.lang_pred for r in one} == {"xx"}


def test_every_language_is_learned(make_docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"x{c}": f"{c * 3} {c * 4} {c}{c}" for c in letters}
    rows = [(i, words[lang], lang) for i, lang in enumerate([*words] * 30 + [*words][:20] * 10)]
    got = language.identify(make_docs(rows)).collect()
    want = {i: lang for i, _, lang in rows}
    assert len(words) == 26 and [r for r in got if r.lang_pred != want[r.doc_id]] == []


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5))
    y = np.where(x @ [1, -2, 0, 1, 0] > 0, 1.0, -1.0)
    w = language.train_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


@pytest.mark.parametrize("text,want", [("abc", True), ("漢", True), ("12 !?", False), ("", False)])
def test_letters(text, want):
    assert language.has_letter(text) is want
