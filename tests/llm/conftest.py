import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts, or from (doc_id, text, lang) rows, with clashing extra columns."""

    def make(rows, extra=False):
        rows = [r if isinstance(r, tuple) else (i, r, None) for i, r in enumerate(rows)]
        full = [(i, t, lang, None, len(t or "")) for i, t, lang in rows]
        docs = spark.createDataFrame(full, DOC)
        if extra:
            from pyspark.sql import functions as F

            for name in ("item", "bin", "part", "words", "score", "size", "shard", "label"):
                docs = docs.withColumn(name, F.lit("x"))
        return docs

    return make


HARD = [
    None, "", " ", "\n\n  \t", "a", "a  b", "don't we'll   stop ", "été à l'œuvre 漢字テスト 🙂🙂",
    "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "!!! ??? ...", "0123456789 12 3",
    "the same text twice", "the same text twice", "ab" * 3000, "word " * 9000, " " * 5000 + "end",
    "line one\nline two\r\nline three  x",
]


def word_list(text):
    """Words as the operators define them, character by character."""
    import unicodedata

    import regex

    words, run = [], ""
    for c in (text or "").lower():
        alone = regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]", c)
        part = unicodedata.category(c)[0] in "LNM"
        if run and (alone or not part):
            words.append(run)
            run = ""
        if alone and part:
            words.append(c)
        elif part:
            run += c
    return [*words, run] if run else words
