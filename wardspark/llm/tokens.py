"""Operator 5 (token counts of prefixes) and the token ids that packing needs.

Byte-level BPE works on each pre-token by itself, so the count of a prefix that ends
between two pre-tokens is a running sum: the table of an operator's row holds the sums at
all those ends.  Each pre-token has a table of its own, built by dynamic programming over
its bytes: its last entry is the pre-token's count, and a prefix that ends inside it adds
the entry of that place.  Questions about budgets and cuts
are answered from both tables; no text is encoded again.

Null text counts as empty.  An empty text has no tokens and an empty table.  Texts are
taken whole; repeated rows are counted one by one.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import ship_package
from .common import slices

# Fixed values of the vocabulary: how text is cut into pre-tokens, and its special string.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}
MAX_CACHED = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """Counts and ids of texts, with bounded tables of the pre-tokens met so far."""

    def __init__(self, ranks_path: str):
        import ahocorasick
        import tiktoken

        with open(ranks_path, "rb") as lines:
            pairs = [line.split() for line in lines]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.finder = ahocorasick.Automaton()
        for token in self.ranks:
            self.finder.add_word(token.decode("latin-1"), token)
        self.finder.make_automaton()
        self.library = tiktoken.Encoding(
            "bytes", pat_str=PRE_TOKEN, mergeable_ranks=self.ranks, special_tokens=SPECIAL
        )
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, SPECIAL)))
        self.counts: dict[str, int] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def ids(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, allowed_special="all")

    def piece_count(self, piece: str) -> int:
        found = self.counts.get(piece)
        if found is None:
            if len(self.counts) >= MAX_CACHED:
                self.counts.clear()
            found = 1 if piece in SPECIAL else self.piece_table(piece.encode())[-1]
            self.counts[piece] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; a special string is one of its own."""
        if not any(s in text for s in SPECIAL):
            return self.pattern.findall(text)
        out, at = [], 0
        for match in self.special.finditer(text):
            out += self.pattern.findall(text[at : match.start()])
            out.append(match[0])
            at = match.end()
        return out + self.pattern.findall(text[at:])

    def total(self, text: str) -> int:
        known = self.counts
        pieces = self.pieces(text)
        try:
            return sum([known[p] for p in pieces])
        except KeyError:
            return sum(map(self.piece_count, pieces))

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the pre-tokens in code points, and the token count up to each."""
        pieces = self.pieces(text)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        counts = np.cumsum([self.piece_count(p) for p in pieces], dtype=np.int64)
        return ends, counts

    def _compatible(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stand when their bytes are encoded together."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MAX_CACHED:
                self.pairs.clear()
            ids = self.library._encode_single_piece(left + right)
            found = ids == [self.ranks[left], self.ranks[right]]
            self.pairs[key] = found
        return found

    def piece_table(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of one pre-token, from 0 to its length.

        The last token of a prefix is the one token that ends there and stands beside
        the last token of the prefix before it; its count is that prefix's plus one.
        """
        counts, last = [0] * (len(piece) + 1), [b""] * (len(piece) + 1)
        done, known = 0, self.pairs.get
        # all tokens that end at each byte, the longest first
        for at, token in self.finder.iter(piece.decode("latin-1")):
            end = at + 1
            if end == done:
                continue
            start = end - len(token)
            if start:
                stands = known((last[start], token))
                if stands is None:
                    stands = self._compatible(last[start], token)
                if not stands:
                    continue
            counts[end], last[end], done = counts[start] + 1, token, end
        return counts

    def prefix_count(self, text: str, ends: np.ndarray, counts: np.ndarray, n: int) -> int:
        """Tokens of the first `n` code points, from the tables of the whole text."""
        k = bisect_right(ends, n)
        start = int(ends[k - 1]) if k else 0
        before = int(counts[k - 1]) if k else 0
        rest = text[start:n]
        if rest and k and text[start : int(ends[k])] in SPECIAL:
            # the head of a special string is plain text and may join what is before it
            begin = int(ends[k - 2]) if k > 1 else 0
            if text[begin:start] not in SPECIAL:
                start, before = begin, int(counts[k - 2]) if k > 1 else 0
                rest = text[start:n]
        elif rest and rest.isspace() and k:
            # a run of blanks gives its last one to the next word only if a word follows
            begin = int(ends[k - 2]) if k > 1 else 0
            if text[begin:start].isspace():
                start, before = begin, int(counts[k - 2]) if k > 1 else 0
                rest = text[start:n]
        for part in self.pieces(rest):
            before += 1 if part in SPECIAL else self.piece_table(part.encode())[-1]
        if rest or not k:
            return before
        return self._whole_blanks(text, ends, counts, k)

    def _whole_blanks(self, text: str, ends, counts, k: int) -> int:
        """Count at a pre-token's end; a blank run cut off from its word is one run."""
        first = k
        while first and text[int(ends[first - 2]) if first > 1 else 0 : int(ends[first - 1])].isspace():
            first -= 1
        if k - first < 2:
            return int(counts[k - 1])
        start = int(ends[first - 1]) if first else 0
        before = int(counts[first - 1]) if first else 0
        return before + self.total(text[start : int(ends[k - 1])])

    def fit(self, text: str, ends: np.ndarray, counts: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix that holds at most `budget` tokens.

        Counts never fall from one end of a pre-token to the next, so the cut lies in the
        pre-token after the last end within the budget.
        """
        k = bisect_right(counts, budget)
        if k == len(ends):
            return len(text)
        low, high = int(ends[k - 1]) if k else 0, int(ends[k])
        spent = int(counts[k - 1]) if k else 0
        piece = text[low:high]
        if piece in SPECIAL:
            heads = range(high - 1, low, -1)
            cuts = (n for n in heads if self.prefix_count(text, ends, counts, n) <= budget)
            return next(cuts, low)
        table = self.piece_table(piece.encode())
        at, best, length = 0, 0, 0
        for character in piece:
            at += len(character.encode())
            length += 1
            if spent + table[at] <= budget:
                best = length
        if not best and k and piece[0].isspace():
            # a blank cut off from its word joins the blanks before it
            best = int(self.prefix_count(text, ends, counts, low + 1) <= budget)
        return low + best


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _whole(text: str | None) -> str:
    return text or ""


def prefix_tables(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the prefix table as arrays `ends` and `counts`."""
    path = ranks_path or default_vocabulary()
    ship_package(docs.sparkSession)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches):
            made = [words.table(_whole(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([int(c[-1]) if len(c) else 0 for _, c in made], pa.int64()),
                    pa.array([e for e, _ in made], pa.list_(pa.int64())),
                    pa.array([c for _, c in made], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_tokens", "ends", "counts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tables, f"doc_id {kind}, n_tokens long, ends array<long>, counts array<long>"
    )


def token_counts(docs: DataFrame, limit: int = 512, ranks_path: str | None = None) -> DataFrame:
    """Exact token count of each text, whether it is over `limit`, and where to cut it.

    `fit_chars` is the length of the longest prefix of at most `limit` tokens.
    """
    path = ranks_path or default_vocabulary()
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches):
            texts = [_whole(t) for t in batch.column("text").to_pylist()]
            totals, fits = [], []
            for text in texts:
                # a text of no more bytes than the limit cannot hold more tokens
                if len(text) * 4 <= limit:
                    totals.append(words.total(text))
                    fits.append(len(text))
                    continue
                ends, counts = words.table(text)
                totals.append(int(counts[-1]) if len(counts) else 0)
                fits.append(words.fit(text, ends, counts, limit))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array([n > limit for n in totals], pa.bool_()),
                    pa.array(fits, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    )


def token_pieces(
    docs: DataFrame, capacity: int = 2048, end_id: int = 0, ranks_path: str | None = None
) -> DataFrame:
    """Cut each document's ids, closed by `end_id`, into pieces of `capacity`.

    Only the first piece of a document may be shorter.  Ids stay in the task; a piece is
    told by its place, length and checksum.
    """
    path = ranks_path or default_vocabulary()
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches):
            rows, number, start, length, checksum = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(words.ids(_whole(text)), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    number.append(n)
                    start.append(a)
                    length.append(b - a)
                    checksum.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(checksum, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )
