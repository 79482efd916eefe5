"""Scans of Arrow batches of text with RE2, the engine the patterns are written for.

Spark hands a task its texts as Arrow arrays; `pyarrow.compute` runs an RE2 automaton over
an array in one call, a few hundred megabytes a second, with no row seen by Python.  One
automaton of all literals of all phrases, with whatever may stand between their letters,
finds the suspects in one pass; only they get the six forms, and of those only the ones
that differ are scanned.  One automaton of all output patterns does the same for flags.

Forms are built from whole arrays as well: bytes are mapped by a table, blanks dropped by a
mask, lone letters joined by replacements.  Only a text with white space beyond ASCII, or
with the two marks that the replacements use, is taken apart by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import fixed_values as V


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def _hint(literals: tuple[str, ...]) -> str:
    """The literals, spelled with look-alikes and with anything a form drops in between."""
    alike: dict[str, str] = {}
    for sign, letter in zip(V.LEET_FROM, V.LEET_TO):
        alike[letter] = alike.get(letter, "") + sign
    between = _class(V.INVISIBLE + V.UNICODE_SPACE + V.DELIMITERS) + "*"
    return "|".join(between.join(_class(c + alike.get(c, "")) for c in word) for word in literals)


LITERALS = tuple(dict.fromkeys(V.KEYWORD_LITERALS + V.STRUCTURAL_LITERALS + V.VERB_LITERALS))
HINT = f"(?i)(?:{_hint(LITERALS)})"
ANY_OUTPUT = "|".join(
    f"(?i:{p.removeprefix('(?i)')})" if p.startswith("(?i)") else f"(?:{p})" for p in V.OUTPUT_PATTERNS.values()
)

_INVISIBLE = _class(V.INVISIBLE)
_RARE_SPACE = "".join(c for c in V.UNICODE_SPACE if c not in V.ASCII_SPACE)
_WIDE_SPACE = _class("".join(c for c in V.UNICODE_SPACE if ord(c) > 127))
_RARE = _class(_RARE_SPACE)
_DELIM = r"[-._/]"
_INNER_DELIM = rf"([\pL\p{{Nd}}]){_DELIM}([\pL\p{{Nd}}])"
_LONE = rf"{_DELIM}*\pL{_DELIM}*"
_LONE_TO_JOIN = (
    rf"(?:^|[ \n])(?:{_LONE} {_LONE}|{_DELIM}+\pL{_DELIM}*|\pL{_DELIM}+)(?:$|[ \n])"
)
_COLLAPSES = (
    rf"[\pL\p{{Nd}}]{_DELIM}[\pL\p{{Nd}}]|{_RARE}|[Hh][Yy][Pp][Oo][Tt][Hh]"
    rf"|(?:^|[\t\n\f\r ])(?:{_LONE}[\t\n\f\r ]{_LONE}|{_DELIM}+\pL{_DELIM}*|\pL{_DELIM}+)(?:$|[\t\n\f\r ])"
)
_OPEN, _CLOSE = "\x01", "\x02"  # marks around a lone letter, in texts that hold neither
_BYTES = np.arange(256, dtype=np.uint8)
_LEET = _BYTES.copy()
for _sign, _letter in zip(V.LEET_FROM, V.LEET_TO):
    _LEET[ord(_sign)] = ord(_letter)
_TO_SPACE = _BYTES.copy()
_TO_SPACE[[ord(c) for c in V.ASCII_SPACE]] = ord(" ")
_SPACE_BYTE = np.zeros(256, dtype=bool)
_SPACE_BYTE[[ord(c) for c in V.UNICODE_SPACE if ord(c) < 128]] = True


# ---- arrays of texts and their bytes ----

def plain(texts: pa.Array) -> pa.StringArray:
    """The texts with 32-bit offsets and the empty text for null."""
    return pc.fill_null(texts if texts.type == pa.string() else texts.cast(pa.string()), "")


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array without nulls, and the offset of every text in them."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int32)
    places = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]], places - places[0]


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)
    )


def _mapped(texts: pa.StringArray, table: np.ndarray) -> pa.StringArray:
    data, offsets = _bytes(texts)
    return _texts(table[data], offsets)


def _where(texts: pa.StringArray, mask: pa.BooleanArray, change) -> pa.StringArray:
    """The texts with change(those of the mask) in their place."""
    if not pc.any(mask).as_py():
        return texts
    return pc.replace_with_mask(texts, mask, change(texts.filter(mask)))


def matches(texts: pa.StringArray, pattern: str) -> pa.BooleanArray:
    return pc.match_substring_regex(texts, pattern)


def _strings(texts: pa.StringArray) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]


# ---- the six forms ----

def strip_invisible(texts: pa.StringArray) -> pa.StringArray:
    return _where(texts, matches(texts, _INVISIBLE), lambda t: pc.replace_substring_regex(t, _INVISIBLE, ""))


def fold_leet(texts: pa.StringArray) -> pa.StringArray:
    return _mapped(texts, _LEET)


def strip_whitespace(texts: pa.StringArray) -> pa.StringArray:
    texts = _where(texts, matches(texts, _WIDE_SPACE), lambda t: pc.replace_substring_regex(t, _WIDE_SPACE, ""))
    data, offsets = _bytes(texts)
    blank = _SPACE_BYTE[data]
    return _texts(data[~blank], offsets - np.searchsorted(np.flatnonzero(blank), offsets))


def collapse_spaced(texts: pa.StringArray) -> pa.StringArray:
    """Join letters set apart by blanks or delimiters, within chunks that runs of blanks cut."""
    def apart(t):
        for _ in range(2):  # neighbours share a letter, so every second one per pass
            t = pc.replace_substring_regex(t, _INNER_DELIM, r"\1 \2")
        return t

    texts = _where(texts, matches(texts, _INNER_DELIM), apart)
    rare = matches(texts, f"{_RARE}|[{_OPEN}{_CLOSE}]")
    if not pc.any(rare).as_py():
        return _collapse_plain(texts)
    one_by_one = pa.array([_collapse_text(t) for t in _strings(texts.filter(rare))], pa.string())
    common = pc.invert(rare)
    return pc.replace_with_mask(_where(texts, common, _collapse_plain), rare, one_by_one)


def _collapse_plain(texts: pa.StringArray) -> pa.StringArray:
    """For texts whose white space is ASCII.  A newline marks the cut between chunks."""
    cut = pc.replace_substring_regex(_mapped(texts, _TO_SPACE), " {2,}", "\n")
    cut = pc.ascii_trim(cut, " ")
    joined = _where(cut, matches(cut, _LONE_TO_JOIN), _join_lone)
    # A lone blank trims to nothing, yet stays as it is.
    return pc.if_else(pc.equal(pc.binary_length(texts), 1), texts, pc.replace_substring(joined, "\n", " "))


def _join_lone(texts: pa.StringArray) -> pa.StringArray:
    """Every word gets a blank of its own on each side; those of lone letters become marks,
    and where two marks meet the letters join."""
    padded = pc.replace_substring(pc.replace_substring(texts, " ", "  "), "\n", " \n ")
    padded = pc.binary_join_element_wise(" ", padded, " ", "")
    marked = pc.replace_substring_regex(padded, rf" {_DELIM}*(\pL){_DELIM}* ", rf"{_OPEN}\1{_CLOSE}")
    joined = pc.replace_substring(marked, _CLOSE + _OPEN, "")
    for mark in (_OPEN, _CLOSE):
        joined = pc.replace_substring(joined, mark, " ")
    inner = pc.binary_slice(joined.cast(pa.binary()), 1, -1).cast(pa.string())
    return pc.replace_substring(pc.replace_substring(inner, "  ", " "), " \n ", "\n")


_CHUNK = re.compile("[" + re.escape(V.ASCII_SPACE) + "]{2,}")
_WORD = re.compile("[^" + re.escape(V.UNICODE_SPACE) + "]+")


def _collapse_text(text: str) -> str:
    return " ".join(map(_collapse_chunk, _CHUNK.split(text)))


def _collapse_chunk(chunk: str) -> str:
    words, lone = [], False
    for word in _WORD.findall(chunk):
        core = word.strip(V.DELIMITERS)
        letter = len(core) == 1 and core.isalpha()
        if letter and lone:
            words[-1] += core
        else:
            words.append(core if letter else word)
        lone = letter
    return " ".join(words) if words else chunk


def forms(texts: pa.StringArray) -> list[pa.StringArray]:
    """The six inspected forms of every text, in order."""
    clean = strip_invisible(texts)
    leet = fold_leet(clean)
    return [texts, clean, leet, collapse_spaced(clean), collapse_spaced(leet), strip_whitespace(leet)]


# ---- counts and signals ----

def word_counts(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space per text, and those of one character."""
    texts = _where(texts, matches(texts, _WIDE_SPACE), lambda t: pc.replace_substring_regex(t, _WIDE_SPACE, " "))
    data, offsets = _bytes(texts)
    blank = np.ones(len(data) + 1, dtype=bool)  # as is the end of all texts
    blank[:-1] = _SPACE_BYTE[data]
    opens = ~blank[:-1]
    opens[1:] &= blank[:-2]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[starts] = ~blank[starts]
    words = np.flatnonzero(opens)
    lead = data[words]
    after = words + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)  # past one character
    ends = offsets[np.searchsorted(offsets, words, "right")]
    single = words[(after >= ends) | blank[np.minimum(after, len(data))]]
    return np.diff(np.searchsorted(words, offsets)), np.diff(np.searchsorted(single, offsets))


_COUNTED = {"keyword": V.KEYWORD, "structural": V.STRUCTURAL, "repetition": V.OVERRIDE_VERBS}


def _counts(texts: pa.StringArray, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _worth_scanning(raw: pa.StringArray) -> Iterator[tuple[np.ndarray, pa.StringArray]]:
    """The forms of the texts that no form before already stands for, with their rows.  A row
    may come twice in one array.

    Collapsing a text without lone letters, inner delimiters and rare blanks changes ASCII
    blanks only.  No phrase tells these apart but the one with a dot, which is looked for.
    """
    clean = strip_invisible(raw)
    leet = fold_leet(clean)
    folded = pc.not_equal(leet, clean)
    everyone = np.arange(len(raw))
    yield everyone, raw
    for form, fresh in ((clean, pc.not_equal(clean, raw)), (leet, folded)):
        rows = _true(fresh)
        if len(rows):
            yield rows, form.take(pa.array(rows))
    some = _true(matches(clean, _COLLAPSES))
    other = _true(pc.and_(folded, matches(leet, _COLLAPSES)))
    if len(some) or len(other):
        yield np.concatenate([some, other]), collapse_spaced(
            pa.concat_arrays([clean.take(pa.array(some)), leet.take(pa.array(other))])
        )
    yield everyone, strip_whitespace(leet)


def _true(mask: pa.BooleanArray) -> np.ndarray:
    return np.flatnonzero(mask.to_numpy(zero_copy_only=False))


def _gathered(forms: Iterator[tuple[np.ndarray, pa.StringArray]]) -> Iterator[tuple[np.ndarray, pa.StringArray]]:
    """The same forms in few arrays of a part's bytes: every search builds its automaton anew,
    which for short texts takes longer than the search."""
    held, size = [], 0
    for rows, texts in forms:
        more = len(_bytes(texts)[0])
        if held and size + more > PART_BYTES:
            yield _joined(held)
            held, size = [], 0
        held.append((rows, texts))
        size += more
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, pa.StringArray]]) -> tuple[np.ndarray, pa.StringArray]:
    return np.concatenate([rows for rows, _ in held]), pa.concat_arrays([texts for _, texts in held])


def phrase_signals(texts: pa.StringArray) -> dict[str, np.ndarray]:
    """The three signals that take the worst of the six forms."""
    found = {name: np.zeros(len(texts)) for name in _COUNTED}
    suspect = np.flatnonzero(matches(texts, HINT).to_numpy(zero_copy_only=False))
    if not len(suspect):
        return found
    for rows, scanned in _gathered(_worth_scanning(texts.take(pa.array(suspect)))):
        for name, pattern in _COUNTED.items():
            hits = _counts(scanned, pattern)
            some = np.flatnonzero(hits)
            if not len(some):
                continue
            if name == "repetition":
                words, _ = word_counts(scanned.take(pa.array(some)))
                points = hits[some] / words / V.REPETITION_FULL_DENSITY
            else:
                points = hits[some] * (V.KEYWORD_POINTS if name == "keyword" else V.STRUCTURAL_POINTS)
            np.maximum.at(found[name], suspect[rows[some]], np.minimum(points, 1.0))
    verbs = np.flatnonzero(found["repetition"])
    if len(verbs):  # a floor for texts spelled out in letters
        words, single = word_counts(texts.take(pa.array(verbs)))
        spelled = (words >= V.SPACED_MIN_WORDS) & (single >= V.SPACED_MIN_RATIO * words)
        where = verbs[spelled & (single / np.maximum(words, 1) >= V.SPACED_MIN_RATIO)]
        found["repetition"][where] = np.maximum(found["repetition"][where], V.SPACED_FLOOR)
    return found


def boundary_signal(texts: pa.StringArray) -> np.ndarray:
    points = np.zeros(len(texts))
    some = np.flatnonzero(matches(texts, V.BOUNDARY).to_numpy(zero_copy_only=False))
    if len(some):
        points[some] = np.minimum(_counts(texts.take(pa.array(some)), V.BOUNDARY) * V.BOUNDARY_POINTS, 1.0)
    return points


_BLANKS = np.array([ord(c) for c in V.UNICODE_SPACE])


def _entropy(text: str) -> float:
    """Shannon bits per non-blank character."""
    try:
        counts = np.bincount(np.frombuffer(text.encode("latin-1"), dtype=np.uint8), minlength=256)
        counts[_BLANKS[_BLANKS < 256]] = 0
        values = counts[counts > 0]
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if points.max() >= 1 << 16:  # few such texts; a counter per code point is large
            values = np.unique(points[~np.isin(points, _BLANKS)], return_counts=True)[1]
        else:
            counts = np.bincount(points, minlength=_BLANKS.max() + 1)
            counts[_BLANKS] = 0
            values = counts[counts > 0]
    total = values.sum()
    return float(np.log2(total) - (values * np.log2(values)).sum() / total) if total else 0.0


def entropy_bits(texts: pa.StringArray) -> np.ndarray:
    return np.array([_entropy(t) for t in _strings(texts)], dtype=np.float64)


SHORT_BYTES = 256  # up to here a look at many texts at once is cheaper than one by one


def _varied(texts: pa.StringArray) -> np.ndarray:
    """Which texts are long enough and may have more than the base bits: n different
    characters have at most log2(n).

    Characters beyond ASCII count each time, one more stands for bytes that are no character,
    and texts that are not short may always have them.
    """
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    varied = sizes >= V.ENTROPY_MIN_BYTES
    short = np.flatnonzero(varied & (sizes <= SHORT_BYTES))
    for begin, end in _parts(sizes[short], RUN_BYTES):
        rows = short[begin:end]
        data, offsets = _bytes(texts.take(pa.array(rows)))
        of = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(offsets))
        seen = np.zeros((len(rows), 256), dtype=bool)
        seen[of, data] = True
        beyond = np.bincount(of[data >= 0xC0], minlength=len(rows))
        varied[rows] = seen[:, :128].sum(axis=1) + beyond + 1 >= 2 ** V.ENTROPY_BASE_BITS
    return varied


def entropy_signal(texts: pa.StringArray) -> np.ndarray:
    """How far the character entropy lies above 5 bits, at most 1."""
    points = np.zeros(len(texts))
    where = np.flatnonzero(_varied(texts))
    over = (entropy_bits(texts.take(pa.array(where))) - V.ENTROPY_BASE_BITS) / V.ENTROPY_SPAN_BITS
    points[where] = np.clip(over, 0.0, 1.0)
    return points


PART_BYTES, PART_ROWS = 8 << 20, 16384
RUN_BYTES = 1 << 20  # of runs, whose bytes get places of eight bytes each


def _parts(sizes: np.ndarray, part_bytes: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of parts of few rows and bytes, or of one row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        until = min(int(np.searchsorted(ends, before + part_bytes, "right")), at + PART_ROWS)
        yield at, max(until, at + 1)
        at = max(until, at + 1)


def _in_parts(
    scan: Callable[..., pa.Array], texts: pa.Array, *others: pa.Array, part_bytes: int = PART_BYTES
) -> pa.Array:
    """scan over parts of few rows and bytes, so that what it holds is bounded by them or
    by the longest text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    parts = [
        scan(*[a.slice(begin, end - begin) for a in (texts, *others)])
        for begin, end in _parts(sizes, part_bytes)
    ]
    return pa.concat_arrays(parts) if parts else scan(texts, *others)


def signals(texts: pa.Array) -> pa.StructArray:
    """The five unrounded signals; a null text has none."""
    return _in_parts(_signals, texts)


def _signals(texts: pa.Array) -> pa.StructArray:
    known = plain(texts)
    found = phrase_signals(known)
    found["boundary"] = boundary_signal(known)
    found["entropy"] = entropy_signal(known)
    return pa.StructArray.from_arrays([pa.array(found[n]) for n in V.SIGNAL_WEIGHTS], list(V.SIGNAL_WEIGHTS))


def output_flags(texts: pa.Array) -> pa.StructArray:
    """One flag per output pattern; null for a null text."""
    return _in_parts(_output_flags, texts)


def _output_flags(texts: pa.Array) -> pa.StructArray:
    known = plain(texts)
    hit = np.flatnonzero(matches(known, ANY_OUTPUT).to_numpy(zero_copy_only=False))
    rows = known.take(pa.array(hit))
    unknown = texts.is_null().to_numpy(zero_copy_only=False)
    columns = []
    for pattern in V.OUTPUT_PATTERNS.values():
        flags = np.zeros(len(known), dtype=bool)
        if len(hit):
            flags[hit] = matches(rows, pattern).to_numpy(zero_copy_only=False)
        columns.append(pa.array(flags, mask=unknown))
    return pa.StructArray.from_arrays(columns, list(V.OUTPUT_PATTERNS))


def unsafe(texts: pa.Array) -> pa.BooleanArray:
    """Whether any output pattern matches; null for a null text."""
    return pc.match_substring_regex(texts, ANY_OUTPUT)


# ---- the buffers of streams ----

# What any output pattern that matches a buffer leaves in the joined view of every run of
# bytes around the buffer: without word boundaries, line ends and what a cut may change.
STREAM_CORE = "|".join((
    r"[a-zA-Z0-9._%+\-]@",
    r"(?:[0-9][\t\n\f\r \-.()]{0,3}){9}",
    r"AKIA[0-9A-Z]{16}",
    r"sk-[a-zA-Z0-9]{16}",
    r"(?i:how\s*to\s*(?:make|build|synthesize)\s*(?:a\s*)?(?:bomb|weapon|explosive|poison|malware|virus))",
    r"(?i:steps?\s*(?:to|for)\s*(?:commit\s*suicide|self[\s\-]?harm|end\s*(?:your|my)\s*life))",
))


def _unframed(raw: pa.StringArray) -> pa.StringArray:
    return pc.replace_substring(raw, V.DATA_PREFIX, "")


def joined_view(raw: pa.StringArray) -> pa.StringArray:
    """Event bytes with framing and line ends removed: split secrets rejoin."""
    view = _unframed(raw)
    for part in ("\n", "\r", V.DONE):
        view = pc.replace_substring(view, part, "")
    return view


_LINE_ENDS = _BYTES.copy()
_LINE_ENDS[[10, 13]] = ord(" ")


def spaced_view(raw: pa.StringArray) -> pa.StringArray:
    """Event bytes with framing removed and line ends read as blanks."""
    return _mapped(pc.replace_substring(_unframed(raw), V.DONE, ""), _LINE_ENDS)


def stream_unsafe(raw: pa.StringArray) -> np.ndarray:
    """Whether an output pattern matches either view, per text of raw event bytes."""
    either = pc.or_(matches(joined_view(raw), ANY_OUTPUT), matches(spaced_view(raw), ANY_OUTPUT))
    return either.to_numpy(zero_copy_only=False)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """data[start:end] of every pair; the bytes may begin or end within a character."""
    sizes = np.maximum(ends - starts, 0)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return _texts(data[places], offsets)


def _first_of_runs(keys: np.ndarray) -> np.ndarray:
    """Places at which a value differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)


def unsafe_buffers(data: np.ndarray, past: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which buffers data[past:end] are unsafe.

    Neighbouring buffers overlap by nearly all they hold, so they are first looked at in
    spans (their numbers, ascending): a span's bytes are searched once for what any match
    in any of its buffers leaves there, and only buffers of spans with a hit are cut out
    and matched one by one, as framing and word boundaries depend on where each is cut.
    """
    flags = np.zeros(len(ends), dtype=bool)
    first = _first_of_runs(spans)
    if not len(first):
        return flags
    lows, highs = past[first], np.maximum.reduceat(ends, first)
    hit = matches(joined_view(_cut(data, lows, highs)), STREAM_CORE).to_numpy(zero_copy_only=False)
    sizes = np.diff(np.concatenate([first, [len(ends)]]))
    some = np.flatnonzero(np.repeat(hit, sizes))
    for begin, end in _parts(ends[some] - past[some], RUN_BYTES):
        rows = some[begin:end]
        flags[rows] = stream_unsafe(_cut(data, past[rows], ends[rows]))
    return flags


def _binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array, and the offset of every value in them; null is empty."""
    return _bytes(pc.fill_null(values.cast(pa.binary()), b""))


def _lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All items of a list array, and the offset of every list in them."""
    counts = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    return values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])


def _as_lists(items: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(items))


def _as_binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return _cut(data, starts, ends).cast(pa.binary())


def _spans(rows: np.ndarray, begins: np.ndarray, window: int) -> np.ndarray:
    """Number of the span of a few windows that a buffer belongs to, ascending along rows."""
    return (rows << 40) + begins // max(4 * window, 1024)


def run_flags(runs: pa.Array, sizes: pa.Array, window: int) -> pa.StructArray:
    """Of each run of chunks, by its bytes and the sizes of its chunks: where chunks end,
    whether the buffer at each is unsafe if nothing comes before the run, the bytes of the
    chunks whose buffers reach back before it, and its last `window` bytes."""
    return _in_parts(lambda *part: _run_flags(*part, window), runs, sizes, part_bytes=RUN_BYTES)


def _run_flags(runs: pa.Array, sizes: pa.Array, window: int) -> pa.StructArray:
    data, places = _binary(runs)
    size, offsets = _lists(sizes)
    rows = np.repeat(np.arange(len(runs)), np.diff(offsets))
    total = np.cumsum(size)
    ends = total - np.repeat(np.concatenate([[0], total])[offsets[:-1]], np.diff(offsets))
    begins = ends - size
    lows = places[rows].astype(np.int64)
    flags = unsafe_buffers(
        data, lows + np.maximum(begins - window, 0), lows + ends, _spans(rows, begins, window)
    )
    heads = np.zeros(len(runs), dtype=np.int64)
    np.maximum.at(heads, rows, np.where(begins < window, ends, 0))
    low, high = places[:-1].astype(np.int64), places[1:].astype(np.int64)
    return pa.StructArray.from_arrays([
        pa.array(high - low), _as_lists(size, offsets), _as_lists(ends, offsets), _as_lists(flags, offsets),
        _as_binary(data, low, low + heads), _as_binary(data, np.maximum(high - window, low), high),
    ], ["n_bytes", "sizes", "ends", "flags", "head", "tail"])


def head_flags(
    past: pa.Array, head: pa.Array, ends: pa.Array, flags: pa.Array, finale: pa.Array, window: int
) -> pa.StructArray:
    """The flags of each run with the bytes before it in view, and whether the last bytes of
    its stream (`finale`, null but in the last run) are unsafe.

    Only chunks of the head are matched again, and only if there is a past.
    """
    return _in_parts(
        lambda head, past, *rest: _head_flags(past, head, *rest, window), head, past, ends, flags, finale,
        part_bytes=RUN_BYTES,
    )


def _head_flags(
    past: pa.Array, head: pa.Array, ends: pa.Array, flags: pa.Array, finale: pa.Array, window: int
) -> pa.StructArray:
    end, offsets = _lists(ends)
    flag = _lists(flags)[0].astype(bool)
    rows = np.repeat(np.arange(len(past)), np.diff(offsets))
    before, after = _binary(past), _binary(head)
    n_past, n_head = np.diff(before[1]).astype(np.int64), np.diff(after[1]).astype(np.int64)
    again = np.flatnonzero((end <= n_head[rows]) & (n_past[rows] > 0))
    if len(again):
        some = np.unique(rows[again])
        both = pc.binary_join_element_wise(
            pc.fill_null(past.cast(pa.binary()), b""), pc.fill_null(head.cast(pa.binary()), b""), b""
        ).take(pa.array(some))
        data, places = _binary(both)
        row = np.searchsorted(some, rows[again])
        low = places[row].astype(np.int64)
        stops = n_past[rows[again]] + end[again]
        opens = n_past[rows[again]] + np.concatenate([[0], end])[again] * (again != offsets[:-1][rows[again]])
        flag[again] = unsafe_buffers(
            data, low + np.maximum(opens - window, 0), low + stops, _spans(row, opens, window)
        )
    last = np.flatnonzero(finale.is_valid().to_numpy(zero_copy_only=False))
    drain = np.zeros(len(past), dtype=bool)
    if len(last):
        drain[last] = stream_unsafe(_texts(*_binary(finale.take(pa.array(last)))))
    return pa.StructArray.from_arrays([_as_lists(flag, offsets), pa.array(drain)], ["flags", "drain"])
