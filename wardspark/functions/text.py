"""Text normalisation: the six forms in which a prompt is inspected, as columns.

Scans build the same forms over whole Arrow arrays (see batches); tests compare the two.
"""

from pyspark.sql import Column, functions as F

from . import fixed_values as V
from .regex import char_class

_WS = char_class(V.UNICODE_SPACE)
_RARE_WS = char_class("".join(c for c in V.UNICODE_SPACE if c not in V.ASCII_SPACE))
_ASCII_WS = char_class(V.ASCII_SPACE)
_DELIM = r"[-._/]"
# One letter standing alone between blanks, and the blank between two of them.
_LONE_LETTER = rf"([ \n]){_DELIM}*(\p{{L}}){_DELIM}*(?=[ \n]|\z)"
_LONE_GAP = r" (?<=(?<![^ \n])\p{L} )(?=\p{L}(?![^ \n]))"
# The delimiter comes first, so that most positions fail on one comparison.
_INNER_DELIM = rf"{_DELIM}(?<=[\p{{L}}\p{{Nd}}].)(?=[\p{{L}}\p{{Nd}}])"


def strip_invisible(text: Column) -> Column:
    """Drop zero-width and formatting characters, where there are any."""
    found = text.rlike(char_class(V.INVISIBLE))
    return F.when(found, F.translate(text, V.INVISIBLE, "")).otherwise(text)


def fold_leet(text: Column) -> Column:
    """Read look-alike digits and signs as the letters they imitate."""
    return F.translate(text, V.LEET_FROM, V.LEET_TO)


def strip_whitespace(text: Column) -> Column:
    """Drop every Unicode white-space character."""
    return F.translate(text, V.UNICODE_SPACE, "")


def collapse_spaced(text: Column) -> Column:
    """Join letters that were set apart by blanks or delimiters into words.

    Runs of two or more ASCII blanks cut the text into chunks; lone letters join
    only within a chunk.  Chunks without a word stay as they are.
    """
    return bind(F.regexp_replace(text, _INNER_DELIM, " "), _collapse_apart)


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once; a one-element array holds it."""
    return F.transform(F.array(value), use)[0]


def _collapse_apart(apart: Column) -> Column:
    # Only ASCII blanks: one pass over the whole string.  Blanks become spaces,
    # a newline marks the cut between chunks.
    spaced = F.translate(apart, V.ASCII_SPACE, " " * len(V.ASCII_SPACE))
    cut = F.trim(F.regexp_replace(spaced, " {2,}", "\n"))
    # A lone blank trims to nothing, yet stays as it is.
    fast = F.when(F.octet_length(apart) == 1, apart).otherwise(
        F.translate(_join_lone_letters(cut), "\n", " ")
    )
    # Other white space: chunk by chunk, as such a chunk may hold no word at all.
    slow = F.array_join(
        F.transform(F.split(apart, _ASCII_WS + "{2,}", -1), _collapse_chunk), " "
    )
    return F.when(apart.rlike(_RARE_WS), slow).otherwise(fast)


def _join_lone_letters(text: Column) -> Column:
    # Every word then follows a blank, which is the quickest thing to look for.
    led = F.regexp_replace(F.concat(F.lit(" "), text), _LONE_LETTER, "$1$2")
    return F.substring(F.regexp_replace(led, _LONE_GAP, ""), 2, 2**31 - 1)


def _collapse_chunk(chunk: Column) -> Column:
    words = F.trim(F.regexp_replace(chunk, _WS + "+", " "))
    return F.when(words == "", chunk).otherwise(_join_lone_letters(words))


def prompt_variants(text: Column) -> Column:
    """The six inspected forms, in order, duplicates kept."""
    return bind(strip_invisible(text), lambda clean: bind(fold_leet(clean), lambda leet: F.array(
        text, clean, leet, collapse_spaced(clean), collapse_spaced(leet), strip_whitespace(leet)
    )))
