"""Bracket classes for patterns that the Java engine runs.

Phrases and output patterns do not run on that engine: see batches.
"""


def char_class(chars: str) -> str:
    """Bracket class of the given characters.

    Java keeps single Latin-1 characters in one bit set; others go fastest as ranges.
    """
    latin = "".join(f"\\x{{{c:x}}}" for c in sorted(set(map(ord, chars))) if c < 256)
    spans: list[list[int]] = []
    for code in sorted({ord(c) for c in chars if ord(c) > 255}):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return f"[{latin}" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"
