"""Regex building blocks that mean the same in Java and RE2 and follow Unicode text rules.

``\\w`` and ``\\s`` differ between engines (ASCII or Unicode, with or without combining marks), so
patterns spell the classes out. ``[^\\n]`` stands for "any character but a newline": Java's ``.`` would
also stop at a carriage return.
"""

from __future__ import annotations

from collections.abc import Iterable

# A word character: letter, number or underscore.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

Ranges = list[tuple[int, int]]
LAST = 0x10FFFF


def body(ranges: Ranges) -> str:
    """Code point ranges as a class body, usable inside [...]."""
    return "".join(rf"\x{{{lo:x}}}" if lo == hi else rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges)


def complement(ranges: Ranges) -> Ranges:
    """All other code points, widest share of everyday text (plain ASCII) first.

    Java matches a negated class of several ranges about ten times slower than the same class spelled
    out, so hot patterns spell it out.
    """
    out, start = [], 0
    for lo, hi in sorted(ranges):
        if lo > start:
            out.append((start, lo - 1))
        start = max(start, hi + 1)
    if start <= LAST:
        out.append((start, LAST))
    return sorted(out, key=lambda r: not (r[0] <= 0x7E and r[1] >= 0x21))


def points(chars: str) -> Ranges:
    return [(ord(c), ord(c)) for c in chars]


LETTERS = [(ord("a"), ord("z")), (ord("A"), ord("Z"))]
# Unicode white space.
SPACES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
SPACE_BODY = body(SPACES)
NOT_SPACE = f"[{body(complement(SPACES))}]"

TAG = r"<[^\n]*?>"
LINK = rf"http{NOT_SPACE}+"
DIGITS = "[0-9]+"

# The repeated groups are possessive: Java matches those in a loop, the plain form by recursion, which a
# text without white space could drive into a stack overflow.
# Words of a text; an apostrophe between word characters stays inside the word (don't).
TERM = rf"{WORD}++(?:'{WORD}++)*+"
# Count-vectoriser terms: runs of at least two word characters.
TERM2 = rf"{WORD}{{2,}}"
# White-space separated chunks without the punctuation at either end.
CHUNK = rf"{WORD}++(?:[^\p{{L}}\p{{N}}_{SPACE_BODY}]++{WORD}++)*+"
# Words and, as tokens of their own, the punctuation that separates phrases.
PHRASE_TOKEN = rf"{WORD}++(?:['’-]{WORD}++)*+|[.,;:!?|()\x22]"


def _has_bare_bar(pattern: str) -> bool:
    """Whether a pattern has an alternation outside all groups."""
    depth, in_class, escaped = 0, False, False
    for ch in pattern:
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            return True
    return False


def any_of(patterns: Iterable[str]) -> str:
    """Fuse one pattern family into a single case-insensitive, Unicode-aware Java pattern.

    One pass of the regex engine per family and row, instead of one per pattern. Word boundaries that
    all patterns share are tested once in front of the alternatives: about twice as fast.
    """
    listed = list(patterns)
    if not listed:
        return r"(?!)"
    edge = r"\b"
    inner = [p[2:-2] for p in listed if p.startswith(edge) and p.endswith(edge) and len(p) > 4]
    if len(inner) == len(listed) and not any(map(_has_bare_bar, inner)):
        return rf"(?iU)\b(?:{'|'.join(f'(?:{p})' for p in inner)})\b"
    return f"(?iU){'|'.join(f'(?:{p})' for p in listed)}"
