"""Pieces of text that a byte-level tokenizer splits alike wherever they stand.

The split pattern of byte-level BPE always parts before a single space or newline that
follows other text, so what lies between two such places can be encoded once and kept.
Texts with other white space, or with two white spaces in a row, are not cut this way.
"""

from __future__ import annotations

from collections.abc import Callable

#: Chunks that a task keeps the ids of: those of late use, and as many from before.
CACHE = 120_000
#: Chunks that encode_each keeps the ids of at most.
KNOWN = 600_000
#: Characters of the longest chunk that is kept: of the two bounds above, this makes bounds of memory.
LONGEST = 64
# The split pattern for which texts may be cut, as byte-level tokenizers write it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than space and newline, in any definition; and the mark used below.
_OTHER = [chr(c) for c in (0, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_OTHER_ASCII = [c for c in _OTHER if c.isascii()]
_RUNS = ["  ", "\n\n", " \n", "\n "]
_ENDS = tuple(".,;:!?")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def cut(text: str) -> list[str] | None:
    """Chunks of a text, or None where it must be encoded whole. A chunk stands for itself with
    a space before it; one that begins with NUL has none, and a newline stands alone."""
    marked = parted(text)
    return None if marked is None else marked.split(" ")


def parted(text: str) -> str | None:
    """The chunks of a text with a space between them, or None where it must be encoded whole."""
    if any(x in text for x in _RUNS) or any(x in text for x in (_OTHER_ASCII if text.isascii() else _OTHER)):
        return None
    return "\0" + text.replace("\n", " \n \0")


class Chunks(dict):
    """The encoded bytes of each chunk, made on first use."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        self.before: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.before.get(chunk)
        if out is None:
            if chunk[-1:] in _ENDS and chunk[-2:-1].isalpha():
                out = self[chunk[:-1]] + self["\0" + chunk[-1]]  # letters and a mark after them are always parted
            else:
                text = chunk[1:] if chunk[:1] == "\0" else chunk if chunk == "\n" else f" {chunk}"
                out = self.encode(text) if text else b""
        if len(chunk) > LONGEST:
            return out
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        self[chunk] = out
        return out


def encode_each(distinct: list[str], known: dict[str, bytes], words: Callable[[list[str], list[str]], list[bytes]], other: Callable[[str], bytes]) -> list[bytes]:
    """The encoded bytes of each of these chunks, which are distinct.

    Of what known lacks, letters alone go to words in one call, those with a space before them
    (without it) and those without; the text of any other chunk goes to other.
    """
    get = known.get
    found = list(map(get, distinct))
    lacking = [c for c, x in zip(distinct, found) if x is None]
    if not lacking:
        return found
    here: dict[str, bytes] = {}
    plain = {c for c in lacking if c.isalpha()}
    bare, ended, rest, added = [], [], [], len(lacking)
    for c in lacking:
        if c in plain:
            continue
        stem = c.rstrip(_MARKS)
        if stem != c and stem.isalpha():
            ended.append((c, stem, "\0" + c[len(stem) :]))  # letters and the run of marks after them are always parted
            if stem not in plain and stem not in here:
                x = get(stem)
                if x is None:
                    plain.add(stem)
                    added += 1
                else:
                    here[stem] = x
        else:
            (bare if c[:1] == "\0" and c[1:].isalpha() else rest).append(c)
    listed = list(plain)
    new = dict(zip(listed + bare, words(listed, [c[1:] for c in bare])))
    for c in {*rest, *(marks for _, _, marks in ended)}:
        text = c[1:] if c[:1] == "\0" else c if c == "\n" else f" {c}"
        new[c] = other(text) if text else b""
    if len(known) + added > KNOWN:
        known.clear()
    here.update(new)
    ends = {c: here[stem] + here[marks] for c, stem, marks in ended}
    here.update(ends)
    for made in (new, ends):
        known.update(made if max(map(len, made), default=0) <= LONGEST else {c: x for c, x in made.items() if len(c) <= LONGEST})
    return [here[c] if x is None else x for c, x in zip(distinct, found)]
