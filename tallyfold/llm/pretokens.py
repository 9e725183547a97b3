"""Cutting a text into pieces that byte-level BPE encodes independently of each other.

The split pattern of the public byte-level vocabularies always ends a match before white space that follows another
character, and between a letter and a mark that closes a word. Parts may therefore start there, and equal parts have equal ids
wherever they stand, so that a worker encodes each distinct part once and looks the others up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

# The characters with Unicode's White_Space property, which the pattern's \s means.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Letters of Latin and Cyrillic script, which any version of Unicode calls letters. The split pattern ends a match between such
# a letter and anything that is none, and around a line end that stands between other characters.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0400-\u0481\u048a-\u052f"
CLOSING = ".,;:!?"
PART = re.compile(
    f" ?[{LETTERS}]++(?=[{CLOSING}{WHITE}]|$)"  # a word, with the blank before it
    f"|[{CLOSING}]++(?=[{WHITE}]|$)"  # what closes it
    f"|\n(?=[{LETTERS}])"  # a single line end
    f"|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"  # anything else up to the next white space
)
WORD = re.compile(f" ?[{LETTERS}]+")
MAX_CACHED_PIECE = 64
# About 250 bytes each, so that a worker's cache stays under 80 MB.
MAX_CACHED_PIECES = 300_000
SLICE_BYTES = 4_000_000


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch in runs of about ``most`` characters, so that only a part of it is Python strings at a time."""
    run, size = [], 0
    for value in texts:
        run.append(value.as_py())
        size += len(run[-1] or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
