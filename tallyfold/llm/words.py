"""Words as every operator here cuts them: runs of characters other than ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters between words are blank and U+0009 to U+000D.


def words_of(text: Column) -> Column:
    """The words of a text in order; none of a null text."""
    blanks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(blanks, " ", -1), "")


def split_words(text: str | None) -> list[str]:
    """The same in Python. ``str.split()`` would also cut at other white space."""
    if not text:
        return []
    for gap in "\t\n\x0b\x0c\r":
        text = text.replace(gap, " ")
    return [w for w in text.split(" ") if w]


def lower_ascii(text: str) -> str:
    """A-Z in lower case, everything else unchanged."""
    return text.lower() if text.isascii() else text.encode().lower().decode()
