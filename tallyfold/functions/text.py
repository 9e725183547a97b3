"""Text and number coercions with the loose rules of a web form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space stripped from both ends of a submitted text.
SPACE = (
    r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

# What a leaked personal detail looks like.
PII_PATTERNS = {
    "national_id": r"[12][0-9]{9}",
    "mobile": r"(?:\+?966|0)5[0-9]{8}",
    "email": r"[\w.\-]+@[\w.\-]+\.\w{2,}",
}

# The address pattern, tried at each character of a run of word characters, is quadratic in the run. To tell whether
# an address occurs, one character before the @ is enough; to find all of them, a run is tried only where it
# begins or where the match before it ended. Both give what the plain pattern gives.
LINEAR_TEST = {PII_PATTERNS["email"]: r"[\w.\-]@[\w.\-]+\.\w{2,}"}
LINEAR_FIND = {PII_PATTERNS["email"]: r"(?:\G|(?<![\w.\-]))[\w.\-]++@[\w.\-]+\.\w{2,}"}

ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"

# A word is a run of letters, marks and digits; everything else separates words. Java's \b is not
# used because it does not treat Arabic letters as word characters.
WORD = r"[\p{L}\p{M}\p{N}]"
GAP = r"[^\p{L}\p{M}\p{N}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A lambda body is evaluated per element, and an expression it captures is evaluated anew each
    time; bound as a lambda variable it is computed once.
    """
    return F.transform(F.array(value), use)[0]


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def fold_digits(text: Column) -> Column:
    """Arabic-Indic digits as ASCII digits."""
    return F.translate(text, ARABIC_DIGITS, "0123456789")


def lenient_int(text: Column) -> Column:
    """The leading integer of a text, 0 when there is none."""
    digits = F.regexp_extract(text, rf"^{SPACE}*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def clipped(text: Column, size: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def loose_number(value: Column) -> Column:
    """A JSON (variant) value compared as a number: text is parsed, true is 1, JSON null is 0."""
    kind = F.schema_of_variant(value)
    text = strip_space(value.try_cast("string"))
    return (
        F.when(kind == "VOID", F.lit(0.0))
        .when(kind == "BOOLEAN", F.when(value.try_cast("boolean"), 1.0).otherwise(0.0))
        .when((kind == "STRING") & (text == ""), F.lit(0.0))
        .otherwise(text.try_cast("double"))
    )


def json_number(json: Column, path: str) -> Column:
    """``loose_number`` of one path of a JSON text; null when absent or not a number."""
    return loose_number(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def string_items(json: Column) -> Column:
    """The string elements of a JSON array; an empty array for anything else."""
    items = F.try_parse_json(json).try_cast("array<variant>")
    texts = F.transform(
        F.filter(items, lambda e: F.schema_of_variant(e) == "STRING"),
        lambda e: e.cast("string"),
    )
    return F.coalesce(texts, F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD}+)"), F.lit(1))


def minor_units(amount: Column) -> Column:
    """An amount of money in hundredths, rounded half up."""
    return F.round(amount * 100).cast("long")


def share_half_up(amount: Column, part: Column, whole: Column) -> Column:
    """amount * part / whole in whole minor units, rounded half up, in integers throughout."""
    return F.call_function("div", amount * part * 2 + whole, whole * 2)


def word_runs(items: Column, size: int, make: Callable[[Column], Column]) -> Column:
    """``make`` of every run of ``size`` consecutive items; of all items when there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: make(F.slice(items, i, F.lit(size))))
