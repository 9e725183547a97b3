"""Quality rules: counts of each text, and its divergence from language references.

The divergence compares two histograms of a text, over classes of characters and over common words, with
references of several languages by Jensen-Shannon distance, and takes the nearest language. Everything
is a column expression over one row; nothing is shuffled and no Python runs.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.words import words_of

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

# Shares of characters in running text (small letters a-z, capital letters A-Z, digits,
# white space, other ASCII, everything else) per language.
CHAR_SHARES = {
    "en": (0.765, 0.035, 0.010, 0.165, 0.024, 0.001),
    "de": (0.755, 0.055, 0.010, 0.140, 0.022, 0.018),
    "fr": (0.745, 0.030, 0.010, 0.160, 0.025, 0.030),
    "es": (0.755, 0.030, 0.010, 0.165, 0.020, 0.020),
}
# Shares of the commonest words of running text per language.
WORD_SHARES = {
    "en": {"the": 0.060, "of": 0.032, "and": 0.028, "to": 0.025, "a": 0.022, "in": 0.020, "is": 0.011,
           "that": 0.011, "for": 0.010, "it": 0.009, "was": 0.009, "on": 0.008, "with": 0.007, "as": 0.007},
    "de": {"der": 0.030, "die": 0.030, "und": 0.026, "in": 0.018, "den": 0.012, "von": 0.011, "zu": 0.010,
           "das": 0.010, "mit": 0.009, "sich": 0.008, "auf": 0.008, "des": 0.008, "ist": 0.008, "für": 0.007},
    "fr": {"de": 0.050, "la": 0.030, "le": 0.022, "et": 0.021, "les": 0.018, "des": 0.015, "en": 0.013,
           "un": 0.012, "du": 0.011, "une": 0.010, "que": 0.009, "est": 0.009, "pour": 0.008, "qui": 0.008},
    "es": {"de": 0.060, "la": 0.037, "que": 0.030, "el": 0.027, "en": 0.025, "y": 0.024, "los": 0.017,
           "se": 0.012, "las": 0.012, "del": 0.012, "un": 0.010, "por": 0.010, "con": 0.009, "no": 0.009},
}
@dataclass(frozen=True)
class References:
    """Per language the shares of the six classes of characters, and those of its commonest words; all above 0."""

    chars: Mapping[str, Sequence[float]]
    words: Mapping[str, Mapping[str, float]]


TYPED = References(CHAR_SHARES, WORD_SHARES)
CHAR_CLASSES = 6
COMMON_WORDS = 14
MIN_CHARS_FOR_DIVERGENCE = 300
MIN_WORDS_FOR_DIVERGENCE = 100
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.30


def _distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of an array of shares to reference shares, which are above 0."""

    def term(p: Column, q: Column) -> Column:
        own = F.when(p > 0, p * F.log(F.lit(2.0) * p / (p + q))).otherwise(F.lit(0.0))
        return (own + q * F.log(F.lit(2.0) * q / (p + q))) * F.lit(0.5 / math.log(2.0))

    terms = F.zip_with(shares, F.array(*[F.lit(q) for q in reference]), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _char_counts(df: DataFrame) -> DataFrame:
    """Characters per class, and symbols; small letters and blanks, most of a text, go in one step."""
    df = df.withColumn("_left0", F.regexp_replace("_text", "[a-z ]+", ""))
    df = df.withColumn("_n_symbols", F.length("_left0") - F.length(F.regexp_replace("_left0", SYMBOLS, "")))
    steps = [("[A-Z]+", "_c1"), ("[0-9]+", "_c2"), (r"[\x09-\x0D]+", "_breaks"), (r"[\x00-\x7f]+", "_c4")]
    for i, (pattern, name) in enumerate(steps):
        df = df.withColumn(f"_left{i + 1}", F.regexp_replace(f"_left{i}", pattern, ""))
        df = df.withColumn(name, F.length(f"_left{i}") - F.length(f"_left{i + 1}"))
    df = df.withColumn("_c5", F.length("_left4")).withColumn("_chars", F.length("_text"))
    df = df.withColumn("_word_chars", F.length(F.array_join("_words", "")))
    df = df.withColumn("_c3", F.col("_chars") - F.col("_word_chars"))
    return df.withColumn("_c0", F.col("_chars") - F.length("_left0") - F.col("_c3") + F.col("_breaks"))


def _repeats(df: DataFrame) -> DataFrame:
    """Words inside windows of five words that occur twice or more in the text.

    Equal windows have equal hashes, so a text whose hashes all differ is done. In the others the hashes, cut
    short to leave room for the position, are sorted to find candidates; the windows themselves then decide, so
    the count is exact.
    """
    parts = ", ".join(f"_word_hashes[i + {k}]" for k in range(WINDOW))
    starts = f"if(size(_words) >= {WINDOW}, sequence(0, size(_words) - {WINDOW}), cast(array() as array<int>))"
    df = df.withColumn("_word_hashes", F.expr("transform(_words, w -> xxhash64(w))"))
    df = df.withColumn("_hashes", F.expr(f"transform({starts}, i -> xxhash64({parts}))"))
    df = df.withColumn("_again", F.expr("size(array_distinct(_hashes)) < size(_hashes)"))
    packed = "sort_array(transform(_hashes, (h, i) -> shiftleft(shiftright(h, 31), 31) | i))"
    df = df.withColumn("_packed", F.expr(f"if(_again, {packed}, cast(array() as array<bigint>))"))
    same = "coalesce(shiftright(x, 31) = shiftright(get(_packed, k {} 1), 31), false)"
    df = df.withColumn("_maybe", F.expr(f"filter(_packed, (x, k) -> {same.format('-')} or {same.format('+')})"))
    window = f"concat_ws(' ', slice(_words, cast(x & 2147483647 as int) + 1, {WINDOW}))"
    df = df.withColumn(
        "_sorted",
        F.expr(f"sort_array(transform(_maybe, x -> struct({window} as s, cast(x & 2147483647 as int) as p)))"),
    )
    same = "coalesce(x.s = get(_sorted, k {} 1).s, false)"
    df = df.withColumn(
        "_at",
        F.expr(f"sort_array(transform(filter(_sorted, (x, k) -> {same.format('-')} or {same.format('+')}), x -> x.p))"),
    )
    covered = (
        f"aggregate(transform(_at, (p, k) -> least({WINDOW}, coalesce(get(_at, k + 1) - p, {WINDOW}))),"
        " 0L, (a, x) -> a + x)"
    )
    return df.withColumn("_n_repeat_words", F.expr(covered))


def _common_counts(df: DataFrame, common: list[str]) -> DataFrame:
    """How often each common word, written small or with a capital, occurs; one text of them is counted."""
    forms = [*common, *(w.capitalize() for w in common)]
    joined = F.lower(F.array_join(F.filter("_words", lambda w: w.isin(forms)), "  "))
    df = df.withColumn("_common", F.concat(F.lit(" "), joined, F.lit(" ")))
    for i, w in enumerate(common):
        mark = f" {w} "
        left = F.octet_length(F.replace("_common", F.lit(mark), F.lit("")))
        df = df.withColumn(f"_n{i}", (F.octet_length("_common") - left) / len(mark.encode()))
    shares = F.array(*[F.col(f"_n{i}") for i in range(len(common))])
    return df.withColumn("_word_shares", F.transform(shares, lambda c: c / F.greatest("_n_words", F.lit(1))))


def learn_references(
    docs: DataFrame, languages: Sequence[str], lang: str = "lang", text: str = "text", common: int = COMMON_WORDS
) -> References:
    """References of the named languages from all texts of a table that say which language they are in.

    Characters are counted per class, and words of letters in small letters or with a capital as one. The ``common`` most
    frequent ones of each language (ties by the word) are its common words. Counts combine on the map side, and only
    these numbers per named language reach the driver. Null texts, and null or other languages, count nothing; a language
    without any word of its own is left out, and a table without any such language raises a ValueError. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(f"`{lang}`").alias("_lang"), F.col(f"`{text}`").alias("_text"))
    rows = rows.where(F.col("_lang").isin(list(languages)) & F.col("_text").isNotNull())
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    classes = [F.sum(f"_c{i}").alias(f"_c{i}") for i in range(CHAR_CLASSES)]
    totals = {r["_lang"]: r for r in _char_counts(rows).groupBy("_lang").agg(*classes, F.sum(F.size("_words")).alias("_n")).collect()}
    word = rows.select("_lang", F.explode("_words").alias("_word")).where(F.regexp_like("_word", F.lit(r"^\p{L}\p{Ll}*$")))
    counted = word.groupBy("_lang", F.lower("_word").alias("_word")).count()
    order = Window.partitionBy("_lang").orderBy(F.desc("count"), "_word")
    top = counted.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= common).orderBy("_lang", "_place")
    words: dict[str, dict[str, float]] = {}
    for r in top.collect():
        words.setdefault(r["_lang"], {})[r["_word"]] = r["count"] / (totals[r["_lang"]]["_n"] + 1)
    if not words:
        raise ValueError("no text in any of the languages has a word")
    chars = {}
    for name in words:
        counts = [totals[name][f"_c{i}"] + 1 for i in range(CHAR_CLASSES)]  # one more each, so that no share is 0
        chars[name] = [n / sum(counts) for n in counts]
    return References(chars, words)


def measure_quality(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    with_text: bool = False,
    references: References = TYPED,
) -> DataFrame:
    """``keep`` columns and, for every row, counts, divergences and verdicts.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); char_distance and word_distance (double,
    to the nearest language, null for texts under the minimum lengths); base_failed and kept (boolean). A null or
    empty text has no words and fails. Repeated rows are judged each; other columns of ``docs`` are not read.
    A text is one row; its longest intermediate value is five times its own size. ``with_text`` adds the text itself as _text,
    empty where it is null. ``references`` are those of ``learn_references``, or typed ones of four languages.
    """
    df = docs.select(
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_n_words", F.size("_words").cast("long"))
    df = _repeats(_char_counts(df))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_lines", lines)
    common = sorted({w for shares in references.words.values() for w in shares})
    df = _common_counts(df, common)
    counts = F.array(*[F.col(f"_c{i}") for i in range(CHAR_CLASSES)])
    df = df.withColumn("_char_shares", F.transform(counts, lambda c: c / F.greatest("_chars", F.lit(1))))

    by_chars = [_distance(F.col("_char_shares"), list(q)) for q in references.chars.values()]
    by_words = []
    for shares in references.words.values():
        at = F.array(*[F.lit(common.index(w)) for w in shares])
        own = F.transform(at, lambda k: F.get("_word_shares", k))
        rest = F.greatest(F.lit(1.0) - F.aggregate(own, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
        by_words.append(_distance(F.concat(own, F.array(rest)), [*shares.values(), 1.0 - sum(shares.values())]))
    long_enough = (F.col("_chars") >= MIN_CHARS_FOR_DIVERGENCE) & (F.col("_n_words") >= MIN_WORDS_FOR_DIVERGENCE)
    df = df.withColumn("_char_distance", F.when(long_enough, F.least(*by_chars)))
    df = df.withColumn("_word_distance", F.when(long_enough, F.least(*by_words)))

    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))
    far = F.coalesce(F.col("_char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("_word_distance") > MAX_WORD_DISTANCE, F.lit(False)
    )
    return df.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_n_words").alias("n_words"),
        F.col("_word_chars").cast("long").alias("word_chars"),
        F.col("_n_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        # The always true last part keeps a filter on the verdict from being computed anew below this projection.
        (~failed & ~far & (F.monotonically_increasing_id() >= 0)).alias("kept"),
        F.col("_char_distance").alias("char_distance"),
        F.col("_word_distance").alias("word_distance"),
        *[F.col("_text")] * with_text,
    )


def keep_good(docs: DataFrame, text: str = "text", references: References = TYPED) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names."""
    # The text goes once through each row; a null one is never kept.
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    rows = docs.select(F.struct(F.lit(1).alias("one"), *others).alias("_row"), F.col(f"`{text}`").alias("text"))
    kept = measure_quality(rows, keep=("_row",), with_text=True, references=references).where("kept")
    return kept.select(*[F.col("_text" if c == text else f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
