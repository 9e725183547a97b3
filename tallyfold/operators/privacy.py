"""Personal details: scan, mask, and numbered codes in place of names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import OrderedRows, dealt_anew, row_number
from ..functions.text import GAP, LINEAR_FIND, LINEAR_TEST, PII_PATTERNS, WORD, let, words
from ..functions.text import fold_digits as folded


def _searched(text: Column, fold_digits: bool) -> Column:
    return folded(text) if fold_digits else text


def _occurs(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs; a text without an @ is not searched for addresses."""
    found = text.rlike(LINEAR_TEST.get(pattern, pattern))
    return text.contains("@") & found if "@" in pattern else found


def any_pii(text: Column, fold_digits: bool = False) -> Column:
    """Whether any pattern occurs anywhere in the text."""
    text = _searched(text, fold_digits)
    found = reduce(lambda a, b: a | b, [_occurs(text, p) for p in PII_PATTERNS.values()])
    return F.coalesce(found, F.lit(False))


def scan_pii(
    df: DataFrame,
    col: str,
    patterns: Mapping[str, str] = PII_PATTERNS,
    fold_digits: bool = False,
) -> DataFrame:
    """Add ``has_<pattern>`` per pattern and ``has_any``, in one pass over whole texts."""
    text = _searched(F.col(col), fold_digits)
    flags = {f"has_{n}": F.coalesce(_occurs(text, p), F.lit(False)) for n, p in patterns.items()}
    return df.withColumns(flags).withColumn(
        "has_any", reduce(lambda a, b: a | b, [F.col(n) for n in flags])
    )


def mask_pii(
    df: DataFrame, col: str, patterns: Mapping[str, str] = PII_PATTERNS, mask: str = "***"
) -> DataFrame:
    """Replace every detail by ``mask`` and count the places in ``masked``."""
    either = "|".join(f"(?:{LINEAR_FIND.get(p, p)})" for p in patterns.values())
    text = F.col(col)
    found = reduce(lambda a, b: a | b, [_occurs(text, p) for p in patterns.values()])
    return df.withColumns(
        {
            col: F.when(found, F.regexp_replace(text, either, mask)).otherwise(text),
            "masked": F.when(found, F.regexp_count(text, F.lit(either))).otherwise(F.lit(0)),
        }
    )


_CODE = "طالب "
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"  # Unicode noncharacters, which no exchanged text contains
# Hits of a document are folded in blocks, so that the work stays in proportion to them.
_BLOCK = 128
_HIT = "struct<at:int,back:int,number:bigint>"


def _pieces(text: Column) -> Column:
    """Words at odd places and what separates them at even ones, from the first word on."""
    return F.regexp_extract_all(F.regexp_replace(text, f"^{GAP}", ""), F.lit(f"({WORD}+|{GAP})"), F.lit(1))


def _as_words(name: Column) -> Column:
    """A name as its words with one blank between them."""
    return F.array_join(words(name), " ")


def _runs(pieces: Column, sizes: Sequence[int]) -> Column:
    """(at, n, name) of every run of these numbers of words; ``at`` counts words from 0."""
    nothing = F.array().cast("array<struct<at:int,n:int,name:string>>")

    def of_size(found: Column, n: int) -> Column:
        last = F.size(found) - n
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(
                i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(found, i + 1, F.lit(n)), " ").alias("name")
            ),
        )
        return F.when(last >= 0, runs).otherwise(nothing)

    own = F.filter(pieces, lambda x, i: i % 2 == 0)
    return let(own, lambda found: F.flatten(F.array(*[of_size(found, n) for n in sizes])))


def roster_codes(
    roster: DataFrame,
    docs: DataFrame,
    owner: str,
    name: str = "name",
    body: str = "text",
    code: str = _CODE,
) -> DataFrame:
    """owner, name, code, number and words: one numbered code per name of each owner, in name order.

    Names with the same words are one name, whatever stands between the words; the smallest spelling is shown. Numbering
    starts above any code-like text already in the owner's documents; restoring then cannot touch what was there before.
    """
    seen = F.regexp_extract_all(F.col(body), F.lit(f"{code}([0-9]+)"), F.lit(1))
    highest = F.array_max(F.transform(seen, lambda n: n.try_cast("long")))
    base = docs.groupBy(owner).agg(F.max(highest).alias("_base")).where("_base is not null")
    trimmed = F.regexp_replace(F.col(name), f"^{GAP}|{GAP}$", "")
    names = roster.select(owner, trimmed.alias("name")).where(F.col("name").rlike(r"\p{L}"))
    names = names.groupBy(owner, _as_words(F.col("name")).alias("words")).agg(F.min("name").alias("name"))
    numbered = OrderedRows(names, owner, ["name", "words"]).add(_n=row_number()).rows()
    number = F.col("_n") + F.coalesce("_base", F.lit(0))
    return (
        numbered.join(dealt_anew(base, owner), owner, "left")
        .withColumn("number", number)
        .select(owner, "name", F.concat(F.lit(code), F.col("number")).alias("code"), "number", "words")
    )


def pseudonymise(
    docs: DataFrame,
    roster: DataFrame,
    owner: str,
    key: Sequence[str],
    body: str = "text",
    name: str = "name",
    longest: int | None = None,
    code: str = _CODE,
) -> dict[str, DataFrame]:
    """Replace roster names by numbered codes; returns ``docs`` (with ``replaced`` and ``places``) and ``map``.

    A text is cut once into words and what separates them. Names match word by word, whatever separates the words in
    the roster or in the text (blanks, line ends, marks); a name inside another word is left alone. From left to
    right the longest name that begins at a word is replaced and the next one is sought after it. ``places`` holds each code-like
    stretch of the new text in order, with what it stands for, so that ``restore`` gives the very text back. Names of any number
    of words count, or of up to ``longest`` words where it is given.

    The runs of words of a document meet its owner's roster in one equality join, so only names that really occur travel
    back, and the work per document is in proportion to its words and hits. ``key`` is unique in ``docs``. The driver learns
    the distinct numbers of words in names, a few integers.
    """
    codes = roster_codes(roster, docs, owner, name, body, code)
    counts = codes.select(F.size(words(F.col("name"))).alias("n")).distinct().collect() if longest is None else ()
    sizes = range(1, longest + 1) if longest is not None else sorted(r.n for r in counts) or [1]

    runs = docs.select(*key, owner, F.explode(_runs(_pieces(F.col(body)), sizes)).alias("_run"))
    runs = runs.select(*key, owner, F.col("_run.at").alias("at"), F.col("_run.n").alias("n"), F.col("_run.name").alias("words"))
    # Both sides are much larger than the files they are estimated from: neither is ever sent to the driver.
    known = dealt_anew(codes.select(owner, "words", "number"), [owner, "words"]).hint("merge")
    met = runs.join(known, [owner, "words"])
    # Of runs that begin at one word the longest comes first. At most one element per run of the document.
    hit = F.struct("at", (-F.col("n")).alias("back"), F.col("number").cast("bigint").alias("number"))
    hits = met.groupBy(*key).agg(F.array_sort(F.collect_list(hit)).alias("_hits"))

    done = docs.join(hits, list(key), "left").withColumn("_pieces", _pieces(F.col(body)))
    done = done.withColumn(
        "_kept",
        F.expr(
            f"""if(_hits is null, cast(array() as array<{_HIT}>), aggregate(
              transform(sequence(0, (size(_hits) - 1) div {_BLOCK}), b -> slice(_hits, cast(b * {_BLOCK} + 1 as int), {_BLOCK})),
              named_struct('stop', 0, 'kept', cast(array() as array<array<{_HIT}>>)),
              (s, block) -> aggregate(
                block, named_struct('stop', s.stop, 'kept', cast(array() as array<{_HIT}>)),
                (t, h) -> if(h.at >= t.stop, named_struct('stop', h.at - h.back, 'kept', concat(t.kept, array(h))), t),
                t -> named_struct('stop', t.stop, 'kept', concat(s.kept, array(t.kept)))),
              s -> flatten(s.kept)))"""
        ),
    )
    # Pieces up to 2 at belong to what stands before a hit, and the hit ends with piece 2 (at + n) - 1.
    end = "2 * (get(_kept, k - 1).at - get(_kept, k - 1).back) - 1"
    done = done.withColumn(
        "_parts",
        F.expr(
            f"""transform(_kept, (h, k) -> named_struct(
              'before', array_join(slice(_pieces, if(k = 0, 0, {end}) + 1, 2 * h.at - if(k = 0, 0, {end})), ''),
              'was', array_join(slice(_pieces, 2 * h.at + 1, -2 * h.back - 1), ''),
              'number', h.number))"""
        ),
    )
    last = F.expr("if(size(_kept) = 0, 0, 2 * (element_at(_kept, -1).at - element_at(_kept, -1).back) - 1)")
    done = done.withColumn("_last", last)
    done = done.withColumn("_tail", F.array_join(F.slice("_pieces", F.col("_last") + 1, F.greatest(F.size("_pieces") - F.col("_last"), F.lit(0))), ""))

    def own(text: Column) -> Column:
        like = F.regexp_extract_all(text, F.lit(f"({code}[0-9]+)"), F.lit(1))
        return F.transform(like, lambda c: F.struct(c.alias("code"), c.alias("was")))

    def coded(p: Column) -> Column:
        return F.concat(F.lit(code), p["number"].cast("string"))

    places = F.flatten(
        F.transform(
            "_parts",
            lambda p: F.concat(own(p["before"]), F.array(F.struct(coded(p).alias("code"), p["was"].alias("was")))),
        )
    )
    written = F.concat(
        F.regexp_extract(body, f"^(?:{GAP})?", 0),
        F.array_join(F.transform("_parts", lambda p: F.concat(p["before"], coded(p))), ""),
        F.col("_tail"),
    )
    any_hit = F.size("_kept") > 0
    result = done.withColumns(
        {
            "places": F.when(any_hit, F.concat(places, own(F.col("_tail")))),
            "replaced": F.size("_kept"),
            "_written": F.when(any_hit, written).otherwise(F.col(body)),
        }
    ).withColumn(body, F.col("_written"))
    drop = ("_written", "_hits", "_pieces", "_kept", "_parts", "_last", "_tail")
    return {"docs": result.drop(*drop).select(*docs.columns, "replaced", "places"), "map": codes}


def restore(
    docs: DataFrame,
    mapping: DataFrame,
    owner: str,
    key: Sequence[str],
    body: str = "text",
    code: str = _CODE,
    places: str = "places",
) -> DataFrame:
    """Put the names back in place of the codes of this mapping; other code-like text stays.

    Where the codes of a text are those of its ``places``, in the same order, each becomes what stood there, to the byte. In a
    text that was changed in between, or without the column ``places``, a code becomes the name of the mapping.
    """
    pattern = f"{code}([0-9]+)"
    if places in docs.columns:
        recorded = F.col(places)
    else:
        recorded = F.lit(None).cast("array<struct<code:string,was:string>>")
    marked = docs.withColumn("_places", recorded).withColumn(
        "_same", F.coalesce(F.regexp_extract_all(body, F.lit(f"({pattern})"), F.lit(1)) == F.col("_places.code"), F.lit(False))
    )
    numbers = F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(1)))
    used = marked.where("not _same").select(*key, owner, F.explode(numbers).alias("_n"))
    known = mapping.select(owner, F.col("number").cast("string").alias("_n"), "name")
    met = used.join(known.hint("merge"), [owner, "_n"])
    hits = met.groupBy(*key).agg(F.collect_list(F.struct("_n", "name")).alias("_hits"))
    between = F.split(body, f"{code}[0-9]+", -1)
    exact = F.array_join(
        F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get("_places", i)["was"], F.lit("")))), ""
    )
    opened = F.regexp_replace(body, pattern, f"{_OPEN}$1{_CLOSE}")
    named = F.aggregate(
        F.coalesce("_hits", F.array().cast("array<struct<_n:string,name:string>>")),
        opened,
        lambda text, h: F.replace(
            text, F.concat(F.lit(_OPEN), h["_n"], F.lit(_CLOSE)), h["name"]
        ),
    )
    back = F.regexp_replace(named, f"{_OPEN}([0-9]+){_CLOSE}", f"{code}$1")
    whole = marked.join(hits, list(key), "left")
    return whole.withColumn(body, F.when(F.col("_same"), exact).otherwise(back)).drop("_hits", "_places", "_same", places)


def find_suspects(
    docs: DataFrame, names: DataFrame, key: Sequence[str], body: str = "text", name: str = "name"
) -> DataFrame:
    """Listed first names that still occur in each document, as ``suspects`` in name order."""

    def tokens(df: DataFrame) -> DataFrame:
        return df.select(*key, F.explode(F.array_distinct(words(F.col(body)))).alias("name"))

    listed = names.select(F.col(name).alias("name")).distinct()
    met = tokens(docs).join(dealt_anew(listed, "name"), "name", "left_semi")
    # At most one element per distinct word of the document.
    found = met.groupBy(*key).agg(F.array_sort(F.collect_list("name")).alias("suspects"))
    return docs.join(found, list(key), "left").withColumn(
        "suspects", F.coalesce("suspects", F.array().cast("array<string>"))
    )
