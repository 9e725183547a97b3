"""Phrases of two to four words that stand together more often than their parts suggest.

Counting goes by length: words first, then pairs of counted words, then triples and quadruples of counted pairs. A phrase
cannot be more frequent than its parts, so a bit table of those that reached the minimum tells which phrases need not
be counted; a bit set by chance only costs a count, never a result. Each task counts its own text in sorted runs, and equal
phrases are combined before and after the shuffle.

The frequent phrases are then kept as two streams: in prefix order, by their words, and in suffix order, by their words
from last to first. In each stream the parts that a phrase begins (or ends) with stand before it, so that one pass
with the open parts at hand merges each phrase with the counts of its left (or right) parts and tells each part the
count of its extension by one word. No table of counts is looked up by hash. Streams are cut into slices of about
``SLICE_ROWS`` phrases (``MAX_SLICES`` slices at most, longer ones beyond it); a slice starts with a copy of the parts its first phrase begins with, at most three rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.words import lower_ascii
from tallyfold.session import stored

MAX_WORDS = 4
MIN_COUNT = 30
ABSORB_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
# Bits of the table of frequent parts, 8 MB; what it cannot tell apart is counted.
BITS = 26
# Tokens of one language that a task counts at a time, and distinct words it holds.
RUN_TOKENS = 1_500_000
RUN_WORDS = 400_000
RUN_LANGUAGES = 16
SLICE_ROWS = 20_000
MAX_SLICES = 4_096
SAMPLED_PER_SLICE = 20
# Odd factors below 2**30 that mix the checksums of a pair's words without leaving 63 bits.
LEFT_FACTOR, RIGHT_FACTOR, SHIFT = 0x2545F491, 0x27D4EB2F, 18

# Characters between pieces of text; a line end stands for all of them, and never is in a word.
ENDS = ".,;:!?\x0b\x0c\r"
GAP = "\n"


def tokens_of(text: str | None) -> list[str]:
    """Words in order, with a line end wherever a piece of text ends."""
    if not text:
        return []
    text = lower_ascii(text)
    for mark in ENDS:
        text = text.replace(mark, GAP)
    return [t for t in text.replace(GAP, f" {GAP} ").replace("\t", " ").split(" ") if t]


def _checksum(lang: str, word: str) -> int:
    return zlib.crc32(f"{lang}\n{word}".encode())


def _word_bit(bits: int) -> Column:
    return F.crc32(F.concat_ws("\n", "lang", "phrase")) % (1 << bits)


def _pair_bit(bits: int) -> Column:
    left, right = (F.crc32(F.concat_ws("\n", "lang", F.split("phrase", " ")[i])) for i in (0, 1))
    return F.shiftright(left * LEFT_FACTOR + right * RIGHT_FACTOR, SHIFT) % (1 << bits)


def _bit_table(phrases: DataFrame, bit: Column, bits: int) -> np.ndarray:
    """The bits of all phrases; 4 KB for each block of bits reach the driver, whatever the number of phrases."""
    own = phrases.select(bit.alias("bit")).select(F.shiftright("bit", 15).alias("block"), (F.col("bit") % (1 << 15)).alias("bit"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for row in own.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect():
        table[row["block"] << 12 : (row["block"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return table


def _set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _rows(lang: str, phrases: pa.Array, counts: pa.Array, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(phrases), size):
        part = phrases.slice(i, size)
        langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([lang])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs, part, counts.slice(i, size)], ["lang", "phrase", "f"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            text = text.as_py()
            if text:
                yield lang.as_py(), text


def _count_words(texts: DataFrame) -> DataFrame:
    """lang, phrase, f of single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            found = counts.pop(lang)
            found.pop(GAP, None)
            yield from _rows(lang, pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()))

        for lang, text in _documents(batches):
            found = counts.setdefault(lang, Counter())
            found.update(tokens_of(text))
            if len(found) > RUN_WORDS or len(counts) > RUN_LANGUAGES:
                yield from out(max(counts, key=lambda k: len(counts[k])))
        for lang in list(counts):
            yield from out(lang)

    counted = texts.mapInArrow(run, "lang string, phrase string, f bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


class _Numbers(dict):
    """Words to numbers in the order of their first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Run:
    """Tokens of one language as numbers, to count their phrases at once."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.parts, self.size = lang, _Numbers({GAP: 0}), [], 0

    def add(self, tokens: list[str]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(tokens) + 1

    def full(self) -> bool:
        return self.size > RUN_TOKENS or len(self.numbers) > RUN_WORDS

    def phrases(self, words: np.ndarray, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Pairs of words in the bit table ``words``; with ``pairs`` the triples and quadruples of pairs in that table."""
        at = np.concatenate(self.parts)
        names = pa.array(list(self.numbers), pa.string())
        sums = np.array([_checksum(self.lang, w) for w in self.numbers], np.int64)
        frequent = _set(words, sums % (len(words) * 8))
        frequent[0] = False
        good = frequent[at]
        starts = np.flatnonzero(good[:-1] & good[1:])
        code = at[starts].astype(np.int64) * len(sums) + at[starts + 1]
        if pairs is None:
            yield from self._counted(names, [code], [(0, 1)], len(sums))
            return
        own = sums[at]
        bit = ((own[starts] * LEFT_FACTOR + own[starts + 1] * RIGHT_FACTOR) >> SHIFT) % (len(pairs) * 8)
        kept = _set(pairs, bit)
        starts, code = starts[kept], code[kept]
        opens = np.full(len(at) + 3, -1, np.int64)
        opens[starts] = code
        third = starts[opens[starts + 1] >= 0]
        yield from self._counted(names, [opens[third], at[third + 2].astype(np.int64)], [(0, 1), (2,)], len(sums))
        fourth = third[opens[third + 2] >= 0]
        yield from self._counted(names, [opens[fourth], opens[fourth + 2]], [(0, 1), (2, 3)], len(sums))

    def _counted(self, names: pa.Array, keys: list[np.ndarray], places: list[tuple], base: int) -> Iterator[pa.RecordBatch]:
        """Equal phrases side by side by sorting, counted as runs."""
        if not len(keys[0]):
            return
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        keys = [k[order] for k in keys]
        new = np.zeros(len(order), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = True
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(order)))
        columns = []
        for k, place in zip(keys, places, strict=True):
            own = k[first]
            columns += [own // base, own % base] if len(place) == 2 else [own]
        for i in range(0, len(first), 50_000):
            phrases = pc.binary_join_element_wise(*[names.take(pa.array(c[i : i + 50_000])) for c in columns], " ")
            yield from _rows(self.lang, phrases, pa.array(counts[i : i + 50_000]))


def _count_phrases(texts: DataFrame, words: np.ndarray, pairs: np.ndarray | None) -> DataFrame:
    """lang, phrase, f of the phrases that the bit tables let through."""
    send = texts.sparkSession.sparkContext.broadcast
    tables = send(words), send(pairs) if pairs is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, Run] = {}
        own = tables[0].value, tables[1].value if tables[1] is not None else None
        for lang, text in _documents(batches):
            runs.setdefault(lang, Run(lang)).add(tokens_of(text))
            if runs[lang].full() or len(runs) > RUN_LANGUAGES:
                largest = max(runs, key=lambda k: runs[k].size)
                yield from runs.pop(largest).phrases(*own)
        for lang in list(runs):
            yield from runs.pop(lang).phrases(*own)

    counted = texts.mapInArrow(run, "lang string, phrase string, f bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of one to four words found ``least`` times or more, and (lang, n) of all words."""
    texts = _texts(docs, text, lang)
    words = stored(_count_words(texts), "words")
    frequent = F.col("f") >= least
    singles = words.where(frequent)
    known = _bit_table(singles, _word_bit(bits), bits)
    pairs = stored(_count_phrases(texts, known, None).where(frequent), "pairs")
    longer = stored(_count_phrases(texts, known, _bit_table(pairs, _pair_bit(bits), bits)).where(frequent), "longer")
    return singles.unionByName(pairs).unionByName(longer), words.groupBy("lang").agg(F.sum("f").alias("n"))


def _in_order(rows: DataFrame, key: Column, total: int) -> DataFrame:
    """Rows with _key, an array that begins with the language, in sorted slices.

    A slice begins at a sampled key. Rows whose key is a proper beginning of it are copied to that slice, marked by _copy.
    The sample only decides where slices begin; the keys sampled are at most about ``MAX_SLICES * SAMPLED_PER_SLICE``.
    """
    keyed = rows.withColumn("_key", key)
    slices = min(MAX_SLICES, max(1, -(-total // SLICE_ROWS)))
    bounds: list[list[str]] = []
    if slices > 1:
        every = max(1, total // (slices * SAMPLED_PER_SLICE))
        found = sorted(r[0] for r in keyed.where(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).select("_key").collect())
        bounds = [found[i * len(found) // slices] for i in range(1, slices)] if found else []
        bounds = [b for i, b in enumerate(bounds) if not i or b != bounds[i - 1]]
    sent = rows.sparkSession.sparkContext.broadcast(bounds)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", _slice int, _copy boolean"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows_of, slice_of, copy = [], [], []
            for i, key in enumerate(batch.column("_key").to_pylist()):
                at = bisect_right(own, key)
                rows_of.append(i)
                slice_of.append(at)
                copy.append(False)
                # The bounds that this key begins come next after it.
                while at < len(own) and own[at][: len(key)] == key:
                    at += 1
                    rows_of.append(i)
                    slice_of.append(at)
                    copy.append(True)
            dealt = batch.take(pa.array(rows_of, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*dealt.columns, pa.array(slice_of, pa.int32()), pa.array(copy, pa.bool_())],
                [*dealt.schema.names, "_slice", "_copy"],
            )

    dealt = keyed.mapInArrow(deal, schema)
    return dealt.repartitionByRange(len(bounds) + 1, "_slice").sortWithinPartitions("_slice", "_key")


def _merged(ordered: DataFrame, kept: list[str], counts: str, absorb: int) -> DataFrame:
    """Lockstep merge of a sorted stream with itself: each phrase and the counts of what it begins with.

    Returns ``kept`` columns, ``counts`` (from the longest beginning to the shortest) and _key of each phrase; and a row with
    counts null for each beginning that its extension by one word absorbs.
    """
    fields = {f.name: f.dataType.simpleString() for f in ordered.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in kept) + f", `{counts}` array<bigint>, _key array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_keys: list[list[str]] = []
        open_counts: list[int] = []
        for batch in batches:
            keys, f, copy = (batch.column(c).to_pylist() for c in ("_key", "f", "_copy"))
            at, found, out_keys, absorbed = [], [], [], []
            for i, key in enumerate(keys):
                while open_keys and (len(open_keys[-1]) >= len(key) or key[: len(open_keys[-1])] != open_keys[-1]):
                    open_keys.pop()
                    open_counts.pop()
                if not copy[i]:
                    at.append(i)
                    found.append(open_counts[::-1])
                    out_keys.append(key)
                    if len(key) > 3 and 100 * f[i] >= absorb * open_counts[-1]:
                        absorbed.append(open_keys[-1])
                open_keys.append(key)
                open_counts.append(f[i])
            own = batch.select(kept).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(found, pa.list_(pa.int64())), pa.array(out_keys, pa.list_(pa.string()))],
                [*kept, counts, "_key"],
            )
            if absorbed:
                nulls = [pa.nulls(len(absorbed), batch.schema.field(c).type) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*nulls, pa.nulls(len(absorbed), pa.list_(pa.int64())), pa.array(absorbed, pa.list_(pa.string()))],
                    [*kept, counts, "_key"],
                )

    return ordered.mapInArrow(run, schema)


def _phrase_of(key: Column, backwards: bool) -> Column:
    words = F.slice(key, 2, MAX_WORDS)
    return F.array_join(F.reverse(words) if backwards else words, " ")


def _floor_share(a: Column, whole: Column) -> Column:
    """floor(2,000,000 a / whole) in whole numbers."""
    return F.call_function("div", a * F.lit(SCALE).cast("decimal(38,0)"), whole)


def mine(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = MIN_COUNT,
    absorb: int = ABSORB_PERCENT,
    top: int = TOP,
    bits: int = BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to four words.

    A null text is empty, a null language is ``und``, and an empty table or one without frequent phrases gives no rows. Repeated rows
    count each. Other columns are not read. Phrases that tie in score and count are ranked by their bytes. Counts cover all
    words of all texts; the score is exact as long as 2,000,000 times a count fits 127 bits. A text is held as its words
    by one task; a task counts about ``RUN_TOKENS`` words, or one longer text, at a time.
    """
    phrases, totals = frequent_phrases(docs, text, lang, least, bits)
    words = F.split("phrase", " ")
    total = phrases.count()
    by_suffix = _in_order(phrases, F.concat(F.array("lang"), F.reverse(words)), total)
    right = _merged(by_suffix, ["f"], "right", absorb)
    right = stored(right.select(F.col("_key")[0].alias("lang"), _phrase_of(F.col("_key"), True).alias("phrase"), "f", "right"), "right")
    # Words that only mark a phrase as absorbed go round the second stream.
    own, marks = right.where(F.col("right").isNotNull()), right.where(F.col("right").isNull()).select("lang", "phrase")
    by_prefix = _in_order(own, F.concat(F.array("lang"), words), total)
    left = _merged(by_prefix, ["f", "right"], "left", absorb)
    left = stored(left.select(F.col("_key")[0].alias("lang"), _phrase_of(F.col("_key"), False).alias("phrase"), "f", "left", "right"), "left")
    marks = marks.unionByName(left.where(F.col("left").isNull()).select("lang", "phrase"))

    # Cut k leaves k words on the left: the k-th shortest beginning, and the end of n - k words.
    wide = lambda c: c.cast("decimal(38,0)")
    sums = F.zip_with(F.reverse("left"), F.col("right"), lambda x, y: F.struct(x.alias("l"), y.alias("r")))
    scored = left.where("left is not null and size(left) > 0").withColumn(
        "_cut",
        F.array_min(
            F.transform(
                sums,
                lambda c, k: F.struct(
                    _floor_share(wide(F.col("f")), wide(c["l"]) + wide(c["r"])).alias("score"),
                    k.alias("k"),
                    c["l"].alias("l"),
                    c["r"].alias("r"),
                ),
            )
        ),
    )
    rows = scored.select("lang", "phrase", F.col("f").alias("a"), "_cut", F.lit(False).alias("gone"))
    marked = marks.select("lang", "phrase", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast(rows.schema["_cut"].dataType).alias("_cut"), F.lit(True).alias("gone"))
    kept = (
        rows.unionByName(marked)
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("a"), F.max("_cut").alias("_cut"), F.max("gone").alias("gone"))
        .where("not gone")
    )
    kept = kept.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))
    # The best of each share of a language's phrases, then the best of these.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = max(1, -(-total // SLICE_ROWS))
    kept = kept.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    kept = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = ranked.withColumn("rank", F.col("_rank").cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
