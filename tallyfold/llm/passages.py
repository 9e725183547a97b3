"""Removal of passages that occur earlier, by FM-index shards.

A window is ``WINDOW`` consecutive words. Equal windows hold equal word runs, so each window goes by the one of its runs of ``GRAM``
words with the smallest hash (the first of equal ones), its anchor, and consecutive windows with the anchor at one place travel together
as a segment. Equal windows have equal anchors at equal places within them: the windows of one segment all differ, an anchor that occurs
once holds no repeated window, and shards made by anchor see all occurrences of a window.
Equal segments are reduced to the earliest; the later ones are removed whole. The earliest of each go with their words to shards
of bounded size. A shard builds a compressed FM-index of its segments and streams them through it by backward search;
windows whose match of ``WINDOW`` words also starts earlier are reported. An anchor with very many different segments sends
no words: each of its windows is a narrow row with a 128-bit hash of its words, and equal windows are reduced to the earliest by an
aggregate that combines before the shuffle. All occurrences of a window have the anchor, so such windows need no index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.fm_index import FmIndex
from tallyfold.llm.pretokens import slices
from tallyfold.llm.words import split_words
from tallyfold.session import stored

WINDOW = 20
GRAM = 5
# Windows in one segment at most: as many as a run of GRAM words has places in a window.
MOST = WINDOW - GRAM + 1
# Symbols in a shard, about; and different segments of one anchor beyond which its windows are compared by hash.
SHARD_SYMBOLS = 1_500_000
HOT_SEGMENTS = 5_000
MAX_CACHED_WORDS = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class WordHashes:
    """64-bit hashes of words; distinct words are hashed once, and a full cache is emptied."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def of(self, words: list[list[str]]) -> np.ndarray:
        if len(self.at) > MAX_CACHED_WORDS:
            self.at, self.hashes = {}, self.hashes[:0]
        new = list(set().union(*words).difference(self.at)) if words else []
        if new:
            self.at.update(zip(new, range(len(self.hashes), len(self.hashes) + len(new)), strict=True))
            found = np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)
            self.hashes = np.concatenate([self.hashes, found])
        get = self.at.__getitem__
        return self.hashes[np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(get, w), np.int64, len(w)) for w in words)])]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))


def segments(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, digest) of the segments of documents that lie in a row."""
    n = len(hashes)
    starts = n - WINDOW + 1
    if starts <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(ODD, n))])
    back = _powers(INVERSE, n)

    def digest(first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _mixed((sums[first + size] - sums[first]) * back[first])

    grams = digest(np.arange(n - GRAM + 1), np.int64(GRAM))
    inside, have = WINDOW - GRAM + 1, 1
    # The first of the smallest grams in each window, and where it stands.
    least, place = grams, np.arange(len(grams))
    while have < inside:
        more = min(have, inside - have)
        right = least[more:] < least[: len(least) - more]
        least = np.where(right, least[more:], least[: len(least) - more])
        place = np.where(right, place[more:], place[: len(place) - more])
        have += more
    document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    whole = document[:starts] == document[WINDOW - 1 :]
    new = np.ones(starts, bool)
    new[1:] = (place[1:] != place[:-1]) | (document[1:starts] != document[: starts - 1])
    first = np.flatnonzero(new | ~whole | np.concatenate([[True], ~whole[:-1]]))
    size = np.diff(first, append=starts)
    first, size = first[whole[first]], size[whole[first]]
    own = document[first]
    begins = ends - np.diff(ends, prepend=0)
    return own, first - begins[own], size, least[first], digest(first, size + WINDOW - 1)


def _anchored(docs: DataFrame) -> DataFrame:
    """anchor, digest, doc, copy, at (first window * MOST + windows - 1) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in batches:
            begin, ids, copies = 0, batch.column("doc").to_numpy(), batch.column("copy").to_numpy()
            for texts in slices(batch.column("text")):
                words = [split_words(t) for t in texts]
                ends = np.cumsum([len(w) for w in words])
                own, first, size, anchor, digest = segments(hasher.of(words), ends)
                own = own + begin
                begin += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(digest.view(np.int64)),
                        pa.array(ids[own]),
                        pa.array(copies[own]),
                        pa.array(first * MOST + size - 1),
                    ],
                    ["anchor", "digest", "doc", "copy", "at"],
                )

    return docs.mapInArrow(run, "anchor bigint, digest bigint, doc bigint, copy bigint, at bigint")


def _repeated(anchored: DataFrame) -> DataFrame:
    """The segments of anchors that occur twice or more; ``first`` marks the earliest of equal segments.

    Rows arrive sorted by anchor, digest and place and are passed on as they come; only the last is held back.
    """
    keys = ["anchor", "digest", "doc", "copy", "at"]
    ordered = anchored.repartition("anchor").sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row, and the anchor and digest of the row before it

        def passed(columns: list[np.ndarray], before, complete: bool) -> Iterator[pa.RecordBatch]:
            anchor, digest = columns[0], columns[1]
            last = len(anchor) if complete else len(anchor) - 1
            same_before = np.zeros(len(anchor), bool)
            same_before[1:] = anchor[1:] == anchor[:-1]
            copy = np.zeros(len(anchor), bool)
            copy[1:] = same_before[1:] & (digest[1:] == digest[:-1])
            if before is not None and len(anchor):
                same_before[0] = anchor[0] == before[0]
                copy[0] = same_before[0] and digest[0] == before[1]
            same_after = np.zeros(len(anchor), bool)
            same_after[:-1] = anchor[1:] == anchor[:-1]
            keep = np.flatnonzero((same_before | same_after)[:last])
            if len(keep):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[keep]) for c in columns), pa.array(~copy[keep])], [*keys, "first"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            # Repeated rows of one document give the very same rows, which count once.
            new = np.ones(len(columns[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            columns = [c[new] for c in columns]
            yield from passed(columns, before, False)
            if len(columns[0]) > 1:
                before = columns[0][-2], columns[1][-2]
            held = [c[-1:] for c in columns]
        if held is not None:
            yield from passed(held, before, True)

    return ordered.mapInArrow(run, ", ".join(f"{k} bigint" for k in keys) + ", first boolean")


def _worded(texts: DataFrame) -> DataFrame:
    """shard, doc, copy, at, words of the listed segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            columns = [batch.column(k) for k in ("doc", "copy", "shards", "text", "list")]
            for doc, copy, shards, text, listed in zip(*columns, strict=True):
                doc, copy, shards = doc.as_py(), copy.as_py(), shards.as_py()
                words = split_words(text.as_py())
                for part in listed.as_py():
                    at, n = part["at"] // MOST, part["at"] % MOST + 1
                    run_of = " ".join(words[at : at + n + WINDOW - 1])
                    out.append((part["anchor"] % shards, doc, copy, at, run_of))
                    size += len(run_of)
                if size > 4_000_000:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["shard", "doc", "copy", "at", "words"]
        )

    return texts.mapInArrow(run, "shard bigint, doc bigint, copy bigint, at bigint, words string")


def _windows(texts: DataFrame) -> DataFrame:
    """digest, doc, copy, at of each window of the listed segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, copy, text, listed in zip(*(batch.column(k) for k in ("doc", "copy", "text", "list")), strict=True):
                doc, copy = doc.as_py(), copy.as_py()
                words = split_words(text.as_py())
                for part in listed.as_py():
                    first, n = part["at"] // MOST, part["at"] % MOST + 1
                    for at in range(first, first + n):
                        out.append((xxhash.xxh3_128_digest(" ".join(words[at : at + WINDOW])), doc, copy, at))
                if len(out) > 100_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary()] + [pa.int64()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["digest", "doc", "copy", "at"]
        )

    return texts.mapInArrow(run, "digest binary, doc bigint, copy bigint, at bigint")


def _later_windows(windows: DataFrame) -> DataFrame:
    """doc, copy, begin, end of the windows that have an equal one at an earlier place."""
    place = F.struct("doc", "copy", "at")
    kept = windows.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = windows.join(kept.select("digest", "first"), "digest").where(place != F.col("first"))
    return later.select("doc", "copy", F.col("at").alias("begin"), (F.col("at") + WINDOW).alias("end"))


def _searched(worded: DataFrame, shards: int) -> DataFrame:
    """doc, copy, begin, end: runs of words covered by windows that start earlier in the same shard."""
    ordered = worded.repartition(shards, "shard").sortWithinPartitions("shard", "doc", "copy", "at")

    def search(docs: list, copies: list, places: list, rows: list[list[str]]) -> pa.RecordBatch:
        sizes = np.array([len(r) for r in rows], np.int64)
        known: dict[str, int] = {}
        symbols = np.fromiter((known.setdefault(w, len(known) + 1) for r in rows for w in r), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        hits = np.flatnonzero(FmIndex(symbols, ends, WINDOW).seen_before(symbols, ends))
        row = np.searchsorted(ends, hits, "right")
        at = np.array(places, np.int64)[row] + hits - (ends - sizes)[row]
        # Consecutive windows of one segment make one run.
        new = np.ones(len(hits), bool)
        new[1:] = (row[1:] != row[:-1]) | (hits[1:] != hits[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(hits)) - 1 if len(hits) else heads
        columns = [np.array(docs, np.int64)[row[heads]], np.array(copies, np.int64)[row[heads]], at[heads], at[tails] + WINDOW]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "copy", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        current, before = None, None
        for batch in batches:
            for shard, *row, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if shard != current and held[0]:
                    yield search(*held)
                    held = ([], [], [], [])
                if [shard, *row] == before:
                    continue  # the same place of a repeated row
                current, before = shard, [shard, *row]
                for column, value in zip(held, [*row, words.split(" ")], strict=True):
                    column.append(value)
        if held[0]:
            yield search(*held)

    return ordered.mapInArrow(run, "doc bigint, copy bigint, begin bigint, end bigint")


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text of every row of ``docs``.

    A word goes if a window that covers it also starts earlier: in a smaller doc_id, or earlier in the same document. All
    windows are judged on the input. doc_id is an integer; rows without one come before all others. Rows with the same id and text are the
    same document, so they get the same result and do not remove each other's words; rows with one id and different texts are
    documents in the order of their texts' hashes. A null or empty text, or one of fewer words than a window, loses nothing. No rows
    give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    stand_in = -(1 << 63)
    own = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(stand_in)).alias("doc"),
        F.xxhash64(F.col(text)).alias("copy"),
        F.col(text).alias("text"),
    )
    found = stored(_repeated(_anchored(own)), "repeated-segments")
    firsts = found.where("first")
    hot = firsts.groupBy("anchor").count().where(F.col("count") > HOT_SEGMENTS).select("anchor")
    hot = stored(hot, "hot-anchors")
    cold = firsts.join(hot, "anchor", "left_anti")
    total = cold.agg(F.coalesce(F.sum(F.col("at") % MOST + WINDOW), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_SYMBOLS), min(spark.sparkContext.defaultParallelism, -(-total // 50_000)))
    listed = cold.groupBy("doc", "copy").agg(F.collect_list(F.struct("anchor", "at")).alias("list"))
    by_doc = own.repartition("doc", "copy")
    texts = by_doc.join(listed.withColumn("shards", F.lit(shards).cast("long")), ["doc", "copy"])
    index_hits = _searched(_worded(texts), shards)
    if not hot.isEmpty():
        listed = firsts.join(hot, "anchor", "left_semi").groupBy("doc", "copy").agg(F.collect_list(F.struct("at")).alias("list"))
        windows = stored(_windows(by_doc.join(listed, ["doc", "copy"])), "hot-windows")
        index_hits = index_hits.unionByName(_later_windows(windows))
    copies = found.where("not first").select(
        "doc", "copy", F.expr(f"at div {MOST}").alias("begin"), F.expr(f"at div {MOST} + at % {MOST} + {WINDOW}").alias("end")
    )
    gone = copies.unionByName(index_hits).groupBy("doc", "copy").agg(F.collect_list(F.struct("begin", "end")).alias("gone"))
    joined = by_doc.join(gone, ["doc", "copy"], "left").select("doc", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, value, gone_of in zip(*(batch.column(k) for k in ("doc", "text", "gone")), strict=True):
                words = split_words(value.as_py())
                kept = words
                if gone_of.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    spans = gone_of.values.flatten()
                    np.add.at(edges, spans[0].to_numpy(), 1)
                    np.add.at(edges, spans[1].to_numpy(), -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    kept = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                joined_words = " ".join(kept)
                out.append(
                    (
                        None if doc.as_py() == stand_in else doc.as_py(),
                        len(words),
                        len(words) - len(kept),
                        hashlib.sha256(joined_words.encode()).hexdigest(),
                        joined_words if with_text else None,
                    )
                )
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names[: len(kinds)]
            )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)
