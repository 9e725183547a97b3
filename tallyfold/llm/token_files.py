"""Token ids of documents as Simple-8b coded files.

A coded document is a row of little-endian 64-bit words. The top four bits of a word select how many ids it packs and how
wide each is; selector 15 is an escape: the word after it is one id as it is. ``blocks`` holds, for every block of about
``BLOCK`` words, its first word and how many ids stand before it, so that a reader can decode any block alone (``read_block``) and
all words of one selector with one array operation; an escape and its id are always in one block. Files are Parquet, written
in ascending document order, with one row for each document: shard, place in the shard, doc_id, n_tokens, words and blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyfold.llm.pretokens import CLOSING, LETTERS, MAX_CACHED_PIECE, MAX_CACHED_PIECES, SLICE_BYTES, WHITE
from tallyfold.session import scratch_path

TOKENIZER_FILE = "byte_bpe_50k.json"
BLOCK = 128
RUN_WORDS = 500_000
ENCODED_AT_ONCE = 1000
# Ids in a word and bits of each, by selector; 0 and 1 pack runs of zeros without payload.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 0])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ONE, ESCAPE = 15, 0xF << 60
# Fixed value: how the vocabulary file writes a blank.
BLANK = "\u0120"
# Selector 15 with a payload of 60 zero bits is the escape; one id of up to 59 bits has a one in bit 59.
MARK = 1 << 59


def pack(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code documents that lie in a row in ``ids`` (unsigned 64 bit) and end at ``ends``.

    Returns the words, the number of words up to the end of each document, and the number of ids before each word.
    No word holds ids of two documents.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(len(ends), np.int64), np.zeros(0, np.int64)
    # The narrowest width of each id; 255 after each document keeps a word within one.
    limits = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)
    if int(ids.max()) < 1 << 16:
        kind = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)[ids]
    else:
        kind = np.searchsorted(limits, ids, "right").astype(np.uint8)
    at = np.arange(n) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    widest = np.full(n + len(ends) + int(COUNTS.max()), 255, np.uint8)
    widest[at] = kind
    selector = np.full(len(widest), ONE, np.uint8)
    have = 1
    for s in range(14, -1, -1):
        # The widest of as many ids as selector s packs, from the widest of fewer.
        count = int(COUNTS[s])
        while have < count:
            more = min(count - have, have)
            np.maximum(widest[:-more], widest[more:], out=widest[:-more])
            widest[-more:] = 255
            have += more
        # Where selector s fits, those above it do, as they pack fewer and wider ids: each that fits takes one off.
        selector -= (widest <= max(s - 1, 0)).view(np.uint8)
    selector = selector[at]
    # As bytes, which hold no object for each id.
    step = np.maximum(COUNTS, 1).astype(np.uint8)[selector].tobytes()
    starts, at = [], 0
    keep = starts.append
    while at < n:
        keep(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    kinds = selector[starts]
    words = kinds.astype(np.uint64) << np.uint64(60)
    for s in np.unique(kinds):
        which = np.flatnonzero(kinds == s)
        if s == ONE:
            value = ids[starts[which]]
            words[which] |= np.where(value < MARK, value | np.uint64(MARK), np.uint64(0))
        elif WIDTHS[s]:
            value = np.zeros(len(which), np.uint64)
            for k in range(COUNTS[s]):
                value |= ids[starts[which] + k] << np.uint64(k * WIDTHS[s])
            words[which] |= value
    words_before = np.searchsorted(starts, ends)
    escaped = np.flatnonzero(words == np.uint64(ESCAPE))
    if len(escaped):
        words = np.insert(words, escaped + 1, ids[starts[escaped]])
        words_before = words_before + np.searchsorted(escaped, words_before)
        starts = np.insert(starts, escaped + 1, starts[escaped] + 1)
    return words.astype("<u8"), words_before, starts


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of the words of any number of whole documents."""
    words = words.astype(np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    if (words == np.uint64(ESCAPE)).any():
        # A word after an escape is an id, whatever its bits are; so is the escape's successor only.
        plain = np.ones(len(words), bool)
        for at in np.flatnonzero(words == np.uint64(ESCAPE)):
            if plain[at]:
                plain[at + 1] = False
        raw = np.flatnonzero(~plain)
        kinds[raw - 1], kinds[raw] = 16, 17
    counts = np.append(COUNTS, [0, 1])[kinds]
    counts[kinds == ONE] = 1
    starts = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(kinds):
        which = np.flatnonzero(kinds == s)
        if s == ONE:
            ids[starts[which]] = words[which] & np.uint64(MARK - 1)
        elif s == 17:
            ids[starts[which]] = words[which]
        elif s < ONE and WIDTHS[s]:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(COUNTS[s]):
                ids[starts[which] + k] = words[which] >> np.uint64(k * WIDTHS[s]) & mask
    return ids


def block_table(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(first word, ids before it) of each block of one document; ``before`` holds the ids before each word."""
    first = np.arange(0, len(words), BLOCK)
    at = np.flatnonzero(words == np.uint64(ESCAPE))
    if len(at):
        raw, last = set(), -2
        for k in at.tolist():
            if k != last + 1:
                raw.add(k + 1)
                last = k
        first = np.array([k + (k in raw) for k in first.tolist()])
    return np.stack([first, before[first]], axis=1).astype("<u8")


def read_block(words: np.ndarray, blocks: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """(ids of the document before the block, ids of block ``k``) from its own words alone."""
    stop = int(blocks[k + 1, 0]) if k + 1 < len(blocks) else len(words)
    return int(blocks[k, 1]), unpack(words[int(blocks[k, 0]) : stop])


# What a character is, by code point; those beyond the table are neither.
LETTER_KIND, CLOSING_KIND, WHITE_KIND = 1, 2, 4
KINDS = np.zeros(1 << 16, np.uint8)
for _kind, _class in ((LETTER_KIND, LETTERS), (CLOSING_KIND, CLOSING), (WHITE_KIND, WHITE)):
    KINDS[[m.start() for m in re.finditer(f"[{_class}]", "".join(map(chr, range(1 << 16))))]] = _kind
# How a part can be encoded together with others: behind a blank of its own, with a line end after it, or alone.
BLANK_BEFORE, LINE_AFTER, ALONE = 0, 1, 2


def _bounds(texts: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    """(where each text begins and the last ends, the bytes of all) of a column without nulls."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return bounds, texts.buffers()[2]


def cut(texts: pa.Array, whole: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(parts of all texts in a row, how each can be encoded, number of parts up to the end of each text).

    A part begins where a text begins, at white space after another character, at a closing mark after a letter, and at a letter
    after a single line end: there the split pattern always ends a match. A text that holds one of ``whole`` is one part.
    """
    bounds, data = _bounds(texts)
    if bounds[-1] == bounds[0]:
        return pa.array([], pa.large_string()), np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
    data = data.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    joined = str(data, "utf-8")
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = KINDS[np.minimum(points, len(KINDS) - 1)]
    white = kinds == WHITE_KIND
    if len(points) == len(data):
        byte = None
        firsts = bounds[:-1] - bounds[0]
    else:
        sizes = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
        byte = np.append(0, np.cumsum(sizes, dtype=np.int64))
        firsts = np.searchsorted(byte, bounds[:-1] - bounds[0])
    begins = np.zeros(len(points), bool)
    letter = kinds == LETTER_KIND
    begins[1:] = white[1:] & ~white[:-1]
    begins[1:] |= (kinds[1:] == CLOSING_KIND) & letter[:-1]
    line = points == 10
    line[1:] &= ~white[:-1]
    begins[1:] |= letter[1:] & line[:-1]
    filled = firsts[np.diff(bounds) > 0]
    begins[filled] = True
    # A line end that opens a text has no white space before it, whatever the text before ends with.
    opens = filled[filled + 1 < len(points)]
    opens = opens[(points[opens] == 10) & letter[opens + 1]]
    begins[opens + 1] = True
    alone = []
    if any(name in joined for name in whole):
        ends = np.append(firsts[1:], len(points))
        for first, end in zip(firsts.tolist(), ends.tolist(), strict=True):
            if any(name in joined[first:end] for name in whole):
                begins[first + 1 : end] = False
                alone.append(first)
    starts = np.flatnonzero(begins)
    # White space stands at the beginning of a part only, but in texts that are one part.
    opening = white[starts]
    long = np.diff(starts, append=len(points)) > 1
    more = white[np.minimum(starts + 1, len(points) - 1)]
    how = np.where(opening & ~more & (points[starts] == 32) & long, BLANK_BEFORE, ALONE).astype(np.uint8)
    how[~opening] = LINE_AFTER
    how[np.searchsorted(starts, alone)] = ALONE
    at = starts if byte is None else byte[starts]
    offsets = np.append(at, len(data)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), data)
    return parts, how, np.searchsorted(starts, np.append(firsts[1:], len(points)))


class WordEncoder:
    """The tokenizers library, asked once for each distinct part of a text while the cache holds it.

    The ids of all parts lie in one array; a text is a row of places in it, so that no part is a Python object but once in a run.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.together = not any(c in WHITE for s in self.specials for c in s)
        found = tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = found[0] if len(found) == 1 else None
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(BLANK)]] = True
        self.places: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, parts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(parts), ENCODED_AT_ONCE):  # the library's results are many times larger than their ids
            for found in self.tokenizer.encode_batch_fast(parts[i : i + ENCODED_AT_ONCE], add_special_tokens=False):
                yield found.ids

    def _encode_joined(self, parts: list[str], between: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each) of words, a thousand in one text; they begin with a blank, or a line end is put after each."""
        for i in range(0, len(parts), ENCODED_AT_ONCE):
            run = parts[i : i + ENCODED_AT_ONCE]
            ids = np.array(next(self._encode(["".join(p + between for p in run)])), np.uint32)
            if between:
                stops = np.flatnonzero(ids == self.line_end)
                sizes = np.diff(stops, prepend=-1) - 1
                ids = np.delete(ids, stops)
            else:
                sizes = np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
            if len(sizes) != len(run) or sizes.sum() != len(ids):
                each = list(self._encode(run))
                ids, sizes = np.array(list(chain.from_iterable(each)), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
            yield ids, sizes

    def _learn(self, new: list[str], how: np.ndarray) -> None:
        """Encode parts that stand at the next places; ``how`` says what they can be encoded with."""
        if not self.together:
            how = np.full(len(new), ALONE)
        elif self.line_end is None:
            how = np.where(how == LINE_AFTER, ALONE, how)
        order, runs = [np.flatnonzero(how == k) for k in (BLANK_BEFORE, LINE_AFTER, ALONE)], []
        for own, between in zip(order, ("", "\n"), strict=False):
            runs += self._encode_joined([new[k] for k in own.tolist()], between)
        alone = list(self._encode([new[k] for k in order[ALONE].tolist()]))
        sizes = np.fromiter(map(len, alone), np.int64, len(alone))
        runs.append((np.fromiter(chain.from_iterable(alone), np.uint32, int(sizes.sum())), sizes))
        sizes = np.concatenate([s for _, s in runs])
        starts = np.cumsum(sizes) - sizes + len(self.flat)
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in runs)])
        own = np.empty((2, len(new)), np.int64)
        own[:, np.concatenate(order)] = starts, sizes
        self.starts, self.sizes = np.concatenate([self.starts, own[0]]), np.concatenate([self.sizes, own[1]])

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts at these places, number of ids up to the end of each)."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[at] - ends + sizes, sizes)], ends

    def _keep(self, at: np.ndarray) -> None:
        """Empty the cache but for short parts at these places."""
        names = list(self.places)
        kept = [k for k in np.unique(at).tolist() if len(names[k]) <= MAX_CACHED_PIECE]
        if len(kept) > MAX_CACHED_PIECES // 2:
            kept = []
        own = np.array(kept, np.int64)
        self.flat, ends = self._gathered(own)
        self.sizes = self.sizes[own]
        self.starts = ends - self.sizes
        self.places = dict(zip((names[k] for k in kept), range(len(kept)), strict=True))

    def encode_texts(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); a null or empty text has none.

        A text that holds the name of a special token goes to the library whole.
        """
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        parts, how, upto = cut(texts.cast(pa.large_string()).fill_null(""), self.specials)
        coded = parts.dictionary_encode()
        index, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.places.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            own = np.empty(len(names), np.uint8)
            own[index] = how  # equal parts can be encoded alike
            place[fresh] = np.arange(len(fresh)) + len(self.places)
            new = [names[k] for k in fresh.tolist()]
            self._learn(new, own[fresh])
            self.places.update(zip(new, place[fresh].tolist(), strict=True))
        at = place[index]
        ids, ends = self._gathered(at)
        if len(self.places) > MAX_CACHED_PIECES or len(self.flat) > 8 * MAX_CACHED_PIECES:
            self._keep(at)
        return ids, np.diff(np.append(0, ends)[upto], prepend=0)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode_texts(texts)
        ends = np.cumsum(sizes).tolist()
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends], ends, strict=False)]


_TOKENIZERS: dict[str, Tokenizer] = {}
FILE_COLUMNS = "shard int, place bigint, doc_id {kind}, n_tokens bigint, words binary, blocks binary"


def encoder(path: str) -> WordEncoder:
    """An encoder with an empty cache, over the one tokenizer that a worker holds for each file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return WordEncoder(_TOKENIZERS[path])


def write_token_files(
    docs: DataFrame,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    end_id: int = 0,
    shards: int | None = None,
) -> None:
    """Tokenize every row and write its ids, closed by ``end_id``, to ``folder`` in ascending order of ``doc_id``.

    A null or empty text has the end id only. Rows without an id come first; rows with the same id
    stand in the order of their texts' hashes, so repeated rows are all there. Other columns are not read. A shard is one range
    of ids; each task holds the strings of about 4 MB of text at a time, or of one longer text, and a cache of bounded size
    that ends with the task. The name of a special token in a text is that token, as in the library's plain call.
    """
    path = path or public_tokenizers.path(TOKENIZER_FILE)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    sorted_rows = (rows.repartitionByRange(shards, *keys) if shards else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = FILE_COLUMNS.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        shard, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text")):
                ids, sizes = own.encode_texts(texts)
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(np.uint64)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                words, upto, starts = pack(ids, ends)
                data, blocks, begin = [], [], 0
                for stop, first in zip(upto.tolist(), (ends - sizes).tolist(), strict=True):
                    data.append(words[begin:stop].tobytes())
                    blocks.append(block_table(words[begin:stop], starts[begin:stop] - first).tobytes())
                    begin = stop
                places = place + ends - sizes
                place += int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(texts), shard, np.int32)),
                        pa.array(places),
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(sizes),
                        pa.array(data, pa.binary()),
                        pa.array(blocks, pa.binary()),
                    ],
                    ["shard", "place", "doc_id", "n_tokens", "words", "blocks"],
                )
                at += len(texts)

    sorted_rows.mapInArrow(run, schema).write.parquet(folder)


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """The texts of a column in runs of about ``SLICE_BYTES``, or one longer text."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds, _ = _bounds(column)
    first = 0
    while first < len(column):
        stop = max(int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES)), first + 1)
        stop = min(stop, len(column))
        yield column.slice(first, stop - first)
        first = stop


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """The words of rows first to stop, about ``RUN_WORDS`` at a time or one longer row."""
    first, held, size = 0, [], 0
    for row, value in enumerate(column):
        held.append(np.frombuffer(value.as_buffer(), "<u8"))
        size += len(held[-1])
        if size >= RUN_WORDS or row == len(column) - 1:
            yield first, row + 1, np.concatenate(held)
            first, held, size = row + 1, [], 0


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` adds the lengths of the shards before, one row each, to the place within the shard.
    """
    files = spark.read.parquet(folder)
    kind = files.schema["doc_id"].dataType.simpleString()
    added = [("ids_crc32", "bigint")] + [("ids", "binary")] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, all_ids, n = [], [], batch.column("n_tokens").to_numpy()
            for first, stop, words in _runs(batch.column("words")):
                ids = unpack(words).astype("<u4").tobytes()
                ends = (np.cumsum(n[first:stop]) * 4).tolist()
                for begin, end in zip([0, *ends], ends, strict=False):
                    crc.append(zlib.crc32(ids[begin:end]))
                    if with_ids:
                        all_ids.append(ids[begin:end])
            columns = [batch.column("shard"), batch.column("place"), batch.column("doc_id"), batch.column("n_tokens")]
            columns += [pa.array(crc, pa.int64())] + [pa.array(all_ids, pa.binary())] * with_ids
            names = ["shard", "place", "doc_id", "n_tokens", *(name for name, _ in added)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"shard int, place bigint, doc_id {kind}, n_tokens bigint, " + ", ".join(f"{n} {k}" for n, k in added)
    decoded = files.select("shard", "place", "doc_id", "n_tokens", "words").mapInArrow(run, schema)
    # One row for each shard: Parquet statistics of a whole table of documents come down to a few rows.
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select(
        F.col("shard").alias("_shard"),
        (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"),
    )
    joined = decoded.join(before, decoded["shard"] == before["_shard"])
    return joined.select("doc_id", (F.col("_before") + F.col("place")).alias("start"), "n_tokens", *(n for n, _ in added))


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Write the token files to the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder, doc_id, text, **options)
    return read_token_files(spark, folder)
