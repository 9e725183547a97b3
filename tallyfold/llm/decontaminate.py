"""Benchmark decontamination by BM25 retrieval and an overlap check.

The test items are the indexed collection, and every passage of every document is a query. A term's weight for an item is its
BM25 part divided by the item's score for itself, so an item found whole scores 1 and one threshold suits all items.
Passages are runs of words that overlap by half and are at least twice as long as the longest item, so any
item lies whole in one of them. Items are in blocks, and each term knows the largest weight in every block it occurs in. Terms whose
largest weights together stay under the threshold lift no item to it alone, so only blocks of the other terms are looked at.
There the sums of block maxima bound the scores; where the bound reaches the threshold, WAND goes through the postings of the
block and skips the items that the terms at hand cannot lift to it. What is retrieved is then verified: the question's and the
answer's words must stand in the passage in order, each side with few enough words changed, left out or put in between.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.pretokens import slices

K1, B = 1.2, 0.75
THRESHOLD = 0.6
MIN_OVERLAP = 0.6
BLOCK = 4
MIN_PASSAGE = 128
PASSAGES_AT_ONCE = 256
SLACK = 1e-5
# One index holds items of about this many characters; more items make more indexes, and as many passes over the documents.
MAX_INDEX_CHARS = 20_000_000
WORD = re.compile(r"\w+")


def terms_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case."""
    return WORD.findall((text or "").lower())


def question_and_answer(text: Column) -> tuple[Column, Column]:
    """A text's last sentence is its answer, what stands before it the question; one sentence alone is both."""
    parts = F.regexp_extract(text, r"(?s)^(.*[.?!])\s+(\S.*)$", 1), F.regexp_extract(text, r"(?s)^(.*[.?!])\s+(\S.*)$", 2)
    return F.when(parts[0] == "", text).otherwise(parts[0]), F.when(parts[1] == "", text).otherwise(parts[1])


@dataclass
class Posting:
    """One term's items in ascending order and their weights."""

    items: array
    weights: array
    blocks: array
    block_max: array
    most: float


class Index:
    """Inverted index of items given as (id, question terms, answer terms), with document frequencies over all items."""

    def __init__(self, items: list[tuple], frequency: dict[str, int], total: int, mean_length: float):
        self.ids = [i for i, _, _ in items]
        self.longest = max((len(q) + len(a) for _, q, a in items), default=0)
        self.n_blocks = -(-len(items) // BLOCK)
        postings: dict[str, tuple[array, array]] = {}
        for at, (_, q, a) in enumerate(items):
            counts = Counter(q + a)
            norm = K1 * (1 - B + B * (len(q) + len(a)) / max(mean_length, 1e-9))
            parts = {
                t: math.log(1 + max(total - frequency.get(t, 1) + 0.5, 0.5) / (frequency.get(t, 1) + 0.5)) * n * (K1 + 1) / (n + norm)
                for t, n in counts.items()
            }
            whole = sum(parts.values())
            for t, part in parts.items():
                own = postings.setdefault(t, (array("i"), array("d")))
                own[0].append(at)
                own[1].append(part / whole)
        self.term_at = {t: k for k, t in enumerate(postings, 1)}
        self.postings = [self._posting(*own) for own in postings.values()]
        # The largest weight of each term; number 0 is for words that are in no item.
        self.most = np.array([0.0, *(p.most for p in self.postings)])
        # The blocks of all terms in a row.
        sizes = np.array([0, *(len(p.blocks) for p in self.postings)], np.int64)
        self.block_ends = np.cumsum(sizes)
        self.block_sizes = sizes
        self.block_at = np.concatenate([np.zeros(0, np.int64), *(np.array(p.blocks, np.int64) for p in self.postings)])
        self.block_max = np.concatenate([np.zeros(0), *(np.array(p.block_max) for p in self.postings)])
        # The words of each side, by number.
        self.sides = [tuple(np.array([self.term_at[t] for t in side], np.int64) for side in own) for _, *own in items]

    @staticmethod
    def _posting(items: array, weights: array) -> Posting:
        blocks, most = array("i"), array("d")
        for item, weight in zip(items, weights, strict=True):
            if not blocks or blocks[-1] != item // BLOCK:
                blocks.append(item // BLOCK)
                most.append(weight)
            elif weight > most[-1]:
                most[-1] = weight
        return Posting(items, weights, blocks, most, max(most))

    def candidates(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs, in order, whose summed block maxima reach the threshold.

        ``passage`` and ``term`` are distinct pairs of numbers, ordered by passage.
        """
        enough = threshold - SLACK
        # In each passage the terms of small weight that cannot reach the threshold together are not essential.
        order = np.lexsort((self.most[term], passage))
        passage, term = passage[order], term[order]
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        sums = np.cumsum(self.most[term])
        before = np.repeat(sums[starts] - self.most[term[starts]], np.diff(starts, append=len(term)))
        essential = sums - before >= enough
        none = np.zeros(0, np.int64)
        if not essential.any():
            return none, none

        def spread(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = self.block_sizes[term[which]]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            at = np.arange(total) + np.repeat(self.block_ends[term[which]] - ends, sizes)
            return np.repeat(passage[which], sizes) * self.n_blocks + self.block_at[at], self.block_max[at]

        wanted = np.unique(spread(np.flatnonzero(essential))[0])
        # Only passages with an essential term are summed up.
        some = np.isin(passage, wanted // self.n_blocks)
        pairs, weights = spread(np.flatnonzero(some))
        place = np.searchsorted(wanted, pairs)
        place[place == len(wanted)] = 0
        hit = wanted[place] == pairs
        bound = np.bincount(place[hit], weights[hit], len(wanted))
        found = wanted[bound >= enough]
        return found // self.n_blocks, found % self.n_blocks

    def search(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of one block, and scores, at or above the threshold, by WAND."""
        begin, end = block * BLOCK, (block + 1) * BLOCK
        cursors = []
        for t in terms:
            p = self.postings[t - 1]
            k = bisect_left(p.blocks, block)
            if k < len(p.blocks) and p.blocks[k] == block:
                at = bisect_left(p.items, begin)
                cursors.append([p.items[at], at, p, p.block_max[k]])
        out, enough = [], threshold - SLACK
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for at, c in enumerate(cursors):
                bound += c[3]
                if bound >= enough:
                    pivot = c[0]
                    break
            if pivot < 0:
                break
            if cursors[0][0] == pivot:
                score = sum(c[2].weights[c[1]] for c in cursors if c[0] == pivot)
                if score >= enough:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in cursors:
                if c[0] < target:
                    c[1] = bisect_left(c[2].items, target, c[1])
                    c[0] = c[2].items[c[1]] if c[1] < len(c[2].items) else end
            cursors = [c for c in cursors if c[0] < end]
        return out


def overlap(side: np.ndarray, passage: np.ndarray) -> float:
    """1 less the share of words that must be changed, left out or put in for the side to stand in the passage; an empty side is found."""
    if not len(side):
        return 1.0
    places = np.arange(len(passage) + 1)
    # Fewest changes with which the words so far end at each place; the side may begin anywhere.
    least = np.zeros(len(passage) + 1, np.int64)
    for word in side:
        now = least + 1
        now[1:] = np.minimum(now[1:], least[:-1] + (passage != word))
        least = np.minimum.accumulate(now - places) + places
    return max(0.0, 1.0 - float(least.min()) / len(side))


def scan(text: str | None, index: Index, threshold: float = THRESHOLD, least: float = MIN_OVERLAP) -> list[tuple]:
    """(item id, score, question overlap, answer overlap) of the items that a text contains, best passage of each."""
    raw = terms_of(text)
    if not raw or not index.ids:
        return []
    look = index.term_at.get
    found = np.array([look(w, 0) for w in raw], np.int64)
    step = max(MIN_PASSAGE, 2 * index.longest) // 2
    n = max(1, -(-len(raw) // step) - 1)
    width = len(index.most)
    best: dict[int, tuple] = {}
    for first in range(0, n, PASSAGES_AT_ONCE):
        last = min(n, first + PASSAGES_AT_ONCE)
        words = np.arange(first * step, min((last + 1) * step, len(raw)))
        # Each word lies in the passage that starts in its half and in the one before; a term counts once in each.
        half = words // step
        pairs = np.concatenate([half * width + found[words], (half - 1) * width + found[words]])
        pairs = np.unique(pairs[(pairs >= first * width) & (pairs < last * width) & (pairs % width > 0)])
        passage, term = pairs // width, pairs % width
        for at, block in zip(*map(np.ndarray.tolist, index.candidates(passage, term, threshold)), strict=True):
            own = term[np.searchsorted(passage, at) : np.searchsorted(passage, at, "right")]
            for item, score in index.search(own.tolist(), block, threshold):
                q, a = (overlap(side, found[at * step : (at + 2) * step]) for side in index.sides[item])
                if q >= least and a >= least and (item not in best or (score, q, a) > best[item][:3]):
                    best[item] = (score, q, a)
    return [(index.ids[i], *best[i]) for i in sorted(best)]


def _with_terms(items: DataFrame) -> DataFrame:
    """Add ``terms``, the words of both sides as ``terms_of`` cuts them."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("q").to_pylist(), batch.column("a").to_pylist(), strict=True)
            terms = pa.array([terms_of(q) + terms_of(a) for q, a in sides], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, terms], [*batch.schema.names, "terms"])

    return items.mapInArrow(run, f"item_id {kind}, q string, a string, terms array<string>")


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    question: str | None = None,
    answer: str | None = None,
    threshold: float = THRESHOLD,
    least: float = MIN_OVERLAP,
    max_chars: int = MAX_INDEX_CHARS,
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each row of ``docs`` and item it contains.

    Items have columns ``question`` and ``answer``, or one text that is cut before its last sentence. Items without terms, null ones
    among them, are never found; items with the same text are all found. A null or empty document contains nothing, repeated rows
    are searched each, and other columns are not read. Without items there are no rows. An index of at most about ``max_chars``
    characters (or one longer item) is broadcast at a time; more items are taken in that many groups, each searched with all documents.
    """
    spark = docs.sparkSession
    if question and answer:
        parts = F.col(question), F.col(answer)
    else:
        parts = question_and_answer(F.col(item_text))
    own = items.select(F.col(item_id).alias("item_id"), parts[0].alias("q"), parts[1].alias("a"))
    # A single sentence is its own answer and must not be counted twice.
    own = own.withColumn("q", F.when(F.col("q") == F.col("a"), F.lit("")).otherwise(F.coalesce("q", F.lit(""))))
    own = own.withColumn("a", F.coalesce("a", F.lit("")))
    own = _with_terms(own).where(F.size("terms") > 0)
    n, chars, mean = own.agg(
        F.count("*"), F.coalesce(F.sum(F.length("q") + F.length("a")), F.lit(0)), F.coalesce(F.avg(F.size("terms")), F.lit(0.0))
    ).first()
    kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    groups = max(1, math.ceil(chars / max_chars))
    frequency = own.select("item_id", F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for group in range(groups if n else 0):
        part = own.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group)
        rows = sorted(part.select("item_id", "q", "a").collect(), key=lambda r: (r.item_id is not None, r.item_id, r.q, r.a))
        known = part.select(F.explode("terms").alias("t")).distinct().join(frequency, "t").collect()
        index = Index([(i, terms_of(q), terms_of(a)) for i, q, a in rows], {t: c for t, c in known}, n, mean)
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found = 0, []
                for run_of in slices(batch.column("text")):
                    for value in run_of:
                        found += [(at, *hit) for hit in scan(value, sent.value, threshold, least)]
                        at += 1
                rows_of = pa.array([f[0] for f in found], pa.int64())
                columns = [batch.column("doc_id").take(rows_of)]
                columns += [pa.array([f[k] for f in found], None if k == 1 and found else pa.float64()) for k in range(1, 5)]
                names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                if found:
                    yield pa.RecordBatch.from_arrays(columns, names)

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is in no contaminated row; rows without an id are judged as one group."""
    hits = find_contamination(docs, items, doc_id, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hits, docs[doc_id].eqNullSafe(hits["_hit"]), "left_anti")
