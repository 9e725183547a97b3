"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one encoding, and so one last token. The last tokens of all prefixes are found from
left to right: the last token of a prefix is the longest token it ends with that may follow the last token of what stands
before it. Two tokens may stand side by side when merging their joined bytes gives the same two again; an encoding
is right exactly when all its neighbours may. The table of last tokens can be extended by appended bytes, and after an
edit it changes only until as many positions as the longest token has bytes agree with the old table.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.pretokens import MAX_CACHED_PIECE, PART, WORD, slices

# About 120 bytes each.
MAX_CACHED_PAIRS = 150_000
# About 250 bytes each.
MAX_CACHED_PARTS = 300_000
SLICE_BYTES = 2_000_000
RANKS_FILE = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks with the lengths that tokens with the same last two bytes have."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # Lengths of tokens by their last three bytes; shorter tails have their own entries.
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            lengths.setdefault(token[-3:], set()).add(len(token))
        self.lengths: dict[bytes, tuple[int, ...]] = {}
        self._by_tail = lengths
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[bytes, bytes] | None] = {}

    def merged(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """Plain merging of a few bytes, lowest rank first, with the ranks under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge forms this one; None if merging never forms it. A byte has none to show."""
        if token not in self._halves:
            data = self.bytes_of[token]
            parts = self.merged(data, token)
            self._halves[token] = (data, b"") if len(data) == 1 else tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left``; -1 on the left stands for the beginning.

        Merges are undone from the last to the first. In each state the two parts at the border must not
        merge before the part that was formed next; of equal ranks the left one goes first.
        """
        if len(self._pairs) > MAX_CACHED_PAIRS:
            self._pairs.clear()
        known = self._pairs[left << 32 | right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        if self.halves(right) is None or left >= 0 and self.halves(left) is None:
            return False
        if left < 0:
            return True
        ranks, bytes_of = self.ranks, self.bytes_of
        if bytes_of[left] + bytes_of[right] in ranks:
            return False
        while True:
            x, y = bytes_of[left], bytes_of[right]
            if len(y) > 1 and (right >= left or len(x) == 1):
                formed, y = right, self.halves(right)[0]
                if ranks.get(x + y, 1 << 60) <= formed:
                    return False
                right = ranks[y]
            elif len(x) > 1:
                formed, x = left, self.halves(left)[1]
                if ranks.get(x + y, 1 << 60) < formed:
                    return False
                left = ranks[x]
            else:
                return True

    def lengths_of(self, tail: bytes) -> tuple[int, ...]:
        """Lengths, longest first, of the tokens that bytes with this end (three at most) can end with."""
        short = {n for k in range(1, len(tail)) for n in self._by_tail.get(tail[k:], ()) if n == len(tail) - k}
        found = tuple(sorted(short | self._by_tail.get(tail, set()), reverse=True))
        if len(self.lengths) <= MAX_CACHED_PAIRS:
            self.lengths[tail] = found
        return found

    def fill(self, data: bytes, last: list[int], stop: int) -> None:
        """Append the last tokens of the prefixes up to ``stop`` bytes; ``last[n]`` is that of n bytes."""
        ranks, lengths, pairs, fits = self.ranks, self.lengths, self._pairs, self.may_follow
        for end in range(len(last), stop + 1):
            tail = data[end - 3 : end] if end > 2 else data[:end]
            for n in lengths.get(tail) or self.lengths_of(tail):
                if n <= end:
                    token = ranks.get(data[end - n : end])
                    if token is not None:
                        known = pairs.get(last[end - n] << 32 | token)
                        if known or known is None and fits(last[end - n], token):
                            last.append(token)
                            break

    def read_back(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding that a full table holds, read from the end."""
        found, end = [], len(data)
        while end:
            found.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return found[::-1]


class PrefixTable:
    """The last token of every prefix of a byte string, without the split pattern."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Bytes at the end; what was computed stays."""
        self.data += more
        self.vocabulary.fill(self.data, self.last, len(self.data))

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace ``removed`` bytes at ``at``; returns how many last tokens were computed anew."""
        data = self.data[:at] + inserted + self.data[at + removed :]
        shift, old = len(inserted) - removed, self.last
        last, same = old[: at + 1], 0
        while len(last) <= len(data) and same < self.vocabulary.longest:
            end = len(last)
            self.vocabulary.fill(data, last, end)
            same = same + 1 if end > at + len(inserted) and last[end] == old[end - shift] else 0
        done = len(last) - at - 1
        last.extend(old[len(last) - shift :])
        self.data, self.last = data, last
        return done

    def tokens(self) -> list[int]:
        """The encoding of all bytes."""
        return self.vocabulary.read_back(self.data, self.last)


class Encoder:
    """Texts to ids: each match of the pattern on its own, each distinct piece of text once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        # All token bytes in a row, for decoding with array look-ups.
        tokens = [self.vocabulary.bytes_of.get(i, b"") for i in range(max(self.vocabulary.bytes_of, default=-1) + 1)]
        self._flat = np.frombuffer(b"".join(tokens), np.uint8)
        self._sizes = np.array([len(t) for t in tokens], np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes

    def _learn(self, matches: set[str]) -> dict[str, bytes]:
        """Encode matches of the pattern in byte order, each from the table of the prefix it shares with the last."""
        v, out = self.vocabulary, {}
        before, last = b"", [-1]
        for data in sorted(m.encode() for m in matches):
            whole = v.ranks.get(data)
            if whole is not None:
                found = [whole]
            else:
                shared, most = 0, min(len(before), len(data))
                while shared < most and before[shared] == data[shared]:
                    shared += 1
                del last[shared + 1 :]
                v.fill(data, last, len(data))
                found, before = v.read_back(data, last), data
            out[data.decode()] = array("I", found).tobytes()
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none of a null or empty text."""
        cut = [PART.findall(t) if t else [] for t in texts]
        known, split = self.known, self.pattern.findall
        used = set().union(*cut)
        new = used.difference(known)
        # A word with the blank before it is one match of the pattern; other parts are split by it.
        parts = {p: [p] if WORD.fullmatch(p) else split(p) for p in new}
        own = self._learn(set(chain.from_iterable(parts.values())))
        known.update((p, b"".join([own[m] for m in found])) for p, found in parts.items())
        out = [b"".join(map(known.__getitem__, found)) for found in cut]
        for p in new:
            if len(p) > MAX_CACHED_PIECE:
                del known[p]
        if len(known) > MAX_CACHED_PARTS:
            # Parts that this run of texts found in the cache are the frequent ones and stay, if they leave room.
            again = used.difference(new)
            self.known = {p: known[p] for p in again} if 2 * len(again) < MAX_CACHED_PARTS else {}
        return out

    def forget(self) -> None:
        """Drop everything that grew with the texts."""
        v = self.vocabulary
        for cache in (self.known, v.lengths, v._pairs):
            cache.clear()

    def encode(self, text: str | None) -> bytes:
        """The ids of one text."""
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, one token after the other."""
        own = np.frombuffer(ids, "<u4")
        sizes = self._sizes[own]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self._flat[np.arange(ends[-1]) + np.repeat(self._starts[own] - ends + sizes, sizes)].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each rank file in a worker; its caches are dropped when a task ends."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(read_ranks(path))
    return _ENCODERS[path]


def encode_table(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row.

    The ids are decoded again in the same task, and decoded_sha256 is the hash of those bytes. A null or empty text
    has no ids. Repeated rows are encoded each; other columns of ``docs`` are not read. ``path`` names a rank
    file that every executor has.
    """
    path = path or public_tokenizers.path(RANKS_FILE)
    kept = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    kinds = [f"_keep_{i} {kept.schema[i].dataType.simpleString()}" for i in range(len(keep))]
    added = ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids binary"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        try:
            for batch in batches:
                at = 0
                for texts in slices(batch.column("_text"), SLICE_BYTES):
                    ids = own.encode_many(texts)
                    columns = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                    columns += [
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids], pa.string()),
                    ]
                    names = [f"_keep_{i}" for i in range(len(keep))] + ["n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        columns.append(pa.array(ids, pa.binary()))
                        names.append("ids")
                    at += len(texts)
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            own.forget()  # an idle worker holds no cache while others work

    encoded = kept.mapInArrow(run, ", ".join(kinds + added))
    return encoded.withColumnsRenamed({f"_keep_{i}": c for i, c in enumerate(keep)})
