"""SentencePiece encoding and decoding for vocabularies of the merge type.

A normalised text is a row of symbols, at first its characters. An agenda holds each pair of neighbours whose joined
text is a piece, best score first and of equal scores the one further left; the best pair becomes one symbol and its new
neighbours enter the agenda, until it is empty. Symbols that are no pieces go by the byte pieces of their UTF-8 form.

Two symbols never merge across a place whose two characters stand side by side in no piece. A text may be cut at such places:
before a word mark, if no piece holds one after another character; between a letter and a closing mark, unless a piece
joins the two; and around line ends, which are in no piece. Each distinct part is encoded once. Parts that are new are checked against the
sentencepiece library, all those of an Arrow batch in one call.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.pretokens import slices

MODEL_FILE = "piece_bpe_32k.model"
MARK = "▁"
# What may close a word; letters that the vocabulary joins to one of these are not cut off from them.
CLOSING = ".,;:!?)#$%&*|<>\"\n\t\r"
LINE_END = "\n"
# Fixed value: how the library writes the unknown piece.
UNKNOWN_SURFACE = " ⁇ "
# A worker's cache of parts, in bytes as counted by ``_cost``; it is emptied when it is full.
CACHE_BYTES = 128_000_000


def _cost(part: str) -> int:
    """About the bytes that a cached part and its ids take."""
    return 250 + 6 * len(part)


class MergeVocabulary:
    """The pieces of a merge-type model with their scores, ids and surfaces."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        special = {i for i in ids if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        # The agenda is a heap of smallest first, so scores are negated.
        self.pieces = {lib.id_to_piece(i): (-lib.get_score(i), i) for i in ids if i not in special}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.cuts_at_marks = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        bound = "".join(re.escape(x[0]) for x in joined if x[1] in CLOSING and x[0].isalpha() | x[0].isnumeric() and not x[0].isdecimal())
        closing, letters = re.escape(CLOSING), f"[^\\W\\d_{bound}]"
        self.cuts_at_lines = not any(LINE_END in x for x in self.pieces)
        word = f"{MARK}*{letters}+(?=[{closing}{MARK}])|[{closing}]*{LINE_END}|" if self.cuts_at_lines else ""
        self.part = re.compile(f"{word}{MARK}*[^{MARK}]+|{MARK}+")
        bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.is_byte = np.array([i in bytes_of for i in ids])
        self.opens = np.array([lib.id_to_piece(i).startswith(MARK) and i not in special for i in ids])
        self.is_control = np.array([lib.is_control(i) for i in ids])
        surface = []
        for i in ids:
            if i in bytes_of:
                surface.append(bytes([bytes_of[i]]))
            elif lib.is_control(i):
                surface.append(b"")
            else:
                surface.append((UNKNOWN_SURFACE if lib.is_unknown(i) else lib.id_to_piece(i).replace(MARK, " ")).encode())
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.sizes = np.array([len(s) for s in surface], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def merge(self, part: str) -> list[int]:
        """The ids of a normalised part, by the agenda of neighbouring symbols."""
        pieces = self.pieces
        if part in pieces and len(part) == 1:
            return [pieces[part][1]]
        symbols: list[str | None] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            found = pieces.get(symbols[i] + symbols[i + 1])
            if found:
                agenda.append((found[0], i, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            left, k = symbols[i], after[i]
            # An entry is out of date when one of its symbols has merged meanwhile.
            if left is None or k >= n or len(left) + len(symbols[k]) != len(joined) or left + symbols[k] != joined:
                continue
            symbols[i], symbols[k] = joined, None
            after[i] = k = after[k]
            if k < n:
                before[k] = i
                found = pieces.get(joined + symbols[k])
                if found:
                    heapq.heappush(agenda, (found[0], i, joined + symbols[k]))
            j = before[i]
            if j >= 0:
                found = pieces.get(symbols[j] + joined)
                if found:
                    heapq.heappush(agenda, (found[0], j, symbols[j] + joined))
        out = []
        for s in symbols:
            if s is not None:
                found = pieces.get(s)
                if found:
                    out.append(found[1])
                else:
                    out += [self.byte_ids[b] for b in s.encode()]
        return out


class PieceEncoder:
    """Texts to ids and back, each distinct part of a text once while the cache holds it."""

    def __init__(self, vocabulary: MergeVocabulary, check: bool = True, cache_bytes: int = CACHE_BYTES):
        self.vocabulary, self.check, self.room = vocabulary, check, cache_bytes
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _library_ids(self, parts: list[str]) -> list[list[int]]:
        """The library's ids of parts. It puts a mark before every text: that of the part, or that of a line end before it."""
        library = self.vocabulary.library
        context = library.encode(LINE_END)
        texts = [(p[1:] if p[0] == MARK else LINE_END + p).replace(MARK, " ") for p in parts]
        found = library.encode(texts, num_threads=1)
        return [ids if p[0] == MARK else ids[len(context) :] for p, ids in zip(parts, found, strict=True)]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with begin and end, as little-endian unsigned 32-bit integers.

        A part whose ids differ from the library's raises ``ValueError``; a text that cannot be cut is one part.
        """
        v = self.vocabulary
        normal = v.library.normalize([t or "" for t in texts])
        cut = list(map(v.part.findall, normal)) if v.cuts_at_marks else [[t] * bool(t) for t in normal]
        known = self.known
        new = list(set().union(*cut).difference(known))
        found = [v.merge(p) for p in new]
        if self.check:
            for part, ids, own in zip(new, found, self._library_ids(new), strict=True):
                # The library puts no mark before an empty text, which is what a single mark comes from.
                if part != MARK and ids != own:
                    raise ValueError(f"the library encodes {part!r} as {own}, not {ids}")
        coded = {p: array("I", ids).tobytes() for p, ids in zip(new, found, strict=True)}
        known.update(coded)
        self.held += sum(map(_cost, new))
        begin, end = (array("I", [i] if i >= 0 else []).tobytes() for i in (v.begin, v.end))
        out = [b"".join([begin, *map(known.__getitem__, parts), end]) for parts in cut]
        if self.held > self.room:
            self.known, self.held = {}, 0
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8: controls are nothing, and the mark that opens the text is not a blank."""
        v = self.vocabulary
        own = np.frombuffer(ids, "<u4")
        shown = np.flatnonzero(~v.is_control[own])
        if not len(shown):
            return b""
        own = own[shown[0] : shown[-1] + 1]
        sizes = v.sizes[own]
        ends = np.cumsum(sizes)
        raw = v.flat[np.arange(ends[-1]) + np.repeat(v.starts[own] - ends + sizes, sizes)].tobytes()
        if v.is_byte[own].any():
            try:
                raw.decode()
                whole = len(own) == len(shown)  # a control in between parts the bytes around it
            except UnicodeDecodeError:
                whole = False
            raw = raw if whole else self._mended(own)
        return raw[1:] if v.opens[own[0]] else raw

    def _mended(self, own: np.ndarray) -> bytes:
        """As ``decode``, with a replacement character for each byte piece that is in no whole character."""
        v, out, i = self.vocabulary, [], 0
        surfaces = [v.flat[v.starts[k] : v.starts[k] + v.sizes[k]].tobytes() for k in own.tolist()]
        while i < len(own):
            if not v.is_byte[own[i]]:
                out.append(surfaces[i])
                i += 1
                continue
            for n in (1, 2, 3, 4):
                run = b"".join(surfaces[i : i + n])
                if len(run) == n and v.is_byte[own[i : i + n]].all():
                    try:
                        run.decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(run)
                    i += n
                    break
            else:
                out.append("�".encode())
                i += 1
        return b"".join(out)


_VOCABULARIES: dict[str, MergeVocabulary] = {}


def vocabulary(path: str) -> MergeVocabulary:
    """One vocabulary of fixed size for each model file in a worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = MergeVocabulary(path)
    return _VOCABULARIES[path]


def encode_table(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    path: str | None = None,
    with_ids: bool = False,
    check: bool = True,
) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row.

    Ids are those of the library with begin and end ids; they are decoded again in the same task, and decoded_sha256 is the hash of
    that text. A null or empty text has the begin and end ids only and decodes to nothing. Repeated rows are encoded each;
    other columns of ``docs`` are not read, and their names may clash with those added only if they are not kept. A text is
    taken whole, however long; a task holds about 4 MB of text or one longer text at a time, and a cache of fixed size that ends
    with the task. ``check`` compares each part that is new to a task with the library and fails on the first difference.
    """
    path = path or public_tokenizers.path(MODEL_FILE)
    kept = docs.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("_text"))
    kinds = [f"_keep_{i} {kept.schema[i].dataType.simpleString()}" for i in range(len(keep))]
    added = ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids binary"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceEncoder(vocabulary(path), check)
        names = [f"_keep_{i}" for i in range(len(keep))] + [a.split()[0] for a in added]
        for batch in batches:
            at = 0
            for texts in slices(batch.column("_text")):
                ids = own.encode_many(texts)
                columns = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                columns += [
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    encoded = kept.mapInArrow(run, ", ".join(kinds + added))
    return encoded.withColumnsRenamed({f"_keep_{i}": c for i, c in enumerate(keep)})
