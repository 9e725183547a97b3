"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over
all ways to cut it into pieces, of the products of their probabilities; a forward pass over the word's characters
computes it. A text's score is the product over its words, and its language the most probable one. Piece probabilities are
learned by expectation-maximisation from word counts of a bounded sample of labelled documents.

Words are runs of letters in lower case after the vocabulary's word mark. A run of over ``MAX_RUN`` letters, as in scripts
without blanks, is cut every ``MAX_RUN`` letters. A character without a piece of its own goes by the byte pieces of its UTF-8 form.
Forward sums that become very small are carried in a common unit of ``UNIT`` per level, so that long words lose nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY_FILE = "piece_bpe_32k.model"
MARK = "▁"
RUN = re.compile(r"[^\W\d_]+")
MAX_RUN = 48
MAX_CACHED_WORDS = 400_000
MAX_TRAIN_DOCS = 4_000
ITERATIONS = 2
SMOOTHING = 0.1
UNKNOWN = "und"
# A row of forward sums whose largest is below this is written in the next smaller unit.
UNIT = 1e-200


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces; byte pieces are written ``<0x41>``."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, long ones cut."""
    found = RUN.findall(text.lower())
    if found and len(max(found, key=len)) > MAX_RUN:
        found = [w[i : i + MAX_RUN] for w in found for i in range(0, len(w), MAX_RUN)]
    return found


@dataclass
class PieceModel:
    """Piece probabilities of each language, as one tuple for each piece."""

    languages: list[str]
    table: dict[str, tuple[float, ...]]

    def __post_init__(self):
        self.longest = max(map(len, self.table), default=1)

    def steps(self, word: str, end: int) -> list[tuple[int, tuple[float, ...]]]:
        """(start, probabilities) of the pieces that end there."""
        table, found = self.table, []
        for start in range(max(0, end - self.longest), end):
            row = table.get(word[start:end])
            if row is not None:
                found.append((start, row))
        if not found or found[-1][0] != end - 1:
            row = (1.0,) * len(self.languages)
            for byte in word[end - 1].encode():
                row = tuple(a * b for a, b in zip(row, table[f"<0x{byte:02X}>"], strict=True))
            found.append((end - 1, row))
        return found

    def extend(self, word: str, forward: list[tuple[int, list[float]]]) -> None:
        """Append (level, sums) of the prefixes of ``word`` that ``forward`` lacks; a sum counts ``UNIT`` to the power of its level."""
        deep = any(level for level, _ in forward)
        for end in range(len(forward), len(word) + 1):
            steps = self.steps(word, end)
            level = min(forward[s][0] for s, _ in steps) if deep else 0
            total = [0.0] * len(self.languages)
            for start, row in steps:
                own, sums = forward[start]
                if own != level:
                    row = [p * UNIT ** (own - level) for p in row]
                total = [t + a * p for t, a, p in zip(total, sums, row, strict=True)]
            if max(total) < UNIT:
                deep, level, total = True, level + 1, [t / UNIT for t in total]
            forward.append((level, total))

    def log_scores(self, words: Iterable[str]) -> dict[str, list[float]]:
        """Log probability by language of distinct words; sorted words share the sums of common prefixes.

        A language whose probability is below 1e-300 of the word's unit counts as that.
        """
        out, before, forward = {}, "", [(0, [1.0] * len(self.languages))]
        for word in sorted(words):
            marked = MARK + word
            shared, most = 0, min(len(before), len(marked))
            while shared < most and before[shared] == marked[shared]:
                shared += 1
            del forward[shared + 1 :]
            self.extend(marked, forward)
            before, out[word] = marked, forward[-1]
        names = list(out)
        logs = np.log(np.maximum(np.array([out[w][1] for w in names]).reshape(len(names), -1), 1e-300))
        logs += math.log(UNIT) * np.array([out[w][0] for w in names]).reshape(len(names), 1)
        return dict(zip(names, logs, strict=True))


def _log_sum(terms: list[float]) -> float:
    most = max(terms, default=-math.inf)
    return most if most == -math.inf else most + math.log(sum(math.exp(t - most) for t in terms))


def _shares(steps: list[list[tuple[int, float]]]) -> Iterator[tuple[int, int, float]]:
    """(start, end, probability) that a segmentation of the word uses the piece from start to end, in logarithms throughout."""
    size = len(steps) - 1
    logs = [[(s, math.log(p)) for s, p in own if p > 0] for own in steps]
    forward, following = [0.0], [[] for _ in steps]
    for end in range(1, size + 1):
        forward.append(_log_sum([forward[s] + p for s, p in logs[end]]))
        for s, p in logs[end]:
            following[s].append((end, p))
    backward = [0.0] * (size + 1)
    for start in range(size - 1, -1, -1):
        backward[start] = _log_sum([backward[e] + p for e, p in following[start]])
    if forward[size] > -math.inf:
        for end in range(1, size + 1):
            for s, p in logs[end]:
                yield s, end, math.exp(forward[s] + p + backward[end] - forward[size])


def expected_pieces(counts: Iterable[tuple[str, int]], model: PieceModel, language: int) -> dict[str, float]:
    """How often each piece is expected in counted words, over all segmentations."""
    out: dict[str, float] = {}
    for word, n in counts:
        marked = MARK + word
        size = len(marked)
        steps = [[]] + [[(s, row[language]) for s, row in model.steps(marked, e)] for e in range(1, size + 1)]
        forward = [1.0] + [0.0] * size
        for end in range(1, size + 1):
            forward[end] = sum(forward[s] * p for s, p in steps[end])
        if forward[size] < UNIT:
            shares = _shares(steps)
        else:
            backward = [0.0] * size + [1.0]
            for end in range(size, 0, -1):
                for s, p in steps[end]:
                    backward[s] += p * backward[end]
            shares = ((s, e, forward[s] * p * backward[e] / forward[size]) for e in range(1, size + 1) for s, p in steps[e])
        for s, end, share in shares:
            piece = marked[s:end]
            if piece in model.table:
                out[piece] = out.get(piece, 0.0) + n * share
            else:
                for byte in piece.encode():
                    name = f"<0x{byte:02X}>"
                    out[name] = out.get(name, 0.0) + n * share
    return out


def _word_counts(sample: DataFrame) -> DataFrame:
    """lang, word, n of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
            for lang, found in counts.items():
                words = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["lang", "word", "n"],
                )

    counted = sample.mapInArrow(run, "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(
    labelled: DataFrame,
    path: str | None = None,
    max_docs: int = MAX_TRAIN_DOCS,
    iterations: int = ITERATIONS,
) -> PieceModel:
    """Learn from columns doc_id, text and lang, none of them null in the rows that count.

    Of each language about its even share of ``max_docs`` documents, chosen by a hash of their ids, or all it has, are the
    sample, so that a rare language is learned in a table of any size; the sample bounds the word table. What reaches the
    driver is one number for each language and piece. Without rows the model has no languages.
    """
    vocabulary = pieces_of(path or public_tokenizers.path(VOCABULARY_FILE))
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    each = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each language, a number the model is made for.
    part = F.lit(float(max_docs)) / max(1, each.count())
    shares = each.select("lang", F.least(F.lit(1.0), part / F.col("_n")).alias("_share"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    chosen = labelled.join(F.broadcast(shares), "lang").where(place < F.col("_share"))
    counts = _word_counts(chosen.select("lang", "text")).persist()
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    start = 1.0 / len(vocabulary)
    model = PieceModel(languages, {p: (start,) * len(languages) for p in vocabulary})
    if not languages:
        return model
    for _ in range(iterations):
        sent = labelled.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                frame = batch.to_pandas()
                for lang, part in frame.groupby("lang"):
                    found = expected_pieces(zip(part["word"], part["n"], strict=True), sent.value, sent.value.languages.index(lang))
                    yield pa.RecordBatch.from_pandas(
                        pd.DataFrame({"lang": lang, "piece": list(found), "n": list(found.values())}), preserve_index=False
                    )

        expected = counts.mapInArrow(run, "lang string, piece string, n double").groupBy("lang", "piece")
        # At most one row for each language and piece of the vocabulary.
        rows = expected.agg(F.sum("n").alias("n")).collect()
        weight = np.full((len(vocabulary), len(languages)), SMOOTHING)
        at = {p: i for i, p in enumerate(vocabulary)}
        for lang, piece, n in rows:
            weight[at[piece], languages.index(lang)] += round(n, 6)
        weight /= weight.sum(axis=0)
        model = PieceModel(languages, dict(zip(vocabulary, map(tuple, weight.tolist()), strict=True)))
    counts.unpersist()
    return model


class Identifier:
    """Texts to languages, scoring each distinct word once; the cache is emptied when it is full."""

    def __init__(self, model: PieceModel):
        self.model, self.rows = model, {}
        self.scores = np.zeros((0, len(model.languages)))

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages = self.model.languages
        if not languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        if len(self.rows) > MAX_CACHED_WORDS:
            self.rows, self.scores = {}, self.scores[:0]
        cut = [words_of(t or "") for t in texts]
        new = set().union(*cut).difference(self.rows)
        if new:
            found = self.model.log_scores(new)
            self.rows.update(zip(found, range(len(self.scores), len(self.scores) + len(found)), strict=False))
            self.scores = np.concatenate([self.scores, np.array(list(found.values()))])
        names, scores = [], []
        for words in cut:
            # A run may consist of number forms only; they are no letters.
            if not any(c.isalpha() for w in words for c in w):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.scores[list(map(self.rows.__getitem__, words))].sum(axis=0)
            best = int(total.argmax())
            names.append(languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def identify(
    docs: DataFrame, model: PieceModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``keep`` columns, lang_pred and score, the probability among the learned languages, of every row.

    A null text, one without letters, or any text under a model without languages gets ``und`` and 0. Of equally probable languages the
    first in alphabetical order wins. Only the text is read for the prediction. The model, one number for each language and piece of a fixed
    vocabulary, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    kinds = ", ".join(f"_keep_{i} {kept.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyfold.llm.pretokens import slices

        own = Identifier(sent.value)
        for batch in batches:
            names, scores = [], []
            for texts in slices(batch.column("_text")):
                n, s = own.identify(texts)
                names += n
                scores += s
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*(f"_keep_{i}" for i in range(len(keep))), "lang_pred", "score"],
            )

    named = kept.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return named.withColumnsRenamed({f"_keep_{i}": c for i, c in enumerate(keep)})


def held_out(doc_id: Column) -> Column:
    """Whether the document is kept out of training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
