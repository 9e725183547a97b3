"""Quality classifier: ordinal regression on hashed words.

Ratings are ordered grades 0 to K. One weight for each hashed word, shared by all grades, gives a text a value; ordered
thresholds cut the line of values into grades: P(grade <= k) = sigmoid(threshold_k - value). From these come the expected
grade and the probability of a grade or better. A text's features are the distinct words it has, in lower case, and for
words with signs or in capitals a feature of that shape.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.pretokens import slices
from tallyfold.llm.words import split_words

BITS = 18
MAX_TRAIN_DOCS = 12_000
MIN_DOCS = 5
MIN_SCORE = 4.5
PENALTY = 0.5
ROUNDS = 300
STEP = 0.05
MAX_CACHED_WORDS = 400_000
ENDS = ".,;:!?\"'()"


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features of one word: the word without case and outer punctuation, and its shape if it has one."""
    core = word.strip(ENDS)
    mask = (1 << BITS) - 1
    found = [xxhash.xxh64_intdigest(core.lower()) & mask] if core else []
    signs = "".join(sorted({c for c in word if not c.isalnum()}))
    if signs.strip(ENDS):
        found.append(xxhash.xxh64_intdigest("\x00" + signs) & mask)
    if len(core) > 3 and core.isupper():
        found.append(xxhash.xxh64_intdigest("\x00upper") & mask)
    return tuple(found)


class Features:
    """Texts to their distinct feature ids; distinct words are hashed once, and a full cache is emptied."""

    def __init__(self):
        self.words: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> np.ndarray:
        if len(self.words) > MAX_CACHED_WORDS:
            self.words.clear()
        known, out = self.words, set()
        for word in set(split_words(text)):
            found = known.get(word)
            if found is None:
                found = features_of(word)
                if len(word) <= 64:
                    known[word] = found
            out.update(found)
        return np.fromiter(out, np.int32, len(out))


@dataclass
class Grader:
    """Weights by feature and the ordered thresholds; without thresholds there is one grade only."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, value: float) -> np.ndarray:
        """Probabilities of grade 1 or better, 2 or better and so on."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - value, -500, 500)))


def _thresholds(state: np.ndarray, cuts: int) -> np.ndarray:
    """The thresholds at the end of a state; the gaps between them are exponentials, so their order holds throughout."""
    own = state[len(state) - cuts :]
    return np.cumsum(np.concatenate([own[:1], np.exp(own[1:])]))


def loss_and_gradient(
    state: np.ndarray, rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, cuts: int
) -> tuple[float, np.ndarray]:
    """Negative log-likelihood with the penalty, and its gradient, at a state of weights and thresholds.

    Document ``rows[i]`` has feature ``columns[i]``; grades run from 0 to ``cuts``.
    """
    names = len(state) - cuts
    weights, limits = state[:names], _thresholds(state, cuts)
    value = np.bincount(rows, weights[columns], minlength=len(grades))
    bounds = np.concatenate([[-np.inf], limits, [np.inf]])
    low = 1 / (1 + np.exp(np.clip(value - bounds[grades], -500, 500)))
    high = 1 / (1 + np.exp(np.clip(value - bounds[grades + 1], -500, 500)))
    low[grades == 0], high[grades == cuts] = 0.0, 1.0
    inside = np.maximum(high - low, 1e-12)
    loss = float(-np.log(inside).sum() + PENALTY / 2 * (weights * weights).sum())
    by_high, by_low = high * (1 - high) / inside, low * (1 - low) / inside
    by_value = by_high - by_low
    gradient = np.zeros_like(state)
    gradient[:names] = np.bincount(columns, by_value[rows], minlength=names) + PENALTY * weights
    by_limit = np.array([by_low[grades == k + 1].sum() - by_high[grades == k].sum() for k in range(cuts)])
    from_here = np.cumsum(by_limit[::-1])[::-1]
    gradient[names] = from_here[0]
    gradient[names + 1 :] = from_here[1:] * np.exp(state[names + 1 :])
    return loss, gradient


def fit(features: list[np.ndarray], grades: np.ndarray) -> Grader:
    """Fit on the given documents by gradient steps with momentum; features in under ``MIN_DOCS`` of them,
    or whose documents' mean grade lies under ``MIN_SCORE`` standard errors from that of all, count nothing."""
    if len(grades) == 0:
        return Grader(np.zeros(1 << BITS), np.zeros(0))
    columns = np.concatenate(features) if features else np.zeros(0, np.int32)
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    # Only features whose documents differ in mean grade from all by more than chance would have it.
    seen = np.bincount(columns, minlength=1 << BITS)
    shift = np.bincount(columns, (grades - grades.mean())[rows], minlength=1 << BITS)
    score = np.abs(shift) / np.maximum(np.sqrt(seen) * grades.std(), 1e-9)
    used = ((seen >= MIN_DOCS) & (score >= MIN_SCORE))[columns]
    columns, rows = columns[used], rows[used]
    names, columns = np.unique(columns, return_inverse=True)
    n, cuts = len(grades), int(grades.max())
    if cuts == 0:
        return Grader(np.zeros(1 << BITS), np.zeros(0))
    shares = np.array([(np.sum(grades <= k) + 0.5) / (n + 1) for k in range(cuts)])
    first = np.log(shares / (1 - shares))
    state = np.concatenate([np.zeros(len(names)), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    mean, square = np.zeros_like(state), np.zeros_like(state)

    for step in range(1, ROUNDS + 1):
        _, gradient = loss_and_gradient(state, rows, columns, grades, cuts)
        gradient /= n
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        state -= STEP * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[names] = state[: len(names)]
    return Grader(weights, _thresholds(state, cuts))


def learn(docs: DataFrame, ratings: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Grader:
    """Learn from documents (doc_id, text) and ratings (doc_id, grade: 0, 1, ...).

    About ``max_docs`` rated documents, chosen by a hash of their ids, are used; their feature ids (at most 2 ** ``BITS`` each) are what
    reaches the driver. Null ids, texts and grades do not count; of several ratings of a document the lowest does.
    """
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
    rated = rated.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = rated.count()
    share = min(1.0, max_docs / n) if n else 1.0
    chosen = rated.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Features()
        for batch in batches:
            found = [maker.of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("grade"), pa.array(found, pa.list_(pa.int32()))],
                ["doc_id", "grade", "features"],
            )

    rows = own.mapInArrow(run, "doc_id string, grade int, features array<int>").toArrow().sort_by("doc_id")
    features = [np.sort(np.asarray(f.values, np.int32)) for f in rows.column("features")] if rows.num_rows else []
    return fit(features, np.array(rows.column("grade").to_pylist(), np.int64))


def grade_documents(
    docs: DataFrame,
    grader: Grader,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    least_grade: int | None = None,
    least_probability: float = 0.5,
) -> DataFrame:
    """``keep`` columns, expected_grade, tail_probability and kept of every row.

    tail_probability is that of ``least_grade`` (the highest by default) or better, and kept says whether it reaches
    ``least_probability``. A null or empty text has no features and is graded by the thresholds alone. A grader that saw one
    grade only, or nothing, expects 0 and keeps all. Repeated rows are graded each. The weights, 2 ** ``BITS`` numbers, are broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(grader)
    kept = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    kinds = ", ".join(f"_keep_{i} {kept.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, own = Features(), sent.value
        cuts = len(own.thresholds)
        at = (cuts if least_grade is None else least_grade) - 1
        for batch in batches:
            expected, tails = [], []
            for texts in slices(batch.column("_text")):
                for value in texts:
                    above = own.at_least(own.weights[maker.of(value)].sum())
                    expected.append(float(above.sum()))
                    tails.append(float(above[at]) if 0 <= at < cuts else 1.0)
            columns = [batch.column(i) for i in range(len(keep))]
            good = [t >= least_probability for t in tails]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(expected, pa.float64()), pa.array(tails, pa.float64()), pa.array(good, pa.bool_())],
                [*(f"_keep_{i}" for i in range(len(keep))), "expected_grade", "tail_probability", "kept"],
            )

    graded = kept.mapInArrow(run, f"{kinds}, expected_grade double, tail_probability double, kept boolean")
    return graded.withColumnsRenamed({f"_keep_{i}": c for i, c in enumerate(keep)})
