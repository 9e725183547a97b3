"""Whitening, collocations and piece encoding against brute force, with the edge cases their docstrings state."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import chain

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
from tallyfold.llm import collocations, piece_bpe, whitening

SMALL = "/root/testdata/sf0.001"


# Whitening


def plain_whitening(rows):
    """{(key, component): (n, deviation, |whitened|, explained)} of usable rows, by a dense eigenproblem."""
    used = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(256 * float(c))) for c in v] for _, v in used]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    own = np.array(fit, float)
    values, vectors = np.linalg.eigh(np.cov(own.T, bias=True).reshape(len(sums), -1))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (key, _), row in zip(used, x, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        away = np.array(row, float) - np.array(sums) / n
        for j in range(min(4, len(sums))):
            out.setdefault((key, j + 1), []).append((n, deviation, abs(away @ vectors[:, j]) / np.sqrt(values[j]), values[j] / values.sum()))
    return out


def check_whitening(got, rows):
    want = plain_whitening(rows)
    assert sum(map(len, want.values())) == len(got)
    for r in got:
        n, deviation, size, share = next(w for w in want[r.vec_id, r.component] if w[1] == r.deviation)
        assert r.n == n
        assert abs(abs(r.whitened) - size) < 1e-7 and abs(r.explained / share - 1) < 1e-6 and r.identity_error < 1e-6


def test_whitening_of_the_table(spark):
    got = entry.queries()["op11_embedding_whitening"](spark, SMALL).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(got, rows)
    white = np.array([[r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == j] for j in (1, 2, 3, 4)])
    assert abs(white @ white.T / white.shape[1] - np.eye(4)).max() < 1e-6  # all vectors of this table differ


def test_whitening_edges(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rnd.normal(size=3) * [4, 2, 1]]) for i in range(40)]
    rows += [(3, rows[5][1]), (3, rows[5][1]), (None, rows[6][1]), (50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf")] * 3)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, x int, _key string").repartition(5)
    single = [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, v in rows]
    check_whitening(whitening.whiten(frame).collect(), single)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id = 50")).count() == 0
    assert whitening.whiten(frame.where("vec_id = 3 and size(embedding) = 3").limit(1)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>")).count() == 0
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whiten(mixed)


def test_vectors_without_variance_in_a_direction(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(35)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and abs(sum({r.explained for r in got}) - 1) < 1e-12


@pytest.mark.parametrize(("d", "gap"), [(10, 0.5), (64, 0.01), (200, 0.002)])
def test_filtered_iteration_certifies_the_leading_pairs(d, gap):
    rnd = np.random.default_rng(d)
    turn = np.linalg.qr(rnd.standard_normal((d, d)))[0]
    values = 10 * (1 - gap) ** np.arange(d)
    matrix = turn * values @ turn.T
    calls = []
    got, vectors, residuals, passes = whitening.leading_pairs(lambda q: calls.append(q.shape) or matrix @ q, d, 4)
    assert np.allclose(got, values[:4], rtol=1e-10) and passes == len(calls)
    assert np.abs(np.abs((turn[:, :4] * vectors).sum(axis=0)) - 1).max() < 1e-10 and residuals.max() <= 1e-11
    assert all(shape[1] <= whitening.BLOCK for shape in calls)


def test_moments_beyond_64_bits(spark):
    rows = [([3 << 40, 1],), ([-5 << 40, 2],), ([7 << 40, 3],)]
    n, sums, squares = whitening.moments(spark.createDataFrame(rows, "x array<bigint>"))
    assert (n, sums, squares) == (3, [5 << 40, 6], 83 * (1 << 80) + 14)


# Collocations


def plain_phrases(rows, least, absorb, top):
    """The contract by plain counting; rows are (lang, text)."""
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own, piece = counts.setdefault(lang, Counter()), []
        for c in ".,;:!?\x0b\x0c\r":
            text = (text or "").replace(c, "\n")
        for part in text.split("\n"):
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in part)
            piece = [w for w in lower.replace("\t", " ").split(" ") if w]
            total[lang] += len(piece)
            for n in range(1, 5):
                own.update(tuple(piece[i : i + n]) for i in range(len(piece) - n + 1))
    out = []
    for lang, own in counts.items():
        found, often = [], {p: a for p, a in own.items() if a >= least and len(p) > 1}
        inside = {}
        for q, b in often.items():
            for p in {q[i : i + n] for n in range(2, len(q)) for i in range(len(q) - n + 1)}:
                inside.setdefault(p, []).append(b)
        for p, a in often.items():
            if all(100 * b < absorb * a for b in inside.get(p, [])):
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_rows(seed, n=120):
    rnd = random.Random(seed)
    words = ["New", "york", "City", "é", "hall", "\xa0", "of", "x" * 300, "A"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", " york city "]) for _ in range(rnd.randint(0, 30)))
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), text))
    return [*rows, rows[0], rows[0], ("en", None), (None, ""), ("fr", "lone words here"), ("en", " .,;\n")]


@pytest.mark.parametrize(("least", "absorb", "top", "bits", "slice_rows"), [(30, 80, 2000, 26, 20_000), (3, 60, 7, 15, 5), (1, 100, 50, 15, 40)])
def test_phrases_like_plain_counting(spark, monkeypatch, least, absorb, top, bits, slice_rows):
    monkeypatch.setattr(collocations, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(collocations, "RUN_TOKENS", 200)
    rows = phrase_rows(least)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, f int").repartition(4)
    got = collocations.mine(frame, least=least, absorb=absorb, top=top, bits=bits)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, absorb, top)
    assert collocations.mine(frame.limit(0)).count() == 0


def test_phrases_of_the_table(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = entry.queries()["op12_phrase_collocations"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 30, 80, 2000) and got


def test_streams_agree_for_any_slices(spark, monkeypatch):
    frame = spark.createDataFrame(phrase_rows(8, 60), "lang string, text string")
    found = []
    for rows in (3, 17, 20_000):
        monkeypatch.setattr(collocations, "SLICE_ROWS", rows)
        found.append(sorted(map(tuple, collocations.mine(frame, least=2).collect())))
    assert found[0] == found[1] == found[2] and found[0]


# Piece encoding


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL_FILE))


def test_pieces_like_the_library(library):
    own, rnd = piece_bpe.PieceEncoder(piece_bpe.vocabulary(public_tokenizers.path(piece_bpe.MODEL_FILE))), random.Random(3)
    marks = " \n\t\x00\x85aAbé'sts12中🙂▁ .,re  the ing<0x0A>�"
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(1000)]
    texts += ["x" * 5000, " " * 3000, "中" * 2000, "▁", "▁▁ ▁", "the " * 500]
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids).decode() == library.decode(want)


def test_decoding_of_any_ids(library):
    own, rnd = piece_bpe.PieceEncoder(piece_bpe.vocabulary(public_tokenizers.path(piece_bpe.MODEL_FILE))), random.Random(5)
    for _ in range(3000):
        ids = [rnd.choice([0, 1, 2, 259, 260, 264, rnd.randint(3, 258), rnd.randint(3, 31_999)]) for _ in range(rnd.randint(0, 8))]
        assert own.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids)


def test_a_part_unlike_the_library_fails():
    vocabulary = piece_bpe.MergeVocabulary(public_tokenizers.path(piece_bpe.MODEL_FILE))
    vocabulary.pieces["▁the"] = (vocabulary.pieces["▁the"][0], 5)
    with pytest.raises(ValueError, match="library"):
        piece_bpe.PieceEncoder(vocabulary).encode_many(["of the old"])
    piece_bpe.PieceEncoder(vocabulary, check=False).encode_many(["of the old"])


def test_the_cache_of_parts_is_bounded():
    own = piece_bpe.PieceEncoder(piece_bpe.vocabulary(public_tokenizers.path(piece_bpe.MODEL_FILE)), cache_bytes=5_000)
    for i in range(50):
        own.encode_many([" ".join(f"w{i}x{j}" for j in range(10))])
        assert own.held <= 5_000 and len(own.known) <= 20


def test_pieces_of_the_table(spark, library):
    got = {r.doc_id: r for r in entry.queries()["op13_sentencepiece"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        own = got[r.doc_id]
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_piece_edges(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (None, " \n\t ", None, 2), (4, "one", "b", 3), (4, "one", "b", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `ids.x` string, _text int")
    got = piece_bpe.encode_table(frame, keep=("doc_id", "ids.x"), with_ids=True).collect()
    assert Counter((r.doc_id, r["ids.x"], r.n_tokens) for r in got)[4, "b", 3] == 2 and len(got) == 5
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {2}
    assert piece_bpe.encode_table(frame.limit(0)).count() == 0
    assert list(chain(*(r.ids for r in got if r.doc_id == 1))) == [1, 0, 0, 0, 2, 0, 0, 0]
