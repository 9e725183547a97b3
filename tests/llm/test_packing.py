"""Packing takes the most ids that fit in each word, and parts say rightly how they can be encoded."""

import random

import numpy as np
import pyarrow as pa

from tallyfold.llm.token_files import ALONE, BLANK_BEFORE, COUNTS, LINE_AFTER, ONE, WHITE, WIDTHS, cut, pack, unpack


def test_words_take_the_most_ids_that_fit():
    draw = random.Random(4)
    docs = [[draw.randrange(1 << draw.choice([0, 0, 0, 1, 3, 7, 9, 14, 16])) for _ in range(draw.randrange(1, 400))] for _ in range(40)]
    docs += [[0] * 700, [1] * 130, [0] * 241 + [5] * 21]
    ids = np.array([i for d in docs for i in d], np.uint64)
    ends = np.cumsum([len(d) for d in docs])
    words, upto, starts = pack(ids, ends)
    assert unpack(words).tolist() == ids.tolist()
    want, at = [], 0
    for end in ends.tolist():
        while at < end:
            fits = [s for s in range(15) if at + COUNTS[s] <= end and int(ids[at : at + COUNTS[s]].max()) < 1 << int(WIDTHS[s])]
            want.append((at, fits[0] if fits else ONE))
            at += int(COUNTS[fits[0]]) if fits else 1
    assert list(zip(starts.tolist(), (words >> np.uint64(60)).tolist(), strict=True)) == want
    assert len(words) == upto[-1]


def test_parts_by_their_white_space():
    texts = [" a b", "a\nb", "\n\nb  c ", "", " ", "x y été, z", "end ", " begin", "\nq", "<|s|> a  b"]
    parts, how, upto = cut(pa.array(texts, pa.large_string()), ["<|s|>"])
    parts, first = parts.to_pylist(), 0
    for text, end in zip(texts, upto.tolist(), strict=True):
        assert "".join(parts[first:end]) == text
        for part, kind in zip(parts[first:end], how[first:end].tolist(), strict=True):
            blanks = sum(c in WHITE for c in part)
            own = BLANK_BEFORE if blanks == 1 and part[0] == " " and len(part) > 1 else LINE_AFTER if blanks == 0 else ALONE
            assert kind == (ALONE if "<|s|>" in text else own), part
        first = end
