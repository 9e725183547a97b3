"""Registered corpus queries and the pipeline over the whole small tables, against plain Python, DuckDB and the libraries."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tallyfold.llm import bpe, decontaminate, grader, jaccard, language, quality, secrets, token_files
from tallyfold.llm.words import lower_ascii, split_words

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())


def result(spark, name):
    return {r.doc_id: r for r in entry.queries()[name](spark, SMALL).collect()}


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def plain_spans(text):
    """The spans of the three base kinds."""
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
        ("access", re.compile("AKIA[A-Z0-9]+")),
        ("hex", re.compile("[0-9a-f]+")),
    ]
    least = {"assign": 6, "access": 20, "hex": 24}
    found = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least[kind]:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_quality_rules"])
def test_twins(spark, name):
    con, sql = oracle.connect(SMALL), entry.oracle_sql()[name]
    assert oracle.difference(oracle.spark_rows(entry.queries()[name](spark, SMALL)), oracle.sql_rows(con, sql)) is None


def test_references_learned_from_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "word", None), (-4, "word", "xx")], "doc_id long, text string, lang string")
    learned = quality.learn_references(docs.unionByName(odd).withColumn("a.b", F.lit(1)), ["en", "de", "none"])
    plain: dict[str, Counter] = {"en": Counter(), "de": Counter()}
    total, classes = Counter(), {"en": [1] * 6, "de": [1] * 6}
    for r in docs.where("lang in ('en', 'de') and text is not null").collect():
        words = split_words(r.text)
        total[r.lang] += len(words)
        plain[r.lang].update(w.lower() for w in words if w.isalpha() and (w[1:] == "" or w[1:].islower()))
        for c in r.text:
            place = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c < "\x80" else 5
            classes[r.lang][place] += 1
    assert set(learned.words) == set(learned.chars) == {"en", "de"}
    for name, counted in plain.items():
        best = sorted(counted.items(), key=lambda wn: (-wn[1], wn[0]))[: quality.COMMON_WORDS]
        assert learned.words[name] == pytest.approx({w: n / (total[name] + 1) for w, n in best})
        assert learned.chars[name] == pytest.approx([n / sum(classes[name]) for n in classes[name]])
    # Texts that the labels call good are near the references of their languages, noise is not.
    good = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").select("doc_id")
    own = docs.where("lang in ('en', 'de')").join(good, "doc_id", "left_semi")
    judged = quality.measure_quality(own, references=learned).where("char_distance is not null")
    assert judged.where("kept").count() == judged.count() > 0
    noise = spark.createDataFrame([(1, " ".join(f"Q{n}Z#{n * 7}" for n in range(400)))], "doc_id long, text string")
    assert not quality.measure_quality(noise, references=learned).first().kept
    with pytest.raises(ValueError):
        quality.learn_references(docs, ["none"])


def test_parts_of_texts_have_the_ids_of_the_library():
    """Random texts of white space, marks, contractions, letters of several scripts and a special token, in Arrow runs."""
    rnd = random.Random(11)
    some = list(" \n\t.,;:!?'abcXYZ\u00e9\u0416\u044f0192*$-_\u00a0\u3000\u65e5\U0001f600\u0301\u01c5")
    some += ["  ", "\n\n", "'s", "'ll ", "<|endoftext|>", "the ", " word", ". ", ",\n", "\r\n"]
    texts = [None, "", " ", "\n", "\na", "a\n", "\nb", ""] + ["".join(rnd.choices(some, k=rnd.randint(0, 40))) for _ in range(8000)]
    own = token_files.encoder(public_tokenizers.path(token_files.TOKENIZER_FILE))
    column = pa.array(texts + texts[::-1], pa.string())
    got = []
    for first in range(0, len(column), 3000):  # runs that begin within the column's buffers
        ids, sizes = own.encode_texts(column.slice(first, 3000))
        got += [found.tolist() for found in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]


def test_token_files_hold_the_library_ids(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER_FILE))
    got, start = result(spark, "op4_token_files"), 0
    for doc, text in documents:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got.pop(doc)
        assert (own.start, own.n_tokens, own.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_special_names_and_odd_texts_as_in_the_plain_call():
    path, rnd = public_tokenizers.path(token_files.TOKENIZER_FILE), random.Random(6)
    library, own = Tokenizer.from_file(path), token_files.encoder(path)
    signs = " \n\t\x00\x85\xa0aAbé's.,;:!?²12中🙂_~)#́ Ж"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "<|endoftext|>", "'s the", "\n\n"]) for _ in range(2000)]
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_each_block_decodes_alone():
    rng = np.random.default_rng(3)
    for n in (0, 1, 401, 5000):
        ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.choice(np.array([0, 0, 1, 30, 60], np.uint64), n)
        words, _, starts = token_files.pack(ids, np.array([n]))
        blocks = token_files.block_table(words, starts) if n else np.zeros((0, 2), "<u8")
        parts = [token_files.read_block(words, blocks, k) for k in range(len(blocks))]
        assert [first for first, _ in parts] == [int(b) for b in np.cumsum([0, *(len(p) for _, p in parts[:-1])])][: len(parts)]
        assert np.concatenate([np.zeros(0, np.uint64), *(p for _, p in parts)]).tolist() == ids.tolist()


def test_the_part_cache_keeps_results_when_it_overflows(monkeypatch):
    path = public_tokenizers.path(token_files.TOKENIZER_FILE)
    monkeypatch.setattr(token_files, "MAX_CACHED_PIECES", 40)
    library, own, rnd = Tokenizer.from_file(path), token_files.encoder(path), random.Random(1)
    for _ in range(100):
        text = " ".join(f"{rnd.choice('abc')}word{chr(97 + rnd.randrange(26))}" for _ in range(30))
        assert np.frombuffer(own.encode_many([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.places) <= 40 + 30


def test_secret_digests(spark, documents):
    got = result(spark, "op5_secret_scan")
    for doc, text in documents:
        spans = plain_spans(text)
        assert got[doc].base_sha256 == digest(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
        counts = Counter(k for k, _, _ in spans)
        assert (got[doc].n_assign, got[doc].n_access, got[doc].n_hex) == tuple(counts[k] for k in ("assign", "access", "hex"))
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(got[doc].spans.split(","))


def test_random_strings_and_plain_ones(spark):
    rnd = random.Random(4)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strings = ["".join(rnd.choices(signs, k=32)) for _ in range(100)] + ["1" + "x" * 30, "xy" * 12 + "7", "0-0-0-0-0-0-0-0-0-0-0-0-a"]
    rows = [(i, f"here is {x} in a text") for i, x in enumerate(strings)]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:8:40" for i in range(100)) >= 95 and not any(got[i] for i in range(100, 103))


def test_passage_digests(spark, documents):
    got, seen = result(spark, "op6_substring_dedup"), set()
    for doc, text in documents:
        words, gone = split_words(text), set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == (len(words), len(gone), digest(kept))


def shingles(text, k):
    words = split_words(lower_ascii(text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def groups(sets, percent):
    found = {d: d for d in sets}
    order = sorted(sets)
    links = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in order:
        for a, b in links:
            found[a] = found[b] = min(found[a], found[b])
    return found


def test_components(spark, documents):
    got, sets = result(spark, "op7_jaccard_join"), {d: shingles(t, 3) for d, t in documents}
    want = groups(sets, 90)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(s), want[d]) for d, s in sets.items()}


def test_byte_level_digests(spark, documents):
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS_FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result(spark, "op10_byte_bpe")
    for doc, text in documents:
        ids = library.encode_ordinary(text or "")
        own = got[doc]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(text or ""))


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the house and the garden of the old man", "en") for i in range(3000)]
    rows += [(5000 + i, "das haus und der garten des alten mannes", "de") for i in range(4)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(train, max_docs=60)
    found = language.identify(spark.createDataFrame([(1, "der garten")], "doc_id long, text string"), model).first()
    assert model.languages == ["de", "en"] and found.lang_pred == "de"


def test_long_words_of_byte_pieces_are_scored():
    table = {f"<0x{b:02X}>": (1e-5, 2e-5) for b in range(256)} | {"▁": (0.1, 0.1)}
    model = language.PieceModel(["x", "y"], table)
    for n in (1, 20, 48):
        scores = model.log_scores(["中" * n])["中" * n]
        assert np.isclose(scores[1] - scores[0], 3 * n * np.log(2))
    word = "中" * 48
    expected = language.expected_pieces([(word, 2)], model, 0)
    assert np.isclose(expected["<0xE4>"], 2 * 48) and np.isclose(expected["▁"], 2)


def test_edited_items_are_found_and_clean_texts_left(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
    rnd, docs = random.Random(3), []
    for i, r in enumerate(items):
        words = r.text.split()
        words[rnd.randrange(len(words))] = "changed"
        docs.append((r.item_id, "pad " * 40 + " ".join(words) + " tail" * 40))
        docs.append((10_000 + i, " ".join(rnd.sample(words, len(words)))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.find_contamination(frame, spark.createDataFrame(items)).collect()
    assert sum(r.doc_id == r.item_id for r in found) >= 0.9 * len(items)
    assert not [r for r in found if r.doc_id >= 10_000]


def test_overlap_is_the_best_fit_of_a_side():
    def plain(side, passage):
        best = [0] * (len(passage) + 1)
        for word in side:
            now = [best[0] + 1]
            for j, p in enumerate(passage):
                now.append(min(best[j] + (p != word), best[j + 1] + 1, now[j] + 1))
            best = now
        return max(0.0, 1 - min(best) / len(side))

    rng = np.random.default_rng(0)
    for _ in range(300):
        side, passage = rng.integers(0, 6, rng.integers(1, 9)), rng.integers(0, 6, rng.integers(0, 25))
        assert np.isclose(decontaminate.overlap(side, passage), plain(side.tolist(), passage.tolist()))
    assert decontaminate.overlap(np.zeros(0), np.zeros(3)) == 1.0


def test_many_spans_and_names_with_dots(spark):
    secret, n = "token=abcdefgh", 20_000
    text = f"{secret} é🙂 " * n
    rows = [(1, text, 5, "x"), (2, None, None, None), (3, "", 0, "y"), (4, "plain", 5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, `a.b` string")
    got = {r.doc_id: r for r in secrets.mask_secrets(frame).collect()}
    want = "[secret] é🙂 " * n
    assert got[1].text == want and got[1].n_chars == len(want) and got[1]["a.b"] == "x"
    assert [tuple(got[i]) for i in (2, 3, 4)] == rows[1:]
    overlapping = "password=AKIA" + "A1" * 10 + " and AKIA" + "B2" * 9 + "password=secret=abcdefg"
    one = spark.createDataFrame([(1, overlapping, 0, "")], frame.schema)
    assert secrets.mask_secrets(one).first().text == "[secret] and [secret]"


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (2, text + " more"), (None, text), (2, text + " more"), (9, "other words"), (7, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_later", F.lit(1))
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.keep_first(frame).collect())
    assert [d for d, _ in kept] == [0, 2, 2, 7, 8, 9] and jaccard.keep_first(frame.limit(0)).count() == 0


def test_gradient_by_finite_differences():
    rng, names, n, cuts = np.random.default_rng(2), 6, 40, 3
    grades = rng.integers(0, cuts + 1, n)
    rows, columns = np.repeat(np.arange(n), 3), rng.integers(0, names, 3 * n)
    state = np.concatenate([rng.normal(size=names) * 0.5, [-1.0, 0.2, -0.3]])
    _, gradient = grader.loss_and_gradient(state, rows, columns, grades, cuts)
    for i in range(len(state)):
        step = np.zeros_like(state)
        step[i] = 1e-6
        up, down = (grader.loss_and_gradient(state + k * step, rows, columns, grades, cuts)[0] for k in (1, -1))
        assert np.isclose((up - down) / 2e-6, gradient[i], rtol=1e-4, atol=1e-5)


def test_grades_of_held_out_labels(spark):
    """Learned on two thirds of the labels of a table; the rest is told apart."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "case when toxic = 1 then 0 when quality = 0 then 1 else 2 end grade")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = grader.learn(docs, labels.where("doc_id % 3 <> 1"))
    graded = {r.doc_id: r.expected_grade for r in grader.grade_documents(docs, model).collect()}
    held = {r.doc_id: r.grade for r in labels.where("doc_id % 3 = 1").collect()}
    mean = [np.mean([graded[d] for d, g in held.items() if g == k]) for k in range(3)]
    assert mean[0] + 0.5 < mean[2] and mean[1] < mean[2]


def test_the_pipeline_stage_by_stage(spark, documents, tmp_path):
    """Each stage's decisions on what the stage before kept, by plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = dict(documents)
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        got = {r.doc_id: r for r in docs.collect()}
        if number < 4:
            assert docs.columns == columns, name
        if number == 0:
            judged = {r.doc_id: r.kept for r in quality.measure_quality(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
            left = {d: t for d, t in left.items() if judged[d]}
        elif number == 1:
            first = groups({d: shingles(t, 5) for d, t in left.items()}, 80)
            left = {d: t for d, t in left.items() if first[d] == d}
        elif number == 2:
            items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
            sides = [tuple(map(decontaminate.terms_of, re.match(r"(?s)^(?:(.*[.?!])\s+)?(\S.*)$", r.text).groups())) for r in items]

            def holds(text):
                terms = decontaminate.terms_of(text)
                ids = {t: i for i, t in enumerate(dict.fromkeys(terms))}
                words = np.array([ids[t] for t in terms])
                side = lambda s: np.array([ids.get(t, -1) for t in s])
                return any(decontaminate.overlap(side(q), words) >= 0.6 and decontaminate.overlap(side(a), words) >= 0.6 and q for q, a in sides)

            dropped = set(left) - set(got)
            assert all(holds(left[d]) for d in dropped)
            verbatim = {d for d, t in left.items() if any(r.text in (t or "") for r in items)}
            assert verbatim <= dropped
            left = {d: t for d, t in left.items() if d in got}
        elif number == 3:
            spans = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(list(left.items()), "doc_id long, text string")).collect()}
            for d, text in left.items():
                cuts = [(int(s), int(e)) for _, s, e in (x.split(":") for x in spans[d].split(",") if x)]
                masked, end = [], 0
                for s, e in sorted(cuts):
                    if s > end or not masked:
                        masked += [text[end:s], "[secret]"]
                    end = max(end, e)
                left[d] = "".join(masked) + text[end:] if cuts else text
        if number < 4:
            assert {d: r.text for d, r in got.items()} == left, name
            assert all(r.n_chars == len(r.text) for r in got.values())
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS_FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {d: np.frombuffer(bytes(r.ids), "<u4").tolist() for d, r in got.items()} == {d: library.encode_ordinary(t) for d, t in left.items()}
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert whole == {d: r.ids_sha256 for d, r in got.items()}
