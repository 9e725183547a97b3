"""Corpus operators against brute force on small fixtures, with nulls, empty texts, repeated rows and clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyfold.llm import bpe, decontaminate, grader, jaccard, language, passages, quality, secrets, token_files, url_filter
from tallyfold.llm.words import lower_ascii, split_words

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "a b c d e " * 30), (6, "x" * 5000), (None, "no id here")]


@pytest.fixture
def edges(spark):
    rows = [(i, t, "clash", 1) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, _text int")


def random_texts(seed, n=60, words=40):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 40)}" for _ in range(150)]
    out = []
    for i in range(n):
        own = []
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, 110)
            own += base[at : at + rnd.randint(5, words)] + [f"w{rnd.randint(0, 40)}" for _ in range(rnd.randint(0, 4))]
        out.append((i, " ".join(own)))
    return out


def test_url_verdicts_by_trie_and_by_join(spark):
    urls = ["http://A.net", "http://a.net/", "https://b.example.net/en/x?q", "https://b.example.net/english", "nothing", None,
            "http://example.com/de/1", "http://example.com/d", "x://org/fr/#", "http://notnet/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "example.net", "/en")]
    rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    trie = {r.page_id: tuple(r) for r in url_filter.judge_urls(pages, rules).collect()}
    join = {r.page_id: tuple(r) for r in url_filter.judge_urls(pages, rules, max_rules=0).collect()}
    assert trie == join
    assert [trie[i][3] for i in range(10)] == [None, "net/", "example.net/en/", "example.net/en", None, None, "example.com/de/", None, "org/fr/", None]
    assert url_filter.judge_urls(pages.limit(0), rules.limit(0)).count() == 0


def test_quality_counts(spark, edges):
    found = {r.doc_id: r for r in quality.measure_quality(edges).collect()}
    assert found[1].n_words == 0 and found[1].base_failed and not found[1].kept
    assert found[5].n_words == 150 and found[5].n_repeat_words == 150
    assert quality.keep_good(edges).columns == edges.columns
    for i, text in random_texts(1, 20) + [(99, "a#a\nb\na#a\n\n c$")]:
        row = quality.measure_quality(spark.createDataFrame([(i, text)], "doc_id long, text string")).first()
        words = split_words(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        counts = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if split_words(x)]
        assert tuple(row)[1:6] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_language_of_held_out_words(spark, edges):
    texts = [("en", "the house and the garden of the old man"), ("de", "das haus und der garten des alten mannes")] * 10
    train = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.learn(train)
    new = spark.createDataFrame([(1, "the man and the house"), (2, "der mann und das haus"), (3, "123 ²"), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(new, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert language.identify(edges, language.learn(train.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_forward_sum_is_that_of_all_segmentations():
    model = language.PieceModel(["x"], {"▁": (0.1,), "a": (0.2,), "b": (0.3,), "ab": (0.4,), "▁a": (0.5,)})

    def brute(rest):
        return 1.0 if not rest else sum(p[0] * brute(rest[len(k) :]) for k, p in model.table.items() if rest.startswith(k))

    for word, log in model.log_scores(["ab", "abab", "ba"]).items():
        assert np.isclose(np.exp(log[0]), brute("▁" + word))


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for case in range(100):
        sizes = rng.integers(0, 300, rng.integers(0, 6))
        n = int(sizes.sum())
        ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2 >> rng.choice(np.array([0, 3, 4, 20, 48, 60], np.uint64), n)
        ids[rng.random(n) < 0.6] = case % 2
        ends = np.cumsum(sizes)
        words, upto, _ = token_files.pack(ids, ends)
        assert (token_files.unpack(words) == ids).all()
        for a, b, first, last in zip([0, *upto[:-1]], upto, ends - sizes, ends, strict=True) if len(ends) else []:
            assert (token_files.unpack(words[a:b]) == ids[first:last]).all()


def test_token_files_are_in_order(spark, edges):
    rows = sorted((r.start, r.n_tokens) for r in token_files.tokenize(edges).collect())
    assert len(rows) == len(EDGES) and rows[0][0] == 0
    assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))


def test_secrets_like_the_plain_patterns(spark, edges):
    texts = ['x password = "abcdefg" AKIA' + "A1" * 9 + " deadbeef" * 4, "secret: token: abcdefgh", "api_key=ab0123456789abcdef0123456789", None, ""]
    found = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    pattern = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for row in found.collect():
        text = texts[row.doc_id] or ""
        assert row.n_assign == sum(len(m[1]) >= 6 for m in pattern.finditer(text))
        assert row.n_access == sum(len(m) >= 20 for m in re.findall("AKIA[A-Z0-9]+", text))
        assert row.n_hex == sum(len(m) >= 24 for m in re.findall("[0-9a-f]+", text))
    assert sorted(map(str, secrets.mask_secrets(edges).collect())) == sorted(map(str, edges.collect()))


@pytest.mark.parametrize("hot", [5_000, 3])
def test_passages_like_brute_force(spark, edges, hot, monkeypatch):
    monkeypatch.setattr(passages, "HOT_SEGMENTS", hot)
    rows, first, want = random_texts(3), {}, {}
    for doc, text in rows:
        words = split_words(text)
        gone = set()
        for i in range(len(words) - 19):
            if first.setdefault(tuple(words[i : i + 20]), (doc, i)) != (doc, i):
                gone |= set(range(i, i + 20))
        want[doc] = (len(words), len(gone))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in passages.remove_repeated(frame).collect()} == want
    assert passages.remove_repeated(edges).count() == len(EDGES)


def test_hot_anchors_send_no_words(spark, monkeypatch):
    monkeypatch.setattr(passages, "HOT_SEGMENTS", 20)
    sent, worded = [], passages._worded
    monkeypatch.setattr(passages, "_worded", lambda texts: sent.append(worded(texts)) or sent[-1])
    passage = " ".join(f"w{i}" for i in range(22))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.remove_repeated(frame).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(i, 22 * (i > 0)) for i in range(300)]
    heavy = sent[0].selectExpr("split(words, ' ') w").where("size(array_intersect(w, array('w0', 'w21'))) > 0").count()
    assert heavy <= 2 * 20


@pytest.mark.parametrize("hot", [5000, 0])
def test_repeated_rows_keep_their_passage(spark, hot, monkeypatch):
    monkeypatch.setattr(passages, "HOT_SEGMENTS", hot)
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, passage), (1, passage), (1, passage), (2, "before " + passage), (None, "x " * 25), (None, "x " * 25)]
    got = passages.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 25, 24)] * 2 + [(1, 30, 0)] * 3 + [(2, 31, 30)]


@pytest.mark.parametrize(("k", "percent", "limit"), [(3, 90, 3_000_000), (1, 80, 200)])
def test_components_like_brute_force(spark, edges, k, percent, limit, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    rows = [(i, t + (" z" if i % 3 else "")) for i, (_, t) in enumerate(random_texts(7, 25) * 2)]
    sets = {}
    for doc, text in rows:
        words = split_words(lower_ascii(text))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    group[b] = min(group[a], group[b])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_duplicates(frame, k=k, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in found} == group
    assert jaccard.near_duplicates(edges).count() == len(EDGES)


def test_wand_like_brute_force():
    rnd = random.Random(2)
    names = [f"t{i}" for i in range(50)]
    for _ in range(50):
        items = [(i, rnd.choices(names, k=rnd.randint(0, 12)), rnd.choices(names, k=3)) for i in range(rnd.randint(1, 60))]
        index = decontaminate.Index(items, Counter(t for _, q, a in items for t in set(q + a)), len(items), 10)
        terms, want = list({rnd.randint(1, len(index.postings)) for _ in range(20)}), Counter()
        for t in terms:
            want.update(dict(zip(index.postings[t - 1].items, index.postings[t - 1].weights, strict=True)))
        found = {i for b in range(index.n_blocks) for i, _ in index.search(terms, b, 0.4)}
        assert found == {i for i, s in want.items() if s >= 0.4 - decontaminate.SLACK}


def test_contained_items_are_found(spark, edges):
    item = "Which river runs through the old town of the valley? It is the long green river."
    docs = spark.createDataFrame([(1, "pad " * 300 + item + " more words"), (2, "pad " * 50), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, items).collect()] == [(1, 9)]
    assert decontaminate.drop_contaminated(docs, items).count() == 2
    assert decontaminate.find_contamination(edges, items.limit(0)).count() == 0


def test_grades_are_ordered(spark, edges):
    kinds = ["awful nasty text", "plain dull text", "lovely clear text"]
    docs = spark.createDataFrame([(i, kinds[i % 3]) for i in range(90)], "doc_id long, text string")
    model = grader.learn(docs, docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade")))
    graded = grader.grade_documents(docs, model).collect()
    means = [np.mean([r.expected_grade for r in graded if r.doc_id % 3 == g]) for g in range(3)]
    assert means[0] < means[1] < means[2] and np.all(np.diff(model.thresholds) > 0)
    assert grader.grade_documents(edges, model).count() == len(EDGES)


def test_bpe_like_the_library(spark, edges):
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS_FILE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rnd = bpe.Encoder(ranks), random.Random(1)
    for _ in range(500):
        text = "".join(rnd.choice(" \n\t \x85aAbé'sts12中🙂 .,'re  the ing") for _ in range(rnd.randint(0, 40)))
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and own.decode(ids) == text.encode()
        data, at = text.encode(), rnd.randint(0, 10)
        table = bpe.PrefixTable(own.vocabulary, data[:at])
        table.append(data[at:])
        assert table.last == bpe.PrefixTable(own.vocabulary, data).last
        table.edit(at // 2, min(3, max(len(data) - at // 2, 0)), b"new") if len(data) > at else None
        assert table.last == bpe.PrefixTable(own.vocabulary, table.data).last
    assert bpe.encode_table(edges).count() == len(EDGES)


def test_common_shingles_tie_no_unrelated_texts(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        words = [f"u{i}x{j}" for j in range(100)] + [f"common{rnd.randint(0, 60)}" for _ in range(8)]
        rows.append((i, " ".join(words)))
    rows.append((300, rows[7][1].replace("u7x50", "other")))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prepared = jaccard._prepared(frame.selectExpr("doc_id doc", "text"), 1, 80)
    ties = jaccard._cell_links(prepared.select("doc", "signatures")).collect()
    assert {(r.u, r.v) for r in ties} == {(300, 7)}
    found = jaccard.near_duplicates(frame, k=1).collect()
    assert {r.doc_id: r.component_id for r in found} == {**{i: i for i in range(300)}, 300: 7}


@pytest.mark.parametrize("percent", [60, 80])
def test_large_regions_stay_whole_and_small(spark, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", 400)
    rnd = random.Random(9)
    sets = {}
    for i in range(90):
        if i % 3:
            core = set(range(40))
            sets[i] = (core - set(rnd.sample(range(40), rnd.randint(0, 6)))) | {1000 * i + j for j in range(rnd.randint(0, 4))}
        else:
            sets[i] = {1000 * i + j for j in range(30)} | {1, 2}
    rows = [(0, i, np.array(sorted(s), "<u8").tobytes()) for i, s in sets.items()]
    members = spark.createDataFrame(rows, "region long, doc long, shingles binary")
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    group[b] = min(group[a], group[b])
    links = jaccard._region_links(members, percent).collect()
    found = {d: d for d in sets}
    for _ in sets:
        for r in links:
            found[r.u] = found[r.v] = min(found[r.u], found[r.v])
    assert found == group
