"""Sets of snapshots, tombstones, compacted stream state, names word by word, one exchange for bodies, outage edges."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyfold.operators.copies import find_copies
from tallyfold.operators.erasure import residuals, write_erasure
from tallyfold.operators.payments import activate, suppress_replays
from tallyfold.operators.privacy import pseudonymise, restore
from tallyfold.operators.refunds import extend_for_outage
from tallyfold.operators.state import latest_documents
from tallyfold.plans.flows import free_subscriptions
from tallyfold.sources.snapshots import MissingSet, manifests, read_set, superseded_sets, verify_set, write_set
from tallyfold.streaming import payments as stream_payments
from tallyfold.streaming.monitor import session_counts
from tallyfold.streaming.payments import activation, subscriptions_after

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def numbers(spark, n):
    return spark.range(n).withColumn("t", F.lit("x"))


def test_a_set_is_seen_whole_or_not_at_all(spark, tmp_path):
    base = str(tmp_path)
    with pytest.raises(MissingSet):
        read_set(spark, base)
    write_set({"a": numbers(spark, 3), "b": numbers(spark, 4)}, base, "20240101-000000")
    broken = numbers(spark, 9).withColumn("t", F.when(F.col("id") == 8, F.raise_error(F.lit("disk full"))).otherwise("y"))
    with pytest.raises(Exception, match="disk full"):
        write_set({"a": numbers(spark, 7), "b": broken}, base, "20240102-000000")
    assert {n: df.count() for n, df in read_set(spark, base).items()} == {"a": 3, "b": 4}
    # The same stamp again, after the failure.
    write_set({"a": numbers(spark, 7), "b": numbers(spark, 9)}, base, "20240102-000000")
    assert {n: df.count() for n, df in read_set(spark, base).items()} == {"a": 7, "b": 9}
    assert {n: df.count() for n, df in read_set(spark, base, "20240101-235959").items()} == {"a": 3, "b": 4}
    assert [r.expected == r.found for r in verify_set(spark, base).collect()] == [True, True]
    with pytest.raises(FileExistsError):
        write_set({"a": numbers(spark, 1)}, base, "20240101-000000")
    with pytest.raises(ValueError, match="at least one"):
        write_set({}, base, "20240103-000000")
    write_set({"a": numbers(spark, 0)}, base, "20240103-000000")
    assert read_set(spark, base)["a"].dtypes == numbers(spark, 0).dtypes and read_set(spark, base)["a"].count() == 0
    assert manifests(spark, base).count() == 5
    old = superseded_sets(spark, base, "2024-01-16 12:00:00").collect()
    assert {r.stamp for r in old} == {"20240101-000000"}
    assert superseded_sets(spark, base, "2030-01-01 00:00:00").where("stamp = '20240103-000000'").count() == 0


def test_tombstones_find_what_others_bring_back(spark, tmp_path):
    make = spark.createDataFrame
    tables = {
        "users": make([("a",), ("b",)], "id string"),
        "app_state": make([("a", "{}"), ("b", "{}")], "user_id string, state string"),
        "subscriptions": make([("a", "active"), ("b", "free")], "user_id string, status string"),
        "award_entrants": make([("a", "R1"), ("b", "R2")], "user_id string, ref string"),
        "award_entries": make([("R1", "x"), ("R2", "y")], "ref string, html string"),
    }
    requests = make([("a",), (None,)], "user_id string")
    for keep, base in ((False, f"{tmp_path}/all"), (True, f"{tmp_path}/kept")):
        write_erasure(tables, requests, base, "s1", keep_ledger=keep)
        after = read_set(spark, base)
        marks = after["tombstones"]
        assert sum(r.residual for r in residuals(after, marks).collect()) == 0
        assert after["subscriptions"].count() == 1 + keep
        again = {**after, "award_entries": after["award_entries"].unionByName(tables["award_entries"])}
        assert {r.table: r.residual for r in residuals(again, marks).collect() if r.residual} == {"award_entries": 1}
    assert residuals({"users": tables["users"]}, marks).count() == 1


def test_stream_state_is_compacted(spark, tmp_path, monkeypatch):
    base, every, users = f"{tmp_path}/state", 4, [f"u{i}" for i in range(5)]
    initial = free_subscriptions(spark.createDataFrame([(u,) for u in users], "id string"))
    read, plain = [], stream_payments.subscriptions_after

    def counted(*args, **more):
        state = plain(*args, **more)
        folders = {re.search(r"((?:batch|full)=\d+)/", f)[1] for f in state.inputFiles() if base in f}
        read.append((more.get("users") is not None or len(args) > 4, folders))
        return state

    monkeypatch.setattr(stream_payments, "subscriptions_after", counted)
    apply, rows = activation(base, initial, compact_every=every), []
    for n in range(14):
        batch = [(random.Random(n).choice(users), f"r{n}", T0 + dt.timedelta(days=n)), ("u0", f"s{n // 2}", T0 + dt.timedelta(days=n, hours=1))]
        rows += batch
        apply(spark.createDataFrame(batch, "user_id string, ref string, paid_at timestamp"), n)
        if n in (5, 8):
            apply(spark.createDataFrame(batch, "user_id string, ref string, paid_at timestamp"), n)  # a retry
    # A full state and the batches after it, and for a new full state the batch at hand.
    assert max(len(folders) for _, folders in read) <= every + 1
    assert any("full=11" in folders for _, folders in read) and all("batch=0" not in f for _, f in read[8:])
    paid = spark.createDataFrame(rows, "user_id string, ref string, paid_at timestamp")
    want = activate(initial, suppress_replays(paid, "last", order=("paid_at", "ref")))
    cols = ["user_id", "status", "expires_at", "provider_ref"]
    as_rows = lambda df: sorted(map(tuple, df.select(cols).collect()), key=repr)
    assert as_rows(plain(spark, base, initial)) == as_rows(want)
    some = spark.createDataFrame([("u0",), ("u4",)], "user_id string")
    assert as_rows(plain(spark, base, initial, None, some)) == as_rows(want.join(some, "user_id"))
    # What a writer has not finished is not read.
    (tmp_path / "state" / "full=99").mkdir()
    assert as_rows(plain(spark, base, initial)) == as_rows(want)


def replaced_plainly(text, names):
    """Left to right the longest name at a word, on words and gaps; (text, places) with numbers from 1 in name order."""
    pieces = re.findall(r"[^\W_]+|[\W_]+", text)
    lead = 1 if pieces and not pieces[0][0].isalnum() else 0
    ws = pieces[lead::2]
    out, i, n = pieces[:lead], 0, 0
    while i < len(ws):
        size = max((len(k) for k in names if tuple(ws[i : i + len(k)]) == k), default=0)
        if size:
            out.append(f"طالب {names[tuple(ws[i : i + size])]}")
            n, i = n + 1, i + size
        else:
            out.append(ws[i])
            i += 1
        out += pieces[lead + 2 * i - 1 : lead + 2 * i]
    return "".join(out), n


def test_names_match_word_by_word(spark):
    rnd = random.Random(11)
    names = {("Abu", "Bakr"): 1, ("Abu", "Bakr", "bin", "Ali", "Omar"): 2, ("Ali",): 3, ("Bakr", "bin"): 4, ("la", "la"): 5}
    roster = [("o", s) for s in ("Abu   Bakr", "Abu\nBakr", "Abu Bakr bin-Ali\tOmar", " Ali.", "Bakr, bin", "la la")]
    tokens = ["Abu", "Bakr", "bin", "Ali", "Omar", "la", "x"]
    gaps = [" ", "  ", "\n", ", ", "-", "\r\n\t", "... "]
    texts = ["".join(rnd.choice(tokens) + rnd.choice(gaps) for _ in range(rnd.randint(0, 30))) for _ in range(150)]
    texts = [rnd.choice(["", " ", "\n"]) + t for t in texts] + ["la " * 3000, "Abu\n\nBakr", "", "  ", None, "Abu Bakr"]
    docs = spark.createDataFrame([(i, "o", t, 1) for i, t in enumerate(texts)], "k int, owner string, text string, words int")
    done = pseudonymise(docs, spark.createDataFrame(roster, "owner string, name string"), "owner", ["k"])
    got = {r.k: (r.text, r.replaced) for r in done["docs"].collect()}
    for i, t in enumerate(texts):
        assert got[i] == ((None, 0) if t is None else replaced_plainly(t, names)), t
    back = {r.k: r.text for r in restore(done["docs"], done["map"], "owner", ["k"]).collect()}
    assert back == dict(enumerate(texts))
    # A text that was changed in between gets the names of the map.
    reply = done["docs"].where("k = 151").withColumn("text", F.concat(F.lit("Dear "), "text", F.lit(" and طالب 3; طالب 99")))
    assert restore(reply, done["map"], "owner", ["k"]).first().text.endswith("Bakr and Ali; طالب 99")


def exchanges(df):
    """What each shuffle of the executed plan moves: its output columns."""
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if node.nodeName() in ("Exchange", "BroadcastExchange"):
            found.append(str(node.output().mkString(",")))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.initialPlan())

    walk(plan)
    return found


def test_a_latest_body_moves_once(spark):
    rows = spark.range(1000).selectExpr("id % 3 user_id", "timestamp_seconds(id) ts", "repeat('x', 50) state")
    df = latest_documents(rows)
    assert len(exchanges(df)) == 1 and df.count() == 3


def test_copies_shuffle_no_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("tallyfold.operators.copies.stored", lambda df, name: seen.append(df) or df)
    texts = [(i, " ".join(f"w{(i * j) % 13}" for j in range(30))) for i in range(12)]
    entries = spark.createDataFrame([*texts, (99, texts[3][1])], "key int, body string").repartition(3)
    entries = spark.createDataFrame(entries.collect(), entries.schema)
    found = find_copies(entries, "key", "body")
    moved = [e for df in (*seen, found["near"], found["exact"]) for e in exchanges(df)]
    assert moved and not any("body" in e for e in moved)
    assert [(r.key, r.original) for r in found["exact"].collect()] == [(99, 3)] and found["near"].where("key = 99").count() == 0


def test_session_parts_are_merged_before_the_shuffle(spark, tmp_path):
    """Of a user with very many arrivals each map task sends one partial session."""
    from tallyfold.session import tune

    tune(spark)
    rows = [("hot", T0 + dt.timedelta(seconds=i)) for i in range(2000)] + [(f"u{i}", T0 + dt.timedelta(hours=i)) for i in range(9)]
    rows.append(("last", T0 + dt.timedelta(days=9)))
    spark.createDataFrame(rows, "user string, received_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user string, received_at timestamp").parquet(f"{tmp_path}/in")
    running = (
        session_counts(stream, "user").writeStream.format("memory").queryName("sessions").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert spark.table("sessions").where("user = 'hot'").first().n == 2000
    assert [p for p in (running._jsq.explainInternal(False),) if p.count("MergingSessions") >= 2]
    running.stop()


def test_outages_by_edges(spark, hot):
    rnd = random.Random(2)
    moment = lambda d: T0 + dt.timedelta(days=d)
    found = [("s", moment(10 * i), moment(10 * i + 8 + i % 2)) for i in range(12)] + [("t", moment(3), moment(20)), ("t", moment(5), moment(15))]
    ms = lambda d: None if d is None else int(moment(d).timestamp() * 1000)
    subs = [(i, rnd.choice(["s", "s", "t", "none"]), rnd.choice([None, *range(130)]), rnd.choice([None, *range(130)])) for i in range(200)]
    subs = [*subs, subs[0], subs[0]]
    frame = spark.createDataFrame([(i, k, ms(a), ms(b)) for i, k, a, b in subs], "id int, service string, starts_ms long, expires_ms long")
    outages = spark.createDataFrame(found, "service string, started_at timestamp, ended_at timestamp")

    def plain(k, a, b):
        low, high = -(10**15) if a is None else ms(a), 10**15 if b is None else ms(b)
        parts = [(int(x.timestamp() * 1000), int(y.timestamp() * 1000)) for s, x, y in found if s == k]
        return sum(max(min(y, high) - max(x, low), 0) for x, y in parts)

    want = sorted((i, plain(k, a, b)) for i, k, a, b in subs)
    for limit in (1000, 7):
        with hot(limit):
            assert sorted((r.id, r.extension_ms) for r in extend_for_outage(frame, outages).collect()) == want


def test_the_new_queries_are_registered():
    assert {"s5_snapshot_sets", "x1_erase_as_set", "x2_erasure_audit", "a8_pseudonymise_names"} <= set(entry.oracle_sql())
