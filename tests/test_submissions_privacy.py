"""Edge rows of submissions and privacy."""

import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.functions.text import fold_digits, json_number, lenient_int, string_items, strip_space
from tallyfold.operators.constraints import audit_domains, judging_view
from tallyfold.operators.privacy import find_suspects, mask_pii, pseudonymise, restore, scan_pii
from tallyfold.operators.submissions import (
    active_entries,
    assign_refs,
    candidate_ref,
    decide_submissions,
    normalise_submissions,
    reidentify,
    signs_for,
    split_identity,
    triage,
)
from tallyfold.plans.flows import process_submissions
from tallyfold.schemas import DOMAINS

CLOSE = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
GOOD = '{"evidence": "5", "students": 1, "workPairs": 1}'
TEXT = "x" * 500


def test_decisions(spark):
    sec = dt.timedelta(seconds=1)
    rows = [
        ("ok", "u", "r", CLOSE, 0, TEXT, GOOD),
        ("no_length", "u", "r", CLOSE, None, TEXT, GOOD),
        ("anonymous", None, "r", CLOSE, 0, TEXT, GOOD),
        ("closed", "u", "shut", CLOSE, 0, TEXT, GOOD),
        ("no_round", "u", "other", CLOSE, 0, TEXT, GOOD),
        ("no_date", "u", "dateless", CLOSE, 0, TEXT, GOOD),
        ("bad_date", "u", "broken", CLOSE, 0, TEXT, GOOD),
        ("late_and_large", "u", "r", CLOSE + sec, 9_999_999, "", None),
        ("large_and_short", "u", "r", CLOSE, 4_613_735, "", None),
        ("at_limit", "u", "r", CLOSE, 4_613_734, TEXT, GOOD),
        ("blank_ends", "u", "r", CLOSE, 0, "﻿　 " + "x" * 499 + " \n", GOOD),
        ("null_html", "u", "r", CLOSE, 0, None, GOOD),
        ("no_stats", "u", "r", CLOSE, 0, TEXT, None),
        ("few", "u", "r", CLOSE, 0, TEXT, '{"evidence": 4, "students": 1, "workPairs": 1}'),
        ("words", "u", "r", CLOSE, 0, TEXT, '{"evidence": "many", "students": 1, "workPairs": 1}'),
        ("true", "u", "r", CLOSE, 0, TEXT, '{"evidence": 5.5, "students": true, "workPairs": " 1 "}'),
        ("nan", "u", "r", CLOSE, 0, TEXT, '{"evidence": "NaN", "students": 1, "workPairs": 1}'),
        ("bad_json", "u", "r", CLOSE, 0, TEXT, "{"),
    ]
    subs = spark.createDataFrame(
        rows,
        "name string, user_id string, round string, received_at timestamp, content_length long, html string, stats string",
    )
    rounds = spark.createDataFrame(
        [("r", True, "2024-06-01T00:00:00Z"), ("shut", False, "2024-06-01"), ("dateless", True, None), ("broken", True, "soon")],
        "round string, open boolean, closes_at string",
    )
    got = {r.name: r.decision for r in decide_submissions(subs, rounds).collect()}
    assert got == {
        "ok": "accepted", "no_length": "accepted", "anonymous": "unauthenticated", "closed": "not_open",
        "no_round": "not_open", "no_date": "not_open", "bad_date": "bad_close_date",
        "late_and_large": "late", "large_and_short": "too_large", "at_limit": "accepted",
        "blank_ends": "short", "null_html": "short", "no_stats": "stats", "few": "stats",
        "words": "stats", "true": "accepted", "nan": "stats", "bad_json": "stats",
    }


def test_coercions(spark):
    df = spark.createDataFrame(
        [(t,) for t in ["12abc", "abc", None, "-7", " +3 ", "99999999999"]], "x string"
    )
    assert [r[0] for r in df.select(lenient_int(F.col("x"))).collect()] == [12, 0, 0, -7, 3, 0]
    df = spark.createDataFrame(
        [(t,) for t in ['["a",1,null]', "{}", "{bad", None, '["b","c"]']], "x string"
    )
    assert [r[0] for r in df.select(string_items(F.col("x"))).collect()] == [["a"], [], [], [], ["b", "c"]]
    df = spark.createDataFrame([('{"n": ""}',), ('{"n": null}',), ('{"n": [1]}',), ("{}",)], "x string")
    assert [r[0] for r in df.select(json_number(F.col("x"), "$.n")).collect()] == [0.0, 0.0, None, None]
    df = spark.createDataFrame([("\u0085a ",), (" b﻿",)], "x string")
    assert [r[0] for r in df.select(strip_space(F.col("x"))).collect()] == ["\u0085a", "b"]


def submission(spark, rows):
    return spark.createDataFrame(
        rows,
        "user_id string, teacher struct<name:string,school:string,region:string,phone:string,email:string>, "
        "html string, replaced string, masked string, imageCount string, suspects string, stats string, "
        "appVersion string, received_at timestamp",
    )


def test_normalise(spark):
    subs = submission(
        spark,
        [
            ("u", ("5" * 300, None, "r", "0" * 50, ""), "h", "12abc", "abc", None, '["a",1,null]', None, "v" * 30, CLOSE),
            ("v", None, "h", "1", "2", "3", "{}", GOOD, None, CLOSE),
        ],
    )
    users = spark.createDataFrame([("u", "u@x.org"), ("v", None)], "id string, email string")
    u, v = sorted(normalise_submissions(subs, users).collect(), key=lambda r: r.user_id)
    assert (len(u.name), u.school, len(u.phone), u.email) == (200, "", 40, "u@x.org")
    assert (u.replaced, u.masked, u.image_count, u.suspects, u.stats) == (12, 0, 0, ["a"], "{}")
    assert len(u.app_version) == 20
    assert (v.name, v.email, v.suspects, v.app_version) == ("", "", [], "")


def test_scan_and_mask(spark):
    texts = {
        "inside": "no 9912345678901 here", "local": "call 0512345678", "plus": "+966512345678",
        "plain": "966512345678", "mail": "a.b-c@d.co", "no_dot": "a@localhost", "nothing": "clean",
        "arabic": "١٢٣٤٥٦٧٨٩٠", "none": None,
    }
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r.k: (r.has_national_id, r.has_mobile, r.has_email, r.has_any) for r in scan_pii(df, "t").collect()}
    assert got == {
        "inside": (True, False, False, True), "local": (False, True, False, True),
        "plus": (False, True, False, True), "plain": (False, True, False, True),
        "mail": (False, False, True, True), "no_dot": (False,) * 4, "nothing": (False,) * 4,
        "arabic": (False,) * 4, "none": (False,) * 4,
    }
    folded = {r.k: r.has_national_id for r in scan_pii(df, "t", fold_digits=True).collect()}
    assert folded["arabic"] and not folded["nothing"]
    masked = {r.k: (r.t, r.masked) for r in mask_pii(df, "t").collect()}
    assert masked["mail"] == ("***", 1) and masked["nothing"] == ("clean", 0)
    assert masked["inside"] == ("no 99***1 here", 1)
    assert spark.range(1).select(fold_digits(F.lit("٠٩"))).first()[0] == "09"


def test_triage(spark):
    entries = spark.createDataFrame(
        [("a", "clean", []), ("b", "id 1234567890", []), ("c", "clean", ["Ali"]), ("d", "clean", []), ("e", "clean", None)],
        "ref string, html string, suspects array<string>",
    )
    before = spark.createDataFrame(
        [("a", "judged"), ("b", "disqualified"), ("c", "received")], "ref string, status string"
    )
    got = {r.ref: (r.status, r.reset) for r in triage(entries, before).collect()}
    assert got == {
        "a": ("received", True), "b": ("needs_review", True), "c": ("needs_review", False),
        "d": ("received", False), "e": ("received", False),
    }


def test_refs_are_unique_and_repeatable(spark):
    users = spark.createDataFrame([(i,) for i in range(60)], "user_id long")
    held = spark.createDataFrame([(3, "KEEP"), (99, "AAA")], "user_id long, ref string")

    def numbers():
        return {r.user_id: (r.ref, r.reused) for r in assign_refs(users, held, signs=3, alphabet="ABCDE").collect()}

    got = numbers()
    assert got == numbers()
    assert len(got) == 60 and len({r for r, _ in got.values()}) == 60
    assert got[3] == ("KEEP", True) and "AAA" not in {r for r, _ in got.values()}
    with pytest.raises(ValueError):
        assign_refs(users, held, signs=2, alphabet="ABCDE")
    assert signs_for(1000) == 3 and signs_for(2**26) == 6
    ref = spark.range(1).select(candidate_ref(F.lit("u"), 0, prefix="AB-24-")).first()[0]
    assert re.fullmatch("AB-24-[A-HJ-NP-Z2-9]{6}", ref)


def test_split_and_judging_view(spark):
    subs = spark.createDataFrame(
        [("u", "R1", "Name", "html"), ("v", "R2", None, "more")],
        "user_id string, ref string, name string, html string",
    )
    split = split_identity(subs, ["user_id", "ref", "name"])
    assert set(split["entries"].columns) == {"ref", "html"}
    back = reidentify(split["entries"], split["entrants"]).select(*subs.columns)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, subs.collect()), key=repr)
    with pytest.raises(ValueError):
        split_identity(subs, ["user_id"])
    with pytest.raises(ValueError):
        judging_view(subs, ["ref", "name"])
    assert judging_view(split["entries"], ["ref", "html"]).columns == ["ref", "html"]


def test_active_entry(spark):
    subs = spark.createDataFrame([("u", 1, "a"), ("u", 3, "c"), ("u", 2, "b"), ("v", 1, "d")], "user_id string, submitted_at int, html string")
    assert sorted(r.html for r in active_entries(subs).collect()) == ["c", "d"]


def test_domains(spark):
    subs = spark.createDataFrame(
        [("u", "free", "t"), ("v", "odd", None), (None, None, "t")], "user_id string, status string, updated_at string"
    )
    bad = {r.user_id: sorted(r.reasons) for r in audit_domains(subs, DOMAINS["subscriptions"]).collect()}
    assert bad == {
        "v": ["status not allowed", "updated_at is null"],
        None: ["status is null", "user_id is null"],
    }


def pseudonyms(spark, docs, roster, **kw):
    d = spark.createDataFrame(docs, "doc long, owner string, text string")
    r = spark.createDataFrame(roster, "owner string, name string")
    done = pseudonymise(d, r, "owner", ["doc"], **kw)
    texts = {x.doc: (x.text, x.replaced) for x in done["docs"].collect()}
    back = {x.doc: x.text for x in restore(done["docs"], done["map"], "owner", ["doc"]).collect()}
    assert back == {k: t for k, _, t in docs}
    return texts


def test_pseudonyms(spark):
    docs = [
        (1, "t1", "Ali met Alia, Ali-Reza and ALI."),
        (2, "t1", "Sara Ali Hasan wrote to Sara, not to Sarah."),
        (3, "t2", "Ali here is another pupil; طالب 7 was here."),
        (4, "t2", "محمد يكتب ومحمد يقرأ، محمد!"),
        (5, "t3", "nobody listed"),
        (6, "t1", "Abu  Bakr and Abu Bakr (a+b)"),
    ]
    roster = [
        ("t1", "Ali"), ("t1", "Sara"), ("t1", "Sara Ali Hasan"), ("t1", "Ali"), ("t1", "Abu Bakr"), ("t1", "42"),
        ("t2", "Ali"), ("t2", " محمد "), ("t4", "unused"),
    ]
    got = pseudonyms(spark, docs, roster)
    # Codes follow name order: Abu Bakr 1, Ali 2, Sara 3, Sara Ali Hasan 4.
    assert got[1] == ("طالب 2 met Alia, طالب 2-Reza and ALI.", 2)
    assert got[2] == ("طالب 4 wrote to طالب 3, not to Sarah.", 2)
    # Owner t2 already has a code-like text numbered 7, so its codes start at 8.
    assert got[3] == ("طالب 8 here is another pupil; طالب 7 was here.", 1)
    assert got[4] == ("طالب 9 يكتب ومحمد يقرأ، طالب 9!", 2)
    assert got[5] == ("nobody listed", 0)
    assert got[6] == ("طالب 1 and طالب 1 (a+b)", 2)  # two blanks are no other name


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["Ali", "Sara", "طالب", "3", "Ali Sara", "-", "x"]), max_size=8), min_size=1, max_size=5))
def test_restore_inverts(spark, docs):
    rows = [(i, f"t{i % 2}", " ".join(d)) for i, d in enumerate(docs)]
    roster = [(o, n) for o in ("t0", "t1") for n in ("Ali", "Sara", "طالب", "Ali Sara")]
    pseudonyms(spark, rows, roster)


def test_suspects(spark):
    docs = spark.createDataFrame([(1, "Ali and Sara, Ali."), (2, "nobody")], "doc long, text string")
    names = spark.createDataFrame([("Ali",), ("Sara",), ("Omar",)], "name string")
    got = {r.doc: r.suspects for r in find_suspects(docs, names, ["doc"]).collect()}
    assert got == {1: ["Ali", "Sara"], 2: []}


def test_submission_flow(spark):
    teacher = ("T", "S", "R", "P", "")
    old = CLOSE - dt.timedelta(days=1)
    rows = [
        ("u", teacher, TEXT, "0", "0", "0", "[]", GOOD, "1", old),
        ("u", teacher, TEXT + " a@b.co", "0", "0", "0", "[]", GOOD, "1", CLOSE),
        ("v", teacher, TEXT, "0", "0", "0", '["Ali"]', GOOD, "1", CLOSE),
        ("w", teacher, "short", "0", "0", "0", "[]", GOOD, "1", CLOSE),
    ]
    subs = submission(spark, rows).withColumn("round", F.lit("r"))
    rounds = spark.createDataFrame([("r", True, "2024-06-01T00:00:00Z")], "round string, open boolean, closes_at string")
    users = spark.createDataFrame([("u", "u@x.org"), ("v", "v@x.org")], "id string, email string")
    existing = spark.createDataFrame([("v", "OLD")], "user_id string, ref string")
    previous = spark.createDataFrame([("OLD", "judged")], "ref string, status string")
    out = process_submissions(subs, rounds, users, existing, previous)
    entrants = {r.user_id: r for r in out["entrants"].collect()}
    assert set(entrants) == {"u", "v"} and entrants["v"].ref == "OLD" and entrants["u"].email == "u@x.org"
    entries = {r.ref: r for r in out["entries"].collect()}
    assert entries["OLD"].status == "needs_review" and entries[entrants["u"].ref].html.endswith("a@b.co")
    assert "user_id" not in out["entries"].columns
    assert {r.ref: r.reset for r in out["triaged"].collect()}["OLD"]
