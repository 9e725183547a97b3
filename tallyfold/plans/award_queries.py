"""Submissions, privacy and judging over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.copies import exact_copies, find_copies, passage_origins
from ..operators.judging import (
    award_deadlines,
    award_prizes,
    best_per_person,
    contact_key,
    disqualify,
    eligible_suggestions,
    rank_entries,
    reward_payouts,
    weighted_scores,
)
from ..operators.privacy import find_suspects, mask_pii, pseudonymise, restore, scan_pii
from ..operators.submissions import (
    ALPHABET,
    active_entries,
    assign_refs,
    decide_submissions,
    entry_summary,
    normalise_submissions,
    reidentify,
    split_identity,
    triage,
)
from ..session import stored
from .flows import process_submissions
from .registry import Tables, query

SPACE_RE2 = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WORD_RE2 = r"[\p{L}\p{M}\p{N}]"
ID_RE, MOBILE_RE, EMAIL_RE = r"[12][0-9]{9}", r"(?:\+?966|0)5[0-9]{8}", r"[\w.\-]+@[\w.\-]+\.\w{2,}"
ANY_RE = f"(?:{ID_RE})|(?:{MOBILE_RE})|(?:{EMAIL_RE})"


def page_submissions(t: Tables) -> DataFrame:
    """Pages as submissions, one per hour, each by its own user."""
    received = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 3600)
    stats = F.to_json(
        F.struct(
            (F.col("page_id") % 12).alias("evidence"),
            (F.col("page_id") % 3).cast("string").alias("students"),
            (F.col("page_id") % 2 == 1).alias("workPairs"),
        )
    )
    return t.pages.select(
        F.col("page_id").alias("user_id"),
        F.when(F.col("url").contains("?"), "second").otherwise("first").alias("round"),
        received.alias("received_at"),
        "html",
        stats.alias("stats"),
    )


def award_rounds(t: Tables) -> DataFrame:
    closes = "2024-01-06 00:00:00"
    return t.spark.createDataFrame(
        [("first", True, closes), ("second", True, closes)],
        "round string, open boolean, closes_at string",
    )


DECIDE_SQL = rf"""select page_id as user_id, case
         when timestamp '2024-01-01 00:00:00' + to_hours(page_id) > timestamp '2024-01-06 00:00:00' then 'late'
         when octet_length(encode(html)) > 8000 then 'too_large'
         when length(regexp_replace(html, '^{SPACE_RE2}+|{SPACE_RE2}+$', '', 'g')) < 1200 then 'short'
         when not (page_id % 12 >= 5 and page_id % 3 >= 1 and page_id % 2 >= 1) then 'stats'
         else 'accepted' end as decision
       from pages"""


@query("a1_decide_submissions", DECIDE_SQL)
def a1(t: Tables) -> DataFrame:
    decided = decide_submissions(page_submissions(t), award_rounds(t), max_bytes=8000, min_chars=1200)
    return decided.select("user_id", "decision")


@query(
    "a2_normalise_submissions",
    r"""select 'c' || conv_id as user_id, turn as replaced,
              coalesce(try_cast(regexp_extract(text, '^\s*([+-]?[0-9]+)', 1) as integer), 0) as masked,
              -cast(turn as integer) as image_count, md5(substring(text, 1, 200)) as name, role as school,
              substring(text, 1, 40) as phone, 'c' || conv_id || '@example.org' as email,
              role || ';' || substring(text, 1, 5) as suspects, substring(text, 1, 20) as app_version
       from (select conv_id, cast(turn as integer) as turn, role, text from conversations)""",
)
def a2(t: Tables) -> DataFrame:
    user = F.concat(F.lit("c"), F.col("conv_id"))
    cut = F.substring("text", 1, 5)
    subs = t.conversations.select(
        user.alias("user_id"),
        F.struct(
            F.col("text").alias("name"),
            F.col("role").alias("school"),
            F.lit(None).cast("string").alias("region"),
            F.col("text").alias("phone"),
            F.lit("").alias("email"),
        ).alias("teacher"),
        F.col("text").alias("html"),
        F.concat(F.lit(" "), F.col("turn"), F.col("text")).alias("replaced"),
        F.col("text").alias("masked"),
        F.concat(F.lit("-"), F.col("turn"), F.lit("px")).alias("imageCount"),
        F.to_json(F.array(F.to_json(F.struct("role")))).alias("_ignored"),
        F.concat(
            F.lit("["), F.to_json(F.array("role")).substr(F.lit(2), F.length("role") + 2),
            F.lit(",7,null,true,"), F.to_json(F.array(cut)).substr(F.lit(2), F.length(F.to_json(F.array(cut)))),
        ).alias("suspects"),
        F.lit(None).cast("string").alias("stats"),
        F.col("text").alias("appVersion"),
        F.lit(None).cast("timestamp").alias("received_at"),
    ).drop("_ignored")
    users = (
        t.conversations.select(user.alias("id"))
        .distinct()
        .withColumn("email", F.concat("id", F.lit("@example.org")))
    )
    return normalise_submissions(subs, users).select(
        "user_id", "replaced", "masked", "image_count", F.md5("name").alias("name"), "school",
        "phone", "email", F.array_join("suspects", ";").alias("suspects"), "app_version",
    )


def _scan_sql(table: str, key: str, text: str) -> str:
    return rf"""select {key}, regexp_matches({text}, '{ID_RE}') as has_national_id,
              regexp_matches({text}, '{MOBILE_RE}') as has_mobile,
              regexp_matches({text}, '{EMAIL_RE}') as has_email,
              regexp_matches({text}, '{ANY_RE}') as has_any
       from {table}"""


@query("a3_scan_pii", _scan_sql("documents", "doc_id", "text"))
def a3(t: Tables) -> DataFrame:
    return scan_pii(t.documents.select("doc_id", "text"), "text").drop("text")


@query("a3_scan_pii_pages", _scan_sql("pages", "page_id", "html"))
def a3_pages(t: Tables) -> DataFrame:
    return scan_pii(t.pages.select("page_id", "html"), "html").drop("html")


@query(
    "a3_scan_pii_folded",
    _scan_sql(
        "(select conv_id, turn, translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789') as text from conversations)",
        "conv_id, turn",
        "text",
    ),
)
def a3_folded(t: Tables) -> DataFrame:
    return scan_pii(t.conversations, "text", fold_digits=True).drop("text", "role")


def review_entries(t: Tables) -> DataFrame:
    """Documents as entries; a toxic label counts as a suspect name."""
    entries = t.documents.join(t.labels, "doc_id", "left")
    suspects = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(
        F.array().cast("array<string>")
    )
    return entries.select(
        F.col("doc_id").alias("ref"), F.col("text").alias("html"), "n_chars", suspects.alias("suspects")
    )


def reviewed_before(t: Tables) -> DataFrame:
    status = F.when(F.col("quality") == 1, "judged").otherwise("received")
    return t.labels.select(F.col("doc_id").alias("ref"), status.alias("status"))


TRIAGE_SQL = rf"""select d.doc_id as ref,
         case when toxic = 1 or regexp_matches(text, '{ANY_RE}') then 'needs_review' else 'received' end as status,
         coalesce(quality = 1, false) as reset
       from documents d left join labels l on l.doc_id = d.doc_id"""


@query("a4_triage", TRIAGE_SQL)
def a4(t: Tables) -> DataFrame:
    done = triage(review_entries(t), reviewed_before(t))
    return done.select("ref", "status", "reset")


# The SQL twin of assign_refs: eight hash signs per user and turn, cut to the needed number, and
# four turns of "smallest user keeps a free number".
_SIGNS = " || ".join(
    f"substr('{ALPHABET}', cast('0x' || substr(h, {2 * k + 1}, 2) as integer) % 32 + 1, 1)"
    for k in range(8)
)


def _refs_sql(turns: int = 4) -> str:
    parts = [
        "with need as (select 6 as signs)",
        "held as (select doc_id as user_id, 'EARLIER-' || doc_id as ref from labels)",
        "w0 as (select doc_id as user_id from documents where doc_id not in (select user_id from held))",
    ]
    taken = "select ref from held"
    for k in range(turns):
        parts.append(
            f"t{k} as (select user_id, left({_SIGNS}, signs) as ref from "
            f"(select user_id, md5(user_id || '|' || {k}) as h from w{k}), need)"
        )
        parts.append(
            f"g{k} as (select min(user_id) as user_id, ref from t{k} where ref not in ({taken}) group by ref)"
        )
        parts.append(
            f"w{k + 1} as (select user_id from w{k} where user_id not in (select user_id from g{k}))"
        )
        taken += f" union all select ref from g{k}"
    all_new = " union all ".join(f"select user_id, ref, false as reused from g{k}" for k in range(turns))
    return ", ".join(parts) + f" select user_id, ref, true as reused from held union all {all_new}"


@query("a5_assign_refs", _refs_sql())
def a5(t: Tables) -> DataFrame:
    users = t.documents.select(F.col("doc_id").alias("user_id"))
    earlier = t.labels.select(
        F.col("doc_id").alias("user_id"), F.concat(F.lit("EARLIER-"), F.col("doc_id")).alias("ref")
    )
    return assign_refs(users, earlier)


def document_submissions(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("user_id"),
        F.md5(F.col("doc_id").cast("string")).alias("ref"),
        F.col("source").alias("school"),
        F.col("text").alias("html"),
        "n_chars",
    )


@query(
    "a6_split_identity",
    """select doc_id as user_id, md5(cast(doc_id as varchar)) as ref, source as school,
              md5(text) as digest, n_chars, 3 as identity_columns, 3 as content_columns
       from documents""",
)
def a6(t: Tables) -> DataFrame:
    split = split_identity(document_submissions(t), ["user_id", "ref", "school"])
    back = reidentify(split["entries"], split["entrants"])
    return back.select(
        "user_id", "ref", "school", F.md5("html").alias("digest"), "n_chars",
        F.lit(len(split["entrants"].columns)).alias("identity_columns"),
        F.lit(len(split["entries"].columns)).alias("content_columns"),
    )


@query(
    "a7_active_entries",
    """select source as user_id, max(doc_id) as doc_id, arg_max(md5(text), doc_id) as digest
       from documents group by source""",
)
def a7(t: Tables) -> DataFrame:
    subs = t.documents.withColumnRenamed("source", "user_id")
    latest = active_entries(subs, order=("doc_id",))
    return latest.select("user_id", "doc_id", F.md5("text").alias("digest"))


def conversation_roster(t: Tables) -> DataFrame:
    """The five most used words of at least five letters per conversation, as a roster table."""
    tokens = t.conversations.select("conv_id", F.explode(words(F.col("text"))).alias("name"))
    used = (
        tokens.where((F.length("name") >= 5) & F.col("name").rlike(r"\p{L}"))
        .groupBy("conv_id", "name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = Window.partitionBy("conv_id").orderBy(F.desc("n"), "name")
    top = used.withColumn("rn", F.row_number().over(best)).where("rn <= 5")
    return stored(top.select("conv_id", "name"), "roster")


ROSTER_SQL = rf"""tok as (select conv_id, unnest(regexp_extract_all(text, '{WORD_RE2}+')) as name from conversations),
used as (select conv_id, name, count(*) as n from tok
         where length(name) >= 5 and regexp_matches(name, '\p{{L}}') group by 1, 2),
roster as (select conv_id, name from used
           qualify row_number() over (partition by conv_id order by n desc, name) <= 5),
codes as (select conv_id, name, row_number() over (partition by conv_id order by name) as number from roster),
piece as (select conv_id, turn, unnest(p) as piece, generate_subscripts(p, 1) as pos
          from (select conv_id, turn, regexp_extract_all(text, '{WORD_RE2}+|[^\p{{L}}\p{{M}}\p{{N}}]+') as p
                from conversations))"""


@query(
    "a8_pseudonymise",
    f"""with {ROSTER_SQL}
select p.conv_id, p.turn, cast(count(c.number) as integer) as replaced,
       md5(string_agg(case when c.number is null then piece else 'طالب ' || c.number end, '' order by pos)) as digest
from piece p left join codes c on c.conv_id = p.conv_id and c.name = piece
group by 1, 2""",
)
def a8(t: Tables) -> DataFrame:
    done = pseudonymise(t.conversations, conversation_roster(t), "conv_id", ["conv_id", "turn"], longest=1)
    return done["docs"].select("conv_id", "turn", "replaced", F.md5("text").alias("digest"))


@query("a8_restore", "select conv_id, turn, md5(text) as digest from conversations")
def a8_restore(t: Tables) -> DataFrame:
    key = ["conv_id", "turn"]
    done = pseudonymise(t.conversations, conversation_roster(t), "conv_id", key, longest=1)
    back = restore(done["docs"], done["map"], "conv_id", key)
    return back.select("conv_id", "turn", F.md5("text").alias("digest"))


def phrase_roster(t: Tables) -> DataFrame:
    """Names of one to five words per conversation, cut out of its turns, with two blanks between their words."""
    first = t.conversations.select("conv_id", "turn", words(F.col("text")).alias("w"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.slice("w", 5 * n + 1, n))
    names = first.select("conv_id", F.explode(F.filter(cut, lambda c: F.size(c) > 0)).alias("c"))
    named = names.where(F.array_join("c", " ").rlike(r"\p{L}"))
    return stored(named.select("conv_id", F.array_join("c", "  ").alias("name")).distinct(), "phrase-roster")


NAMES_SQL = rf"""turns as (select conv_id, turn, text, regexp_extract_all(text, '{WORD_RE2}+') as w,
                 regexp_extract_all(text, '{WORD_RE2}+|[^\p{{L}}\p{{M}}\p{{N}}]+') as p from conversations),
cuts as (select conv_id, w[5 * n + 1 : 5 * n + n] as c from turns, (select unnest([1, 2, 3, 4, 5]) as n)),
roster as (select distinct conv_id, list_aggregate(c, 'string_agg', '  ') as name, list_aggregate(c, 'string_agg', ' ') as words from cuts
           where len(c) > 0 and regexp_matches(list_aggregate(c, 'string_agg', ' '), '\p{{L}}')),
codes as (select conv_id, words, row_number() over (partition by conv_id order by name, words) as number,
                 len(string_split(words, ' ')) as n from roster),
spots as (select conv_id, turn, w, unnest(range(0, len(w))) as i from turns),
hits as (select a.conv_id, a.turn, i, max_by([i, n, number], n) as h from spots a join codes c
         on c.conv_id = a.conv_id and list_aggregate(a.w[i + 1 : i + n], 'string_agg', ' ') = c.words and i + n <= len(w) group by 1, 2, 3),
kept as (select conv_id, turn, list_reduce(list(h order by i),
           lambda x, y: case when y[1] >= x[len(x) - 2] + x[len(x) - 1] then list_concat(x, y) else x end) as k from hits group by 1, 2),
steps as (select conv_id, turn, unnest(range(0, len(k) // 3)) as j, k from kept),
gone as (select conv_id, turn, k[3 * j + 1] as i, k[3 * j + 2] as n, k[3 * j + 3] as number from steps),
piece as (select conv_id, turn, unnest(p) as piece, generate_subscripts(p, 1) as pos,
                 case when regexp_matches(p[1], '^{WORD_RE2}') then 0 else 1 end as lead from turns),
place as (select *, pos - 1 - lead as q from piece)"""


@query(
    "a8_pseudonymise_names",
    f"""with {NAMES_SQL}
select c.conv_id, c.turn, cast(coalesce((select len(k) // 3 from kept k where k.conv_id = c.conv_id and k.turn = c.turn), 0) as integer) as replaced,
       md5(coalesce(string_agg(case when g.i is null then piece when q = 2 * g.i then 'طالب ' || g.number else '' end, '' order by pos), '')) as digest
from conversations c left join place p on p.conv_id = c.conv_id and p.turn = c.turn
left join gone g on g.conv_id = p.conv_id and g.turn = p.turn and q >= 2 * g.i and q <= 2 * (g.i + g.n) - 2
group by 1, 2""",
)
def a8_names(t: Tables) -> DataFrame:
    done = pseudonymise(t.conversations, phrase_roster(t), "conv_id", ["conv_id", "turn"])
    return done["docs"].select("conv_id", "turn", "replaced", F.md5("text").alias("digest"))


@query("a8_restore_names", "select conv_id, turn, md5(text) as digest from conversations")
def a8_restore_names(t: Tables) -> DataFrame:
    key = ["conv_id", "turn"]
    done = pseudonymise(t.conversations, phrase_roster(t), "conv_id", key)
    return restore(done["docs"], done["map"], "conv_id", key).select(*key, F.md5("text").alias("digest"))


@query(
    "a9_mask_pii",
    rf"""select doc_id, cast(len(regexp_extract_all(text, '{ANY_RE}')) as integer) as masked,
              md5(regexp_replace(text, '{ANY_RE}', '***', 'g')) as digest from documents""",
)
def a9(t: Tables) -> DataFrame:
    return mask_pii(t.documents, "text").select("doc_id", "masked", F.md5("text").alias("digest"))


@query(
    "a10_find_suspects",
    rf"""with names as (select distinct name from (
           select unnest(regexp_extract_all(text, '{WORD_RE2}+')) as name from benchmark) where length(name) >= 5),
     tok as (select distinct conv_id, turn, unnest(regexp_extract_all(text, '{WORD_RE2}+')) as name from conversations),
     hit as (select conv_id, turn, count(*) as n, string_agg(name, ';' order by name) as suspects
             from tok join names using (name) group by 1, 2)
select c.conv_id, c.turn, cast(coalesce(n, 0) as integer) as n, coalesce(suspects, '') as suspects
from conversations c left join hit using (conv_id, turn)""",
)
def a10(t: Tables) -> DataFrame:
    names = t.benchmark.select(F.explode(words(F.col("text"))).alias("name")).where(F.length("name") >= 5)
    found = find_suspects(t.conversations, names, ["conv_id", "turn"])
    return found.select(
        "conv_id", "turn", F.size("suspects").alias("n"), F.array_join("suspects", ";").alias("suspects")
    )


@query(
    "a11_entry_summary",
    rf"""select case when toxic = 1 or regexp_matches(text, '{ANY_RE}') then 'needs_review' else 'received' end as status,
              count(*) as entries, cast(sum(n_chars) as bigint) as replaced,
              cast(sum(len(regexp_extract_all(text, '{ANY_RE}'))) as bigint) as masked,
              cast(sum(n_chars % 7) as bigint) as images,
              count(*) filter (toxic = 1) as with_suspects
       from documents d left join labels l on l.doc_id = d.doc_id group by 1""",
)
def a11(t: Tables) -> DataFrame:
    done = triage(review_entries(t), reviewed_before(t))
    counted = mask_pii(done, "html").withColumns(
        {"replaced": F.col("n_chars"), "image_count": F.col("n_chars") % 7}
    )
    return entry_summary(counted)


def part_scores(t: Tables, round_column: Column) -> DataFrame:
    """Four derived scores per part, one row per criterion."""
    score = {
        "evidence": F.col("p_size") % 10,
        "quality": F.col("p_partkey") % 10,
        "impact": F.col("p_partkey") % 7,
        "layout": F.col("p_size") % 5,
    }
    each = F.array(
        *[F.struct(F.lit(c).alias("criterion"), v.cast("int").alias("score")) for c, v in score.items()]
    )
    rows = t.part.select(
        round_column.alias("round"), F.col("p_partkey").alias("ref"), F.explode(each).alias("s")
    )
    return rows.select("round", "ref", "s.*")


SCORE_SQL = """scored as (
  select p_brand, p_type, p_partkey as ref, p_partkey % 7 as impact,
         (30 * (p_size % 10) + 30 * (p_partkey % 10) + 25 * (p_partkey % 7) + 15 * (p_size % 5)) / 100.0 as score
  from part)"""


@query(
    "j1_weighted_scores",
    f"""with {SCORE_SQL}
select p_brand as round, ref, cast(score as double) as score, cast(impact as bigint) as impact, true as complete from scored""",
)
def j1(t: Tables) -> DataFrame:
    scored = weighted_scores(part_scores(t, F.col("p_brand")))
    return scored.withColumn("score", F.col("score").cast("double"))


@query(
    "j2_rank_entries",
    f"""with {SCORE_SQL}
select p_brand as round, ref,
       row_number() over (partition by p_brand order by score desc, impact desc, ref) as place from scored""",
)
def j2(t: Tables) -> DataFrame:
    scored = weighted_scores(part_scores(t, F.col("p_brand")))
    return rank_entries(scored).select("round", "ref", "place")


@query(
    "j3_award_prizes",
    f"""with {SCORE_SQL},
best as (select * from scored qualify row_number() over (partition by p_type order by score desc, impact desc, ref) = 1),
ranked as (select *, row_number() over (order by score desc, impact desc, ref) as place from best)
select p_type as user_id, ref, place,
       cast(case place when 1 then 15000 when 2 then 10000 when 3 then 5000 else 2500 end as bigint) as prize
from ranked where place <= 5""",
)
def j3(t: Tables) -> DataFrame:
    scored = weighted_scores(part_scores(t, F.lit("all")))
    entrants = t.part.select(F.col("p_partkey").alias("ref"), F.col("p_type").alias("user_id"))
    ranked = rank_entries(best_per_person(scored, entrants), top=5)
    return award_prizes(ranked).select("user_id", "ref", "place", "prize")


@query(
    "j4_disqualify",
    r"""with acc as (
  select c_custkey as user_id, regexp_replace(lower(cast(c_nationkey as varchar)), '[^\p{L}\p{N}@]+', '', 'g') || '|' ||
         regexp_replace(lower(c_mktsegment), '[^\p{L}\p{N}@]+', '', 'g') || '|' ||
         regexp_replace(cast(cast(floor(c_acctbal / 100) as bigint) as varchar), '[^\p{L}\p{N}@]+', '', 'g') as contact
  from customer),
shared as (select contact from acc group by 1 having count(distinct user_id) > 1),
late as (select o_custkey from orders where o_orderstatus = 'O'
         group by 1 having date_diff('day', cast(min(o_orderdate) as date), cast(max(o_orderdate) as date)) > 7),
judged as (
  select c_custkey as user_id, 'R' || c_custkey as ref, concat_ws(';',
    case when contact in (select contact from shared) then 'several accounts' end,
    case when c_custkey in (select o_custkey from late) then 'details not corrected' end,
    case when c_acctbal < 0 then 'staff' end) as reasons
  from customer join acc on user_id = c_custkey)
select * from judged where reasons <> ''""",
)
def j4(t: Tables) -> DataFrame:
    entries = t.customer.select(
        F.col("c_custkey").alias("user_id"), F.concat(F.lit("R"), F.col("c_custkey")).alias("ref")
    )
    contact = contact_key(
        F.col("c_nationkey"), F.col("c_mktsegment"), F.floor(F.col("c_acctbal") / 100)
    )
    accounts = t.customer.select(F.col("c_custkey").alias("user_id"), contact.alias("contact"))
    notices = (
        t.orders.where(F.col("o_orderstatus") == "O")
        .groupBy(F.concat(F.lit("R"), F.col("o_custkey")).alias("ref"))
        .agg(F.min("o_orderdate").alias("notified_at"), F.max("o_orderdate").alias("corrected_at"))
    )
    blocked = t.customer.where("c_acctbal < 0").select(
        F.col("c_custkey").alias("user_id"), F.lit("staff").alias("reason")
    )
    out = disqualify(entries, accounts, notices, blocked, F.lit("2002-01-01").cast("date"))
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query(
    "j5_exact_copies",
    """select doc_id, original from (
         select doc_id, min(doc_id) over (partition by sha256(text)) as original from documents)
       where doc_id <> original""",
)
def j5_exact(t: Tables) -> DataFrame:
    return exact_copies(t.documents, "doc_id", "text")


PASSAGES_SQL = rf"""uniq as (select min(doc_id) as doc_id, arg_min(text, doc_id) as text from documents group by sha256(text)),
w as (select doc_id, regexp_extract_all(lower(text), '{WORD_RE2}+') as ws from uniq),
p as (select distinct doc_id, md5(array_to_string(ws[i:i + 7], ' ')) as passage
      from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 7, 1))) as i from w where len(ws) > 0)),
o as (select passage, min(doc_id) as owner from p group by 1),
taken as (select p.doc_id, owner, count(*) as shared from p join o using (passage) where owner <> p.doc_id group by 1, 2),
best as (select doc_id, cast(sum(shared) as bigint) as copied, max(shared) as from_source from taken group by 1),
src as (select doc_id, owner as source from taken
        qualify row_number() over (partition by doc_id order by shared desc, owner) = 1),
sizes as (select u.doc_id, count(passage) as passages from uniq u left join p on p.doc_id = u.doc_id group by 1)"""


@query(
    "j5_passage_origins",
    f"""with {PASSAGES_SQL}
select s.doc_id, passages, coalesce(copied, 0) as copied, coalesce(source, -1) as source,
       coalesce(from_source, 0) as from_source
from sizes s left join best using (doc_id) left join src using (doc_id)""",
)
def j5_near(t: Tables) -> DataFrame:
    origins = passage_origins(t.documents, "doc_id", "text")
    return origins.withColumn("source", F.coalesce("source", F.lit(-1).cast("long")))


@query(
    "j4_disqualify_copies",
    f"""with {PASSAGES_SQL},
copies as (
  select doc_id from (select doc_id, min(doc_id) over (partition by sha256(text)) as first from documents) where doc_id <> first
  union select doc_id from sizes join best using (doc_id) where copied >= passages * 0.5),
judged as (
  select doc_id as user_id, cast(doc_id as varchar) as ref, concat_ws(';',
    case when doc_id % 10 = 0 and date '2024-01-01' + cast(doc_id % 13 as integer)
              > least(date '2024-01-01' + 7, date '2024-01-06' + cast(doc_id % 3 as integer)) then 'details not corrected' end,
    case when doc_id % 50 = 7 then 'relative' end,
    case when doc_id in (select doc_id from copies) then 'copied work' end) as reasons
  from documents)
select * from judged where reasons <> ''""",
)
def j4_copies(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    entries = docs.select(F.col("doc_id").alias("user_id"), F.col("doc_id").cast("string").alias("ref"))
    found = find_copies(docs, "doc_id", "text")
    copied = found["exact"].select("doc_id").unionByName(found["near"].select("doc_id"))
    start = F.lit("2024-01-01").cast("date")
    closes = F.date_add(F.lit("2024-01-06").cast("date"), (F.col("ref").cast("long") % 3).cast("int"))
    notices = docs.where("doc_id % 10 = 0").select(
        F.col("doc_id").cast("string").alias("ref"),
        start.alias("notified_at"),
        F.date_add(start, (F.col("doc_id") % 13).cast("int")).alias("corrected_at"),
    )
    nobody = docs.select(F.col("doc_id").alias("user_id"), F.col("doc_id").cast("string").alias("contact"))
    blocked = docs.where("doc_id % 50 = 7").select(F.col("doc_id").alias("user_id"), F.lit("relative").alias("reason"))
    out = disqualify(
        entries, nobody, notices, blocked, F.lit("2024-02-01").cast("date"), closes=closes,
        copied=copied.select(F.col("doc_id").cast("string").alias("ref")),
    )
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query(
    "j6_award_deadlines",
    """with c as (
  select o_orderkey as ref, o_orderpriority as round, cast(o_orderdate as date) as notified,
         cast(min(l_shipdate) as date) as corrected, cast(max(l_shipdate) as date) as documents
  from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2, 3),
r as (select o_orderpriority as round, cast(max(o_orderdate) as date) - 700 as closes from orders group by 1),
d as (select c.*, closes, least(notified + 7, closes) as correct_by, notified + 14 as documents_by,
             documents + 30 as transfer_by, date '2001-06-01' as today
      from c join r on r.round = c.round)
select ref, cast(correct_by as varchar) as correct_by, cast(closes + 30 as varchar) as results_by,
       coalesce(corrected, today) > correct_by as correction_overdue,
       coalesce(documents, today) > documents_by as forfeited,
       not coalesce(documents, today) > documents_by and coalesce(today > transfer_by, false) as transfer_overdue
from d""",
)
def j6(t: Tables) -> DataFrame:
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("ref")).agg(
        F.min("l_shipdate").cast("date").alias("corrected_on"),
        F.max("l_shipdate").cast("date").alias("documents_on"),
    )
    cases = t.orders.select(
        F.col("o_orderkey").alias("ref"),
        F.col("o_orderpriority").alias("round"),
        F.col("o_orderdate").cast("date").alias("notified_on"),
        F.col("o_orderdate").cast("date").alias("documents_asked_on"),
        F.lit(None).cast("date").alias("paid_on"),
    ).join(shipped, "ref", "left")
    rounds = t.orders.groupBy(F.col("o_orderpriority").alias("round")).agg(
        F.date_sub(F.max("o_orderdate").cast("date"), 700).alias("closes_on")
    )
    done = award_deadlines(cases, rounds, "2001-06-01")
    return done.select(
        "ref", F.col("correct_by").cast("string").alias("correct_by"),
        F.col("results_by").cast("string").alias("results_by"),
        "correction_overdue", "forfeited", "transfer_overdue",
    )


@query(
    "j7_eligible_suggestions",
    """with log as (
  select d.doc_id, sha256(text) as content, case when lang = 'en' then 'app' when lang = 'fr' then 'mail' else 'chat' end as channel,
         case when quality = 0 then 'bug' else 'idea' end as kind
  from documents d left join labels l on l.doc_id = d.doc_id),
claim as (select * from log qualify row_number() over (partition by content order by doc_id) = 1),
plan as (select sha256(text) as content, min(d.doc_id - toxic) as added
         from labels l join documents d on d.doc_id = l.doc_id group by 1)
select doc_id as id, claim.content, channel from claim left join plan on plan.content = claim.content
where (added is null or added >= doc_id) and kind <> 'bug'""",
)
def j7(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("content"))
    log = hashed.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "lang",
        "content",
        F.col("doc_id").alias("arrived_at"),
        F.when(F.col("quality") == 0, "bug").otherwise("idea").alias("kind"),
    )
    roadmap = hashed.join(t.labels, "doc_id").select(
        "content", (F.col("doc_id") - F.col("toxic")).alias("added_at")
    )
    channels = {
        "app": log.where("lang = 'en'"),
        "mail": log.where("lang = 'fr'"),
        "chat": log.where("lang not in ('en', 'fr')"),
    }
    return eligible_suggestions(channels, roadmap).select("id", "content", "channel")


@query(
    "j8_reward_payouts",
    """select o_orderkey as id, cast(floor(o_totalprice / 10) as bigint) as amount, released_on,
              floor(o_totalprice / 10) between 500 and 15000 as in_range
       from orders join (select l_orderkey, cast(cast(min(l_shipdate) as date) as varchar) as released_on
                         from lineitem where l_linestatus = 'F' group by 1) on l_orderkey = o_orderkey""",
)
def j8(t: Tables) -> DataFrame:
    suggestions = t.orders.select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 10).alias("amount")
    )
    released = F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))
    releases = t.lineitem.select(F.col("l_orderkey").alias("id"), released.alias("released_at"))
    due = reward_payouts(suggestions, releases)
    return due.select(
        "id", "amount", F.col("released_at").cast("date").cast("string").alias("released_on"), "in_range"
    )


@query(
    "flow_submissions",
    rf"""with decided as ({DECIDE_SQL})
select d.user_id, case when regexp_matches(html, '{ANY_RE}') then 'needs_review' else 'received' end as status,
       md5(html) as digest, 'page' || d.user_id || '@example.org' as email
from decided d join pages on page_id = d.user_id where decision = 'accepted'""",
)
def flow(t: Tables) -> DataFrame:
    nothing = F.lit(None).cast("string")
    subs = page_submissions(t).withColumns(
        {
            "teacher": F.struct(*[nothing.alias(c) for c in ("name", "school", "region", "phone", "email")]),
            "replaced": F.lit("0"), "masked": F.lit("0"), "imageCount": F.lit("0"),
            "suspects": F.lit("[]"), "appVersion": F.lit("2.5"),
        }
    )
    users = t.pages.select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("page"), F.col("page_id"), F.lit("@example.org")).alias("email"),
    )
    none = users.select(F.col("id").alias("user_id"), nothing.alias("ref"), nothing.alias("status")).limit(0)
    out = process_submissions(
        subs, award_rounds(t), users, none.select("user_id", "ref"), none.select("ref", "status"),
        decide={"max_bytes": 8000, "min_chars": 1200},
    )
    back = reidentify(out["entries"], out["entrants"])
    return back.select("user_id", "status", F.md5("html").alias("digest"), "email")
