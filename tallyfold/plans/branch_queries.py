"""Outcomes that the plain queries do not reach: missing users, closed rounds, prices, holidays, policy, ties."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import minor_units
from ..operators.judging import eligible_suggestions
from ..operators.payments import classify_events, mark_replays
from ..operators.refunds import charge_anomalies, late_remedies
from ..operators.service import response_due
from ..operators.state import latest_documents
from ..operators.submissions import active_entries, decide_submissions
from ..session import scratch_path
from ..sources.export import export_lines, read_export
from .account_queries import deliveries
from .award_queries import DECIDE_SQL, page_submissions
from .registry import Tables, query
from .service_queries import CALENDAR_SQL, day_text, order_payments

CLOSES = "2024-01-06 00:00:00"
HOLIDAYS = ["2024-01-03", "2024-01-05", "2024-01-10", "2024-01-11", "2024-01-14"]


@query(
    "p1_classify_branches",
    """with delivery as (
  select event_id, case when event_id % 50 = 0 then null when event_id % 49 = 0 then 0 else event_id * 2 end as object_id
  from events),
     stored as (select o_custkey, max(o_orderkey) as provider_ref from orders where o_orderstatus = 'F' group by 1)
select event_id, case when object_id is null or object_id = 0 then 'no_id' when o.o_orderkey is null then 'unverifiable'
         when o_orderstatus <> 'F' then 'not_paid' when o.o_custkey % 7 in (0, 1) then 'no_user'
         when provider_ref = object_id then 'already' else 'activated' end as outcome
from delivery left join orders o on o.o_orderkey = object_id left join stored s on s.o_custkey = o.o_custkey""",
)
def p1_branches(t: Tables) -> DataFrame:
    d = deliveries(t)
    zero = F.when((F.col("event_id") % 49 == 0) & F.col("object_id").isNotNull(), 0).otherwise(F.col("object_id"))
    rest = F.col("user_id") % 7
    user = F.when(rest > 1, F.col("user_id"))
    objects = [d[name].withColumn("user_id", user) for name in ("payments", "invoices")]
    done = classify_events(d["events"].withColumn("object_id", zero), *objects, d["stored"])
    return done.select("event_id", "outcome")


@query(
    "p1_mark_replays",
    """with delivery as (
  select o_orderkey as ref, o_custkey as user_id, o_orderdate as moment, 0 as n from orders
  union all
  select o_orderkey, o_custkey, o_orderdate + to_days(cast(o_orderkey % 3 * 60 as integer)), 1 from orders)
select ref, n, coalesce(lag(ref) over (partition by user_id order by moment, ref, n) = ref, false) as repeated from delivery""",
)
def p1_replays(t: Tables) -> DataFrame:
    first = t.orders.select(
        F.col("o_orderkey").alias("ref"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
        F.lit(0).alias("n"),
    )
    late = F.col("received_at") + F.make_dt_interval((F.col("ref") % 3 * 60).cast("int"))
    again = first.withColumns({"received_at": late, "n": F.lit(1)})
    marked = mark_replays(first.unionByName(again), order=("received_at", "ref", "n"))
    return marked.select("ref", "n", "repeated")


@query(
    "a1_decide_branches",
    f"""select user_id as page_id, case when user_id % 13 = 0 then 'unauthenticated'
         when user_id % 6 in (1, 3, 4, 5) then 'not_open' when user_id % 6 = 2 then 'bad_close_date'
         else decision end as decision
from ({DECIDE_SQL})""",
)
def a1_branches(t: Tables) -> DataFrame:
    """Rounds that are open, closed, closed at no date, at an empty one, of unknown state, and no round at all."""
    rounds = t.spark.createDataFrame(
        [("r0", True, CLOSES), ("r1", False, CLOSES), ("r2", True, "soon"), ("r3", True, ""), ("r4", None, CLOSES)],
        "round string, open boolean, closes_at string",
    )
    page = F.col("user_id")
    subs = page_submissions(t).withColumns(
        {
            "page_id": page,
            "round": F.concat(F.lit("r"), page % 6),
            "user_id": F.when(page % 13 != 0, page),
        }
    )
    decided = decide_submissions(subs, rounds, max_bytes=8000, min_chars=1200)
    return decided.select("page_id", "decision")


@query(
    "a7_active_entries_ties",
    """select user_id, doc_id, part from (
  select source as user_id, doc_id, nullif(n_chars % 7, 0) as part,
         row_number() over (partition by source order by nullif(n_chars % 7, 0) desc nulls last, doc_id desc) as n
  from documents) where n = 1 and user_id is not null""",
)
def a7_ties(t: Tables) -> DataFrame:
    """Entries with few different times, some of them null: a null stands first, and the id decides ties."""
    part = F.nullif(F.col("n_chars") % 7, F.lit(0))
    subs = t.documents.select(F.col("source").alias("user_id"), "doc_id", "text", part.alias("part"))
    return active_entries(subs, order=("part", "doc_id")).select("user_id", "doc_id", "part")


@query(
    "d1_latest_documents_ties",
    """with w as (
  select user_id, event_id, props, case when event_id % 5 <> 0 then date_trunc('day', ts) end as moment from events)
select user_id, count(*) as version, epoch_us(min(moment)) as created_us, epoch_us(max(moment)) as updated_us,
       arg_max(props, event_id) filter (where moment is not distinct from last) as state
from (select w.*, max(moment) over (partition by user_id) as last from w) group by user_id""",
)
def d1_ties(t: Tables) -> DataFrame:
    """Writes by day, so that most tie, a fifth of them without a time."""
    at = F.when(F.col("event_id") % 5 != 0, F.date_trunc("day", F.col("ts").cast("timestamp")))
    writes = t.events.select("user_id", "event_id", F.col("props").alias("state"), at.alias("at"))
    rows = latest_documents(writes, order=("at", "event_id"))
    return rows.select(
        "user_id",
        "version",
        F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("updated_at").alias("updated_us"),
        "state",
    )


@query(
    "r3_remedies_by_price",
    """with e as (select o_custkey as u, cast(max(o_orderdate) as date) as ends, count(*) as days from orders
           where o_custkey % 5 <> 0 group by 1),
r as (select o_orderkey, cast(o_orderdate as date) as asked, cast(round(o_totalprice * 100) as bigint) as charged,
             5000000 + o_custkey % 3 * 5000000 as price, ends, days,
             case o_orderpriority when '1-URGENT' then 'wrong_amount' when '2-HIGH' then 'outage'
               when '3-MEDIUM' then 'defect' end as cause
      from orders left join e on u = o_custkey),
m as (select r.*, case when cause = 'defect' then 'pro_rata' when cause = 'wrong_amount' then 'difference'
               when cause = 'outage' and days > 7 then 'extension_or_pro_rata' else 'none' end as remedy,
             coalesce(greatest(date_diff('day', asked, ends), 0), 0) as days_left from r)
select o_orderkey as request_id, remedy,
       cast(case when remedy in ('pro_rata', 'extension_or_pro_rata') then (price * days_left * 2 + 365) // 730
            when remedy = 'difference' then greatest(charged - price, 0) else 0 end as bigint) as amount,
       cast(case when remedy = 'extension_or_pro_rata' then days else 0 end as bigint) as extension_days
from m""",
)
def r3_by_price(t: Tables) -> DataFrame:
    """A price of each user's own; every fifth user has neither a subscription nor outages, some requests no cause."""
    priority = F.col("o_orderpriority")
    cause = F.when(priority == "1-URGENT", "wrong_amount").when(priority == "2-HIGH", "outage").when(
        priority == "3-MEDIUM", "defect"
    )
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("requested_on"),
        minor_units(F.col("o_totalprice")).alias("charged"),
        cause.alias("cause"),
        F.lit(None).cast("boolean").alias("violation"),
    )
    users = t.orders.where(F.col("o_custkey") % 5 != 0).groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max("o_orderdate").cast("date").alias("expires_on"), F.count(F.lit(1)).alias("outage_days")
    )
    done = late_remedies(requests, users, users, 5_000_000 + F.col("user_id") % 3 * 5_000_000)
    return done.select("request_id", "remedy", "amount", "extension_days")


@query(
    "r4_charges_off_price",
    """select payment_id, repeated, wrong_amount,
       cast(case when repeated then amount when wrong_amount then 500 else 0 end as bigint) as difference
from (select o_orderkey as payment_id, cast(round(o_totalprice * 100) as bigint) as amount, o_orderkey % 10 = 0 as wrong_amount,
             coalesce(date_diff('day', lag(o_orderdate) over w, o_orderdate) <= 30, false) as repeated
      from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
where repeated or wrong_amount""",
)
def r4_off_price(t: Tables) -> DataFrame:
    """Every tenth payment is 500 above the price."""
    above = F.when(F.col("payment_id") % 10 == 0, 500).otherwise(0)
    payments = order_payments(t).withColumn("price", F.col("amount") - above)
    found = charge_anomalies(payments, price=F.col("price"), days=30)
    return found.select("payment_id", "repeated", "wrong_amount", "difference")


WORKS_SQL = "isodow not in (5, 6)"
OFF_SQL = f"(isodow not in (5, 6) and d not in ({', '.join(f"date '{day}'" for day in HOLIDAYS)}))"


@query(
    "r6_response_due_holidays",
    f"""with {CALENDAR_SQL.replace(WORKS_SQL, OFF_SQL)},
ev as (select event_id, event_type, cast(ts + interval 3 hour as date) as d, hour(ts + interval 3 hour) as h from events),
st as (select ev.*, case when works and h < 17 then number else number + 1 end as start_number from ev join cal on cal.d = ev.d)
select event_id, cast(a.d as varchar) as starts_on,
       cast(case event_type when 'purchase' then p2.d else p1.d end as varchar) as due_on,
       cast(st.d + cast(event_id % 9 as integer) as date) > case event_type when 'purchase' then p2.d else p1.d end as breached
from st join work a on a.number = start_number join work p1 on p1.number = start_number + 1
join work p2 on p2.number = start_number + 2""",
)
def r6_holidays(t: Tables) -> DataFrame:
    """Holidays, one of them on a weekend, and answers after 0 to 8 days."""
    later = F.make_dt_interval((F.col("event_id") % 9).cast("int"))
    arrived = F.col("ts").cast("timestamp")
    requests = t.events.select(
        "event_id",
        F.when(F.col("event_type") == "purchase", "refund").otherwise("general").alias("type"),
        arrived.alias("received_at"),
        (arrived + later).alias("answered_at"),
    )
    due = response_due(requests, holidays=[dt.date.fromisoformat(day) for day in HOLIDAYS])
    return due.select("event_id", day_text("starts_on"), day_text("due_on"), "breached")


@query(
    "j7_eligible_by_policy",
    """with log as (
  select d.doc_id, sha256(text) as content, case when toxic = 1 then 'against_policy' when quality = 0 then 'bug' else 'idea' end as kind
  from documents d left join labels l on l.doc_id = d.doc_id)
select doc_id as id, content, 'any' as channel from log
qualify row_number() over (partition by content order by doc_id) = 1 and kind = 'idea'""",
)
def j7_policy(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("content"))
    log = hashed.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "content",
        F.col("doc_id").alias("arrived_at"),
        F.when(F.col("toxic") == 1, "against_policy").when(F.col("quality") == 0, "bug").otherwise("idea").alias("kind"),
    )
    nothing = log.select("content", F.col("arrived_at").alias("added_at")).where(F.lit(False))
    return eligible_suggestions({"any": log}, nothing).select("id", "content", "channel")


@query(
    "s2_read_export_wrapped",
    "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
)
def s2_wrapped(t: Tables) -> DataFrame:
    """Pages that are an object with its rows in ``users``, some as a bare array, between blank lines."""
    path = scratch_path(t.spark, "export")
    page = F.concat(F.lit('{"users":'), "value", F.lit(',"total":1}'))
    line = F.when(F.col("page") % 3 == 0, F.col("value")).otherwise(page)
    export_lines(t.customer, "c_custkey").select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)
    return read_export(t.spark, path, t.customer.schema)
