"""Refunds, deadlines, erasure and request tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_business_days, business_days_between, next_business_day
from ..functions.text import minor_units
from ..operators.erasure import (
    erase,
    erasure_counts,
    overdue_erasures,
    residuals,
    write_erasure,
)
from ..operators.refunds import (
    charge_anomalies,
    extend_for_outage,
    late_remedies,
    notice_audit,
    outages,
    paid_last_12_months,
    refund_decision,
)
from ..operators.requests import build_image_requests, summarise_conversations
from ..operators.service import refund_timeline, response_due
from ..session import scratch_path
from ..sources.snapshots import read_set
from .registry import Tables, query


def day_text(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("date").cast("string").alias(alias or name)


# Working days of the whole period, numbered, as an independent calendar.
CALENDAR_SQL = """cal as (
  select d, isodow not in (5, 6) as works,
         sum(case when isodow not in (5, 6) then 1 else 0 end) over (order by d) as number
  from (select cast(unnest(generate_series(timestamp '1994-12-01', timestamp '2025-12-31', interval 1 day)) as date) as d,
               date_part('isodow', d) as isodow)),
work as (select d, number from cal where works)"""


@query(
    "r1_business_days",
    f"""with {CALENDAR_SQL}
select o_orderkey, cast(w.d as varchar) as due, cast(e.number - s.number as bigint) as between_days,
       cast(nxt.d as varchar) as starts
from orders join cal s on s.d = cast(o_orderdate as date)
join work w on w.number = s.number + 15
join cal e on e.d = cast(o_orderdate as date) + 45
join work nxt on nxt.number = s.number + case when s.works then 0 else 1 end""",
)
def r1(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        add_business_days(day, 15).cast("string").alias("due"),
        business_days_between(day, F.date_add(day, 45)).cast("long").alias("between_days"),
        next_business_day(day).cast("string").alias("starts"),
    )


@query(
    "r2_refund_decision",
    f"""with {CALENDAR_SQL},
req as (select l_orderkey, cast(min(l_shipdate) as date) as asked, bool_or(l_returnflag = 'A') as exported,
               bool_or(l_linestatus = 'O') as broken from lineitem group by 1)
select l_orderkey as payment_id, case when o_orderkey is null then 'unknown_payment'
         when asked < cast(o_orderdate as date) then 'invalid' when asked > w.d then 'late'
         when exported and not broken then 'exported' else 'refund' end as decision
from req left join orders on o_orderkey = l_orderkey left join cal s on s.d = cast(o_orderdate as date)
left join work w on w.number = s.number + 15""",
)
def r2(t: Tables) -> DataFrame:
    payments = t.orders.select(
        F.col("o_orderkey").alias("payment_id"), F.col("o_orderdate").cast("date").alias("paid_on")
    )
    requests = t.lineitem.groupBy(F.col("l_orderkey").alias("payment_id")).agg(
        F.min("l_shipdate").cast("date").alias("requested_on")
    )
    exports = t.lineitem.select(
        F.col("l_orderkey").alias("payment_id"),
        (F.col("l_returnflag") == "A").alias("complete"),
        (F.col("l_linestatus") == "O").alias("broken"),
    )
    return refund_decision(payments, requests, exports).select("payment_id", "decision")


@query(
    "r3_late_remedies",
    """with e as (select o_custkey as u, cast(max(o_orderdate) as date) + 365 as ends, count(*) as outage_days from orders group by 1),
r as (select o_orderkey, o_custkey, cast(o_orderdate as date) as asked, cast(round(o_totalprice * 100) as bigint) as charged,
             case o_orderpriority when '1-URGENT' then 'defect' when '2-HIGH' then 'outage' when '3-MEDIUM' then 'duplicate'
               when '4-NOT SPECIFIED' then 'feature_removed' else 'unused' end as cause, o_orderstatus = 'P' as violation from orders),
m as (select r.*, ends, outage_days, case when violation then 'none' when cause in ('defect', 'feature_removed') then 'pro_rata'
               when cause = 'outage' and outage_days > 7 then 'extension_or_pro_rata' when cause = 'duplicate' then 'difference'
               else 'none' end as remedy,
             greatest(date_diff('day', asked, ends), 0) as days_left from r join e on u = o_custkey)
select o_orderkey as request_id, remedy,
       cast(case when remedy in ('pro_rata', 'extension_or_pro_rata') then (10000 * days_left * 2 + 365) // 730
            when remedy = 'difference' then greatest(charged - 10000, 0) else 0 end as bigint) as amount,
       cast(case when remedy = 'extension_or_pro_rata' then outage_days else 0 end as bigint) as extension_days
from m""",
)
def r3(t: Tables) -> DataFrame:
    cause = F.lit("unused")
    for priority, name in {
        "1-URGENT": "defect", "2-HIGH": "outage", "3-MEDIUM": "duplicate",
        "4-NOT SPECIFIED": "feature_removed",
    }.items():
        cause = F.when(F.col("o_orderpriority") == priority, name).otherwise(cause)
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("requested_on"),
        minor_units(F.col("o_totalprice")).alias("charged"),
        cause.alias("cause"),
        (F.col("o_orderstatus") == "P").alias("violation"),
    )
    per_user = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.date_add(F.max("o_orderdate").cast("date"), 365).alias("expires_on"),
        F.count(F.lit(1)).alias("outage_days"),
    )
    done = late_remedies(requests, per_user, per_user, 10_000)
    return done.select("request_id", "remedy", "amount", "extension_days")


def order_payments(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("payment_id"),
        F.col("o_orderdate").cast("date").alias("paid_on"),
        F.col("o_orderdate").cast("timestamp").alias("paid_at"),
        minor_units(F.col("o_totalprice")).alias("amount"),
    )


@query(
    "r4_charge_anomalies",
    """select payment_id, user_id, gap_days from (
  select o_orderkey as payment_id, o_custkey as user_id,
         date_diff('day', lag(o_orderdate) over w, o_orderdate) as gap_days
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
where gap_days <= 30""",
)
def r4(t: Tables) -> DataFrame:
    repeated = charge_anomalies(order_payments(t), days=30)
    return repeated.select("payment_id", "user_id", F.col("gap_days").cast("long").alias("gap_days"))


RUNS_SQL = """marked as (
  select user_id, ts, event_id, event_type = 'error' as down,
         row_number() over (partition by user_id order by ts, event_id)
         - row_number() over (partition by user_id, event_type = 'error' order by ts, event_id) as island
  from events),
runs as (select user_id, min(ts) as a, max(ts) as b, count(*) as reports from marked where down group by user_id, island),
long_runs as (select * from runs where b - a > interval 1 day)"""


def error_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("service"), "ts", "event_id", (F.col("event_type") != "error").alias("up")
    )


@query(
    "r5_outages",
    f"""with {RUNS_SQL}
select user_id as service, reports, epoch_us(b) - epoch_us(a) as micros, epoch_us(a) as started_us from long_runs""",
)
def r5(t: Tables) -> DataFrame:
    found = outages(error_log(t), min_days=1, order=("event_id",))
    started = F.unix_micros(F.col("started_at").cast("timestamp"))
    return found.select("service", "reports", "micros", started.alias("started_us"))


@query(
    "r5_extend_for_outage",
    f"""with {RUNS_SQL},
subs as (select user_id as service, event_id, epoch_us(ts) // 1000 as starts_ms, epoch_us(ts) // 1000 + 7 * 86400000 as expires_ms
         from events where event_type = 'purchase'),
hit as (select event_id, sum(greatest(least(epoch_us(b) // 1000, expires_ms) - greatest(epoch_us(a) // 1000, starts_ms), 0)) as lost
        from subs join long_runs on user_id = service group by 1)
select s.event_id, cast(coalesce(lost, 0) as bigint) as extension_ms,
       cast(expires_ms + coalesce(lost, 0) as bigint) as expires_ms
from subs s left join hit using (event_id)""",
)
def r5_extend(t: Tables) -> DataFrame:
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    subs = t.events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("service"),
        "event_id",
        start.alias("starts_ms"),
        (start + 7 * 86_400_000).alias("expires_ms"),
    )
    found = outages(error_log(t), min_days=1, order=("event_id",))
    return extend_for_outage(subs, found).select("event_id", "extension_ms", "expires_ms")


@query(
    "r6_response_due",
    f"""with {CALENDAR_SQL},
ev as (select event_id, event_type, cast(ts + interval 3 hour as date) as d, hour(ts + interval 3 hour) as h from events),
st as (select ev.*, case when works and h < 17 then number else number + 1 end as start_number from ev join cal on cal.d = ev.d)
select event_id, cast(a.d as varchar) as starts_on,
       cast(case event_type when 'signup' then st.d + 30 when 'purchase' then p2.d else p1.d end as varchar) as due_on,
       date '2024-01-20' > case event_type when 'signup' then st.d + 30 when 'purchase' then p2.d else p1.d end as breached
from st join work a on a.number = start_number join work p1 on p1.number = start_number + 1
join work p2 on p2.number = start_number + 2""",
)
def r6(t: Tables) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "privacy")
        .when(F.col("event_type") == "purchase", "refund")
        .when(F.col("event_type") == "error", "technical")
        .otherwise("general")
    )
    requests = t.events.select("event_id", kind.alias("type"), F.col("ts").alias("received_at"))
    due = response_due(requests, "2024-01-20")
    return due.select("event_id", day_text("starts_on"), day_text("due_on"), "breached")


@query(
    "r7_refund_timeline",
    f"""with {CALENDAR_SQL}
select o_orderkey, cast(a.d as varchar) as decision_by, cast(b.d as varchar) as executed_by,
       cast(c.d as varchar) as credited_from, cast(e.d as varchar) as credited_by
from orders join cal s on s.d = cast(o_orderdate as date)
join work a on a.number = s.number + 2 join work b on b.number = s.number + 7
join work c on c.number = s.number + 12 join work e on e.number = s.number + 21""",
)
def r7(t: Tables) -> DataFrame:
    requests = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("requested_on"))
    steps = ["decision_by", "executed_by", "credited_from", "credited_by"]
    return refund_timeline(requests).select("o_orderkey", *[day_text(c) for c in steps])


@query(
    "r8_paid_last_12_months",
    """select o_orderkey as payment_id, cast(sum(cast(round(o_totalprice * 100) as bigint)) over (
         partition by o_custkey order by o_orderdate
         range between interval 12 months preceding and current row) as bigint) as paid_12_months
       from orders""",
)
def r8(t: Tables) -> DataFrame:
    return paid_last_12_months(order_payments(t)).select("payment_id", "paid_12_months")


@query(
    "r9_notice_audit",
    """with x as (select o_orderkey, cast(o_orderdate as date) as n, cast(min(l_shipdate) as date) as e,
                         bool_or(l_returnflag = 'R') as leaves
                  from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)
       select o_orderkey, date_diff('day', n, e) as notice_days, date_diff('day', n, e) >= 30 as long_enough,
              cast(case when leaves then (10000 * greatest(date_diff('day', e, n + 365), 0) * 2 + 365) // 730 else 0 end as bigint) as refund
       from x""",
)
def r9(t: Tables) -> DataFrame:
    effect = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").cast("date").alias("effective_on"),
        F.bool_or(F.col("l_returnflag") == "R").alias("leaves"),
    )
    notified = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("notified_on"))
    changes = notified.join(effect, "o_orderkey").withColumns(
        {
            "leaves_on": F.when(F.col("leaves"), F.col("effective_on")),
            "expires_on": F.date_add("notified_on", 365),
        }
    )
    audited = notice_audit(changes, 10_000)
    return audited.select(
        "o_orderkey", F.col("notice_days").cast("long").alias("notice_days"), "long_enough", "refund"
    )


CHAIN = [
    ("customer", "c_custkey", "requests", "c_custkey"),
    ("orders", "o_custkey", "requests", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
]


def erasure_input(t: Tables):
    tables = {n: getattr(t, n) for n in ("customer", "orders", "lineitem")}
    return tables, t.customer.where("c_acctbal < 0").select("c_custkey")


ERASED_SQL = """gone as (select c_custkey from customer where c_acctbal < 0),
gone_orders as (select o_orderkey from orders where o_custkey in (select c_custkey from gone)),
sums as (
  select 'customer' as table_name, (select count(*) from customer) as n,
         (select count(*) from customer where c_custkey not in (select c_custkey from gone)) as kept
  union all select 'orders', (select count(*) from orders),
         (select count(*) from orders where o_custkey not in (select c_custkey from gone))
  union all select 'lineitem', (select count(*) from lineitem),
         (select count(*) from lineitem where l_orderkey not in (select o_orderkey from gone_orders)))"""


@query(
    "x1_erase",
    f"""with {ERASED_SQL} select table_name, n as rows, kept as rows_left, n - kept as removed from sums""",
)
def x1(t: Tables) -> DataFrame:
    tables, requests = erasure_input(t)
    counts = erasure_counts(tables, erase(tables, requests, chain=CHAIN))
    return counts.withColumnsRenamed({"table": "table_name", "left": "rows_left"})


@query(
    "x1_erase_lineitem",
    """select l_orderkey, count(*) as n, cast(sum(l_partkey) as bigint) as parts from lineitem
       where l_orderkey not in (select o_orderkey from orders join customer on c_custkey = o_custkey where c_acctbal < 0)
       group by l_orderkey""",
)
def x1_lineitem(t: Tables) -> DataFrame:
    tables, requests = erasure_input(t)
    left = erase(tables, requests, chain=CHAIN)["lineitem"]
    return left.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts")
    )


# An import that knows nothing of the erasure brings some rows back.
RESTORED = {"orders": "o_orderkey % 7 = 0", "lineitem": "l_linenumber = 1 and l_orderkey % 5 = 0"}


@query(
    "x2_erasure_audit",
    f"""with {ERASED_SQL}
select 'customer' as table_name, cast(0 as bigint) as residual
union all select 'orders', count(*) from orders where o_custkey in (select c_custkey from gone) and {RESTORED["orders"]}
union all select 'lineitem', count(*) from lineitem where l_orderkey in (select o_orderkey from gone_orders) and {RESTORED["lineitem"]}""",
)
def x2(t: Tables) -> DataFrame:
    tables, requests = erasure_input(t)
    base = scratch_path(t.spark, "erasure")
    write_erasure(tables, requests, base, "20240101-000000", chain=CHAIN)
    kept = read_set(t.spark, base)
    after = {name: kept[name].unionByName(tables[name].where(rows)) for name, rows in RESTORED.items()}
    audit = residuals({**kept, **after}, kept["tombstones"], chain=CHAIN)
    return audit.withColumnRenamed("table", "table_name")


@query(
    "x1_erase_as_set",
    f"""with {ERASED_SQL}
select table_name, n as rows, kept as rows_left, n - kept as removed from sums
union all select 'tombstones', marks, marks, 0 from (
  select (select count(*) from gone) * 2 + (select count(*) from gone_orders) as marks)""",
)
def x1_as_set(t: Tables) -> DataFrame:
    tables, requests = erasure_input(t)
    base = scratch_path(t.spark, "erasure")
    write_erasure(tables, requests, base, "20240101-000000", chain=CHAIN)
    after = read_set(t.spark, base)
    before = {**tables, "tombstones": after["tombstones"]}
    counts = erasure_counts(before, {name: after[name] for name in before})
    return counts.withColumnsRenamed({"table": "table_name", "left": "rows_left"})


@query(
    "x2_overdue_erasures",
    """select o_orderkey from orders where o_orderstatus <> 'F'
       and date_diff('day', cast(o_orderdate as date), date '2000-01-01') > 30""",
)
def x2_overdue(t: Tables) -> DataFrame:
    requests = t.orders.select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("requested_on"),
        F.when(F.col("o_orderstatus") == "F", F.lit("2000-01-01").cast("date")).alias("done_on"),
    )
    return overdue_erasures(requests, "2000-01-01").select("o_orderkey")


@query(
    "c1_build_chat_requests",
    """select conv_id, cast(count(*) as integer) as messages, string_agg(role, ',' order by turn) as roles,
              md5(string_agg(text, chr(10) order by turn)) as digest,
              cast(least(case when conv_id * 200 = 0 then 4000 else conv_id * 200 end, 8000) as double) as max_tokens
       from conversations group by conv_id""",
)
def c1(t: Tables) -> DataFrame:
    limits = t.conversations.select(
        "conv_id", (F.col("conv_id") * 200).cast("string").alias("max_tokens")
    ).distinct()
    return summarise_conversations(t.conversations, limits)


@query(
    "c2_build_image_requests",
    """select page_id, 4000.0::double as max_tokens, 'image,text' as kinds, 'base64' as encoding,
              case when page_id % 2 = 0 then 'image/png' else 'image/jpeg' end as media_type,
              md5(html) as data, url as prompt
       from pages where not contains(url, '?')""",
)
def c2(t: Tables) -> DataFrame:
    media = (
        F.when(F.col("url").contains("?"), "")
        .when(F.col("page_id") % 2 == 0, "image/png")
        .otherwise("image/jpeg")
    )
    asked = t.pages.select(
        "page_id",
        F.col("url").alias("prompt"),
        media.alias("mediaType"),
        F.col("html").alias("imageData"),
        F.lit(None).cast("string").alias("max_tokens"),
    )
    content = F.col("messages")[0]["content"]
    return build_image_requests(asked).select(
        "page_id",
        "max_tokens",
        F.array_join(content["type"], ",").alias("kinds"),
        content[0]["source"]["type"].alias("encoding"),
        content[0]["source"]["media_type"].alias("media_type"),
        F.md5(content[0]["source"]["data"]).alias("data"),
        content[1]["text"].alias("prompt"),
    )
