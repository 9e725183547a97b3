"""Access, payments and state documents over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import minor_units
from ..operators.access import access_asof, derive_expired
from ..operators.payments import (
    classify_events,
    invoice_requests,
    latest_periods,
    price_asof,
    resolve_object,
    stack_periods,
    suppress_replays,
    upsert_latest,
)
from ..operators.state import (
    bootstrap_rows,
    latest_documents,
    profile_state,
    replay_versions,
    stale_writes,
)
from .flows import free_subscriptions, payment_state, process_notices
from .registry import Tables, query

ASOF = "1999-01-01 00:00:00"

# Orders with status F are payments of their customer; every customer has an account.
def paid_sql(until: str = "") -> str:
    known = f"and o_orderdate <= timestamp '{until}'" if until else ""
    return f"""paid as (
  select o_custkey as u, o_orderkey as ref, cast(o_orderdate as date) as d,
         row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n
  from orders where o_orderstatus = 'F' {known})"""


def stack_sql(until: str = "") -> str:
    return f"""{paid_sql(until)},
stack as (
  select u, n, ref, cast(d + 365 as date) as e from paid where n = 1
  union all
  select p.u, p.n, p.ref, cast(greatest(p.d, s.e) + 365 as date)
  from stack s join paid p on p.u = s.u and p.n = s.n + 1)"""


def ends_sql(until: str = "") -> str:
    return f"""{stack_sql(until)},
ends as (select u, max(e) as e, max(n) as n, arg_max(ref, n) as ref from stack group by u)"""


ACCESS_SQL = f"""with recursive {ends_sql(ASOF)}
select c_custkey as user_id,
       case when e > date '1999-01-01' then 'subscribed'
            when date '1999-01-01' - (date '1998-12-03' + cast(c_custkey % 30 as integer)) < 10 then 'trial'
            else 'none' end as access
from customer left join ends on u = c_custkey"""


def payments_of(orders: DataFrame, until: str | None = None) -> DataFrame:
    """Paid orders as payments; with ``until`` only those known at that moment."""
    paid = orders.where(F.col("o_orderstatus") == "F")
    if until:
        paid = paid.where(F.col("o_orderdate") <= F.lit(until).cast("timestamp_ntz"))
    return paid.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("ref"),
        F.col("o_orderdate").cast("timestamp").alias("paid_at"),
    )


def accounts_of(customer: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("1998-12-03").cast("date"), (F.col("c_custkey") % 30).cast("int"))
    return customer.select(F.col("c_custkey").alias("id"), day.cast("timestamp").alias("created_at"))


def access_by_customer(t: Tables) -> DataFrame:
    """Payments so far → replay removal → stacked periods → stored subscriptions → access."""
    users = accounts_of(t.customer)
    subs = payment_state(users, payments_of(t.orders, ASOF))
    return access_asof(users, subs, ASOF)


@query("e1_access_asof", ACCESS_SQL)
def e1(t: Tables) -> DataFrame:
    return access_by_customer(t).select("user_id", "access")


@query(
    "flagship_access_counts",
    f"select access, count(*) as users from ({ACCESS_SQL}) group by access",
)
def flagship(t: Tables) -> DataFrame:
    return access_by_customer(t).groupBy("access").agg(F.count(F.lit(1)).alias("users"))


def deliveries(t: Tables) -> dict[str, DataFrame]:
    """Events as webhook deliveries, orders as payments and invoices."""
    token = F.when(F.col("user_id") % 10 == 0, "guess").otherwise("agreed")
    object_id = F.when(F.col("event_id") % 50 != 0, F.col("event_id") * 2)
    events = t.events.select(
        "event_id",
        object_id.alias("object_id"),
        token.alias("secret_token"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    objects = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "paid").otherwise("initiated").alias("status"),
        F.col("o_custkey").alias("user_id"),
        urgent.alias("direct"),
    )
    stored = (
        t.orders.where(F.col("o_orderstatus") == "F")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(F.max("o_orderkey").alias("provider_ref"))
    )
    return {
        "events": events,
        "payments": objects.where("direct").drop("direct"),
        "invoices": objects.where("not direct").drop("direct"),
        "stored": stored,
    }


DELIVERY_SQL = """delivery as (
  select event_id, case when event_id % 50 <> 0 then event_id * 2 end as object_id,
         case when user_id % 10 = 0 then 'guess' else 'agreed' end as token
  from events)"""


@query(
    "p1_classify_events",
    f"""with {DELIVERY_SQL},
     stored as (select o_custkey, max(o_orderkey) as provider_ref from orders where o_orderstatus = 'F' group by 1)
select event_id, case when token <> 'agreed' then 'bad_token' when object_id is null then 'no_id'
         when o.o_orderkey is null then 'unverifiable' when o_orderstatus <> 'F' then 'not_paid'
         when provider_ref = object_id then 'already' else 'activated' end as outcome
from delivery left join orders o on o.o_orderkey = object_id left join stored s on s.o_custkey = o.o_custkey""",
)
def p1(t: Tables) -> DataFrame:
    d = deliveries(t)
    done = classify_events(d["events"], d["payments"], d["invoices"], d["stored"], token="agreed")
    return done.select("event_id", "outcome")


@query(
    "p2_resolve_object",
    f"""with {DELIVERY_SQL}
select event_id, coalesce(case when o_orderkey is not null and o_orderpriority in ('1-URGENT', '2-HIGH')
         then 'payment' when o_orderkey is not null then 'invoice' end, 'none') as found_in,
       coalesce(cast(o_custkey as varchar), '') as user_id
from delivery left join orders on o_orderkey = object_id""",
)
def p2(t: Tables) -> DataFrame:
    d = deliveries(t)
    found = resolve_object(d["events"], d["payments"], d["invoices"])
    return found.select(
        "event_id",
        F.coalesce("found_in", F.lit("none")).alias("found_in"),
        F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user_id"),
    )


@query(
    "flow_payments",
    f"""with recursive {DELIVERY_SQL},
stored as (select o_custkey as u, max(o_orderkey) as provider_ref from orders where o_orderstatus = 'F' group by 1),
act as (select o_custkey as u, object_id as ref, epoch_us(ts) // 1000 as t,
               row_number() over (partition by o_custkey order by ts, object_id) as n
        from delivery join events using (event_id) join orders on o_orderkey = object_id
        where token = 'agreed' and o_orderstatus = 'F'),
stack as (
  select u, 0::bigint as n, provider_ref as ref, 0::bigint as e from stored
  union all
  select a.u, a.n, a.ref, case when a.ref = s.ref then s.e else greatest(a.t, s.e) + 365 * 86400000::bigint end
  from stack s join act a on a.u = s.u and a.n = s.n + 1),
ends as (select u, max(e) as e, arg_max(ref, n) as ref from stack group by u)
select u as user_id, case when e = 0 then 'free' else 'active' end as status,
       cast(ref as varchar) as provider_ref, e as expires_ms
from ends""",
)
def flow_payments(t: Tables) -> DataFrame:
    d = deliveries(t)
    subs = free_subscriptions(d["stored"].withColumnRenamed("user_id", "id")).drop("provider_ref")
    subs = subs.join(d["stored"], "user_id").withColumn("provider_ref", F.col("provider_ref").cast("string"))
    out = process_notices(d["events"], d["payments"], d["invoices"], subs, token="agreed")
    ends = F.coalesce(F.unix_millis("expires_at"), F.lit(0))
    return out["subscriptions"].select(
        "user_id", "status", "provider_ref", ends.alias("expires_ms")
    )


def purchases(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", F.col("props").alias("ref"), "ts"
    )


@query(
    "p3_suppress_replays_last",
    """select event_id, user_id from (
         select event_id, user_id, props, lag(props) over (partition by user_id order by ts, event_id) as before
         from events where event_type = 'purchase')
       where before is distinct from props""",
)
def p3_last(t: Tables) -> DataFrame:
    return suppress_replays(purchases(t), order=("ts", "event_id")).select("event_id", "user_id")


@query(
    "p3_suppress_replays_all",
    """select arg_min(event_id, ts) as event_id, user_id from events
       where event_type = 'purchase' group by user_id, props""",
)
def p3_all(t: Tables) -> DataFrame:
    kept = suppress_replays(purchases(t), mode="all", order=("ts", "event_id"))
    return kept.select("event_id", "user_id")


@query(
    "e4_stack_periods",
    f"""with recursive {stack_sql()}
select u as user_id, ref, cast(e as varchar) as expires_on from stack""",
)
def e4(t: Tables) -> DataFrame:
    stacked = stack_periods(payments_of(t.orders))
    day = F.col("expires_at").cast("date").cast("string")
    return stacked.select("user_id", "ref", day.alias("expires_on"))


@query(
    "e4_stack_calendar_years",
    f"""with recursive {paid_sql()},
stack as (
  select u, n, ref, cast(d + interval 1 year as date) as e from paid where n = 1
  union all
  select p.u, p.n, p.ref, cast(greatest(p.d, s.e) + interval 1 year as date)
  from stack s join paid p on p.u = s.u and p.n = s.n + 1)
select u as user_id, ref, cast(e as varchar) as expires_on from stack""",
)
def e4_calendar(t: Tables) -> DataFrame:
    stacked = stack_periods(payments_of(t.orders), year="calendar")
    day = F.col("expires_at").cast("date").cast("string")
    return stacked.select("user_id", "ref", day.alias("expires_on"))


@query(
    "e4_latest_periods",
    f"""with recursive {ends_sql()}
select u as user_id, cast(e as varchar) as expires_on from ends""",
)
def e4_latest(t: Tables) -> DataFrame:
    ends = latest_periods(stack_periods(payments_of(t.orders)))
    return ends.select("user_id", F.col("expires_at").cast("date").cast("string").alias("expires_on"))


@query(
    "e5_upsert_latest",
    """with last as (
  select o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as priority,
         max(cast(o_orderdate as date)) as d
  from orders group by 1)
select coalesce(c_custkey, o_custkey) as user_id, coalesce(c_name, '') as name,
       coalesce(case when o_custkey is null then c_mktsegment else priority end, '') as plan,
       coalesce(cast(d as varchar), '') as updated_on
from customer full join last on c_custkey = o_custkey""",
)
def e5(t: Tables) -> DataFrame:
    target = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("plan"),
        F.lit(None).cast("string").alias("updated_on"),
    )
    changes = t.orders.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("plan"),
        F.col("o_orderdate").cast("date").cast("string").alias("updated_on"),
        "o_orderkey",
    )
    state = upsert_latest(target, changes, "user_id", ["updated_on", "o_orderkey"], ["plan", "updated_on"])
    return state.fillna("")


@query(
    "e6_invoice_requests",
    """select cast(round(c_acctbal * 100) as bigint) * 100 as amount, 'SAR' as currency,
              'Annual ' || c_name as description, cast(c_custkey as varchar) as user_id, c_name as email
       from customer""",
)
def e6(t: Tables) -> DataFrame:
    users = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("email"), "c_acctbal"
    )
    asked = invoice_requests(users, price=minor_units(F.col("c_acctbal")), description="Annual ")
    return asked.select("amount", "currency", "description", "metadata.user_id", "metadata.email")


@query(
    "e7_price_asof",
    """select p.event_id, p.user_id, coalesce(v.value, -1.0) as price
       from (select * from events where event_type = 'purchase') p
       asof left join (select * from events where event_type = 'view') v
         on p.user_id = v.user_id and p.ts > v.ts""",
)
def e7(t: Tables) -> DataFrame:
    renewals = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    prices = t.events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("price"))
    priced = price_asof(renewals, prices, "user_id", order=("event_id",))
    return priced.select("event_id", "user_id", F.coalesce("price", F.lit(-1.0)).alias("price"))


@query(
    "t5_derive_expired",
    f"""with recursive {ends_sql(ASOF)}
select u as user_id, case when e <= date '1999-01-01' then 'expired' else 'active' end as status from ends""",
)
def t5(t: Tables) -> DataFrame:
    ends = latest_periods(stack_periods(payments_of(t.orders, ASOF)))
    subs = ends.withColumn("status", F.lit("active"))
    return derive_expired(subs, ASOF).select("user_id", "status")


def state_writes(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", "user_id", "ts", F.col("event_type").alias("device"), F.col("props").alias("state")
    )


@query(
    "d1_replay_versions",
    """select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as version
       from events""",
)
def d1(t: Tables) -> DataFrame:
    writes = state_writes(t).select("event_id", "user_id", "ts")
    return replay_versions(writes, order=("ts", "event_id")).select("event_id", "user_id", "version")


@query(
    "d1_latest_documents",
    """select user_id, count(*) as version, arg_max(props, ts) as state,
              epoch_us(min(ts)) as created_us, epoch_us(max(ts)) as updated_us
       from events group by user_id""",
)
def d1_latest(t: Tables) -> DataFrame:
    rows = latest_documents(state_writes(t), order=("ts", "event_id"))
    return rows.select(
        "user_id",
        "version",
        "state",
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"),
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"),
    )


@query(
    "d2_bootstrap_rows",
    """select o_custkey as user_id, 'ordered' as status, count(*) as version from orders
         where year(o_orderdate) = 1998 group by 1
       union all select c_custkey, 'free', 1 from customer
         where c_custkey not in (select o_custkey from orders where year(o_orderdate) = 1998)""",
)
def d2(t: Tables) -> DataFrame:
    table = (
        t.orders.where(F.year("o_orderdate") == 1998)
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(F.lit("ordered").alias("status"), F.count(F.lit(1)).alias("version"))
    )
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    return bootstrap_rows(
        users, table, {"status": F.lit("free"), "version": F.lit(1).cast("long")}
    )


@query(
    "d3_stale_writes",
    """with v as (select *, row_number() over (partition by user_id order by ts, event_id) as version from events)
       select event_id, user_id, version,
              coalesce(lag(version) over (partition by user_id, event_type order by version) <> version - 1, false) as stale
       from v""",
)
def d3(t: Tables) -> DataFrame:
    writes = state_writes(t).drop("state")
    return stale_writes(writes, order=("ts", "event_id")).select(
        "event_id", "user_id", "version", "stale"
    )


@query(
    "d4_profile_state",
    """select '$.k' as path,
              case json_type(props, '$.k') when 'UBIGINT' then 'BIGINT' else coalesce(json_type(props, '$.k'), 'ABSENT') end as type,
              count(*) as documents, cast(0 as bigint) as array_items,
              cast(sum(octet_length(encode(props))) as bigint) as total_bytes,
              max(octet_length(encode(props))) as largest_bytes,
              count(*) filter (octet_length(encode(props)) > 8) as oversize
       from events group by 2
       union all
       select '$.missing', 'ABSENT', count(*), 0, cast(sum(octet_length(encode(props))) as bigint),
              max(octet_length(encode(props))), count(*) filter (octet_length(encode(props)) > 8)
       from events""",
)
def d4(t: Tables) -> DataFrame:
    return profile_state(t.events, ["$.k", "$.missing"], body="props", oversize=8)
