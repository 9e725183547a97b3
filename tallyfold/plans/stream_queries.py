"""The streaming operators, fed with the driver's tables as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming.monitor import session_counts, tumbling_counts
from ..streaming.payments import activation, drop_redeliveries, subscriptions_after
from ..streaming.run import drain, drain_batches
from ..streaming.submissions import decide_stream
from .account_queries import accounts_of, ends_sql, payments_of
from .award_queries import DECIDE_SQL, award_rounds, page_submissions
from .flows import free_subscriptions
from .registry import Tables, query


class StreamTables(Tables):
    """The same tables read as streams of files."""

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        schema = self.spark.read.parquet(path).schema
        # As a pattern the path may name a single file as well as a folder of them.
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")


def event_stream(t: Tables) -> DataFrame:
    events = StreamTables(t.spark, t.folder).events
    return events.withColumn("received_at", F.col("ts").cast("timestamp"))


@query(
    "t1_drop_redeliveries",
    "select distinct user_id, props as ref from events where event_type = 'purchase'",
)
def t1(t: Tables) -> DataFrame:
    paid = event_stream(t).where("event_type = 'purchase'").select(
        "user_id", F.col("props").alias("ref"), "received_at"
    )
    return drain(drop_redeliveries(paid, ["user_id", "ref"], delay="31 days")).select("user_id", "ref")


@query(
    "t2_stream_activation",
    f"""with recursive {ends_sql()}
select c_custkey as user_id, coalesce(cast(e as varchar), '') as expires_on, coalesce(cast(ref as varchar), '') as provider_ref,
       case when e is null then 'free' else 'active' end as status
from customer left join ends on u = c_custkey""",
)
def t2(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "activation")
    initial = free_subscriptions(accounts_of(t.customer))
    paid = payments_of(StreamTables(t.spark, t.folder).orders)
    drain_batches(paid, activation(f"{folder}/state", initial), f"{folder}/progress")
    state = subscriptions_after(t.spark, f"{folder}/state", initial)
    return state.select(
        "user_id",
        F.coalesce(F.col("expires_at").cast("date").cast("string"), F.lit("")).alias("expires_on"),
        F.coalesce("provider_ref", F.lit("")).alias("provider_ref"),
        "status",
    )


@query("t3_decide_stream", DECIDE_SQL)
def t3(t: Tables) -> DataFrame:
    pages = page_submissions(StreamTables(t.spark, t.folder))
    decided = decide_stream(pages, award_rounds(t), max_bytes=8000, min_chars=1200)
    return drain(decided.select("user_id", "decision"))


@query(
    "t4_tumbling_counts",
    """select epoch_us(time_bucket(interval 1 day, ts)) as starts_us, event_type, count(*) as n from events
       where time_bucket(interval 1 day, ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour
       group by 1, 2""",
)
def t4(t: Tables) -> DataFrame:
    counts = drain(tumbling_counts(event_stream(t), "event_type"))
    return counts.select(F.unix_micros("starts_at").alias("starts_us"), "event_type", "n")


@query(
    "t4_session_counts",
    """with m as (select user_id, ts, case when ts - lag(ts) over w < interval 4 hour then 0 else 1 end as fresh
                  from events window w as (partition by user_id order by ts)),
s as (select *, sum(fresh) over (partition by user_id order by ts) as session from m)
select user_id, epoch_us(min(ts)) as starts_us, epoch_us(max(ts)) + 4 * 3600000000 as ends_us, count(*) as n
from s group by user_id, session
having max(ts) + interval 4 hour <= (select max(ts) from events) - interval 1 hour""",
)
def t4_sessions(t: Tables) -> DataFrame:
    counts = drain(session_counts(event_stream(t), "user_id", gap="4 hours"))
    return counts.select(
        "user_id",
        F.unix_micros("starts_at").alias("starts_us"),
        F.unix_micros("ends_at").alias("ends_us"),
        "n",
    )
