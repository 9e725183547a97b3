"""Scans, exports, visibility and audits over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.constraints import audit_domains, audit_keys, judging_view
from ..operators.rows import check_writes, lookup, visible_rows
from ..session import scratch_path
from ..sources.export import (
    expired_snapshots,
    export_pages,
    read_export,
    write_export,
    write_snapshot,
)
from ..sources.reconcile import export_report, export_totals, reconcile
from ..sources.snapshots import verify_set, write_set
from ..sources.tables import read_typed
from .registry import Tables, query

DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


@query(
    "s1_read_tables",
    " union all ".join(
        f"select '{t}' as table_name, count(*) as n from {t}" for t in DRIVER_SCHEMAS
    ),
)
def s1(t: Tables) -> DataFrame:
    counts = [
        read_typed(t.spark, f"{t.folder}/{name}.parquet", ddl)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("table_name"), "n")
        for name, ddl in DRIVER_SCHEMAS.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "s2_read_export",
    "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
)
def s2(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "export")
    write_export(t.customer, "c_custkey", path)
    return read_export(t.spark, path, t.customer.schema)


@query(
    "s3_export_pages",
    """select (rank - 1) // 50 as page, count(*) as n, min(c_custkey) as first_key,
              max(c_custkey) as last_key, min(rank) as first_rank
       from (select c_custkey, row_number() over (order by c_custkey) as rank from customer)
       group by 1""",
)
def s3(t: Tables) -> DataFrame:
    return (
        export_pages(t.customer.select("c_custkey"), "c_custkey")
        .groupBy("page")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("c_custkey").alias("first_key"),
            F.max("c_custkey").alias("last_key"),
            F.min("rank").alias("first_rank"),
        )
    )


def _exported_orders(orders: DataFrame) -> DataFrame:
    """An export of orders with rows left out, changed and added, by status and priority."""
    open_status = F.col("o_orderstatus") == "P"
    urgent = F.col("o_orderpriority") == "1-URGENT"
    price = F.when(
        open_status & (F.col("o_orderpriority") == "2-HIGH"), F.col("o_totalprice") + 1
    ).otherwise(F.col("o_totalprice"))
    kept = orders.where(~(open_status & urgent)).withColumn("o_totalprice", price)
    added = orders.where(open_status & (F.col("o_orderpriority") == "5-LOW"))
    return kept.unionByName(added.withColumn("o_orderkey", -1 - F.col("o_orderkey")))


@query(
    "s4_reconcile",
    """select o_orderkey, 'missing' as status from orders
         where o_orderstatus = 'P' and o_orderpriority = '1-URGENT'
       union all select o_orderkey, 'changed' from orders
         where o_orderstatus = 'P' and o_orderpriority = '2-HIGH'
       union all select -1 - o_orderkey, 'extra' from orders
         where o_orderstatus = 'P' and o_orderpriority = '5-LOW'""",
)
def s4(t: Tables) -> DataFrame:
    return reconcile(t.orders, _exported_orders(t.orders), "o_orderkey")


@query(
    "s4_export_totals",
    """select count(*) as rows, cast(sum(octet_length(encode(cast(to_json(
                {'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal,
                 'c_mktsegment': c_mktsegment}) as varchar)))) as bigint) as bytes
       from customer""",
)
def s4_totals(t: Tables) -> DataFrame:
    return export_totals(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


def _object_totals_sql(name: str, columns: str) -> str:
    fields = ", ".join(f"'{c}': {c}" for c in columns.split())
    return f"""select '{name}' as object, count(*) as rows,
       cast(sum(octet_length(encode(cast(to_json({{{fields}}}) as varchar)))) as bigint) as bytes from {name}"""


# Every object of an export in one report.
EXPORTED = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "nation": "n_nationkey n_name n_regionkey",
    "region": "r_regionkey r_name",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "labels": "doc_id quality toxic",
}


@query("s4_export_report", " union all ".join(_object_totals_sql(n, c) for n, c in EXPORTED.items()))
def s4_report(t: Tables) -> DataFrame:
    return export_report({name: getattr(t, name).select(*columns.split()) for name, columns in EXPORTED.items()})


@query(
    "s5_write_snapshot",
    """select o_orderstatus, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key,
              cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as minor
       from orders group by o_orderstatus""",
)
def s5(t: Tables) -> DataFrame:
    path = write_snapshot(t.orders, scratch_path(t.spark, "snapshots"), "20240101-000000")
    return (
        t.spark.read.parquet(path)
        .groupBy("o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("o_orderkey").alias("first_key"),
            F.max("o_orderkey").alias("last_key"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("minor"),
        )
    )


@query(
    "s5_snapshot_sets",
    """select 'first' as asof, 'customer' as table_name, count(*) as expected, count(*) as found from customer
       union all select 'first', 'orders', count(*), count(*) from orders
       union all select 'last', 'customer', count(*), count(*) from customer where c_acctbal >= 0
       union all select 'last', 'orders', count(*), count(*) from orders where o_orderstatus <> 'P'""",
)
def s5_sets(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "sets")
    write_set({"customer": t.customer, "orders": t.orders}, base, "20240101-000000")
    later = {"customer": t.customer.where("c_acctbal >= 0"), "orders": t.orders.where("o_orderstatus <> 'P'")}
    write_set(later, base, "20240102-000000")
    found = None
    for name, asof in (("first", "20240101-235959"), ("last", None)):
        one = verify_set(t.spark, base, asof).select(
            F.lit(name).alias("asof"), F.col("table").alias("table_name"), "expected", "found"
        )
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "s6_expired_snapshots",
    """select cast(d as varchar) as stamp
       from (select distinct cast(ts as date) as d from events)
       where date_diff('day', d, date '2024-01-31') > 14""",
)
def s6(t: Tables) -> DataFrame:
    manifest = t.events.select(F.col("ts").cast("date").alias("stamp")).distinct()
    old = expired_snapshots(manifest, "2024-01-31 00:00:00")
    return old.select(F.col("stamp").cast("string").alias("stamp"))


@query(
    "f1_lookup",
    """select o_orderkey, o_custkey, o_orderpriority from orders
       where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
)
def f1(t: Tables) -> DataFrame:
    wanted = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return lookup(t.orders, wanted, ["o_orderkey", "o_custkey", "o_orderpriority"], "o_custkey")


@query(
    "f2_visible_rows",
    """select o_orderkey, o_custkey, 'own' as policy from orders
       where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
)
def f2(t: Tables) -> DataFrame:
    principals = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    rows = t.orders.select("o_orderkey", "o_custkey")
    own = visible_rows(rows, principals, "o_custkey").withColumn("policy", F.lit("own"))
    closed = visible_rows(rows, principals, None).withColumn("policy", F.lit("closed"))
    return own.unionByName(closed)


@query(
    "f3_check_writes",
    """select operation, verdict, count(*) as n, cast(sum(l_orderkey) as bigint) as keys from (
         select l_orderkey,
                case l_returnflag when 'N' then 'insert' when 'R' then 'update' else 'delete' end as operation,
                case when l_returnflag <> 'A' and o_custkey = l_partkey % 1500
                     then 'accepted' else 'rejected' end as verdict
         from lineitem left join orders on o_orderkey = l_orderkey)
       group by 1, 2""",
)
def f3(t: Tables) -> DataFrame:
    operation = (
        F.when(F.col("l_returnflag") == "N", "insert")
        .when(F.col("l_returnflag") == "R", "update")
        .otherwise("delete")
    )
    owners = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag")
    owned = lines.join(owners, "l_orderkey", "left")
    changes = owned.select(
        "l_orderkey",
        F.col("o_custkey").alias("user_id"),
        (F.col("l_partkey") % 1500).alias("caller"),
        operation.alias("operation"),
    )
    split = check_writes(changes, {"insert": "user_id", "update": "user_id"})
    judged = [df.withColumn("verdict", F.lit(v)) for v, df in split.items()]
    return (
        judged[0]
        .unionByName(judged[1])
        .groupBy("operation", "verdict")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))
    )


@query(
    "v1_audit_keys",
    """with dup as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1),
            cust as (select o_custkey, count(*) as n from orders group by 1 having count(*) > 1)
       select 'lineitem' as table_name, 'unique(l_orderkey,l_linenumber)' as rule, count(*) as bad_keys,
              cast(coalesce(sum(n), 0) as bigint) as bad_rows from dup
       union all select 'orders', 'unique(o_custkey)', count(*), cast(coalesce(sum(n), 0) as bigint) from cust
       union all select 'lineitem', 'foreign(l_orderkey)', count(distinct l_orderkey), count(l_orderkey)
         from lineitem where l_orderkey not in (select o_orderkey from orders)
       union all select 'labels', 'foreign(doc_id)', count(distinct doc_id), count(doc_id)
         from labels where doc_id not in (select doc_id from documents)""",
)
def v1(t: Tables) -> DataFrame:
    tables = {n: getattr(t, n) for n in ("lineitem", "orders", "labels", "documents")}
    spec = {
        "lineitem": {
            "unique": [["l_orderkey", "l_linenumber"]],
            "foreign": [(["l_orderkey"], "orders", ["o_orderkey"])],
        },
        "orders": {"unique": [["o_custkey"]]},
        "labels": {"foreign": [(["doc_id"], "documents", ["doc_id"])]},
    }
    return audit_keys(tables, spec).withColumnRenamed("table", "table_name")


@query(
    "v2_audit_domains",
    """select o_orderkey, concat_ws(';',
              case when o_orderstatus not in ('O', 'F') then 'o_orderstatus not allowed' end,
              case when o_orderpriority not in ('1-URGENT', '2-HIGH', '5-LOW') then 'o_orderpriority not allowed' end
              ) as reasons
       from orders
       where o_orderstatus not in ('O', 'F') or o_orderpriority not in ('1-URGENT', '2-HIGH', '5-LOW')""",
)
def v2(t: Tables) -> DataFrame:
    spec = {
        "o_orderstatus": {"required": True, "values": ["O", "F"]},
        "o_orderpriority": {"values": ["1-URGENT", "2-HIGH", "5-LOW"]},
        "o_custkey": {"required": True},
    }
    bad = audit_domains(t.orders, spec)
    return bad.select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


@query(
    "v3_judging_view",
    "select doc_id, md5(text) as digest, lang, n_chars from documents",
)
def v3(t: Tables) -> DataFrame:
    seen = judging_view(t.documents, ["doc_id", "text", "lang", "n_chars"], ["source"])
    return seen.select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")
