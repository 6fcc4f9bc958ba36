"""The shipped tables as inputs of the flow operators, in Spark SQL and in the oracle's dialect.

Each view is written once as a template; only the few spots where the dialects differ are filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# dialect: name -> spelling
SPARK = {
    "k": "cast(get_json_object(props, '$.k') as int)",
    "ts": "cast(ts as timestamp)",
    "shipts": "cast(l_shipdate as timestamp)",
    "orderts": "cast(o_orderdate as timestamp)",
    "nan": "cast('NaN' as double)",
    "inf": "cast('Infinity' as double)",
}
DUCK = {
    "k": "cast(regexp_extract(props, '-?[0-9]+') as integer)",
    "ts": "ts",
    "shipts": "l_shipdate",
    "orderts": "o_orderdate",
    "nan": "cast('nan' as double)",
    "inf": "cast('inf' as double)",
}

PACKETS = """
select ts, case when k % 3 = 0 then dst else src end as src_ip,
       case when k % 3 = 0 then src else dst end as dst_ip,
       cast(case when k % 3 = 0 then 20 + k % 12 else 40000 end as int) as src_port,
       cast(case when k % 3 = 0 then 40000 else 20 + k % 12 end as int) as dst_port,
       protocol, packet_length, protocol = 6 as is_tcp,
       protocol = 6 and event_type = 'signup' as syn,
       protocol = 6 and (event_type = 'click' or (event_type = 'view' and k % 11 <> 0)) as ack,
       protocol = 6 and (event_type = 'error' or (event_type = 'signup' and k % 17 = 0)) as rst,
       protocol = 6 and (event_type = 'purchase' or (event_type = 'signup' and k % 13 = 0)) as fin,
       protocol = 6 and event_type = 'purchase' and k % 7 = 0 as psh,
       protocol = 6 and event_type = 'purchase' and k % 7 = 0 as urg,
       cast(null as int) as raw_flags, event_id as pkt_id
from (
  select event_id, {ts} as ts, event_type, {k} as k,
         concat('10.0.0.', cast(user_id % 50 as varchar(20))) as src,
         concat('10.1.0.', cast(user_id % 3 as varchar(20))) as dst,
         cast(case when {k} % 20 = 18 then 1 when {k} % 10 = 9 then 17 else 6 end as int) as protocol,
         cast(40 + floor(value) as int) as packet_length
  from events
) e
"""

SCORED = """
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
              cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-',
              cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20))) as row_id,
       case when l_returnflag = 'R' then 1 else 0 end as y,
       l_discount * 10 as score, l_tax * 12.5 as score_b, l_extendedprice / 105000.0 as score_c,
       concat(l_returnflag, l_linestatus) as family, l_quantity, l_discount, l_tax, l_extendedprice,
       l_linenumber, l_suppkey, {shipts} as ts
from lineitem
"""

VECTORS = """
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
              cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-',
              cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20))) as row_id,
       l_quantity as f1, l_discount as f2, l_tax as f3,
       case when l_returnflag = 'R' then 1 else 0 end as y, l_returnflag as family,
       concat('part-', cast(l_suppkey % 4 as varchar(20))) as source_file, l_suppkey as grp,
       {shipts} as ts
from lineitem
"""

RAW_FLOWS = """
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
              cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-',
              cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20))) as row_id,
       concat('day-', cast(l_linenumber as varchar(20))) as source_file,
       (l_quantity - 2) * 1000000 as duration_us,
       cast(l_quantity as int) % 7 as fwd_packets, cast(l_discount * 100 as int) as bwd_packets,
       case when l_tax = 0.08 and l_quantity = 10 then {inf}
            when l_tax = 0.07 and l_quantity = 11 then {nan}
            when l_tax = 0.06 and l_quantity = 12 then null
            else l_quantity * 100 end as fwd_bytes,
       l_discount * 1000 as bwd_bytes,
       case when l_returnflag = 'N' then ' benign '
            when l_returnflag = 'A' and l_linestatus = 'F' then 'DoS  Hulk'
            when l_returnflag = 'A' then 'Web Attack – XSS'
            when l_linestatus = 'F' then 'PortScan' else 'mystery' end as native_label,
       {shipts} as ts
from lineitem
"""

SCORED_EVENTS = """
select event_id as seq, {ts} as ts, concat('10.0.0.', cast(user_id % 50 as varchar(20))) as host_id,
       least(value / 200.0, 1.0) as score,
       case when event_type in ('error', 'purchase') then 1 else 0 end as y,
       case event_type when 'error' then 'DDoS' when 'purchase' then 'Bot' when 'signup' then 'PortScan'
            else 'BENIGN' end as family,
       value * 1000.0 as flow_bytes_per_s, {k} as k
from events
"""

FLOW_ROWS = """
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
              cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-',
              cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20))) as row_id,
       cast(case when l_linenumber <= 4 then 6 when l_linenumber = 5 then 1 else 17 end as int) as protocol,
       cast(round(l_quantity) as int) as syn_count,
       cast(case when l_discount < 0.03 then 0 else round(l_tax * 100) end as int) as ack_count,
       cast(round(l_quantity) as int) as packet_count, cast(round(l_extendedprice / 100) as bigint) as total_bytes,
       case when l_tax = 0 then 0.0 else l_quantity / 8.0 end as duration_s,
       case when l_suppkey % 20 = 0 then '0.0.0.0' when l_suppkey % 20 = 1 then ' 127.0.0.1' else '10.0.0.7' end as src_ip,
       case when l_linenumber = 2 then '127.0.0.9' else '10.1.0.1' end as dst_ip,
       cast(20 + l_linenumber as int) as dst_port,
       l_suppkey % 11 = 0 as has_syn_fin, l_suppkey % 11 = 1 as has_syn_rst,
       l_suppkey % 11 = 2 as has_null_flags, l_suppkey % 11 = 3 as has_xmas_flags,
       cast(case when l_suppkey % 11 = 4 then 2 else 0 end as bigint) as invalid_flags_count,
       l_discount * 10 as score
from lineitem
"""

VIEWS = {
    "flow_rows": FLOW_ROWS,
    "packets": PACKETS, "scored": SCORED, "vectors": VECTORS, "raw_flows": RAW_FLOWS,
    "scored_events": SCORED_EVENTS,
}
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of ``VIEWS`` over the tables in ``sf_dir``."""
    text = VIEWS[name].format(**SPARK)
    used = [t for t in TABLES if f"from {t}" in text]
    for t in used:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def cte(*names: str) -> str:
    """``with`` clause that defines the views for the oracle."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n].format(**DUCK)})" for n in names)
