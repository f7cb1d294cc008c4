"""Flow-shaped views of the given tables, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowspark.config import AlertConfig, FlowColumns
from flowspark.operators.alerts import assign_alerts

SNAKE = FlowColumns(
    label="label", flow_id="flow_id", src_ip="source_ip", dst_ip="destination_ip", src_port="source_port",
    dst_port="destination_port", protocol="protocol", timestamp="flow_ts", duration="flow_duration")

FEATURES = ["f_total", "f_items", "f_quantity", "f_max_price", "f_min_discount", "f_max_tax"]

FLOWS_SQL = """
flows as (
  select event_id as sample_id, ts as flow_ts,
         concat('10.0.0.', cast(user_id as varchar)) as source_ip,
         concat('192.168.1.', cast(cast(json_extract_string(props, '$.k') as int) % 16 as varchar)) as destination_ip,
         cast(json_extract_string(props, '$.k') as int) as destination_port,
         case event_type when 'error' then 'DoS' when 'purchase' then 'PortScan' else 'BENIGN' end as label,
         case when event_type in ('error', 'purchase') then 1 else 0 end as binary_label,
         value as flow_value,
         least(value / 100.0::double, 1.0::double) as rf_prob,
         cast((event_id * 7919) % 1000 as double) / 1000.0::double as unsup_score
  from events)"""

ALERTS_SQL = FLOWS_SQL + """,
alerts as (
  select *, case alert_level_code when 3 then 'CRITICAL' when 2 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as alert_level,
         case when alert_level_code >= 2 then 1 else 0 end as final_binary,
         0.85::double * rf_prob + 0.15::double * unsup_score as risk_score
  from (select *, case when rf_prob >= 0.5::double and unsup_score >= 0.5::double then 3
                       when rf_prob >= 0.5::double then 2
                       when rf_prob >= 0.15::double or unsup_score >= 0.85::double then 1
                       else 0 end as alert_level_code from flows))"""

FEATURES_SQL = """
features as (
  select o.o_orderkey as sample_id, o.o_totalprice as f_total, l.f_items, l.f_quantity, l.f_max_price,
         l.f_min_discount, l.f_max_tax, 1.0::double as f_const,
         case when o.o_orderstatus = 'F' then 1 else 0 end as binary_label, o.o_orderpriority as label
  from orders o left join (
    select l_orderkey, cast(count(*) as double) as f_items, sum(l_quantity) as f_quantity,
           max(l_extendedprice) as f_max_price, min(l_discount) as f_min_discount, max(l_tax) as f_max_tax
    from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per event."""
    return as_flows(table(spark, sf_dir, "events"))


def as_flows(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("sample_id"), F.col("ts").cast("timestamp_ntz").alias("flow_ts"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("source_ip"),
        F.concat(F.lit("192.168.1."), (k % 16).cast("string")).alias("destination_ip"),
        k.alias("destination_port"),
        F.when(kind == "error", "DoS").when(kind == "purchase", "PortScan").otherwise("BENIGN").alias("label"),
        F.when(kind.isin("error", "purchase"), 1).otherwise(0).alias("binary_label"),
        F.col("value").alias("flow_value"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("rf_prob"),
        (((F.col("event_id") * 7919) % 1000).cast("double") / F.lit(1000.0)).alias("unsup_score"))


def alerts(spark: SparkSession, sf_dir: str, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Flows with the default alert rule."""
    return assign_alerts(flows(spark, sf_dir), cfg)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric matrix per order, with key and class; orders without lines have gaps."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("f_items"), F.sum("l_quantity").alias("f_quantity"),
        F.max("l_extendedprice").alias("f_max_price"), F.min("l_discount").alias("f_min_discount"), F.max("l_tax").alias("f_max_tax"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("f_total"), "f_items", "f_quantity",
        "f_max_price", "f_min_discount", "f_max_tax", F.lit(1.0).alias("f_const"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("binary_label"), F.col("o_orderpriority").alias("label"))


def embedding_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Embeddings as 64 numeric columns; class 0 is the attack class."""
    names = [f"e{i}" for i in range(64)]
    df = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.when(F.col("label") == 0, 1).otherwise(0).alias("binary_label"),
        F.col("label").cast("string").alias("label"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return df, names
