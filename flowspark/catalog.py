"""Queries over the given tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowspark import fixtures as fx
from flowspark import sinks
from flowspark.config import AlertConfig, PrepareConfig, SupervisedConfig, TraceConfig, UnsupervisedConfig
from flowspark.fixtures import ALERTS_SQL, FEATURES, FEATURES_SQL, FLOWS_SQL, SNAKE
from flowspark.functions import scalars as S
from flowspark.operators import (
    alerts as al, campaigns as ca, clean, curves as cu, display as di, edges as ed, evidence as ev, explain as ex,
    forest as fo, fusion as fu, graph as gr, iforest as ifo, ordering, quantiles as qu, recon as re_, reconcile as rc,
    selection as se, split as sp, summary as su, thresholds as th, threat as tr, trees as ts)
from flowspark.plans.supervised import supervised_score
from flowspark.sources import flow_csv, tables
from flowspark.staging import local_table, new_path, staged
from flowspark.streaming.alert_stream import alert_stream as streaming_alerts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TRACE = TraceConfig(columns=SNAKE)
PREPARE = PrepareConfig(columns=SNAKE)


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def numbers(values) -> str:
    """A constant list as SQL rows (position, value)."""
    return ", ".join(f"({i}, {v!r}::double)" for i, v in enumerate(values))


# --- labels and cleaning -------------------------------------------------------

RAW_LABEL_SQL = """raw as (
  select event_id as sample_id, case event_type when 'error' then ' DoS ' when 'purchase' then 'benign'
         when 'view' then ' BENIGN' when 'signup' then '  ' end as label from events)"""


def raw_labels(spark, sf):
    kind = F.col("event_type")
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"),
        F.when(kind == "error", " DoS ").when(kind == "purchase", "benign").when(kind == "view", " BENIGN")
        .when(kind == "signup", "  ").alias("label"))


@query(f"""with {RAW_LABEL_SQL}
select sample_id, trim(label) as label, case when trim(label) = 'BENIGN' then 0 else 1 end as binary_label
from raw where label is not null and trim(label) <> ''""")
def label_binary(spark, sf):
    kept = clean.keep_labelled(raw_labels(spark, sf), SNAKE)
    return clean.add_binary_label(kept, SNAKE).withColumn("label", F.trim("label"))


@query(f"""with {RAW_LABEL_SQL}
select count(*) as n_rows, count(*) filter (where label is null or trim(label) = '') as n_dropped from raw""")
def label_filter(spark, sf):
    return clean.unlabelled_count(raw_labels(spark, sf), SNAKE)


@query("""select event_id as sample_id, case event_id % 8 when 0 then value when 6 then 1e5::double when 7 then value end as f
from events""")
def numeric_coerce(spark, sf):
    v = F.col("value").cast("string")
    odd = {1: "Infinity", 2: "-inf", 3: "NaN", 4: "abc", 5: "1.5f", 6: "1e5"}
    text = F.when(F.col("event_id") % 8 == 7, F.concat(F.lit(" "), v, F.lit(" "))).otherwise(v)
    for k, s in odd.items():
        text = F.when(F.col("event_id") % 8 == k, s).otherwise(text)
    raw = fx.table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), text.alias("f"))
    return clean.coerce_numeric(raw, ["f"])


@query(f"""with {FEATURES_SQL}
select sample_id, f_total, f_items, f_quantity, f_max_price, f_min_discount, f_max_tax, binary_label, label
from features where f_total is not null and f_items is not null and f_quantity is not null
  and f_max_price is not null and f_min_discount is not null and f_max_tax is not null""")
def clean_features(spark, sf):
    return clean.clean_features(fx.features(spark, sf), PREPARE)[0]


@query(f"with {FEATURES_SQL}\n" + " union all ".join(
    f"select '{c}' as feature, case when count(distinct {c}) + max(case when {c} is null then 1 else 0 end) <= 1 then 1 else 0 end as is_constant from features"
    for c in [*FEATURES, "f_const"]))
def const_columns(spark, sf):
    return clean.constant_columns(fx.features(spark, sf), [*FEATURES, "f_const"])


@query(f"""with {FEATURES_SQL}
select label, cast(sum({' + '.join(f'(case when {c} is null then 1 else 0 end)' for c in FEATURES)}) as bigint) as n_missing,
       cast(0 as bigint) as n_infinite from features group by label""")
def nonfinite_audit(spark, sf):
    return clean.nonfinite_audit(fx.features(spark, sf), FEATURES, by="label")


MEDIANS_SQL = ", ".join(f"median({c}) as {c}" for c in FEATURES)


@query(f"with {FEATURES_SQL}, m as (select {MEDIANS_SQL} from features)\n" + " union all ".join(
    f"select '{c}' as feature, round({c}, 6) as value from m" for c in FEATURES))
def column_medians(spark, sf):
    return rounded(qu.quantile_table(fx.features(spark, sf), FEATURES, [0.5]), 6, "value").select("feature", "value")


@query(f"with {FEATURES_SQL}\n" + " union all ".join(
    f"select '{c}' as feature, {p}::double as prob, round(quantile_cont({c}, {p}), 6) as value from features"
    for c in FEATURES for p in (0.25, 0.99, 0.995)))
def column_percentiles(spark, sf):
    return rounded(qu.quantile_table(fx.features(spark, sf), FEATURES, [0.25, 0.99, 0.995]), 6, "value")


PROBS = (0.01, 0.25, 0.5, 0.99)


@query(f"with {FEATURES_SQL}\n" + " union all ".join(
    f"select '{c}' as feature, {p}::double as prob, count({c}) as n, 1 as near from features" for c in FEATURES for p in PROBS))
def column_percentiles_approx(spark, sf):
    """Whether the sketch's quantiles lie within their rank error, by the exact ranks of their values."""
    df = staged(fx.features(spark, sf).select(*FEATURES), "features")
    found = qu.approx_quantiles(df, FEATURES, PROBS, 1e-3)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in FEATURES])
    long = df.select(F.explode(cells).alias("e")).select("e.*").where("x is not null")
    ranks = long.join(found, "feature").groupBy("feature", "prob").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    slack, spot = F.col("n") * 1e-3 + 1, F.col("n") * F.col("prob")
    return ranks.select("feature", "prob", "n", ((F.col("below") <= spot + slack) & (F.col("upto") >= spot - slack)).cast("int").alias("near"))


@query(f"""with {FEATURES_SQL}, m as (select {MEDIANS_SQL} from features where binary_label = 0)
select f.sample_id, {', '.join(f'round(coalesce(f.{c}, m.{c}), 6) as {c}' for c in FEATURES)} from features f, m""")
def impute_benign_medians(spark, sf):
    df = fx.features(spark, sf)
    medians = clean.column_medians(df.where("binary_label = 0"), FEATURES)
    return rounded(clean.impute(df, medians).select("sample_id", *FEATURES), 6, *FEATURES)


@query(f"""with {FEATURES_SQL}, m as (select {MEDIANS_SQL} from features)
select f.sample_id, {', '.join(f'round(coalesce(f.{c}, m.{c}), 6) as {c}' for c in FEATURES)} from features f, m""")
def impute_own_medians(spark, sf):
    return rounded(clean.impute_own(fx.features(spark, sf), FEATURES).select("sample_id", *FEATURES), 6, *FEATURES)


@query(f"""with {FEATURES_SQL}, s as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as d_{c}' for c in FEATURES)}
  from features where binary_label = 0)
select f.sample_id, {', '.join(f'round((f.{c} - s.m_{c}) / s.d_{c}, 7) as {c}' for c in FEATURES)} from features f, s""")
def standardise(spark, sf):
    df = fx.features(spark, sf)
    stats = clean.scale_stats(df.where("binary_label = 0"), FEATURES)
    return rounded(clean.standardise(df, stats).select("sample_id", *FEATURES), 7, *FEATURES)


# --- trace tables and splits ---------------------------------------------------


@query(f"with {FLOWS_SQL} select sample_id, label, binary_label, source_ip, destination_ip, destination_port, flow_ts from flows")
def trace_metadata(spark, sf):
    return ed.trace_metadata(fx.flows(spark, sf), SNAKE)


def quota_sql(source: str, label: str, tag: str) -> str:
    """Largest-remainder quotas and hash-ordered split as SQL."""
    return f"""
{tag}_c as (select cast({label} as varchar) as cls, count(*) as n from {source} group by 1),
{tag}_t as (select cls, n, (floor(0.7::double * sum(n) over ())::double * n) / sum(n) over () as x,
         floor(0.7::double * sum(n) over ()) as take from {tag}_c),
{tag}_a as (select *, cast(floor(x) as bigint) + case when row_number() over (order by x - floor(x) desc, cls)
         <= take - sum(floor(x)) over () then 1 else 0 end as train from {tag}_t),
{tag}_r as (select *, n - train as rest, floor((0.15::double / (1.0::double - 0.7::double)) * sum(n - train) over ()) as take2 from {tag}_a),
{tag}_v as (select *, take2 * rest / sum(rest) over () as y from {tag}_r),
{tag}_q as (select cls, train, cast(floor(y) as bigint) + case when row_number() over (order by y - floor(y) desc, cls)
         <= take2 - sum(floor(y)) over () then 1 else 0 end as val from {tag}_v),
{tag}_o as (select sample_id, cast({label} as varchar) as cls, row_number() over (partition by {label}
         order by ('0x' || substr(md5(concat(sample_id, '-42')), 1, 15))::bigint, sample_id) as rn from {source}),
{tag} as (select sample_id, case when rn <= train then 'train' when rn <= train + val then 'val' else 'test' end as split
         from {tag}_o join {tag}_q using (cls))"""


@query(f"""with {FEATURES_SQL}, {quota_sql('features', 'binary_label', 'b')}, {quota_sql('features', 'label', 'm')}
select f.sample_id, b.split as split_binary, m.split as split_multiclass
from features f join b using (sample_id) join m using (sample_id)""")
def split_rows(spark, sf):
    return sp.split_flows(fx.features(spark, sf), PREPARE).select("sample_id", "split_binary", "split_multiclass")


@query(f"""with {FLOWS_SQL}, {quota_sql('flows', 'label', 'm')}
select m.split, f.label, count(*) as n from flows f join m using (sample_id) group by all""")
def split_counts(spark, sf):
    return sp.label_counts(sp.stratified_split(fx.flows(spark, sf), "label", "split", PREPARE), "split", "label")


@query(f"""with {FLOWS_SQL}, s as (
  select sample_id, 'train' as split_binary from flows where flow_value < 50 union all
  select sample_id, 'test' from flows where flow_value >= 50 and flow_value < 100)
select f.sample_id, f.source_ip, coalesce(s.split_binary, 'unknown') as split_binary from flows f left join s using (sample_id)""")
def attach_split(spark, sf):
    df = fx.flows(spark, sf)
    parts = {"train": df.where("flow_value < 50"), "test": df.where("flow_value >= 50 and flow_value < 100")}
    return sp.attach_split(df.select("sample_id", "source_ip"), sp.union_splits(parts, "split_binary", SNAKE), "split_binary", SNAKE)


@query(f"with {FLOWS_SQL} select row_number() over (order by label) - 1 as code, label from (select distinct label from flows)")
def label_mapping(spark, sf):
    return sp.label_mapping(fx.flows(spark, sf), SNAKE).withColumn("code", F.col("code").cast("long"))


@query(f"with {FLOWS_SQL} select label, binary_label, count(*) as n from flows group by all")
def label_dist(spark, sf):
    return sp.label_counts(fx.flows(spark, sf), "label", "binary_label")


@query(f"""with {FLOWS_SQL} select count(*) filter (where binary_label = 0) as n_neg, count(*) filter (where binary_label = 1) as n_pos,
  round(count(*) filter (where binary_label = 0)::double / greatest(count(*) filter (where binary_label = 1), 1), 9) as pos_weight from flows""")
def class_balance(spark, sf):
    return rounded(sp.class_balance(fx.flows(spark, sf), SNAKE), 9, "pos_weight")


EDGE_AGG_SQL = """count(*) as flow_count, cast(sum(binary_label) as bigint) as attack_flow_count, min(flow_ts) as first_seen,
  max(flow_ts) as last_seen, round(sum(binary_label)::double / count(*), 9) as attack_flow_ratio"""


@query(f"""with {FLOWS_SQL} select source_ip as src_node, destination_ip as dst_node, 'ip' as src_node_type, 'ip' as dst_node_type,
  destination_port, {EDGE_AGG_SQL} from flows group by source_ip, destination_ip, destination_port""")
def edge_table(spark, sf):
    return rounded(ed.edge_table(fx.flows(spark, sf), SNAKE), 9, "attack_flow_ratio")


@query(f"""with {FLOWS_SQL} select label as src_node, cast(sample_id % 500 as varchar) as dst_node, 'file' as src_node_type, 'flow' as dst_node_type,
  {EDGE_AGG_SQL} from flows group by 1, 2""")
def edge_table_by_file_flow(spark, sf):
    df = fx.flows(spark, sf).drop("destination_ip").withColumns(
        {"source_file": F.col("label"), "flow_id": (F.col("sample_id") % 500).cast("string")})
    return rounded(ed.edge_table(df, SNAKE), 9, "attack_flow_ratio")


@query(f"with {FLOWS_SQL} select source_ip as src_node, destination_ip as dst_node, min(flow_ts) as first_seen, max(flow_ts) as last_seen from flows group by 1, 2")
def edge_first_last_seen(spark, sf):
    df = fx.flows(spark, sf).drop("destination_port")
    return ed.edge_table(df, SNAKE).select("src_node", "dst_node", "first_seen", "last_seen")


@query(f"with {FLOWS_SQL} select source_ip as src_node, destination_ip as dst_node, round(sum(binary_label)::double / count(*), 9) as attack_flow_ratio from flows group by 1, 2")
def edge_attack_ratio(spark, sf):
    df = fx.flows(spark, sf).drop("destination_port")
    return rounded(ed.edge_table(df, SNAKE).select("src_node", "dst_node", "attack_flow_ratio"), 9, "attack_flow_ratio")


@query(f"""with {FLOWS_SQL} select label as src_node, coalesce(cast(nullif(destination_port, 7) as varchar), 'nan') as dst_node, 'file' as src_node_type, 'port' as dst_node_type,
  {EDGE_AGG_SQL} from flows group by 1, 2""")
def edge_table_by_file_port(spark, sf):
    df = fx.flows(spark, sf).drop("source_ip", "destination_ip").withColumn("source_file", F.col("label")).withColumn(
        "destination_port", F.when(F.col("destination_port") != 7, F.col("destination_port")))
    return rounded(ed.edge_table(df, SNAKE), 9, "attack_flow_ratio")


@query(f"with {FLOWS_SQL} select sample_id, row_number() over (order by flow_value, sample_id) - 1 as row_index from flows")
def row_index(spark, sf):
    df = fx.flows(spark, sf).select("sample_id", "flow_value")
    return ordering.row_numbers(df, [F.col("flow_value").asc(), F.col("sample_id").asc()], "row_index").drop("flow_value")


@query(f"""with {FLOWS_SQL} select sample_id, label from flows
order by ('0x' || substr(md5(concat(sample_id, '-42')), 1, 15))::bigint, sample_id limit 777""")
def sample_exact(spark, sf):
    return qu.sample_exact(fx.flows(spark, sf).select("sample_id", "label"), 777, seed=42)


@query(ORACLES["sample_exact"])
def sample_small(spark, sf):
    return qu.sample_small(fx.flows(spark, sf).select("sample_id", "label"), 777, seed=42)


@query(f"with {FLOWS_SQL} select sample_id, source_ip, flow_value from flows order by sample_id limit 500")
def first_rows(spark, sf):
    return rc.first_rows(fx.flows(spark, sf), 500).select("sample_id", "source_ip", "flow_value")


# --- alerts --------------------------------------------------------------------


@query(f"""with {ALERTS_SQL}
select sample_id, alert_level_code, alert_level, final_binary, round(risk_score, 9) as risk_score,
  case alert_level_code when 3 then 'rf+unsup' when 2 then 'rf' when 1 then 'suspect' else 'benign' end as detection_source from alerts""")
def alert_levels(spark, sf):
    out = fx.alerts(spark, sf).select("sample_id", "alert_level_code", "alert_level", "final_binary", "risk_score", "detection_source")
    return rounded(out, 9, "risk_score")


@query(f"""with {ALERTS_SQL}
select sample_id, binary_label as y_true, round_even(rf_prob, 6) as rf_prob, round_even(unsup_score, 6) as unsup_score, alert_level,
  alert_level_code, final_binary, round_even(risk_score, 6) as risk_score, 'suspect' as detection_source
from alerts where alert_level = 'MEDIUM'""")
def medium_export(spark, sf):
    return al.medium_flows(al.prediction_table(fx.alerts(spark, sf), "binary_label"))


@query(f"""with {ALERTS_SQL}, lv as (select * from (values ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) t(alert_level))
select lv.alert_level, count(a.sample_id) as count, cast(coalesce(sum(a.binary_label), 0) as bigint) as attacks,
  round_even(coalesce(sum(a.binary_label)::double / nullif(count(a.sample_id), 0), 0), 6) as attack_ratio,
  round_even(count(a.sample_id)::double / (select count(*) from alerts) * 100, 2) as pct
from lv left join alerts a using (alert_level) group by 1""")
def alert_distribution(spark, sf):
    return al.alert_distribution(fx.alerts(spark, sf), "binary_label")


@query(f"""with {ALERTS_SQL}, c as (select count(*) filter (where alert_level_code = 1) as medium_total,
  count(*) filter (where alert_level_code = 1 and binary_label = 1) as medium_attacks,
  count(*) filter (where rf_prob < 0.5::double and binary_label = 1) as rf_fn_total,
  count(*) filter (where rf_prob < 0.5::double and binary_label = 1 and alert_level_code = 1) as rescued_by_medium,
  count(*) filter (where final_binary = 1 and binary_label = 1) as tp, count(*) filter (where binary_label = 1) as atk from alerts)
select medium_total, medium_attacks, round_even(medium_attacks::double / medium_total, 4) as medium_attack_ratio, rf_fn_total,
  rescued_by_medium, round_even(rescued_by_medium::double / greatest(rf_fn_total, 1), 4) as rescue_rate,
  round_even((tp + medium_attacks)::double / atk, 6) as extended_recall from c""")
def medium_analysis(spark, sf):
    return al.medium_analysis(fx.alerts(spark, sf), "binary_label")


@query(f"""with {ALERTS_SQL} select trim(label) as attack_type, count(*) as total,
  count(*) filter (where alert_level = 'LOW') as low, count(*) filter (where alert_level = 'MEDIUM') as medium,
  count(*) filter (where alert_level = 'HIGH') as high, count(*) filter (where alert_level = 'CRITICAL') as critical,
  count(*) filter (where final_binary = 1) as detected, round_even(count(*) filter (where final_binary = 1)::double / count(*), 4) as recall
from alerts where trim(label) <> 'BENIGN' group by 1""")
def per_attack(spark, sf):
    return al.per_attack_levels(fx.alerts(spark, sf), "label")


@query(f"""with {ALERTS_SQL} select trim(label) as attack_type, count(*) as total, count(*) filter (where unsup_score >= 0.7::double) as detected,
  round_even(count(*) filter (where unsup_score >= 0.7::double)::double / count(*), 4) as recall from alerts group by 1""")
def per_class_recall(spark, sf):
    return al.per_class_recall(fx.alerts(spark, sf), "unsup_score", 0.7, "label")


def confusion_sql(name: str, pred: str) -> str:
    return f"""select '{name}' as name, count(*) filter (where binary_label = 0 and not {pred}) as tn, count(*) filter (where binary_label = 0 and {pred}) as fp,
  count(*) filter (where binary_label = 1 and not {pred}) as fn, count(*) filter (where binary_label = 1 and {pred}) as tp from alerts"""


def auc_sql(score: str, source: str = "alerts", y: str = "binary_label") -> str:
    """Rank-sum area with ties at one half."""
    return f"""(select (sum(case when y = 1 then r else 0 end) - p * (p + 1) / 2) / (p * q) from (
      select {y} as y, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0::double as r,
      sum({y}) over ()::double as p, (count(*) over () - sum({y}) over ())::double as q from {source}) group by p, q)"""


RATES_SQL = """round((tp + tn)::double / (tp + tn + fp + fn), 9) as accuracy, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 9) as precision,
  round(coalesce(tp::double / nullif(tp + fn, 0), 0), 9) as recall, round(coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0), 9) as f1,
  round(coalesce(fp::double / nullif(fp + tn, 0), 0), 9) as fpr"""
METRICS_SQL = f"""{ALERTS_SQL}, c as ({confusion_sql('rf_alone', 'rf_prob >= 0.5::double')} union all {confusion_sql('ensemble', 'final_binary = 1')}),
m as (select name, tn, fp, fn, tp, {RATES_SQL}, round(case name when 'rf_alone' then {auc_sql('rf_prob')} else {auc_sql('risk_score')} end, 9) as auc from c)"""
RATE_NAMES = ("accuracy", "precision", "recall", "f1", "fpr", "auc")


@query(f"with {METRICS_SQL} select * from m")
def confusion_metrics(spark, sf):
    return rounded(al.detector_metrics(fx.alerts(spark, sf), "binary_label"), 9, *RATE_NAMES)


@query(f"with {METRICS_SQL}, p as (" + " union all ".join(
    f"select '{m}' as metric, max({m}) filter (where name = 'rf_alone') as base_value, max({m}) filter (where name = 'ensemble') as other_value from m"
    for m in RATE_NAMES) + ") select metric, base_value, other_value, round(other_value - base_value, 7) as delta from p")
def model_compare(spark, sf):
    out = rounded(al.detector_comparison(fx.alerts(spark, sf), "binary_label"), 9, "base_value", "other_value")
    return rounded(out, 7, "delta")


@query(f"""with {ALERTS_SQL}, k as (select * from (values (0), (1)) t(c)),
e as (select c, count(*) filter (where binary_label = c) as support, count(*) filter (where final_binary = c) as said,
  count(*) filter (where binary_label = c and final_binary = c) as hit from alerts, k group by c),
r as (select cast(c as varchar) as class, hit::double / said as precision, hit::double / support as recall, 2.0::double * hit / (said + support) as f1, support from e),
u as (select * from r union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from r
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), cast(sum(support) as bigint) from r)
select class, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from u""")
def class_report(spark, sf):
    return rounded(cu.class_report(fx.alerts(spark, sf), "binary_label", "final_binary"), 9, "precision", "recall", "f1")


# --- curves --------------------------------------------------------------------

CUM_SQL = FLOWS_SQL + """,
g as (select rf_prob as score, sum(binary_label) as pos, count(*) - sum(binary_label) as neg from flows group by 1),
cum as (select score, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, (select sum(pos) from g) as p, (select sum(neg) from g) as q
  from g window w as (order by score desc)),
pr as (select score as threshold, tp::double / (tp + fp) as precision, tp::double / p as recall from cum)"""


@query(f"""with {CUM_SQL} select threshold, round(precision, 9) as precision, round(recall, 9) as recall
from (select * from pr union all select null, 1, 0)""")
def pr_curve(spark, sf):
    return rounded(cu.pr_curve(fx.flows(spark, sf), "rf_prob", "binary_label"), 9, "precision", "recall")


@query(f"""with {CUM_SQL}, s as (select recall as r, precision as pc, coalesce(lag(recall) over w, 0) as r0, coalesce(lag(precision) over w, 1) as p0
  from pr window w as (order by threshold desc)) select round(sum((r - r0) * (pc + p0) / 2), 8) as pr_area from s""")
def pr_area(spark, sf):
    return rounded(cu.pr_area(fx.flows(spark, sf), "rf_prob", "binary_label"), 8, "pr_area")


@query(f"""with {CUM_SQL}, n as (select *, lead(pos) over w as np, lead(neg) over w as nn, row_number() over w as rn from cum window w as (order by score desc))
select threshold, round(fpr, 9) as fpr, round(tpr, 9) as tpr from (
  select score as threshold, fp::double / q as fpr, tp::double / p as tpr from n where rn = 1 or np is null or np <> pos or nn <> neg
  union all select null, 0, 0)""")
def roc_curve(spark, sf):
    return rounded(cu.roc_curve(fx.flows(spark, sf), "rf_prob", "binary_label"), 9, "fpr", "tpr")


@query(f"with {FLOWS_SQL} select round({auc_sql('unsup_score', 'flows')}, 9) as auc")
def roc_auc(spark, sf):
    return rounded(cu.roc_auc(fx.flows(spark, sf), "unsup_score", "binary_label"), 9, "auc")


@query(f"""with {ALERTS_SQL}, t as (select * from (values {numbers([i / 100 if i == 100 else i * (1.0 / 100) for i in range(101)])}) v(i, threshold)),
c as (select threshold, count(*) filter (where risk_score >= threshold and binary_label = 1) as tp, count(*) filter (where risk_score >= threshold and binary_label = 0) as fp,
  count(*) filter (where binary_label = 1) as p, count(*) filter (where binary_label = 0) as q from alerts, t group by 1)
select round(threshold, 9) as threshold, round(fp::double / q, 9) as fpr, round(tp::double / p, 9) as recall, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 9) as precision from c""")
def threshold_sweep(spark, sf):
    return rounded(cu.threshold_sweep(fx.alerts(spark, sf), "risk_score", "binary_label"), 9, "threshold", "fpr", "recall", "precision")


@query(f"""with {ALERTS_SQL}, b as (select ({' + '.join(f'(case when s > {i / 10!r}::double then 1 else 0 end)' for i in range(1, 10))}) as bin, s, binary_label
  from (select least(greatest(rf_prob, 0), 1) as s, binary_label from alerts))
select bin, count(*) as n, round(avg(s), 9) as mean_score, round(avg(binary_label), 9) as positive_rate from b group by 1""")
def calibration_bins(spark, sf):
    return rounded(cu.calibration_bins(fx.alerts(spark, sf), "rf_prob", "binary_label"), 9, "mean_score", "positive_rate")


@query(f"""with {ALERTS_SQL}, r as (select binary_label, min(unsup_score) as lo, max(unsup_score) as hi from alerts group by 1),
b as (select binary_label, least(cast(floor((unsup_score - lo) / (hi - lo) * 40) as int), 39) as bin, lo, (hi - lo) / 40 as width from alerts join r using (binary_label)),
c as (select binary_label, bin, any_value(lo) as lo, any_value(width) as width, count(*) as n from b group by 1, 2)
select binary_label, bin, round(lo + bin * width, 9) as bin_start, n, round(n / (sum(n) over (partition by binary_label) * width), 9) as density from c""")
def score_histogram(spark, sf):
    return rounded(cu.histogram(fx.alerts(spark, sf), "unsup_score", 40, by=["binary_label"]), 9, "bin_start", "density")


@query(f"""with {ALERTS_SQL}, c as (select binary_label, least(cast(floor(risk_score * 40) as int), 39) as bin, count(*) as n from alerts where risk_score between 0 and 1 group by 1, 2)
select binary_label, bin, round(bin * 0.025::double, 9) as bin_start, n, round(n / (sum(n) over (partition by binary_label) * 0.025::double), 9) as density from c""")
def risk_histogram(spark, sf):
    return rounded(cu.histogram(fx.alerts(spark, sf), "risk_score", 40, 0.0, 1.0, by=["binary_label"]), 9, "bin_start", "density")


@query(f"""with {FLOWS_SQL}, r as (select min(flow_value) as lo, max(flow_value) as hi, least(50, greatest(10, count(*) // 20)) as k from flows),
b as (select least(cast(floor((flow_value - lo) / (hi - lo) * k) as int), cast(k as int) - 1) as bin, lo, (hi - lo) / k as width from flows, r),
c as (select bin, any_value(lo) as lo, any_value(width) as width, count(*) as n from b group by 1)
select bin, round(lo + bin * width, 7) as bin_start, n, round(n / (sum(n) over () * width), 9) as density from c""")
def latency_histogram(spark, sf):
    return rounded(rounded(cu.latency_histogram(fx.flows(spark, sf), "flow_value"), 7, "bin_start"), 9, "density")


# --- thresholds ----------------------------------------------------------------

HP = "coalesce((select threshold from pr where precision >= {t}::double order by recall desc, threshold limit 1), (select threshold from pr order by precision desc, threshold limit 1))"
HR = "coalesce((select threshold from pr where recall >= {t}::double order by precision desc, threshold limit 1), (select threshold from pr order by recall desc, threshold limit 1))"
BF = "(select threshold from pr order by case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end desc, threshold limit 1)"


def _thresholds(spark, sf, p, r):
    return th.curve_thresholds(cu.pr_curve(fx.flows(spark, sf), "rf_prob", "binary_label"), p, r)


@query(f"with {CUM_SQL} select {HP.format(t=0.995)} as high_precision, {HP.format(t=0.4)} as reachable")
def threshold_hp(spark, sf):
    curve = staged(cu.pr_curve(fx.flows(spark, sf), "rf_prob", "binary_label"), "curve")
    strict = th.curve_thresholds(curve, 0.995, 0.995).first().high_precision
    return th.curve_thresholds(curve, 0.4, 0.995).select(F.lit(strict).alias("high_precision"), F.col("high_precision").alias("reachable"))


@query(f"with {CUM_SQL} select {HR.format(t=0.995)} as high_recall")
def threshold_hr(spark, sf):
    return _thresholds(spark, sf, 0.995, 0.995).select("high_recall")


@query(f"with {CUM_SQL} select {BF} as best_f1")
def threshold_f1(spark, sf):
    return _thresholds(spark, sf, 0.995, 0.995).select("best_f1")


@query(f"""with {CUM_SQL}, t as (select round((select quantile_cont(rf_prob, 0.99) from flows where binary_label = 0), 12) as "default",
  {HP.format(t=0.995)} as high_precision, {HR.format(t=0.995)} as high_recall, {BF} as best_f1) select * from t""")
def threshold_bundle(spark, sf):
    return rounded(th.threshold_bundle(fx.flows(spark, sf), "rf_prob", "binary_label"), 12, "default")


@query(f"""with {CUM_SQL}, alerts as (select * from flows), c as ({confusion_sql('default', 'rf_prob >= 0.5::double')}
  union all {confusion_sql('high_recall', 'rf_prob >= ' + HR.format(t=0.995))} union all {confusion_sql('best_f1', 'rf_prob >= ' + BF)})
select name, tn, fp, fn, tp, {RATES_SQL}, round({auc_sql('rf_prob')}, 9) as auc from c""")
def threshold_metrics(spark, sf):
    df = fx.flows(spark, sf)
    bundle = th.as_dict(th.threshold_bundle(df, "rf_prob", "binary_label", default=0.5))
    bundle.pop("high_precision")
    return rounded(th.evaluate_bundle(df, "rf_prob", "binary_label", bundle), 9, *RATE_NAMES)


# --- calibration and fusion ----------------------------------------------------


@query(f"""with {FLOWS_SQL}, g as (select * from (values {numbers(al.gray_grid())}) v(i, cut)),
c as (select i, cut, avg(binary_label) * ln(1 + count(*)) as goal from g join flows on rf_prob >= cut and rf_prob < 0.5::double group by 1, 2 having count(*) >= 10)
select round(coalesce((select cut from c order by goal desc, i limit 1), 0.15::double), 9) as theta_gray""")
def calibrate_gray(spark, sf):
    return rounded(al.calibrate_gray(fx.flows(spark, sf), "binary_label"), 9, "theta_gray")


@query(f"""with {FLOWS_SQL}, h as (select unsup_score from flows where rf_prob >= 0.5::double and binary_label = 1), t as (select quantile_cont(unsup_score, 0.25) as q from h)
select round((select q from t), 9) as theta_unsup_high, round(avg(case when unsup_score >= (select q from t) then 1.0::double else 0 end), 9) as critical_share from h""")
def calibrate_high(spark, sf):
    return rounded(al.calibrate_high(fx.flows(spark, sf), "binary_label"), 9, "theta_unsup_high", "critical_share")


@query(f"""with {FLOWS_SQL}, l as (select unsup_score, binary_label from flows where rf_prob < 0.15::double),
g as (select * from (values {numbers(al.extreme_grid())}) v(i, cut)),
c as (select i, cut, sum(binary_label) as atk from g join l on unsup_score >= cut group by 1, 2 having count(*) >= 3 and avg(binary_label) >= 0.3::double and sum(binary_label) > 0)
select round(coalesce((select cut from c order by atk desc, i limit 1), (select quantile_cont(unsup_score, 0.995) from l)), 9) as theta_unsup_extreme""")
def calibrate_extreme(spark, sf):
    return rounded(al.calibrate_extreme(fx.flows(spark, sf), "binary_label"), 9, "theta_unsup_extreme")


SCORES_SQL = FLOWS_SQL + """,
scored as (select sample_id, binary_label as y, rf_prob as a, unsup_score as b, flow_value + destination_port as c from flows),
rng as (select min(a) as la, max(a) - min(a) as wa, min(b) as lb, max(b) - min(b) as wb, min(c) as lc, max(c) - min(c) as wc from scored),
n as (select y, (a - la) / wa as a, (b - lb) / wb as b, (c - lc) / wc as c from scored, rng)"""


def scored(spark, sf):
    return fx.flows(spark, sf).select(
        "sample_id", F.col("binary_label").alias("y"), F.col("rf_prob").alias("a"), F.col("unsup_score").alias("b"),
        (F.col("flow_value") + F.col("destination_port")).alias("c"))


def weights_sql(grid, names) -> str:
    ws = ", ".join(f"w{j + 1}" for j in range(len(names)))
    rows = ", ".join("(" + ", ".join([str(i), *[f"{w!r}::double" for w in g]]) + ")" for i, g in enumerate(grid))
    fused = " + ".join(f"w{j + 1} * {s}" for j, s in enumerate(names))
    return f"""with {SCORES_SQL}, g as (select * from (values {rows}) v(i, {ws})),
f as (select i, {ws}, y, {fused} as s from n, g),
d as (select i, {ws}, s, sum(y) as pos, count(*) - sum(y) as neg from f group by all),
e as (select *, sum(neg) over (partition by i order by s) - neg as under from d),
auc as (select i, {ws}, sum(pos * (under + neg / 2.0::double)) / (sum(pos)::double * sum(neg)) as auc from e group by all)
select {ws}, round(auc, 9) as auc from auc order by auc.auc desc, i limit 1"""


@query(weights_sql(fu.grid_two(), ["a", "b"]))
def weights_2(spark, sf):
    return rounded(fu.search_weights(scored(spark, sf), ["a", "b"], "y", fu.grid_two()), 9, "auc")


@query(weights_sql(fu.grid_three(), ["a", "b", "c"]))
def weights_3(spark, sf):
    return rounded(fu.search_weights(scored(spark, sf), ["a", "b", "c"], "y", fu.grid_three()), 9, "auc")


@query(weights_sql(fu.grid_three_rest(), ["a", "b", "c"]))
def weights_3_fusion(spark, sf):
    return rounded(fu.search_weights(scored(spark, sf), ["a", "b", "c"], "y", fu.grid_three_rest(), clip=True, flat=1e-12), 9, "auc")


PAIRS = {"A+B": ["a", "b"], "A+C": ["a", "c"], "B+C": ["b", "c"], "A+B+C": ["a", "b", "c"]}


def fusions_sql() -> str:
    parts = []
    for i, (name, cols) in enumerate(PAIRS.items()):
        grid = fu.grid_two() if len(cols) == 2 else fu.grid_three()
        parts.append(f"select {i} as pos, '{name}' as name, auc from ({weights_sql(grid, cols)})")
    return f"select name, auc, case when row_number() over (order by auc desc, pos) = 1 then 1 else 0 end as is_best from ({' union all '.join(parts)})"


@query(fusions_sql())
def fusion_choice(spark, sf):
    found = fu.compare_fusions(staged(scored(spark, sf), "scored"), PAIRS, "y")
    best = fu.best_fusion(found)
    return local_table(spark, [(n, round(a, 9), int(i == best)) for i, (n, _, a) in enumerate(found)], "name string, auc double, is_best int")


@query(f"""with {SCORES_SQL}, ref as (select min(a) as la, max(a) - min(a) as wa, min(b) as lb, max(b) - min(b) as wb, min(c) as lc, max(c) - min(c) as wc from scored where y = 0)
select sample_id, round(0.5::double * least(greatest((a - la) / wa, 0), 1) + 0.3::double * least(greatest((b - lb) / wb, 0), 1)
  + 0.2::double * least(greatest((c - lc) / wc, 0), 1), 9) as fused from scored, ref""")
def minmax_fuse(spark, sf):
    df = scored(spark, sf)
    ranges = fu.score_ranges(df.where("y = 0"), ["a", "b", "c"])
    return rounded(fu.fuse(df, ["a", "b", "c"], (0.5, 0.3, 0.2), ranges, "fused", clip=True, flat=1e-12).select("sample_id", "fused"), 9, "fused")


# --- source summaries ----------------------------------------------------------


@query(f"""with {FLOWS_SQL}, p as (select source_ip, binary_label as y_true, rf_prob as attack_prob, case when rf_prob >= 0.5::double then 1 else 0 end as d,
  case when rf_prob >= 0.9::double then 1 else 0 end as hp, case when rf_prob >= 0.1::double then 1 else 0 end as hr from flows),
s as (select source_ip, count(*) as total_flows, cast(sum(d) as bigint) as pred_attack_flows_default, avg(d) as rd, avg(hp) as rp, avg(hr) as rr,
  avg(attack_prob) as ap, avg(y_true) as tr from p group by 1)
select source_ip, total_flows, pred_attack_flows_default, round(rd, 10) as pred_attack_ratio_default, round(rp, 10) as pred_attack_ratio_high_precision,
  round(rr, 10) as pred_attack_ratio_high_recall, round(ap, 10) as avg_attack_prob, round(tr, 10) as true_attack_ratio,
  case when rd >= 0.5::double then 1 else 0 end as ip_is_attack_default, case when rp >= 0.5::double then 1 else 0 end as ip_is_attack_high_precision,
  case when rr >= 0.5::double then 1 else 0 end as ip_is_attack_high_recall from s""")
def source_summary_sup(spark, sf):
    df = fx.flows(spark, sf)
    preds = df.select("sample_id", F.col("binary_label").alias("y_true"), F.col("rf_prob").alias("attack_prob"))
    preds = th.flag_columns(preds, "attack_prob", {"default": 0.5, "high_precision": 0.9, "high_recall": 0.1}, "pred_")
    detail = su.flow_detail(ed.trace_metadata(df, SNAKE), preds, SNAKE)
    ratios = [f"pred_attack_ratio_{n}" for n in ("default", "high_precision", "high_recall")]
    return rounded(su.supervised_summary(detail, SNAKE), 10, *ratios, "avg_attack_prob", "true_attack_ratio")


@query(f"""with {FLOWS_SQL}, p as (select source_ip, binary_label as y, unsup_score as s, case when unsup_score >= 0.8::double then 1 else 0 end as d from flows)
select source_ip, count(*) as total_flows, cast(sum(d) as bigint) as attack_flows, round(avg(d), 10) as attack_ratio, round(avg(s), 10) as avg_score,
  round(avg(y), 10) as true_attack_ratio from p group by 1""")
def source_summary_unsup(spark, sf):
    df = fx.flows(spark, sf)
    preds = df.select("sample_id", F.col("binary_label").alias("y_true"), F.col("unsup_score").alias("ae_score"))
    preds = th.flag_columns(preds, "ae_score", {"best_f1": 0.8}, "ae_pred_")
    out = su.unsupervised_summary(su.flow_detail(ed.trace_metadata(df, SNAKE), preds, SNAKE), SNAKE)
    return rounded(out, 10, "attack_ratio", "avg_score", "true_attack_ratio")


SUMMARY_SQL = ALERTS_SQL + """,
summary as (select source_ip, count(*) as total_flows, cast(sum(final_binary) as bigint) as attack_flows, avg(final_binary) as attack_ratio,
  count(*) filter (where alert_level = 'CRITICAL') as critical, count(*) filter (where alert_level = 'HIGH') as high,
  count(*) filter (where alert_level = 'MEDIUM') as medium, avg(risk_score) as avg_risk, avg(rf_prob) as avg_rf_prob, avg(unsup_score) as avg_unsup
  from alerts group by 1)"""
MEANS = ("attack_ratio", "avg_risk", "avg_rf_prob", "avg_unsup")
SUMMARY_OUT = "source_ip, total_flows, attack_flows, critical, high, medium, " + ", ".join(f"round({m}, 10) as {m}" for m in MEANS)


@query(f"with {SUMMARY_SQL} select {SUMMARY_OUT} from summary")
def source_summary_ens(spark, sf):
    preds = al.prediction_table(fx.alerts(spark, sf), "binary_label")
    detail = su.flow_detail(ed.trace_metadata(fx.flows(spark, sf), SNAKE), preds, SNAKE)
    return rounded(su.ensemble_summary(detail, SNAKE), 10, *MEANS)


@query(f"with {SUMMARY_SQL} select {SUMMARY_OUT} from summary order by summary.attack_ratio desc, source_ip limit 10")
def top_sources(spark, sf):
    return rounded(su.top_sources(su.ensemble_summary(fx.alerts(spark, sf), SNAKE), "attack_ratio", 10, SNAKE), 10, *MEANS)


# --- attack graph --------------------------------------------------------------

EDGES_SQL = """edges as (select source_ip as src, destination_ip as dst, sum(risk_score) as weight from alerts where alert_level <> 'LOW' group by 1, 2)"""


@query(f"with {ALERTS_SQL}, {EDGES_SQL} select src, dst, round(weight, 9) as weight from edges")
def attack_edges(spark, sf):
    return rounded(gr.weighted_edges(fx.alerts(spark, sf), SNAKE), 9, "weight")


@query(f"""with {ALERTS_SQL}, l as (select source_ip as src, destination_ip as dst, alert_level, count(*) as n, avg(risk_score) as risk, avg(rf_prob) as rf
  from alerts where alert_level <> 'LOW' group by 1, 2, 3)
select src, dst, cast(sum(n) as bigint) as flow_count, round(min_by(risk, alert_level), 10) as avg_risk, round(min_by(rf, alert_level), 10) as avg_rf,
  cast(sum(case alert_level when 'CRITICAL' then n else 0 end) as bigint) as critical, cast(sum(case alert_level when 'HIGH' then n else 0 end) as bigint) as high,
  cast(sum(case alert_level when 'MEDIUM' then n else 0 end) as bigint) as medium from l group by 1, 2""")
def attack_graph(spark, sf):
    return rounded(gr.attack_graph(fx.alerts(spark, sf), SNAKE), 10, "avg_risk", "avg_rf")


PAGERANK_SQL = f"""{SUMMARY_SQL}, {EDGES_SQL},
strength as (select src, sum(weight) as s from edges group by 1),
links as (select e.src, e.dst, e.weight / s.s as p from edges e join strength s using (src)),
vert as (select node, s.s is null as dangling, count(*) over ()::double as n from (select src as node from edges union select dst from edges) v left join strength s on s.src = v.node),
pr as (
  select 0 as it, node, 1 / n as rank, cast(null as double) as err from vert
  union all
  select it + 1, node, fresh, sum(abs(fresh - rank)) over () from (
    select r.it, r.node, r.rank, 0.85::double * (coalesce(g.got, 0) + sum(case when v.dangling then r.rank else 0 end) over () / v.n) + 0.15::double / v.n as fresh
    from pr r join vert v on v.node = r.node
    left join (select l.dst, sum(l.p * q.rank) as got from pr q join links l on l.src = q.node group by 1) g on g.dst = r.node
    where r.it < 100 and (r.err is null or r.err >= v.n * 1e-6::double))),
ranks as (select node, rank as pagerank from pr where it = (select max(it) from pr))"""


@query(f"with recursive {PAGERANK_SQL} select node, round(pagerank, 10) as pagerank from ranks")
def pagerank(spark, sf):
    return rounded(gr.pagerank(gr.weighted_edges(fx.alerts(spark, sf), SNAKE), TRACE), 10, "pagerank")


THREAT_SQL = f"""{PAGERANK_SQL},
sev as (select s.*, coalesce(r.pagerank, 0) as pagerank, (3 * critical + 2 * high + medium)::double / greatest(total_flows * 3, 1) as alert_severity_score
  from summary s left join ranks r on r.node = s.source_ip),
nrm as (select *, pagerank / max(pagerank) over () as norm_pagerank from sev),
thr as (select *, 0.35::double * attack_ratio + 0.20::double * norm_pagerank + 0.25::double * avg_risk + 0.20::double * alert_severity_score as threat_score,
  case when attack_ratio >= 0.1::double then 'attacker' when attack_ratio >= 0.001::double then 'suspect' else 'normal' end as role from nrm),
ranking as (select *, row_number() over (order by threat_score desc, source_ip) as rank from thr)"""
RANKING_OUT = "rank, source_ip, role, total_flows, attack_flows, critical, high, medium, round(threat_score, 12) as threat_score, round(pagerank, 10) as pagerank, round(norm_pagerank, 9) as norm_pagerank, round(alert_severity_score, 9) as alert_severity_score"


def ranking_of(df: DataFrame) -> DataFrame:
    ranks = gr.pagerank(gr.weighted_edges(df, SNAKE), TRACE)
    return tr.threat_ranking(su.ensemble_summary(df, SNAKE), ranks, TRACE)


@query(f"with recursive {THREAT_SQL} select {RANKING_OUT} from ranking")
def threat_ranking(spark, sf):
    out = ranking_of(fx.alerts(spark, sf)).select(
        "rank", "source_ip", "role", "total_flows", "attack_flows", "critical", "high", "medium", "threat_score", "pagerank", "norm_pagerank", "alert_severity_score")
    return rounded(rounded(rounded(out, 12, "threat_score"), 10, "pagerank"), 9, "norm_pagerank", "alert_severity_score")


@query(f"with recursive {THREAT_SQL} select rank, source_ip, role, total_flows, critical, high, medium, round(threat_score, 12) as threat_score from ranking where rank <= 20")
def threat_top20(spark, sf):
    top = ranking_of(fx.alerts(spark, sf)).orderBy("rank").limit(20)
    return rounded(top.select("rank", "source_ip", "role", "total_flows", "critical", "high", "medium", "threat_score"), 12, "threat_score")


# The tables below need roles only; the short ranking has no graph part.
ROLES_SQL = f"""{SUMMARY_SQL},
ranking as (select *, row_number() over (order by threat_score desc, source_ip) as rank from (select *,
  0.35::double * attack_ratio + 0.20::double * 0 + 0.25::double * avg_risk + 0.20::double * ((3 * critical + 2 * high + medium)::double / greatest(total_flows * 3, 1)) as threat_score,
  case when attack_ratio >= 0.42::double then 'attacker' when attack_ratio >= 0.36::double then 'suspect' else 'normal' end as role from summary))"""
STRICT = TraceConfig(columns=SNAKE, attacker_ratio=0.42, suspect_ratio=0.36)


def short_ranking(df: DataFrame, cfg: TraceConfig = STRICT) -> DataFrame:
    return staged(tr.threat_ranking(su.ensemble_summary(df, SNAKE), None, cfg), "ranking")


@query(f"""with {ROLES_SQL}, {EDGES_SQL}
select 'total_nodes' as stat, (select count(*) from (select src from edges union select dst from edges)) as n union all
select 'total_edges', (select count(*) from edges) union all select 'total_ips', (select count(*) from ranking) union all
select 'attacker_ips', (select count(*) from ranking where role = 'attacker') union all
select 'suspect_ips', (select count(*) from ranking where role = 'suspect') union all select 'normal_ips', (select count(*) from ranking where role = 'normal')""")
def graph_stats(spark, sf):
    df = fx.alerts(spark, sf)
    return gr.graph_stats(gr.attack_graph(df, SNAKE), short_ranking(df))


CAMP_SQL = f"""{ROLES_SQL}, hot as (select a.* from alerts a join ranking r using (source_ip) where r.role in ('attacker', 'suspect') and alert_level <> 'LOW')"""
ATT = TraceConfig(columns=SNAKE, attacker_ratio=0.36)
CAMP_WHERE = "from hot where upper(trim(label)) <> 'BENIGN'"


@query(f"""with {CAMP_SQL} select source_ip as ip, label as attack_type, count(*) as total_flows, min(flow_ts) as start_time, max(flow_ts) as end_time,
  count(distinct destination_ip) as n_targets {CAMP_WHERE} group by 1, 2""")
def campaigns(spark, sf):
    df = fx.alerts(spark, sf)
    return ca.campaigns(df, short_ranking(df, ATT), SNAKE)


@query(f"""with {CAMP_SQL} select source_ip as ip, 'unknown' as attack_type, count(*) as total_flows, null::timestamp as start_time, null::timestamp as end_time,
  count(distinct destination_ip) as n_targets from hot group by 1""")
def campaigns_unlabelled(spark, sf):
    df = fx.alerts(spark, sf)
    return ca.campaigns(df.drop("label"), short_ranking(df, ATT), SNAKE)


@query(f"""with {CAMP_SQL} select source_ip as ip, label as attack_type, destination_ip as target, count(*) as flows,
  count(*) filter (where alert_level = 'CRITICAL') as critical, count(*) filter (where alert_level = 'HIGH') as high,
  count(*) filter (where alert_level = 'MEDIUM') as medium, concat(source_ip, ' -> ', destination_ip) as path {CAMP_WHERE} group by 1, 2, 3, 8""")
def campaign_targets(spark, sf):
    df = fx.alerts(spark, sf)
    return ca.campaign_targets(df, short_ranking(df, ATT), SNAKE)


@query(f"""with {CAMP_SQL} select r.source_ip as ip, round(any_value(r.threat_score), 9) as threat_score, 'attacker' as role, count(h.sample_id) as total_attack_flows
  from ranking r left join hot h using (source_ip) where r.role in ('attacker', 'suspect') group by 1""")
def campaign_sources(spark, sf):
    df = fx.alerts(spark, sf)
    return rounded(ca.campaign_sources(df, short_ranking(df, ATT), SNAKE), 9, "threat_score")


WATCH_SQL = f"""{ROLES_SQL}, watched as (select source_ip from ranking where role in ('attacker', 'suspect')),
seen as (select a.* from alerts a join watched using (source_ip))"""


@query(f"with {WATCH_SQL} select source_ip, alert_level, count(*) as n from seen group by 1, 2")
def evidence_levels(spark, sf):
    df = fx.alerts(spark, sf)
    return ev.evidence_levels(df, short_ranking(df), STRICT)


@query(f"""with {WATCH_SQL} select source_ip, label as type, count(*) as count from seen where alert_level <> 'LOW' and upper(trim(label)) <> 'BENIGN' group by 1, 2""")
def evidence_types(spark, sf):
    df = fx.alerts(spark, sf)
    return ev.evidence_types(df, short_ranking(df), STRICT)


@query(f"""with {WATCH_SQL}, h as (select source_ip, hour(flow_ts) as hr, count(*) as n from seen where final_binary = 1 group by 1, 2),
k as (select source_ip, cast(hr as int) as peak_attack_hour from h qualify row_number() over (partition by source_ip order by n desc, hr) = 1),
s as (select source_ip, min(flow_ts) as first_seen, max(flow_ts) as last_seen, min(flow_ts) filter (where final_binary = 1) as attack_start,
  max(flow_ts) filter (where final_binary = 1) as attack_end from seen group by 1)
select s.*, k.peak_attack_hour from s left join k using (source_ip)""")
def evidence_time(spark, sf):
    df = fx.alerts(spark, sf)
    return ev.evidence_time(df, short_ranking(df), STRICT)


@query(f"""with {WATCH_SQL}, c as (select source_ip, destination_ip as target, count(*) as attack_flows from seen where alert_level <> 'LOW' group by 1, 2)
select source_ip, target, attack_flows, cast(row_number() over (partition by source_ip order by attack_flows desc, target) as int) as place from c
qualify place <= 10""")
def evidence_targets(spark, sf):
    df = fx.alerts(spark, sf)
    return ev.evidence_targets(df, short_ranking(df), STRICT)


@query(f"""with {WATCH_SQL}, t as (select source_ip, count(distinct label) filter (where alert_level <> 'LOW' and upper(trim(label)) <> 'BENIGN') as n_types,
  count(distinct alert_level) as n_levels, least(count(distinct destination_ip) filter (where alert_level <> 'LOW'), 10) as n_targets, min(flow_ts) as first_seen,
  max(flow_ts) filter (where final_binary = 1) as attack_end from seen group by 1)
select r.source_ip, r.role, r.total_flows, r.attack_flows, round(r.avg_risk, 10) as avg_risk_score, cast(t.n_types as int) as n_types, cast(t.n_levels as int) as n_levels,
  cast(t.n_targets as int) as n_targets, t.first_seen, t.attack_end from ranking r join t using (source_ip)""")
def evidence_chains(spark, sf):
    df = fx.alerts(spark, sf)
    out = ev.evidence_chains(df, short_ranking(df), STRICT)
    return rounded(out.select(
        "source_ip", "role", "total_flows", "attack_flows", "avg_risk_score", F.greatest(F.size("attack_types"), F.lit(0)).alias("n_types"),
        F.size("alert_distribution").alias("n_levels"), F.size("top_targets").alias("n_targets"),
        "time_evidence.first_seen", "time_evidence.attack_end"), 10, "avg_risk_score")


SHOWN = TraceConfig(columns=SNAKE, attacker_ratio=0.42, suspect_ratio=0.36, max_edges=500)
SHOWN_SQL = f"""{ROLES_SQL}, shown as (select source_ip as src, destination_ip as dst, count(*) as flow_count,
  count(*) filter (where alert_level = 'CRITICAL') as critical, count(*) filter (where alert_level = 'HIGH') as high,
  count(*) filter (where alert_level = 'MEDIUM') as medium, avg(risk_score) as avg_risk from alerts where alert_level <> 'LOW'
  group by 1, 2 order by flow_count desc, src, dst limit 500)"""


@query(f"""with {SHOWN_SQL} select src, dst, flow_count, round(greatest(1, least(10, log2(greatest(flow_count, 1)) * 1.5)), 9) as width,
  case when critical::double / greatest(flow_count, 1) > 0.5 then '#e74c3c' when critical::double / greatest(flow_count, 1) > 0.1 then '#f39c12' else '#7f8c8d' end as color,
  printf('%s → %s<br>Flows: %d<br>C=%d H=%d M=%d<br>', src, dst, flow_count, critical, high, medium) as title_head from shown""")
def display_edges(spark, sf):
    out = di.display_edges(fx.alerts(spark, sf), SHOWN)
    head = F.regexp_replace("title", "Avg Risk.*$", "")
    return rounded(out.withColumn("title_head", head).drop("title"), 9, "width")


@query(f"""with {SHOWN_SQL}, e as (select src as node, flow_count as o, 0 as i from shown union all select dst, 0, flow_count from shown),
n as (select node, cast(sum(o) as bigint) as out_flows, cast(sum(i) as bigint) as in_flows from e group by 1),
d as (select n.*, coalesce(r.threat_score, 0) as threat_score, case when coalesce(r.role, 'normal') = 'normal' and in_flows > out_flows then 'victim' else coalesce(r.role, 'normal') end as display_role
  from n left join ranking r on r.source_ip = n.node)
select node, display_role, round(threat_score, 9) as threat_score, out_flows, in_flows,
  case display_role when 'attacker' then '#e74c3c' when 'suspect' then '#f39c12' when 'victim' then '#3498db' else '#95a5a6' end as color,
  round(greatest(10, least(60, 10 + log2(greatest(out_flows + in_flows, 1)) * 5)), 9) as size from d""")
def display_nodes(spark, sf):
    df = fx.alerts(spark, sf)
    return rounded(di.display_nodes(df, short_ranking(df, SHOWN), SHOWN).drop("title"), 9, "threat_score", "size")


@query(f"""with {ROLES_SQL}, top as (select source_ip, rank from ranking where role in ('attacker', 'suspect') order by rank limit 20),
c as (select source_ip, date_trunc('hour', flow_ts) as hour_bin, count(*) as flows from alerts join top using (source_ip) where alert_level <> 'LOW' group by 1, 2),
full_grid as (select s.source_ip, h.hour_bin from (select distinct source_ip from c) s, (select distinct hour_bin from c) h)
select g.source_ip, top.rank, cast(g.hour_bin as timestamp) as hour_bin, coalesce(c.flows, 0) as flows, round(ln(1 + coalesce(c.flows, 0)), 9) as log_flows
from full_grid g join top using (source_ip) left join c using (source_ip, hour_bin)""")
def timeline(spark, sf):
    df = fx.alerts(spark, sf)
    return rounded(di.timeline(df, short_ranking(df), STRICT), 9, "log_flows")


@query(f"""with {ALERTS_SQL}, {EDGES_SQL}, u as (select src, dst from edges union select dst, src from edges),
h1 as (select distinct dst as node from u where src = '10.0.0.8'), h2 as (select distinct dst as node from u where src in (select node from h1))
select node, min(hop) as hop from (select '10.0.0.8' as node, 0 as hop union all select node, 1 from h1 union all select node, 2 from h2) group by 1""")
def khop(spark, sf):
    return gr.neighbourhood(gr.weighted_edges(fx.alerts(spark, sf), SNAKE), "10.0.0.8", 2)


@query(f"""with {ALERTS_SQL}, l as (select source_ip as src, destination_ip as dst, count(*) as flow_count from alerts where alert_level <> 'LOW' group by 1, 2)
select src as node from l where flow_count in (1, 2) union select dst from l where flow_count in (1, 2)""")
def select_edges_by_property(spark, sf):
    return gr.select_edge_ends(gr.attack_graph(fx.alerts(spark, sf), SNAKE), "flow_count", ["1", "2"])


@query(f"with {ROLES_SQL} select source_ip as node from ranking where role in ('attacker', 'suspect')")
def select_nodes_by_property(spark, sf):
    df = fx.alerts(spark, sf)
    return gr.select_nodes(short_ranking(df).withColumn("node", F.col("source_ip")), "role", ["attacker", "suspect"])


# --- matching ------------------------------------------------------------------

LAB_SQL = """
lines as (select l_orderkey as s, l_partkey as d, cast(l_suppkey as int) as x, l_linenumber as y, cast(l_quantity as int) as p, l_returnflag as label from lineitem),
gen as (select s, d, x, y, p, count(*) as n_rows from lines group by all),
ref as (select case when d % 5 = 0 then concat_ws('-', d, s, y, x, p) when d % 5 = 1 then concat_ws('-', d, s, x, y, p) when d % 5 = 2 then concat_ws('-', s, d, x, y, p)
  when d % 5 = 3 then concat_ws('-', s, d, y, x, p) else concat_ws('-', s, d, 'other') end as flow_id, label from lines),
known as (select flow_id, min(label) as label from ref group by 1),
tries as (select s, d, x, y, p, n_rows, 0 as pos, concat_ws('-', d, s, y, x, p) as flow_id from gen union all select s, d, x, y, p, n_rows, 1, concat_ws('-', d, s, x, y, p) from gen
  union all select s, d, x, y, p, n_rows, 2, concat_ws('-', s, d, x, y, p) from gen union all select s, d, x, y, p, n_rows, 3, concat_ws('-', s, d, y, x, p) from gen),
hits as (select t.*, k.label from tries t join known k using (flow_id) qualify row_number() over (partition by s, d, x, y, p order by pos) = 1)"""


def match_tables(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("src_ip"), F.col("l_partkey").cast("string").alias("dst_ip"), F.col("l_suppkey").cast("int").alias("src_port"),
        F.col("l_linenumber").alias("dst_port"), F.col("l_quantity").cast("int").alias("protocol"), F.col("l_returnflag").alias("Label"))
    s, d, x, y, p = (F.col(c).cast("string") for c in rc.FIVE_TUPLE)
    kind = F.col("dst_ip").cast("long") % 5
    flow_id = F.when(kind == 0, F.concat_ws("-", d, s, y, x, p)).when(kind == 1, F.concat_ws("-", d, s, x, y, p)).when(
        kind == 2, F.concat_ws("-", s, d, x, y, p)).when(kind == 3, F.concat_ws("-", s, d, y, x, p)).otherwise(F.concat_ws("-", s, d, F.lit("other")))
    # the label doubles as row id, so the first row of a flow id is known to SQL too
    labelled = lines.select(F.concat(F.lit(" "), flow_id, F.lit(" ")).alias("Flow ID"), "Label", F.col("Label").alias("sample_id"))
    return lines.drop("Label"), labelled


@query(f"with {LAB_SQL} select s as src_ip, d as dst_ip, x as src_port, y as dst_port, p as protocol, g.n_rows, h.flow_id, h.label from gen g left join hits h using (s, d, x, y, p)".replace(
    "select s as src_ip, d as dst_ip", "select cast(s as varchar) as src_ip, cast(d as varchar) as dst_ip"))
def flow_id_match(spark, sf):
    return rc.match_flows(*match_tables(spark, sf))


@query(f"""with {LAB_SQL} select cast(sum(g.n_rows) as bigint) as n_rows, cast(sum(case when h.flow_id is not null then g.n_rows else 0 end) as bigint) as n_matched,
  round(sum(case when h.flow_id is not null then g.n_rows else 0 end)::double / sum(g.n_rows), 9) as hit_rate from gen g left join hits h using (s, d, x, y, p)""")
def flow_id_hit_rate(spark, sf):
    return rounded(rc.match_summary(rc.match_flows(*match_tables(spark, sf))), 9, "hit_rate")


@query(f"with {LAB_SQL} select label, cast(sum(n_rows) as bigint) as n from hits group by 1")
def match_labels(spark, sf):
    return rc.matched_labels(rc.match_flows(*match_tables(spark, sf)))


@query(f"""with {ALERTS_SQL}
select sample_id, alert_level_code, alert_level, final_binary, round(risk_score, 9) as risk_score, case when trim(label) = 'BENIGN' then 0 else 1 end as binary_label from alerts""")
def alert_stream(spark, sf):
    """The alert rule on the events read as a stream."""
    schema = fx.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = streaming_alerts(fx.as_flows(raw).drop("binary_label"), cols=SNAKE)
    path = new_path(spark, "stream")
    columns = ["sample_id", "alert_level_code", "alert_level", "final_binary", "risk_score", "binary_label"]
    out.select(*columns).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-progress").start(
        path, format="parquet", outputMode="append").awaitTermination()
    return rounded(spark.read.parquet(path), 9, "risk_score")


# --- reading and writing -------------------------------------------------------


def written_csvs(spark, sf) -> str:
    """The flows as three CSV folders' worth of files with blank-padded headers."""
    path = new_path(spark, "csv")
    df = fx.flows(spark, sf)
    for i, kind in enumerate(("BENIGN", "DoS", "PortScan")):
        part = df.where(F.col("label") == kind).select(
            F.col("source_ip").alias(" Source IP"), F.col("destination_ip").alias("Destination IP "),
            F.col("destination_port").alias("Destination Port"), F.date_format("flow_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
            F.when(F.col("sample_id") % 10 == 3, "Infinity").otherwise(F.col("flow_value").cast("string")).alias(" Flow Bytes/s"),
            F.col("unsup_score").alias("Flow IAT Max"), F.col("sample_id").alias("Idle Mean"), F.col("label").alias(" Label"))
        part.drop("Flow IAT Max" if i == 2 else "none").write.option("header", True).mode("append").csv(f"{path}/{i}")
    return path


@query(f"""with {FLOWS_SQL}
select source_ip as "Source IP", destination_ip as "Destination IP", destination_port as "Destination Port",
  case when sample_id % 10 = 3 then null else flow_value end as "Flow Bytes/s", case when label = 'PortScan' then null else unsup_score end as "Flow IAT Max",
  sample_id::double as "Idle Mean", label as "Label", binary_label from flows""")
def csv_flows(spark, sf):
    path = written_csvs(spark, sf)
    files = [f for i in range(3) for f in flow_csv.list_csv(spark, f"{path}/{i}")]
    raw = clean.add_binary_label(clean.keep_labelled(flow_csv.read_flow_csvs(spark, files)))
    typed = clean.coerce_numeric(flow_csv.typed_trace_columns(raw), ["Flow Bytes/s", "Flow IAT Max", "Idle Mean"])
    return typed.drop("Timestamp", "source_file", "__block")


@query(f"""with {FLOWS_SQL} select row_number() over (order by sample_id) - 1 as row_id, sample_id::double as n from flows where label = 'DoS'""")
def csv_row_ids(spark, sf):
    path = f"{written_csvs(spark, sf)}/1"
    out = flow_csv.with_sample_id(flow_csv.read_flow_csvs(spark, flow_csv.list_csv(spark, path)), "row_id")
    return out.select("row_id", F.col("Idle Mean").cast("double").alias("n"))


@query(f"""with {FLOWS_SQL} select count(*) as n_rows, 0::bigint as first_id, count(*) - 1 as last_id, count(*) as n_ids from flows""")
def csv_row_ids_all(spark, sf):
    """Row numbers over the files of all folders: dense, none twice."""
    path = written_csvs(spark, sf)
    files = [f for i in range(3) for f in flow_csv.list_csv(spark, f"{path}/{i}")]
    out = flow_csv.with_sample_id(flow_csv.read_flow_csvs(spark, files), "row_id")
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"), F.count_distinct("row_id").alias("n_ids"))


@query(f"""with {FLOWS_SQL} select count(*) as n_rows, count(*) filter (where label <> 'PortScan') as n_with_score, min(flow_ts) as first_seen, max(flow_ts) as last_seen from flows""")
def csv_merge(spark, sf):
    path = written_csvs(spark, sf)
    merged = None
    for i in range(3):
        part = flow_csv.merge_captures(spark, f"{path}/{i}")
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    ts = S.to_timestamp("Timestamp")
    return merged.agg(F.count(F.lit(1)).alias("n_rows"), F.count("Flow IAT Max").alias("n_with_score"),
                      F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def prepared(spark, sf) -> str:
    path = new_path(spark, "prepared")
    df = sp.split_flows(clean.drop_incomplete(fx.features(spark, sf).drop("f_const"), FEATURES), PREPARE)
    sinks.save_prepared(staged(df, "split"), FEATURES, path, SNAKE)
    return path


COMPLETE_SQL = FEATURES_SQL + """,
whole as (select * from features where f_items is not null)"""


@query(f"""with {COMPLETE_SQL}, {quota_sql('whole', 'binary_label', 'b')}
select w.sample_id, w.f_total, w.f_items, w.label from whole w join b using (sample_id) where b.split = 'test'""")
def read_split(spark, sf):
    test = tables.read_split(spark, f"{prepared(spark, sf)}/flows", "test", label="binary_label")
    return test.select("sample_id", "f_total", "f_items", "label")


@query(f"""with {COMPLETE_SQL}, {quota_sql('whole', 'binary_label', 'b')}
select {', '.join(f'w.{c}' for c in FEATURES)} from whole w join b using (sample_id) where b.split = 'train' and w.binary_label = 0""")
def benign_train_features(spark, sf):
    path = prepared(spark, sf)
    names = tables.read_feature_names(spark, f"{path}/feature_names")
    return tables.read_columns(spark, f"{path}/features_benign_train", names)


@query(f"""with {FLOWS_SQL}, j as (select sample_id, case when flow_value < 10 then null when flow_value < 20 then null else flow_value end as v, label from flows)
select sample_id, v, label from j""")
def json_round_trip(spark, sf):
    path = new_path(spark, "json")
    v = F.when(F.col("flow_value") < 10, float("nan")).when(F.col("flow_value") < 20, float("inf")).otherwise(F.col("flow_value"))
    sinks.write_document(fx.flows(spark, sf).select("sample_id", v.alias("v"), "label"), path)
    return spark.read.schema("sample_id long, v double, label string").json(path)


@query(f"""with {ALERTS_SQL} select 'predictions' as stored, sample_id, alert_level from alerts union all
select 'suspicious_flows_medium', sample_id, alert_level from alerts where alert_level = 'MEDIUM'""")
def prediction_sink(spark, sf):
    path = new_path(spark, "predictions")
    sinks.save_predictions(fx.alerts(spark, sf), path)
    out = None
    for name in ("predictions", "suspicious_flows_medium"):
        part = spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("stored"), "sample_id", "alert_level")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with {ALERTS_SQL} select sample_id, label from alerts where sample_id % 7 = 0""")
def trace_inputs(spark, sf):
    """Stored trace tables read back: the test split of the trace rows."""
    path, df = new_path(spark, "trace"), fx.alerts(spark, sf)
    split = F.when(F.col("sample_id") % 7 == 0, "test").otherwise("train")
    sinks.write_table(ed.trace_metadata(df, SNAKE).withColumn("split_binary", split), f"{path}/trace_metadata", by=["split_binary"])
    sinks.write_table(df.select("sample_id", "alert_level"), f"{path}/predictions")
    sinks.write_table(df.groupBy("source_ip").agg(F.count(F.lit(1)).alias("total_flows")), f"{path}/ip_summary")
    return tables.load_trace_inputs(spark, path)["trace_metadata"].select("sample_id", "label")


@query(ORACLES["edge_table"])
def edge_sink(spark, sf):
    """The edge table as the preparation stores it, read back."""
    path = new_path(spark, "stored")
    split = F.when(F.col("sample_id") % 7 == 0, "test").otherwise("train")
    sinks.save_prepared(fx.flows(spark, sf).withColumn("split_binary", split), ["flow_value"], path, SNAKE)
    return rounded(spark.read.parquet(f"{path}/trace_edges"), 9, "attack_flow_ratio")


@query(f"""with {FLOWS_SQL} select case sample_id % 2 when 0 then 'utf8' else 'latin' end as kind, sample_id::double as n,
  label || ' – é' || destination_port as "Label" from flows where sample_id % 2 = 0 union all
select 'latin', sample_id::double, label || ' é' || destination_port from flows where sample_id % 2 = 1""")
def csv_encodings(spark, sf):
    """Files of two encodings read as one table, with the file each row is from."""
    path, df = new_path(spark, "csv"), fx.flows(spark, sf)
    for i, (kind, dash) in enumerate((("UTF-8", " – é"), ("ISO-8859-1", " é"))):
        part = df.where(F.col("sample_id") % 2 == i).select(F.col("sample_id").alias("n"), F.concat("label", F.lit(dash), F.col("destination_port").cast("string")).alias("Label"))
        part.write.option("header", True).option("encoding", kind).csv(f"{path}/{i}")
    files = {i: flow_csv.list_csv(spark, f"{path}/{i}") for i in range(2)}
    utf8 = [f.rsplit("/", 1)[-1] for f in files[0]]
    raw = flow_csv.read_flow_csvs(spark, [*files[0], *files[1]])
    return raw.select(F.when(F.col("source_file").isin(utf8), "utf8").otherwise("latin").alias("kind"), F.col("n").cast("double").alias("n"), "Label")


@query(f"""with {FLOWS_SQL} select source_ip as src_ip, destination_ip as dst_ip, destination_port as dst_port, flow_value as flow_byts_s from flows""")
def generated_names(spark, sf):
    """Flows under labelled headers, renamed to the generated layout."""
    df = fx.flows(spark, sf).select(F.col("source_ip").alias("Source IP"), F.col("destination_ip").alias("Destination IP"),
                                    F.col("destination_port").alias("Destination Port"), F.col("flow_value").alias("Flow Bytes/s"))
    return rc.to_generated_names(df)


@query(f"""with {FLOWS_SQL} select 'rows' as name, count(*)::double as value from flows union all
select 'attacks', sum(binary_label)::double from flows union all select 'highest', max(unsup_score) from flows""")
def flat_metrics(spark, sf):
    """Numbers of a stored metrics document, plain and wrapped ones."""
    path = new_path(spark, "metrics")
    n = fx.flows(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.sum("binary_label").alias("attacks"), F.max("unsup_score").alias("highest")).first()
    facts = {"rows": n["rows"], "attacks": {"value": n["attacks"], "unit": "flows"}, "highest": n["highest"], "done": True, "name": "x", "gone": None}
    sinks.write_document(sinks.manifest(spark, metrics=facts), path)
    return tables.flat_metrics(spark, path)


@query(f"with {FLOWS_SQL} select round(flow_value, 4) as latency from flows where sample_id % 5 <> 0")
def latency_values(spark, sf):
    """The latency column of a stored CSV, without its gaps."""
    path = f"{new_path(spark, 'latency')}.csv"
    value = F.when(F.col("sample_id") % 5 != 0, F.round("flow_value", 4))
    fx.flows(spark, sf).select(F.col("sample_id").alias("batch"), value.alias("latency_ms")).write.option("header", True).csv(path)
    return tables.read_latency(spark, path)


@query(f"with {FEATURES_SQL} select f_max_tax, f_total from features")
def aligned_features(spark, sf):
    return clean.align_features(fx.features(spark, sf), ["f_max_tax", "f_total"])


@query(f"""with {FLOWS_SQL}, s as (select source_ip, count(*) as n from flows where binary_label = 1 group by 1)
select 'sources' as stored, count(*) as rows, sum(n)::bigint as flows, (select count(*) from s) as said from s union all
select 'flows', count(*), count(*), count(*) from flows""")
def published_run(spark, sf):
    """Two tables of a run published together, read back by the manifest; a
    later run that breaks before its end changes nothing."""
    path, df = new_path(spark, "published"), fx.flows(spark, sf)
    sources = df.where("binary_label = 1").groupBy("source_ip").agg(F.count(F.lit(1)).alias("n"))
    sinks.publish(spark, {"sources": sources, "flows": df.select("sample_id", "label")}, path, precision_target=0.995)
    sinks.write_table(sources.limit(1), f"{path}/run-broken/sources")
    stored, document = sinks.published(spark, path)
    said = document.select("tables.*").first().asDict(True)
    out = stored["sources"].agg(F.lit("sources").alias("stored"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("flows"))
    out = out.unionByName(stored["flows"].agg(F.lit("flows").alias("stored"), F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("flows")))
    return out.withColumn("said", F.when(F.col("stored") == "flows", said["flows"]["rows"]).otherwise(said["sources"]["rows"]).cast("long"))


# --- models --------------------------------------------------------------------

DEFAULT = SupervisedConfig(columns=SNAKE)
# boosting and contributions take minutes at the defaults even on small tables; times are in the README
SMALL = SupervisedConfig(columns=SNAKE, num_trees=20, max_depth=8, boost_rounds=10, boost_depth=5)
UNSUPERVISED = UnsupervisedConfig(columns=SNAKE)


def _model_rows(spark, sf):
    # written before the split, whose cuts take several scans
    df = staged(clean.drop_incomplete(fx.features(spark, sf).drop("f_const"), FEATURES), "features")
    return staged(sp.stratified_split(df, "binary_label", "split_binary", PREPARE), "rows")


def _scaled_embeddings(spark, sf):
    df, names = fx.embedding_features(spark, sf)
    df = staged(df, "embeddings")
    stats = clean.scale_stats(df.where("binary_label = 0"), names)
    return staged(clean.standardise(df, stats), "scaled"), names


@query()
def rf_scores(spark, sf):
    df = _model_rows(spark, sf)
    model = fo.fit_forest(df.where("split_binary = 'train'"), FEATURES, DEFAULT)
    return fo.score_attacks(model, df, FEATURES, ["sample_id", "split_binary"])


@query()
def rf_importance(spark, sf):
    df = _model_rows(spark, sf)
    return fo.importances(fo.fit_forest(df, FEATURES, DEFAULT), FEATURES, 10)


@query()
def gbt_scores(spark, sf):
    df = _model_rows(spark, sf)
    model = fo.fit_boosted(df.where("split_binary = 'train'"), FEATURES, SMALL)
    return fo.score_attacks(model, df, FEATURES, ["sample_id", "split_binary"])


@query()
def supervised_predictions(spark, sf):
    return supervised_score(_model_rows(spark, sf), FEATURES, DEFAULT).predictions


@query()
def tree_shap(spark, sf):
    df = _model_rows(spark, sf)
    model = fo.fit_forest(df.where("split_binary = 'train'"), FEATURES, SMALL)
    return ex.explain_forest(model, df.where("split_binary = 'test'"), FEATURES)


@query("select 0.0::double as largest_gap")
def shap_additivity(spark, sf):
    """Base plus contributions against the score of every test row."""
    df = _model_rows(spark, sf)
    model = fo.fit_forest(df.where("split_binary = 'train'"), FEATURES, SMALL)
    test = staged(clean.impute_own(df.where("split_binary = 'test'"), FEATURES), "test")
    parts = ex.contributions(model, test, FEATURES, "sample_id").groupBy("id").agg((F.first("base") + F.sum("contribution")).alias("whole"))
    scores = fo.score_attacks(model, test, FEATURES, ["sample_id"])
    both = scores.join(parts, scores.sample_id == parts.id)
    return both.agg(F.round(F.max(F.abs(F.col("attack_prob") - F.col("whole"))), 6).alias("largest_gap"))


MI_BINS = [i / 10 for i in range(1, 10)]


@query(f"""with {FEATURES_SQL}, u as (""" + " union all ".join(f"select '{c}' as feature, binary_label as y, {c} as x from features where {c} is not null" for c in FEATURES)
       + f"""), q as (select feature, quantile_cont(x, {MI_BINS}) as cuts from u group by 1),
b as (select feature, y, len(list_filter(cuts, lambda c: c < x)) as bin, count(*)::double as n from u join q using (feature) group by all),
t as (select feature, n, sum(n) over (partition by feature) as total, sum(n) over (partition by feature, bin) as nb, sum(n) over (partition by feature, y) as ny from b)
select feature, round(greatest(sum(n / total * ln(n * total / (nb * ny))), 0), 10) as mi from t group by 1""")
def mi_binned(spark, sf):
    return rounded(se.mi_binned(fx.features(spark, sf), FEATURES, "binary_label"), 10, "mi")


def _near_sql(feature: str) -> str:
    return f"""select '{feature}' as feature, a.sample_id, count(*) as m from (select * from r where feature = '{feature}') a
  join (select x from r where feature = '{feature}') b on b.x > a.x - 1.001 * a.r and b.x < a.x + 1.001 * a.r where abs(b.x - a.x) < a.r group by a.sample_id"""


@query(f"""with {FEATURES_SQL}, u as (""" + " union all ".join(f"select '{c}' as feature, sample_id, binary_label as y, {c} as x from features where {c} is not null" for c in FEATURES)
       + """), c as (select feature, y, count(*) as same from u group by all having count(*) > 1),
s as (select feature, greatest(stddev_pop(x), avg(abs(x))) * 1e-10 as step from u group by all),
v as (select feature, y, same, sample_id, x + (('0x' || md5(sample_id || ':' || feature)[1:13])::bigint::double / 2251799813685248 - 1) * step as x from u join c using (feature, y) join s using (feature)),
r as (select feature, y, same, sample_id, x, list_sort(list_filter([""" + ", ".join(f"x - lag(x, {i}) over w, lead(x, {i}) over w - x" for i in (1, 2, 3))
       + """], lambda d: d is not null))[least(3, same - 1)] as r from v window w as (partition by feature, y order by x)),
m as (""" + " union all ".join(_near_sql(c) for c in FEATURES) + """),
e as (select feature, x, count(*) as m from r group by all),
h as (select n, sum(1.0::double / nullif(n - 1, 0)) over (order by n) as h from range(1, (select count(*) + 2 from r)) t(n)),
g as (select n, coalesce(h, 0) - 0.5772156649015329 as psi from h),
p as (select r.feature, count(*) as n, avg(a.psi) as k, avg(b.psi) as own, avg(d.psi) as near from r left join m using (feature, sample_id)
  join e on e.feature = r.feature and e.x = r.x join g a on a.n = least(3, same - 1) join g b on b.n = same join g d on d.n = case when r.r = 0 then e.m else m.m end group by 1)
select feature, round(greatest(g.psi + k - own - near, 0), 9) as mi from p join g on g.n = p.n""")
def mi_knn(spark, sf):
    return rounded(se.mi_knn(fx.features(spark, sf), FEATURES, "binary_label"), 9, "mi")


@query()
def stored_models(spark, sf):
    """Scores of every row by a forest, boosted and isolation trees read back
    from the one form in which they are stored, next to those before."""
    df, path = _model_rows(spark, sf), new_path(spark, "models")
    train = df.where("split_binary = 'train'")
    models = {"forest": fo.fit_forest(train, FEATURES, SMALL), "boosted": fo.fit_boosted(train, FEATURES, SMALL),
              "isolation": ts.isolation_model(ifo.fit_iforest(train.where("binary_label = 0"), FEATURES, cfg=UNSUPERVISED))}
    out = None
    for kind, model in models.items():
        ts.save_trees(model, f"{path}/{kind}")
        before = fo.score_attacks(model, df, FEATURES, ["sample_id"], "score")
        after = fo.score_attacks(ts.load_trees(spark, f"{path}/{kind}"), df, FEATURES, ["sample_id"], "read_back")
        part = before.join(after, "sample_id").select(F.lit(kind).alias("kind"), "sample_id", "score", "read_back")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def pca_variance(spark, sf):
    df, names = _scaled_embeddings(spark, sf)
    return se.pca_variance(df.where("binary_label = 0"), names, 0.95)


@query()
def pca_2d(spark, sf):
    df, names = fx.embedding_features(spark, sf)
    return se.pca_plane(staged(df, "embeddings"), names, ["sample_id", "binary_label"])


@query()
def iforest_scores(spark, sf):
    df, names = _scaled_embeddings(spark, sf)
    nodes = ifo.fit_iforest(df.where("binary_label = 0"), names, cfg=UNSUPERVISED)
    return ifo.score_iforest(df, nodes, names, ["sample_id", "binary_label"])


@query()
def iforest_flow_scores(spark, sf):
    df = _model_rows(spark, sf)
    nodes = ifo.fit_iforest(df.where("binary_label = 0"), FEATURES, cfg=UNSUPERVISED)
    return ifo.score_iforest(df, nodes, FEATURES, ["sample_id", "binary_label"])


@query()
def recon_pca(spark, sf):
    df, names = _scaled_embeddings(spark, sf)
    return se.linear_residual(df, df.where("binary_label = 0"), names, ["sample_id", "binary_label"], 20)


def _recon(spark, sf, variational):
    df, names = _scaled_embeddings(spark, sf)
    df = staged(sp.stratified_split(df, "binary_label", "split_binary", PREPARE), "split")
    train, val = df.where("split_binary = 'train' and binary_label = 0"), df.where("split_binary = 'val'")
    model, _ = re_.fit_reconstruction(train, val, names, "binary_label", variational, UNSUPERVISED)
    return re_.score_reconstruction(df, model, ["sample_id", "binary_label"])


@query()
def recon_ae(spark, sf):
    return _recon(spark, sf, False)


@query()
def recon_vae(spark, sf):
    return _recon(spark, sf, True)


@query()
def ensemble_predictions(spark, sf):
    """Forest and isolation-forest scores of the order rows, fused, calibrated
    on validation and alerted on test."""
    df = _model_rows(spark, sf)
    forest = fo.fit_forest(df.where("split_binary = 'train'"), FEATURES, DEFAULT)
    nodes = ifo.fit_iforest(df.where("split_binary = 'train' and binary_label = 0"), FEATURES, cfg=UNSUPERVISED)
    keep = ["sample_id", "binary_label", "split_binary"]
    rf = fo.score_attacks(forest, df, FEATURES, ["sample_id"], "rf_prob")
    scored = staged(ifo.score_iforest(df, nodes, FEATURES, keep).join(rf, "sample_id"), "scored")
    val = scored.where("split_binary = 'val'")
    ranges = fu.score_ranges(val, ["iforest_score"])
    scored = staged(fu.fuse(scored, ["iforest_score"], [1.0], ranges, "unsup_score", clip=True, flat=1e-12), "fused")
    cfg = al.calibrate(scored.where("split_binary = 'val'"), "binary_label", AlertConfig())
    return al.prediction_table(al.assign_alerts(scored.where("split_binary = 'test'"), cfg), "binary_label")
