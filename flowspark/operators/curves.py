"""Ranking curves, binned curves and confusion metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flowspark.functions.scalars import as_column, quoted, share
from flowspark.operators.ordering import running_sums, with_next
from flowspark.staging import local_table, staged


def score_groups(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: the only shuffle of the rows."""
    y = F.col(quoted(label))
    return (
        df.where(F.col(quoted(score)).isNotNull())
        .groupBy(*keys, F.col(quoted(score)).alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )


def cumulative(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positives (tp) and negatives (fp) at or above every distinct score."""
    groups = score_groups(df, score, label, keys)
    return running_sums(groups, [F.col("score").desc()], {"tp": "pos", "fp": "neg"}, keys)


def _class_totals(cum: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cum.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )


def _with_totals(cum: DataFrame) -> DataFrame:
    row = _class_totals(cum).first()
    return cum.withColumns({"n_pos": F.lit(row.n_pos or 0).cast("long"), "n_neg": F.lit(row.n_neg or 0).cast("long")})


def _recall() -> Column:
    return F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(F.try_divide("tp", "n_pos"))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision and recall at every distinct score, plus the end point (1, 0)."""
    return _pr_points(_with_totals(cumulative(df, score, label)))


def _pr_points(cum: DataFrame) -> DataFrame:
    points = cum.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _recall().alias("recall"),
    )
    end = _one_row(cum).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def _one_row(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(0, 1, 1, 1)


def pr_area(df: DataFrame, score: str, label: str) -> DataFrame:
    """Trapezoid area under the precision-recall points."""
    cum = _with_totals(cumulative(df, score, label))
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, tp0 + fp0))
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    step = F.try_divide(F.col("pos"), F.col("n_pos"))
    return cum.agg(F.sum(step * (before + here) / 2).alias("pr_area"))


def roc_curve(df: DataFrame, score: str, label: str, drop_collinear: bool = True) -> DataFrame:
    """False and true positive rates from (0, 0) on; points inside a straight
    run are left out unless asked for."""
    cum = _with_totals(cumulative(df, score, label))
    if drop_collinear:
        nxt = with_next(cum, [F.col("score").desc()], ["pos", "neg"])
        bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        cum = nxt.where(first | F.col("next_pos").isNull() | bends)
    points = cum.select(
        F.col("score").alias("threshold"),
        F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"),
    )
    start = _one_row(df).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve (ties count half); NULL with one class only."""
    cum = cumulative(df, score, label, keys)
    if keys:
        # one row per key, keys are few
        cum = cum.join(_class_totals(cum, keys), list(keys))
    else:
        cum = _with_totals(cum)
    wins = F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / F.lit(2.0))
    pairs = F.first("n_pos") * F.first("n_neg").cast("double")
    return cum.groupBy(*keys).agg(F.try_divide(F.sum(wins), pairs).alias("auc"))


# --- binned curves -----------------------------------------------------------


def bin_index(df: DataFrame, score: str, cuts: Sequence[float], name: str) -> DataFrame:
    """Number of cut points at or below the score."""
    splits = [-float("inf"), *map(float, cuts), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=score, outputCol=name, handleInvalid="skip")
    return cut.transform(df).withColumn(name, F.col(name).cast("int"))


def counts_from_cut(df: DataFrame, score: str, label: str, cuts: Sequence[float]) -> DataFrame:
    """Rows and attacks with score >= cut, for every cut, in one pass.

    A row is counted in its cell only; sums over the cells above a cut run
    over the handful of cells, never over rows x cuts.
    """
    cells = bin_index(df.select(quoted(score), quoted(label)), score, cuts, "cell").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum(quoted(label)).cast("long").alias("attacks")
    )
    grid = local_table(df.sparkSession, [(i + 1, float(c)) for i, c in enumerate(cuts)], "cell int, cut double")
    full = grid.join(cells, "cell", "full_outer").na.fill(0, ["n", "attacks"])
    above = W.orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, 0)  # len(cuts) + 1 rows
    return full.select(
        "cut", F.sum("n").over(above).alias("n"), F.sum("attacks").over(above).alias("attacks")
    ).where("cut is not null")


def threshold_sweep(df: DataFrame, score: str, label: str, steps: int = 101) -> DataFrame:
    """False positive rate, recall and precision at evenly spaced cuts of [0, 1]."""
    cuts = [i / (steps - 1) if i == steps - 1 else i * (1.0 / (steps - 1)) for i in range(steps)]
    y = F.col(quoted(label))
    totals = df.agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("q")).first()
    tp, fp = F.col("attacks"), F.col("n") - F.col("attacks")
    return counts_from_cut(df, score, label, cuts).select(
        F.col("cut").alias("threshold"),
        share(fp, F.lit(totals.q)).alias("fpr"),
        share(tp, F.lit(totals.p)).alias("recall"),
        share(tp, "n").alias("precision"),
    )


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and positive rate per uniform bin of [0, 1]; an inner edge
    belongs to the lower bin, empty bins do not appear."""
    clipped = F.least(F.greatest(F.col(quoted(score)), F.lit(0.0)), F.lit(1.0))
    edges = [i / bins for i in range(1, bins)]
    over = [F.when(clipped > F.lit(e), 1).otherwise(0) for e in edges]
    cell = over[0]
    for o in over[1:]:
        cell = cell + o
    return (
        df.where(F.col(quoted(score)).isNotNull()).groupBy(cell.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(clipped).alias("mean_score"),
             F.avg(quoted(label)).alias("positive_rate"))
    )


def histogram(
    df: DataFrame, score: str, bins: int, low: float | None = None, high: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts and density per equal-width bin; the range defaults to the
    (group's) own minimum and maximum, values outside a given range drop out."""
    v = F.col(quoted(score)).cast("double")
    rows = df.where(v.isNotNull()).select(*by, v.alias("v"))
    if low is None:
        ranges = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        if by:  # written, hence of known size: copied only if it is small
            rows = rows.join(staged(ranges, "ranges"), list(by))
        else:
            row = ranges.first()
            rows = rows.withColumns({"lo": F.lit(row.lo), "hi": F.lit(row.hi)})
        flat = F.col("lo") == F.col("hi")
        rows = rows.withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
                                 "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    else:
        rows = rows.where(_inside(low, high)).withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))})
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(bins)), F.lit(bins - 1))
    counts = rows.groupBy(*by, cell.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.first(width).alias("width")
    )
    total = F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(1)))  # over the bins only
    return counts.select(
        *by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"), "n",
        (F.col("n") / (total * F.col("width"))).alias("density"),
    )


def _inside(low: float, high: float) -> Column:
    return (F.col("v") >= F.lit(float(low))) & (F.col("v") <= F.lit(float(high)))


def latency_histogram(df: DataFrame, latency: str) -> DataFrame:
    """Histogram with one bin per 20 rows, at least 10 and at most 50 bins."""
    n = df.where(F.col(quoted(latency)).isNotNull()).count()
    return histogram(df, latency, bins=min(50, max(10, n // 20)))


# --- confusion metrics -------------------------------------------------------


def confusion_counts(df: DataFrame, label: str, preds: dict[str, Column | str], by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp of several named predictions from one scan, one row each."""
    y = F.col(quoted(label))
    cells = []
    for name, pred in preds.items():
        p = as_column(pred)
        cells.append(F.struct(
            F.lit(name).alias("name"),
            F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
        ))
    return df.groupBy(*by).agg(F.array(*cells).alias("cells")).select(
        *by, F.explode("cells").alias("c")).select(*by, "c.*")


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and false positive rate, 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": share(tp + tn, tp + tn + fp + fn),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "fpr": share(fp, fp + tn),
    })


def confusion_metrics(df: DataFrame, label: str, preds: dict[str, Column | str], scores: dict[str, str] | None = None) -> DataFrame:
    """Confusion counts, rates and, for the scores given, the AUC."""
    out = rates(confusion_counts(df, label, preds))
    aucs = {n: roc_auc(df, s, label).first().auc for n, s in (scores or {}).items()}
    auc = F.lit(None).cast("double")
    for name, value in aucs.items():
        auc = F.when(F.col("name") == name, F.lit(value).cast("double")).otherwise(auc)
    return out.withColumn("auc", auc)


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class with both averages."""
    pairs = df.groupBy(F.col(quoted(label)).cast("string").alias("t"), F.col(quoted(pred)).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said"),
                 F.lit(0).cast("long").alias("hit")),
    )
    # from here on one row per (truth, prediction) pair of classes
    each = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("class").agg(
        F.sum("truth").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    each = each.select(
        "class", share("hit", "said").alias("precision"), share("hit", "support").alias("recall"),
        share(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")
    measures = ("precision", "recall", "f1")
    macro = each.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = each.agg(
        *[share(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"))
    return (
        each.unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def model_comparison(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """One row per measure with both models' values and the difference."""
    names = ("accuracy", "precision", "recall", "f1", "auc", "fpr")
    long = metrics.select("name", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0.0)).alias("value")) for m in names]
    )).alias("e")).select("name", "e.*")
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("name") == base, F.col("value"))).alias("base_value"),
        F.max(F.when(F.col("name") == other, F.col("value"))).alias("other_value"),
    )
    return wide.withColumn("delta", F.col("other_value") - F.col("base_value"))
