"""Mutual information of features with the class, and principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from flowspark.config import UnsupervisedConfig
from flowspark.functions.scalars import quoted
from flowspark.operators.clean import impute_own
from flowspark.operators.forest import VECTOR, assemble
from flowspark.operators.neighbours import mi_knn
from flowspark.operators.ordering import with_ids
from flowspark.operators.quantiles import exact_quantiles, sample_exact
from flowspark.staging import local_table


def _unpivot(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(quoted(c)).cast("double").alias("x")) for c in features])
    return df.select(F.col(quoted(label)).cast("int").alias("y"), F.explode(cells).alias("e")).select("y", "e.*")


def mi_binned(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Information between quantile-binned features and the class over all rows."""
    probs = [i / bins for i in range(1, bins)]
    cuts = exact_quantiles(df, features, probs)
    long = _unpivot(df, features, label).where("x is not null")
    table = local_table(
        df.sparkSession, [(c, [cuts[c, p] for p in probs]) for c in features if cuts[c, probs[0]] is not None], "feature string, cuts array<double>")
    long = long.join(table, "feature")  # a local table, one row per feature
    cell = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    counts = long.groupBy("feature", cell.alias("bin"), "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # from here on features x bins x classes rows
    total = F.sum("n").over(W.partitionBy("feature"))
    by_bin = F.sum("n").over(W.partitionBy("feature", "bin"))
    by_class = F.sum("n").over(W.partitionBy("feature", "y"))
    term = counts.select("feature", (F.col("n") / total * F.log(F.col("n") * total / (by_bin * by_class))).alias("t"))
    return term.groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("mi"))


def top_features(ranking: DataFrame, score: str, k: int) -> DataFrame:
    return ranking.orderBy(F.col(score).desc(), "feature").limit(k)


def select_features(df: DataFrame, features: Sequence[str], label: str, cfg: UnsupervisedConfig = UnsupervisedConfig()) -> list[str]:
    """The most informative features, or all of them when k is out of range."""
    if not 0 < cfg.mi_top_k < len(features):
        return list(features)
    if cfg.mi_estimator == "binned":
        ranking = mi_binned(df, features, label)
    else:
        sid = cfg.columns.sample_id
        ranking = mi_knn(with_ids(df, sid), features, label, sid, cfg.mi_neighbours)
    return [r.feature for r in top_features(ranking, "mi", cfg.mi_top_k).collect()]


def pca_variance(df: DataFrame, features: Sequence[str], share: float = 0.95) -> DataFrame:
    """Explained and cumulative variance per component, and whether the
    component is needed to exceed the share."""
    model = PCA(k=len(features), inputCol=VECTOR, outputCol="pc").fit(assemble(df, features))
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    table = local_table(df.sparkSession, [(i + 1, v) for i, v in enumerate(ratios)], "component int, ratio double")
    running = F.sum("ratio").over(W.orderBy("component"))  # one row per feature
    out = table.withColumn("cumulative", running)
    return out.withColumn("needed", (F.col("cumulative") - F.col("ratio") <= F.lit(share)).cast("int"))


def pca_plane(df: DataFrame, features: Sequence[str], keep: Sequence[str], sample_id: str = "sample_id", rows: int | None = None, seed: int = 42) -> DataFrame:
    """First two components of the centred rows (of a sample when ``rows`` is
    given), with the kept columns."""
    sample = impute_own(df if rows is None else sample_exact(df, rows, sample_id, seed), features)
    means = sample.agg(*[F.avg(quoted(c)) for c in features]).first()
    centred = sample.withColumns({c: F.col(quoted(c)) - F.lit(m) for c, m in zip(features, means)})
    data = assemble(centred, features, keep)
    model = PCA(k=2, inputCol=VECTOR, outputCol="pc").fit(data)
    plane = vector_to_array("pc")
    return model.transform(data).select(*[quoted(c) for c in keep], plane[0].alias("pc1"), plane[1].alias("pc2"))


def linear_residual(df: DataFrame, train: DataFrame, features: Sequence[str], keep: Sequence[str], components: int, name: str = "pca_score") -> DataFrame:
    """Mean squared distance of a row to the plane of the leading components."""
    model = PCA(k=components, inputCol=VECTOR, outputCol="pc").fit(assemble(train, features))
    # |x|^2 - |projection|^2, all inside generated code
    data = assemble(df, features, keep)
    both = model.transform(data).select(*[quoted(c) for c in keep], vector_to_array(VECTOR).alias("x"), vector_to_array("pc").alias("p"))
    norm = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    gap = F.greatest(norm("x") - norm("p"), F.lit(0.0)) / F.lit(float(len(features)))
    return both.select(*[quoted(c) for c in keep], gap.alias(name))
