"""Time-sliced models: offset model and ablation on grouped fits, classifiers on Spark ML, parity gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions import expr as X
from pitpanel.functions.ordered import attach_row, stored_if_large
from pitpanel.operators import grouped as G
from pitpanel.operators import metrics as M
from pitpanel.operators.folds import Fold, fold_name
from pitpanel.sources.workdir import materialise


@dataclass
class OffsetModel:
    """Linear correction on top of a fixed log-odds offset; final = offset + residual."""

    columns: list
    coefficients: dict
    intercept: float

    def residual(self) -> Column:
        z = F.lit(self.intercept)
        for c in self.columns:
            z = z + self.coefficients[c] * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return z


def fit_offset(train: DataFrame, columns: Sequence[str], y: str, offset: str, weight: str | None = None, reg: float = 1e-6) -> OffsetModel:
    """Weighted logistic fit on top of a fixed offset; missing values count as 0."""
    spark = train.sparkSession
    fits = G.members(spark, {"all": ["all"]}, "string")
    spec = G.plain_spec(fits.select("fit"), columns, ridge=F.lit(reg))
    b = G.newton(train.withColumn("_part", F.lit("all")), fits, spec, columns, y, offset=offset, weight=weight, part="_part").first()
    return OffsetModel(list(columns), {c: b[f"b_{i}"] for i, c in enumerate(columns, 1)}, b["b_0"])


def apply_offset(df: DataFrame, model: OffsetModel, offset: str) -> DataFrame:
    return df.withColumn("residual", model.residual()).withColumn("final_logit", F.col(offset) + F.col("residual")).withColumn(
        "final_probability", X.clip(X.sigmoid(F.col("final_logit"))))


def fit_classifier(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str, kind: str = "logistic"):
    """StringIndexer (unknowns kept) + one-hot + imputer + assembler + logistic regression or boosted trees."""
    d = train.select(*[X.finite(F.col(c)).alias(c) for c in numeric], *[X.category(F.col(c)).alias(c) for c in categorical], F.col(y).cast("double").alias("_y"))
    stages = [Imputer(inputCols=list(numeric), outputCols=[f"{c}_f" for c in numeric], strategy="median")]
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical], handleInvalid="keep")]
    stages.append(VectorAssembler(inputCols=[f"{c}_f" for c in numeric] + [f"{c}_v" for c in categorical], outputCol="features"))
    stages.append(GBTClassifier(labelCol="_y", maxIter=20, maxDepth=4, seed=42) if kind == "trees" else LogisticRegression(labelCol="_y", regParam=1e-6, maxIter=100))
    return Pipeline(stages=stages).fit(d)


def predict(model, df: DataFrame, keep: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], y: str) -> DataFrame:
    """Prediction frame: keys, actual and probability."""
    d = df.select(*[F.col(k).alias(f"_k_{k}") for k in keep], *[X.finite(F.col(c)).alias(c) for c in numeric], *[X.category(F.col(c)).alias(c) for c in categorical],
                  F.col(y).cast("double").alias("_y"))
    return model.transform(d).select(*[F.col(f"_k_{k}").alias(k) for k in keep], F.col("_y").cast("int").alias("actual"),
                                     vector_to_array("probability")[1].alias("pred_probability"))


def ablation(df: DataFrame, groups: dict[str, Sequence[str]], folds: Sequence[Fold], year: str, y: str, offset: str, reg: float = 1e-6) -> DataFrame:
    """Drop each feature group, refit every fold, compare pooled log-loss and Brier on the validation years.

    All variants of all folds are fitted in the same rounds; a variant switches the features off that it lacks.
    """
    spark = df.sparkSession
    everything = [c for g in groups.values() for c in g]
    without = {"all": (), **{f"without_{n}": tuple(g) for n, g in groups.items()}}
    names = spark.createDataFrame([(f"{v}|{fold_name(f)}", v, f.validation_year) for v in without for f in folds], "fit string, variant string, validation_year int")
    members = G.members(spark, {f"{v}|{fold_name(f)}": range(f.train_start, f.train_end + 1) for v in without for f in folds})
    use = {c: F.when(F.col("variant").isin(*[v for v, gone in without.items() if c in gone] or ["-"]), 0.0).otherwise(1.0) for c in everything}
    d = df.select(F.col(year).alias("part"), *everything, F.col(y).alias("y"), F.col(offset).alias("offset"))
    d = stored_if_large(d, "ablation-rows")
    fitted = G.newton(d, members, G.plain_spec(names, everything, use, F.lit(reg)), everything, "y", offset="offset")
    out = d.join(F.broadcast(fitted), F.col("part") == F.col("validation_year"))  # a row for every variant and fold of its year
    out = out.withColumn("final_probability", X.clip(X.sigmoid(G.linear(everything, F.col("offset")))))
    return M.probability_metrics(out, ["variant"], "y", "final_probability")


def classifier_grid(df: DataFrame, targets: dict[str, str], sets: dict[str, Sequence[str]], split: str, train: str, c: float = 1.0) -> DataFrame:
    """Every target x feature set: logistic fits on the training split, applied to every split; metrics per target, set and split.

    Rows are repeated once per target; all fits run in the same rounds, and a feature set switches the other columns off.
    Missing and non-finite values take the training median, columns are standardised, and a ridge of 1 / (c * rows) holds the
    coefficients.  Rows whose target is null take no part in that target.  A split without rows has no row in the result.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    d = df.select(F.col(split).alias("split"), *[X.finite(F.col(f).cast("double")).alias(f) for f in columns],
                  F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(y).cast("int").alias("y")) for t, y in targets.items()]))).filter("y is not null")
    d = materialise(d.withColumn("part", F.concat_ws("|", "target", "split")), "classifier-rows")
    fits = G.members(spark, {f"{t}|{s}": [f"{t}|{train}"] for t in targets for s in sets}, "string")
    names = spark.createDataFrame([(f"{t}|{s}", t, s) for t in targets for s in sets], "fit string, target string, feature_set string")
    spec = G.baseline_spec(d, fits, columns, c=c).join(F.broadcast(names), "fit")
    for i, f in enumerate(columns, 1):
        spec = spec.withColumn(f"use_{i}", F.when(F.col("feature_set").isin(*[s for s, fs in sets.items() if f in fs]), 1.0).otherwise(0.0))
    fitted = G.newton(d, fits, spec, columns, "y")
    out = d.join(F.broadcast(fitted), "target")  # one row for every feature set of the target
    out = out.withColumn("pred_probability", X.clip(X.sigmoid(G.linear(columns))))
    return M.probability_metrics(out, ["target", "feature_set", "split"], "y", "pred_probability")


def parity_gate(a: DataFrame, b: DataFrame, keys: Sequence[str], y: str, p: str, tolerance: float) -> DataFrame:
    """One row: key and target agreement, largest and mean probability difference, metric difference, verdict."""
    x = a.select(*keys, F.col(y).alias("_ya"), F.col(p).alias("_pa"))
    z = b.select(*keys, F.col(y).alias("_yb"), F.col(p).alias("_pb"))
    dup = F.count(F.lit(1)) > 1
    da, db = (f.groupBy(*keys).agg(dup.alias("d")).agg(F.count_if("d").alias(n)) for f, n in ((a, "duplicates_a"), (b, "duplicates_b")))
    j = x.join(z, list(keys), "full")
    d = F.abs(F.col("_pa") - F.col("_pb"))
    one = j.agg(F.count_if(F.col("_pb").isNull()).alias("only_a"), F.count_if(F.col("_pa").isNull()).alias("only_b"), F.count(d).alias("common"),
                F.count_if(F.col("_ya") != F.col("_yb")).alias("target_conflicts"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"),
                F.abs(F.avg(M.log_loss(F.col("_ya"), F.col("_pa"), 1e-15)) - F.avg(M.log_loss(F.col("_yb"), F.col("_pb"), 1e-15))).alias("logloss_diff"))
    r = attach_row(attach_row(one, da), db)
    ok = ((F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("target_conflicts") == 0) & (F.col("duplicates_a") == 0) & (F.col("duplicates_b") == 0)
          & (F.col("max_diff") <= tolerance) & (F.col("logloss_diff") <= tolerance))
    return r.withColumn("passed", F.coalesce(ok, F.lit(False)))
