"""Walk-forward models: base rate, logistic regression (pyspark.ml), leaf-wise boosted trees (``boosting``).

Each logistic fold is one distributed fit; there are at most ``max_folds`` folds. The boosted trees of
all folds grow in the same jobs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from . import boosting
from .walkforward import Protocol, fold_dates, folds, purged_base_rates, require_trainable

# The frozen estimator settings.
TREE_SETTINGS = {"trees": 250, "rate": 0.05, "leaves": 15, "min_rows": 30, "l2": 1.0}
LOGISTIC_C = 1.0
LOGISTIC_ITERATIONS = 1000
LOGISTIC_TOLERANCE = 1e-4
MODELS = ("base_rate", "logistic", "gradient_boosting")


def _prepare(features: list[str]) -> list:
    filled = [f"{name}_filled" for name in features]
    return [
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="raw_vector"),
    ]


def logistic_pipeline(features: list[str], rows: int) -> Pipeline:
    """Median-imputed, standardised, L2 with weight 1/(C n) (a summed loss divided by n)."""
    return Pipeline(
        stages=[
            *_prepare(features),
            StandardScaler(inputCol="raw_vector", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(
                labelCol="target", maxIter=LOGISTIC_ITERATIONS, tol=LOGISTIC_TOLERANCE, regParam=1.0 / (LOGISTIC_C * rows),
                elasticNetParam=0.0, standardization=False,
            ),
        ]
    )


def score(model, rows: DataFrame) -> DataFrame:
    if isinstance(model, boosting.Fitted):
        return boosting.score(model, rows)
    keep = rows.columns
    scored = model.transform(rows)
    return scored.select(*keep, vector_to_array(F.col("probability"))[1].alias("model_probability")).withColumnRenamed(
        "model_probability", "probability"
    )


def walk_forward(
    rows: DataFrame, features: list[str], protocol: Protocol, names: list[str], day: str = "target_session",
    at_once: int = 4, **overrides,
) -> DataFrame:
    """Out-of-sample rows of all folds and models, from training labels that were known in time.

    A fold trains on the sessions before its purge gap whose ``label_available_at`` lies before the first
    ``decision_at`` of its test rows. Folds are made once and shared by all models, so the models see the same rows.
    Adds ``fold``, ``model``, ``probability``, ``base_probability``, ``train_rows`` and ``last_label_available_at``; the
    features go. Fold dates, rates and every fold read the rows many times, so they are checkpointed first: neither these
    nor an iterative fit recompute the features or depend on an executor's memory. ``at_once`` logistic fits share the cluster;
    ``overrides`` change settings of the trees.
    """
    rows = reliable_checkpoint(rows)
    dated = fold_dates(rows, protocol, day)
    rates = require_trainable(purged_base_rates(rows, dated, protocol, day), protocol)
    plan = sorted(rates.join(folds(dated, protocol), "fold").collect(), key=lambda r: r["fold"])  # at most max_folds rows
    if not plan:
        raise ValueError("insufficient historical sessions for the validation protocol")
    indexed = reliable_checkpoint(rows.join(dated, day))
    is_known = {
        int(fold["fold"]): (F.col("idx") < int(fold["train_to"])) & (F.col("label_available_at") < F.lit(fold["first_decision_at"]))
        for fold in plan
    }

    def one(task) -> DataFrame:
        fold, name = task
        test = indexed.filter(F.col("fold") == fold["fold"])
        if name == "base_rate":
            scored = test.withColumn("probability", F.lit(float(fold["base_probability"])))
        elif name == "logistic":
            train = indexed.filter(is_known[int(fold["fold"])]).select(*features, "target")
            scored = score(logistic_pipeline(features, int(fold["train_rows"])).fit(train), test)
        else:
            scored = boosted.filter(F.col("fold") == fold["fold"])
        return scored.withColumns(
            {
                "base_probability": F.lit(float(fold["base_probability"])),
                "model": F.lit(name),
                "train_rows": F.lit(int(fold["train_rows"])).cast("bigint"),
                "last_label_available_at": F.lit(fold["last_label_available_at"]),
            }
        )

    if "gradient_boosting" in names:
        boosted = score(boosted_folds(indexed, features, is_known, **overrides), indexed.filter(F.col("fold").isNotNull()))
    with ThreadPoolExecutor(at_once) as pool:
        outputs = list(pool.map(one, [(fold, name) for fold in plan for name in names]))
    return reduce(DataFrame.unionByName, outputs).drop("idx", *features)


def boosted_folds(indexed: DataFrame, features: list[str], is_known: dict, **overrides) -> boosting.Fitted:
    """One boosted model per fold, all fitted together; a row is copied to every fold that may train on it."""
    own = F.array_compact(F.array(*[F.when(known, F.lit(fold)) for fold, known in is_known.items()]))
    train = indexed.select(*features, "target", F.explode(own).alias("fold"))
    return boosting.fit(train, features, "fold", boosting.Settings(**{**TREE_SETTINGS, **overrides}))


def final_model(rows: DataFrame, features: list[str], name: str, **overrides):
    """Refit on every row for forward signals."""
    if name == "gradient_boosting":
        return boosting.fit(rows, features, None, boosting.Settings(**{**TREE_SETTINGS, **overrides}))
    if name == "logistic":
        return logistic_pipeline(features, rows.count()).fit(rows.select(*features, "target"))
    raise ValueError(f"unknown estimator: {name}")


__all__ = ["MODELS", "boosted_folds", "final_model", "score", "walk_forward"]
