"""Boosted trees that penalise underestimates, on Spark ML.

For the asymmetric squared loss with weight ``w`` (``alpha`` where the prediction is too low, else
1, times the row's own weight) the Newton step of a leaf is the weighted mean residual, and the
split gain is the weighted variance reduction. That is what a regression tree with a weight column
fits, so each boosting round is one such tree on the residuals. The L1 and L2 leaf penalties have
no counterpart in Spark ML and are not applied here; ``app_models`` applies them.

One model serves a pool of apps. Level features are divided by the app's mean level, which changes
nothing for a single app, as trees only see the order of values.
"""

from __future__ import annotations

import random
from dataclasses import asdict, dataclass, fields, replace

from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.matrix import (
    CALENDAR_FEATURES, EPSILON, LEVEL_FEATURES, REVIEW_FEATURES, rule_feature_names,
)
from tidemark.session import cut_lineage

CUT_EVERY = 5
FEATURES = [*LEVEL_FEATURES, "pct_change", *REVIEW_FEATURES, *CALENDAR_FEATURES, "weekend_boost_ratio"]
# A change from a zero level is infinite; trees only see that it exceeds every finite change.
INFINITE_CHANGE = 1e300
SEPARATOR = "\x1f"


@dataclass(frozen=True)
class BoostParams:
    """The parameters used where nothing has been tuned."""

    n_estimators: int = 150
    max_depth: int = 6
    learning_rate: float = 0.04406053468266097
    subsample: float = 0.8458975541792212
    colsample_bytree: float = 0.9864080480804699
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 3.3707760847157993e-07
    reg_lambda: float = 1.9781349361493368
    asymmetric_alpha: float = 5.0
    peak_weight_alpha: float = 1.0
    decay_rate: float = 0.95
    rule_decay_rate: float = 0.995
    seed: int = 42

    @classmethod
    def of(cls, values: dict) -> "BoostParams":
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in values.items() if k in known and v is not None})

    def as_dict(self) -> dict:
        return asdict(self)


def app_statistics(matrix: DataFrame) -> DataFrame:
    """Per app: mean level and how much weekends rise above weekdays (at least 0)."""
    weekend = F.avg(F.when(F.col("is_weekend") == 1, F.col("mean_concurrent")))
    weekday = F.avg(F.when(F.col("is_weekend") != 1, F.col("mean_concurrent")))
    return matrix.groupBy("app_id").agg(
        F.avg("mean_concurrent").alias("app_level"),
        weekend.alias("weekend_mean"),
        weekday.alias("weekday_mean"),
        F.greatest(weekend / (weekday + EPSILON) - 1.0, F.lit(0.0)).alias("natural_boost"),
    )


def weekend_weight(peak_weight_alpha: float) -> Column:
    return F.when(F.col("is_weekend") == 1, 1.0 + F.lit(peak_weight_alpha) * F.col("natural_boost")).otherwise(1.0)


def feature_array(rule_names: list[str]) -> Column:
    """All features as an array; needs the column ``app_level``."""
    scale = F.coalesce(F.nullif(F.col("app_level"), F.lit(0.0)), F.lit(1.0))
    fixed = [
        (F.col(c) / scale if c in LEVEL_FEATURES else F.col(c).cast("double")) for c in FEATURES
    ]
    at = FEATURES.index("pct_change")
    fixed[at] = F.when(fixed[at] == F.lit(float("inf")), F.lit(INFINITE_CHANGE)).otherwise(fixed[at])
    bounded = F.array(*fixed)
    if not rule_names:
        return bounded
    names = F.split(F.lit(SEPARATOR.join(rule_names)), SEPARATOR)
    rules = F.transform(names, lambda n: F.coalesce(F.try_element_at("rule_lifts", n), F.lit(0.0)))
    return F.concat(bounded, rules)


@dataclass
class CapacityModel:
    """A fitted pool model with the per-app values its use needs."""

    ensemble: GBTRegressionModel
    base: float
    rule_names: list[str]
    apps: DataFrame
    params: BoostParams
    samples: int
    _vector: Column | None = None

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``prediction``, the expected log-ratio; ``rows`` must hold ``app_level``."""
        if self._vector is None:
            self._vector = array_to_vector(feature_array(self.rule_names))
        vectors = rows.withColumn("features", self._vector)
        scored = self.ensemble.transform(vectors).drop("features")
        return scored.withColumn("prediction", F.col("prediction") + F.lit(self.base))

    def predict_matrix(self, matrix: DataFrame) -> DataFrame:
        return self.predict(matrix.join(self.apps.select("app_id", "app_level"), "app_id"))


def _ensemble(trees: list, weights: list[float], n_features: int) -> GBTRegressionModel:
    """The trees as one Spark ML model, so that a prediction is one expression."""
    gateway = SparkContext._active_spark_context._gateway
    regression = gateway.jvm.org.apache.spark.ml.regression
    tree_array = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    weight_array = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        tree_array[i] = tree._java_obj
        weight_array[i] = float(weight)
    return GBTRegressionModel(
        regression.GBTRegressionModel("capacity_trees", tree_array, weight_array, n_features)
    )


def _sampled_features(x: Column, share: float, size: int, rng: random.Random) -> Column:
    """Features outside this tree's sample become constant, which no split can use."""
    kept = set(rng.sample(range(size), max(1, round(share * size))))
    if len(kept) == size:
        return x
    mask = F.expr(f"array({', '.join('1D' if i in kept else '0D' for i in range(size))})")
    return F.zip_with(x, mask, lambda value, use: value * use)


def _boost(rows: DataFrame, params: BoostParams, size: int, total_weight: float) -> tuple[list, list[float]]:
    rng = random.Random(params.seed)
    trees = []
    for round_no in range(params.n_estimators):
        fitted = rows.withColumn("residual", F.col("target_y") - F.col("fitted")).withColumn(
            "weight",
            F.col("row_weight") * F.when(F.col("fitted") < F.col("target_y"), params.asymmetric_alpha).otherwise(1.0),
        )
        if params.subsample < 1.0:
            draw = F.pmod(F.xxhash64("app_id", "date", F.lit(params.seed * 100003 + round_no)), F.lit(1000000))
            drawn = fitted.filter(draw < F.lit(int(params.subsample * 1000000)))
        else:
            drawn = fitted
        tree = DecisionTreeRegressor(
            featuresCol="features", labelCol="residual", weightCol="weight", predictionCol="step",
            maxDepth=params.max_depth, seed=params.seed,
            minWeightFractionPerNode=min(0.49, params.min_child_weight / max(total_weight, 1.0)),
            minInfoGain=2.0 * params.gamma / max(total_weight, 1.0),
        ).fit(drawn.withColumn("features", array_to_vector(_sampled_features(F.col("x"), params.colsample_bytree, size, rng))))
        trees.append(tree)
        # Constant features are never split on, so the tree applies to the full vector as well.
        stepped = tree.transform(rows.withColumn("features", array_to_vector("x"))).drop("features")
        rows = stepped.withColumn("fitted", F.col("fitted") + params.learning_rate * F.col("step")).drop("step")
        if (round_no + 1) % CUT_EVERY == 0 and round_no + 1 < params.n_estimators:
            rows = cut_lineage(rows)
    return trees, [params.learning_rate] * len(trees)


def fit(matrix: DataFrame, params: BoostParams = BoostParams(), capacity_mode: bool = True) -> CapacityModel | None:
    """Fits the pool of all apps in ``matrix``; ``None`` when it has no rows."""
    matrix = cut_lineage(matrix)
    rule_names = rule_feature_names(matrix)
    apps = app_statistics(matrix)
    size = len(FEATURES) + len(rule_names)
    rows = cut_lineage(
        matrix.join(apps, "app_id").select(
            "app_id", "date", "target_y",
            weekend_weight(params.peak_weight_alpha).alias("row_weight"),
            feature_array(rule_names).alias("x"),
        )
    )
    totals = rows.agg(
        F.count("*").alias("n"), F.avg("target_y").alias("mean"), F.sum("row_weight").alias("weight")
    ).first()
    if totals["n"] == 0:
        return None
    if capacity_mode:
        base = float(totals["mean"])
        start = rows.withColumn("fitted", F.lit(base))
        trees, weights = _boost(start, params, size, float(totals["weight"]))
        ensemble = _ensemble(trees, weights, size)
    else:
        base = 0.0
        ensemble = GBTRegressor(
            featuresCol="features", labelCol="target_y", weightCol="row_weight", maxIter=params.n_estimators,
            maxDepth=params.max_depth, stepSize=params.learning_rate, subsamplingRate=params.subsample,
            seed=params.seed,
        ).fit(rows.withColumn("features", array_to_vector("x")))
    model = CapacityModel(ensemble, base, rule_names, apps, params, int(totals["n"]))
    spread = model.predict_matrix(matrix).groupBy("app_id").agg(
        F.var_pop(F.col("target_y") - F.col("prediction")).alias("residual_var")
    )
    model.apps = cut_lineage(apps.join(spread, "app_id"))
    return model
