"""Tuned parameters as JSON text and as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.boosting import BoostParams

# Parameter names stored under "xgb_params", and those stored under "decay_params".
TREE_PARAMS = [
    "n_estimators", "max_depth", "learning_rate", "min_child_weight", "subsample", "colsample_bytree",
    "gamma", "reg_alpha", "reg_lambda", "asymmetric_alpha",
]
DECAY_PARAMS = ["decay_rate", "rule_decay_rate"]
_DOUBLES = "map<string,double>"


def to_json_text(params: BoostParams) -> str:
    values = params.as_dict()
    return json.dumps({
        "xgb_params": {k: values[k] for k in TREE_PARAMS},
        "decay_params": {k: values[k] for k in DECAY_PARAMS},
        "peak_weight_alpha": values["peak_weight_alpha"],
    })


def from_json_text(text: str | None) -> BoostParams:
    """Parameters from stored text; the older flat form holds tree parameters only."""
    if not text:
        return BoostParams()
    stored = json.loads(text)
    if "xgb_params" in stored and "decay_params" in stored:
        flat = {**stored["xgb_params"], **stored["decay_params"]}
        flat["peak_weight_alpha"] = stored.get("peak_weight_alpha", 1.0)
    else:
        flat = stored
    for whole in ("n_estimators", "max_depth"):
        if whole in flat:
            flat[whole] = int(flat[whole])
    return BoostParams.of(flat)


def normalised(text: Column) -> Column:
    """Stored JSON text to ``struct<xgb_params, decay_params, peak_weight_alpha>``.

    A flat object becomes the tree parameters with default decay; values that are no numbers,
    such as an objective, are left out.
    """
    nested = F.from_json(text, f"xgb_params {_DOUBLES}, decay_params {_DOUBLES}, peak_weight_alpha double")
    numbers = F.transform_values(
        F.map_filter(F.from_json(text, "map<string,string>"), lambda _k, v: v.try_cast("double").isNotNull()),
        lambda _k, v: v.try_cast("double"),
    )
    default_decay = F.create_map(
        F.lit("decay_rate"), F.lit(0.95), F.lit("rule_decay_rate"), F.lit(0.995)
    )
    is_nested = F.get_json_object(text, "$.xgb_params").isNotNull() & F.get_json_object(text, "$.decay_params").isNotNull()
    return F.struct(
        F.when(is_nested, nested["xgb_params"]).otherwise(numbers).alias("xgb_params"),
        F.when(is_nested, nested["decay_params"]).otherwise(default_decay).alias("decay_params"),
        F.coalesce(F.when(is_nested, nested["peak_weight_alpha"]), F.lit(1.0)).alias("peak_weight_alpha"),
    )
