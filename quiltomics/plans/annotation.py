"""State of published cell-type predictions against plan, catalogue and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States after which a dataset needs no further run.
TERMINAL_STATES = ("success", "scientific_failure")


def published_states(plans: DataFrame, catalogue: DataFrame, statuses: DataFrame) -> DataFrame:
    """success, stale, scientific_failure, failure or missing per planned dataset.

    ``plans`` is ``dataset_id, method, parameters, gates, pilot``; ``statuses`` is
    ``dataset_id, status_version, state, category, source_sha256, method, parameters, gates``.
    """
    known = statuses.select(
        "dataset_id",
        "status_version",
        "state",
        "category",
        *[F.col(c).alias(f"_{c}") for c in ("source_sha256", "method", "parameters", "gates")],
    )
    joined = plans.join(catalogue.select("dataset_id", "sha256"), "dataset_id", "left").join(
        known, "dataset_id", "left"
    )
    same = (
        (F.col("_source_sha256") == F.col("sha256"))
        & F.col("_method").eqNullSafe(F.col("method"))
        & F.col("_parameters").eqNullSafe(F.col("parameters"))
        & F.col("_gates").eqNullSafe(F.col("gates"))
    )
    readable = F.col("sha256").isNotNull() & (F.col("status_version") == 1)
    state = (
        F.when(~F.coalesce(readable, F.lit(False)), "missing")
        .when((F.col("state") == "success") & F.coalesce(same, F.lit(False)), "success")
        .when(F.col("state") == "success", "stale")
        .when(
            (F.col("state") == "failure")
            & (F.col("category") == "scientific_failure")
            & F.coalesce(same, F.lit(False)),
            "scientific_failure",
        )
        .when(F.col("state") == "failure", "failure")
        .otherwise("missing")
    )
    return joined.select("dataset_id", "method", "pilot", state.alias("published_state"))


def audit(states: DataFrame) -> DataFrame:
    """Totals of an audit and whether the pilot gate is open."""
    ready = F.col("published_state").isin(*TERMINAL_STATES)
    return states.agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.count_if(F.col("published_state") == "success").alias("success_count"),
        F.count_if(F.col("published_state") == "scientific_failure").alias("scientific_failure_count"),
        F.count_if(~ready).alias("failure_count"),
        F.coalesce(F.bool_and(ready), F.lit(True)).alias("ok"),
        F.coalesce(F.bool_and(F.when(F.col("pilot"), ready)), F.lit(True)).alias("pilot_ready"),
    )
