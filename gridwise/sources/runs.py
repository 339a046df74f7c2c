"""Artefacts of evaluation runs: tables under one folder, each row with its run, joined into one report row a run.

A run may lack any of them: logged metrics (run, name, value), scores by output
(run, parcel, r), scores by subject (run, subject, r) and settings
(run, run_name, reference, tolerance).
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.functions.num import finite
from gridwise.operators.metrics import TOLERANCE, acceptance, report_columns

ARTEFACTS = {
    "metrics": "run string, name string, value double",
    "parcels": "run string, parcel long, r double",
    "subjects": "run string, subject string, r double",
    "settings": "run string, run_name string, reference double, tolerance double",
}
LOGGED = "val/pearson"


def write_run_artefacts(tables: dict[str, DataFrame], root: str) -> None:
    """Adds tables (a part of ARTEFACTS) to the folder; a run that is written again replaces its own rows of that table."""
    if unknown := sorted(set(tables) - set(ARTEFACTS)):
        raise ValueError(f"unknown artefacts: {unknown}")
    for name, df in tables.items():
        columns = [c.split()[0] for c in ARTEFACTS[name].split(", ")]
        df.select(columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{root}/{name}")


def read_run_artefacts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of ARTEFACTS; one that no run has is empty."""
    out = {}
    for name, schema in ARTEFACTS.items():
        empty = spark.createDataFrame([], schema)
        try:
            out[name] = spark.read.schema(empty.schema).parquet(f"{root}/{name}").select(empty.columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = empty
    return out


def runs_report(tables: dict[str, DataFrame], reference: float | None = None, tolerance: float | None = None) -> DataFrame:
    """One row for each run that any table names.

    Mean, median, 10 and 90 percentiles of the finite scores by output and their count above zero; without such scores the mean is the
    metric ``LOGGED`` and the count -1. subject_mean and per_subject (a map) by subject, metrics (a map), and the gap to the reference
    with its verdict. The reference and the tolerance given stand before a run's settings; NULL where neither is there (SKIPPED).
    A repeated name or subject of a run has its largest value.
    """
    largest = lambda df, key, value: df.groupBy("run", key).agg(F.max(value).alias(value))
    named = {
        "parcels": tables["parcels"].select("run", "r"),
        "subjects": largest(tables["subjects"], "subject", "r").select("run", F.col("subject"), F.col("r").alias("subject_r")),
        "metrics": largest(tables["metrics"], "name", "value").select("run", "name", "value"),
        "settings": tables["settings"].select("run", "run_name", "reference", "tolerance"),
    }
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), named.values())  # one shuffle by run
    as_map = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(key, value)))))
    each = rows.groupBy("run").agg(
        *report_columns("r"), F.count(finite(F.col("r"))).alias("__n"), F.round(F.avg("subject_r"), 4).alias("subject_mean"), as_map("subject", F.round("subject_r", 4).alias("r")).alias("per_subject"),
        as_map("name", "value").alias("metrics"), F.max("run_name").alias("run_name"), F.max("reference").alias("__reference"), F.max("tolerance").alias("__tolerance"),
    )
    has = F.col("__n") > 0
    told = each.withColumns(
        {
            "mean": F.when(has, F.col("mean")).otherwise(F.round(F.try_element_at("metrics", F.lit(LOGGED)), 4)),
            "n_positive": F.when(has, F.col("n_positive")).otherwise(F.lit(-1)),
            "reference": F.coalesce(F.lit(reference).cast("double"), "__reference"),
            "tolerance": F.coalesce(F.lit(tolerance).cast("double"), "__tolerance", F.lit(TOLERANCE)),
        }
    )
    return acceptance(told, F.col("reference"), F.col("tolerance")).drop("__n", "__reference", "__tolerance")
