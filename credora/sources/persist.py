"""Persistence of fitted systems: Spark ML writers for models, a one-line JSON text
table for the parameters (medians, levels, frozen features, scaler, flags). Both go
through Spark's file system layer, so the path may be any shared store."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
