"""Model artifact: one parquet row with weights, configuration and version."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from structpeak.config import PeakConfig
from structpeak.operators.model import Denoiser

MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
VECTOR = T.ArrayType(T.DoubleType())
ARTIFACT_SCHEMA = T.StructType([
    T.StructField("version", T.StringType(), False),
    T.StructField("config", T.StringType(), False),
    T.StructField("encode", MATRIX, False),
    T.StructField("decode", MATRIX, False),
    T.StructField("center", VECTOR, False),
    T.StructField("width", VECTOR, False),
    T.StructField("kappa", T.DoubleType(), False),
])


def save_model(spark: SparkSession, model: Denoiser, path: str) -> None:
    row = (
        model.version, json.dumps(model.config.to_dict()), model.encode.tolist(), model.decode.tolist(),
        model.center.tolist(), model.width.tolist(), float(model.kappa),
    )
    spark.createDataFrame([row], ARTIFACT_SCHEMA).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Denoiser:
    """Read a stored model; configuration entries of other versions are ignored."""
    row = spark.read.schema(ARTIFACT_SCHEMA).parquet(path).head()
    return Denoiser(
        PeakConfig.from_dict(json.loads(row["config"])), np.array(row["encode"]), np.array(row["decode"]),
        row["version"], np.array(row["center"]), np.array(row["width"]), row["kappa"],
    )
