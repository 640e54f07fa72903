"""JDBC source and sink through Spark's own connector.

Connection details come from the caller or the environment, never from literals.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SECRET_NAMES = ("url", "user", "password")


@dataclass(frozen=True)
class JdbcTarget:
    url: str
    driver: str
    user: str = ""
    password: str = field(default="", repr=False)

    def options(self, table: str) -> dict[str, str]:
        out = {"url": self.url, "dbtable": table, "driver": self.driver}
        if self.user:
            out |= {"user": self.user, "password": self.password}
        return out


def target_from_secrets(prefix: str, driver: str, lookup: Mapping[str, str] | None = None) -> JdbcTarget:
    """Target whose ``{PREFIX}_URL``, ``_USER`` and ``_PASSWORD`` are looked up (default: environment)."""
    source = os.environ if lookup is None else lookup
    found = {n: source.get(f"{prefix}_{n}".upper()) for n in SECRET_NAMES}
    if not found["url"]:
        raise KeyError(f"{prefix.upper()}_URL is not set")
    return JdbcTarget(found["url"], driver, found["user"] or "", found["password"] or "")


def partition_options(column: str, lower: object, upper: object, partitions: int) -> dict[str, str]:
    """Options that split a read into ranges of one column."""
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}


def read_table(spark: SparkSession, target: JdbcTarget, table: str, **split: str) -> DataFrame:
    """Table as a DataFrame; pass :func:`partition_options` for a parallel read."""
    return spark.read.format("jdbc").options(**target.options(table), **split).load()


def write_table(df: DataFrame, target: JdbcTarget, table: str, mode: str = "overwrite", batch: int = 10_000,
                connections: int = 16) -> None:
    """Write to a table; overwriting truncates, so the table's own definition stays."""
    options = target.options(table) | {"truncate": "true", "batchsize": str(batch), "numPartitions": str(connections)}
    df.write.format("jdbc").options(**options).mode(mode).save()
