"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verification.inputs import Inputs, inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Plain column types for comparison: bigint, double at six places, text, boolean."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str):
    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(build(inputs(spark, sf_dir)))
        return build

    return add
