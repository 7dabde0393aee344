"""A store of measurements as JSON lines: append, list, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.reports import newest

SCHEMA = "id string, instante long, pessoa string, observacao string, bpm double, snrDb double, confianca string, algoritmo string, duracaoS double, origem string"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of JSON texts; broken ones give null fields."""
    return lines.select(F.from_json(column, SCHEMA).alias("r")).select("r.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def append(records: DataFrame, path: str) -> None:
    records.select([x.split()[0] for x in SCHEMA.split(", ")]).write.mode("append").json(path)


def listed(records: DataFrame, most: int = 500) -> DataFrame:
    return newest(records, most, "instante", "id")


def without(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_anti")
