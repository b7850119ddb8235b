"""Sinks, indexes, databases and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles


def write_by(df: DataFrame, path: str, *partitions: str) -> None:
    """Overwrite only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def unfinished(df: DataFrame, spark: SparkSession, path: str, partition: str) -> DataFrame:
    """The rows of partitions that the sink does not hold yet: a run that was broken off goes on there."""
    try:
        done = spark.read.parquet(path).select(partition).distinct()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return df
    return df.join(done.withColumn(partition, F.col(partition).cast(df.schema[partition].dataType)), partition, "left_anti")


def read_database(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[str, str] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A query of a database over JDBC; filters on the result are pushed down. With a column and bounds it is read in parts."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(parts))
    return reader.load()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def text_lookup(index: DataFrame, texts: DataFrame, event_id: str = "event_id", year: str = "year") -> DataFrame:
    """The texts of the indexed events only. texts is partitioned by year, so that Spark prunes the
    years that the index does not name while it runs; missing texts are empty."""
    found = index.join(texts, [year, event_id], "left")
    return found.fillna("", [c for c, t in texts.dtypes if t == "string" and c not in (year, event_id)])


def profile(df: DataFrame, key: str, day: str, numbers: list[str], texts: list[str], quantiles: tuple[float, ...] = (0.5, 0.995)) -> DataFrame:
    """One row: rows, distinct keys, first and last day, nulls per column, non-empty shares, quantiles."""
    stats = [F.count("*").alias("n"), F.countDistinct(key).alias(f"distinct_{key}"), F.min(F.to_date(day)).alias("first_day"), F.max(F.to_date(day)).alias("last_day")]
    stats += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (day, *numbers, *texts)]
    stats += [F.avg((F.coalesce(F.length(c), F.lit(0)) > 0).cast("double")).alias(f"filled_{c}") for c in texts]
    row = df.agg(*stats)
    for c in numbers:
        # one row each; a column without a number has none
        found = exact_quantiles(df, [], c, quantiles, "q").agg(F.first("q").alias("q"))
        row = row.join(F.broadcast(found)).withColumns({f"{c}_p{str(q).replace('0.', '')}": F.get("q", F.lit(i)) for i, q in enumerate(quantiles)}).drop("q")
    return row
