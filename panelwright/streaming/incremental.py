"""Resumable processing: what is done is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import first_per_key


def not_done(items: DataFrame, ledger: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Items whose key the ledger lacks, or has under another version only."""
    own = ledger if version is None else ledger.where(F.col("version") == version)
    return items.join(own.select(*keys).distinct(), keys, "left_anti")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger at a path, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def append_batch(out: DataFrame, done: DataFrame, out_path: str, ledger_path: str) -> None:
    """Append results, then the keys that were handled, with or without results; a crash between them only repeats work."""
    out.write.mode("append").parquet(out_path)
    done.write.mode("append").parquet(ledger_path)


def process_new_files(
    spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str, keys: list[str]
) -> int:
    """Handle the files that a folder has gained since the last call, once each; returns the number of batches.

    A batch is written under its number, so that a repeated batch replaces itself. Of the rows
    of a batch that share their keys the one with the least content stays, wherever it runs.
    """
    batches = []

    def write(df: DataFrame, batch: int) -> None:
        batches.append(batch)
        rows = transform(df)
        first_per_key(rows, keys, F.asc(F.to_json(F.struct(*rows.columns)))).write.mode("overwrite").parquet(f"{out_path}/batch={batch}")

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)


def outcome(df: DataFrame, risky: Column, name: str, given: Column | None = None) -> DataFrame:
    """A column that may fail row by row, with a status beside it: ok; failed, and a null value; or empty, where ``given`` was null already."""
    status = F.when(F.col(name).isNotNull(), "ok").otherwise("failed")
    if given is not None:
        status = F.when(F.col("_given"), status).otherwise("empty")
        df = df.withColumn("_given", given.isNotNull())
    return df.withColumn(name, risky).withColumn("status", status).drop("_given")
