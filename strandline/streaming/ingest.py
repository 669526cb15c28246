"""Lines loaded as files arrive: good rows to one table, bad ones with their reason to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.operators.lines import parse_lines


def load_lines(spark: SparkSession, source: str, good: str, bad: str, state: str) -> None:
    """Take all files of ``source`` that were not taken before, then stop.

    The operator is the batch one. A batch that is repeated after a failure overwrites its own directory, so rows are
    written once.
    """

    def write(df: DataFrame, batch: int) -> None:
        parsed = parse_lines(df).persist()
        parsed.where("ok").drop("ok", "reason").write.mode("overwrite").parquet(f"{good}/batch={batch}")
        parsed.where("NOT ok").select("line_no", "reason").write.mode("overwrite").parquet(f"{bad}/batch={batch}")
        parsed.unpersist()

    lines = spark.readStream.schema("line_no bigint, line string").parquet(source)
    lines.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
