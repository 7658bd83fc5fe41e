"""Incremental prediction: the fitted system's ``predict`` over files as they arrive.

The batch job reads a whole application table; here the same transform runs on a
file stream. Every operation of ``CreditSystem.predict`` is row-local (literal
medians, levels, scaler and broadcast model), so the streaming plan is stateless:
no watermark, no state store. Each micro-batch is written through ``foreachBatch``
to a directory named by the batch id, so a replayed batch overwrites its own output
(exactly-once results on a restart from the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from credora.plans.system import CreditSystem


def score_stream(spark: SparkSession, system: CreditSystem, source_dir: str, schema: T.StructType,
                 out_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                 max_files_per_trigger: int = 100):
    """Start the stream; returns the StreamingQuery (``trigger(availableNow=True)``
    processes what is there and stops)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .format(fmt).load(source_dir))
    scored = system.predict(stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")

    return (scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
