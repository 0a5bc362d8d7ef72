"""Incremental ingest: each micro-batch keeps what no earlier one has shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textloom.functions import text as T
from textloom.operators.dedup import exact_survivors


def ingest(spark: SparkSession, source: str, schema: StructType, out: str, signatures: str, checkpoint: str, id_col: str = "id") -> StreamingQuery:
    """Reads new JSON files under ``source``, drops texts whose signature is known, appends the rest to ``out``.

    Within a batch the longest text of a signature stays. A batch writes under its own number, so one that is run again
    after a failure overwrites what it wrote, and reads only the signatures of earlier batches.
    """

    def step(batch: DataFrame, number: int) -> None:
        sig = T.signature_view(F.col("text"))
        best = exact_survivors(batch, sig, id_col)
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(signatures)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            known = spark.read.schema("sig string, batch long").parquet(signatures).where(F.col("batch") < number).select("sig")
            best = best.join(known, "sig", "left_anti")
        best = best.persist()
        kept = batch.join(best.select(id_col), id_col, "left_semi")
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")
        best.select("sig").write.mode("overwrite").parquet(f"{signatures}/batch={number}")
        best.unpersist()

    reader = spark.readStream.schema(schema).json(source)
    return reader.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
