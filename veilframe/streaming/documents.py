"""De-identification of a stream of documents: documents are independent, so each micro-batch is a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.flow import deidentify


def deidentify_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, profile: str = "broad", style: str = "label") -> StreamingQuery:
    """Parquet files that arrive in ``source`` (doc_id, text) to texts and outcomes under ``sink``.

    A batch writes to a folder of its own number, so a repeated batch overwrites itself: exactly once.
    """
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)

    def batch(docs: DataFrame, number: int) -> None:
        out = deidentify(docs, profile, style)
        released = out["output"].join(out["gate"].where("outcome = 'released'").select("doc_id"), "doc_id", "left_semi")
        released.write.mode("overwrite").parquet(f"{sink}/released/batch={number}")
        out["gate"].where("outcome = 'quarantined'").write.mode("overwrite").json(f"{sink}/quarantined/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
